"""Registered queries: vector search, analogies, word and contextual similarity."""

from pyspark.sql import functions as F

from lorelink.functions.vectors import cosine, l2_normalize
from lorelink.operators import search as S
from lorelink.operators import similarity as Y
from lorelink.plans.oracle import cosine_sql, r6, with_tables
from lorelink.plans.queries_names import six
from lorelink.plans.tables import DIM, Tables
from lorelink.session import cut_lineage


def neighbours_in_order(t: Tables):
    """Each vector with the next three by id."""
    left = t.embeddings.select(F.col("vec_id").alias("a"), F.col("vec").alias("_a"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("_j"))
    right = t.embeddings.select(F.col("vec_id").alias("b"), F.col("vec").alias("_b"))
    return left.withColumn("b", F.col("a") + F.col("_j")).join(right, "b").select("a", "b", six(cosine("_a", "_b")).alias("sim"))


def scaled(t: Tables):
    shaped = t.embeddings.select("vec_id", F.transform("vec", lambda x: x * (F.col("vec_id") % 4)).alias("vec"))
    unit = shaped.select("vec_id", l2_normalize(F.col("vec")).alias("vec"))
    return unit.select("vec_id", six(F.get("vec", F.lit(0))).alias("first"), six(F.element_at("vec", -1)).alias("last"))


def nearest_all(t: Tables):
    rows = t.embeddings
    found = S.nearest(rows.select(F.col("vec_id").alias("query"), "vec"), rows.select(F.col("vec_id").alias("item"), "vec"))
    return found.select("query", "item", six("sim").alias("sim"), "rank")


def used_senses(t: Tables):
    return t.sense_vectors.join(t.entity_ranks.select("entity_id", "place"), "entity_id").select(
        F.col("entity_id").alias("sense_key"), "title", F.lit("kb").alias("sense_kind"), "vec", "mu", (F.col("place") % 3).alias("cluster_size")
    )


def nearest_used(t: Tables):
    queries = t.embeddings.select(F.col("vec_id").alias("query"), "vec")
    return S.nearest_senses(queries, used_senses(t), 5).select("query", "item", six("sim").alias("sim"), "rank")


def name_senses(t: Tables):
    names = t.priors.filter("n >= 4").select(F.col("mention").alias("title")).distinct()
    return S.senses_of_name(names, used_senses(t)).select("title", "sense_kind", "sense_key", six(F.get("vec", F.lit(0))).alias("first"))


def spelled(t: Tables):
    """Two spellings per item that differ in case, with different counts."""
    letter = F.when(F.col("vec_id") % 2 == 0, "w").otherwise("W")
    return t.embeddings.select(
        F.concat(letter, F.floor(F.col("vec_id") / 2).cast("string")).alias("item"), (F.col("vec_id") * 7919 % 1009 + 1).alias("cn"), "vec"
    )


def questions(t: Tables):
    """One question per item; the last ones ask for words outside the vocabulary."""
    first = t.embeddings.filter("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("question_id"))
    word = lambda k: F.concat(F.lit("w"), (F.col("question_id") + k).cast("string"))
    section = (F.col("question_id") % 14 + 1).alias("section_no")
    return first.select("question_id", word(0).alias("a"), word(1).alias("b"), word(2).alias("c"), word(5).alias("d"), section).withColumn(
        "section", F.concat(F.lit("s"), F.col("section_no").cast("string"))
    )


def analogies(t: Tables):
    return S.analogy(questions(t), spelled(t))


def analogy_report(t: Tables):
    return S.analogy_accuracy(analogies(t), questions(t)).withColumn("accuracy", six("accuracy"))


def centres(t: Tables):
    """Label centre nearest to each vector among labels of the same parity."""
    contexts = t.embeddings.select("vec_id", "vec", (F.col("label") % 2).alias("side"))
    means = t.label_means.select(F.col("label").alias("sense_key"), "mu", (F.col("label") % 2).alias("side"))
    found = S.nearest_sense_centre(contexts, means, ["vec_id"], ["side"])
    return found.select("vec_id", "sense_key", six("sim").alias("sim"))


def word_pairs(t: Tables):
    """Each word with the one seven ranks later; only the first words have vectors."""
    ids = t.vocab.filter("item_id > 0").select("item_id", "item")
    later = ids.select((F.col("item_id") - 7).alias("item_id"), F.col("item").alias("w2"))
    return ids.join(later, "item_id").select(F.col("item_id").alias("pair_id"), F.col("item").alias("w1"), "w2")


def names_of_titles(t: Tables):
    return t.priors.join(t.titles, "entity_id").select("mention", "title")


def keyed_senses(t: Tables):
    return t.sense_vectors.select("title", F.col("title").alias("sense_key"), "vec", "mu")


def word_sims(t: Tables):
    vectors = t.word_vectors.withColumnRenamed("word", "item")
    rows = Y.word_similarity(word_pairs(t), vectors, names_of_titles(t), keyed_senses(t))
    return rows.select("pair_id", "w1", "w2", six("glb").alias("glb"), six("avg_sim").alias("avg_sim"), six("max_sim").alias("max_sim"))


def marked_lines(t: Tables):
    """Lines with their first name marked, in pairs of neighbouring lines."""
    known = t.word_vectors.select(F.col("word").alias("token")).join(t.name_entity.select(F.col("mention").alias("token")), "token")
    hits = t.tokens.join(known, "token").groupBy("doc_id", "sent_id").agg(F.min("pos").alias("_at"))
    lines = t.tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_l"))
    words = F.transform("_l", lambda x: F.when(x["pos"] == F.col("_at"), F.concat(F.lit("<b> "), x["token"], F.lit(" </b>"))).otherwise(x["token"]))
    return lines.join(hits, ["doc_id", "sent_id"]).select(
        F.concat_ws("-", "doc_id", F.floor(F.col("sent_id") / 2)).alias("pair"), (F.col("sent_id") % 2).alias("side"), F.array_join(words, " ").alias("text")
    )


def contextual(t: Tables):
    vectors = t.word_vectors.withColumnRenamed("word", "item")
    marked = Y.marked_context(marked_lines(t), "text", ["pair", "side"])
    weights = Y.sense_weights(Y.target_contexts(marked, vectors, ["pair", "side"], DIM), names_of_titles(t), keyed_senses(t), ["pair", "side"])
    weights = cut_lineage(weights)
    rows = Y.contextual_similarity(weights.filter("side = 0"), weights.filter("side = 1"), "pair")
    return rows.select("pair", six("avg_sim_c").alias("avg_sim_c"), six("max_sim_c").alias("max_sim_c"), "senses")


SPELLED = """
  sp AS (SELECT item, max(cn) AS cn, arg_max(vec, cn) AS vec FROM (
    SELECT 'W' || CAST(vec_id // 2 AS VARCHAR) AS item, vec_id * 7919 % 1009 + 1 AS cn, vec FROM emb) GROUP BY item),
  un AS (SELECT item, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM sp),
  qs AS (SELECT question_id, question_id % 14 + 1 AS section_no, 'W' || question_id AS a, 'W' || (question_id + 1) AS b, 'W' || (question_id + 2) AS c, 'W' || (question_id + 5) AS d
    FROM (SELECT vec_id // 2 AS question_id FROM emb WHERE vec_id % 2 = 0)),
  aim AS (SELECT q.*, list_transform(range(1, 65), lambda i: vb.vec[i] - va.vec[i] + vc.vec[i]) AS vec FROM qs q
    JOIN un va ON va.item = q.a JOIN un vb ON vb.item = q.b JOIN un vc ON vc.item = q.c JOIN un vd ON vd.item = q.d),
  hit AS (SELECT q.question_id, u.item, round(list_dot_product(q.vec, u.vec), 6) AS sim FROM aim q JOIN un u ON u.item NOT IN (q.a, q.b, q.c)),
  ans AS (SELECT q.question_id, q.a, q.b, q.c, q.d, h.item AS answer, h.sim FROM aim q LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, item) AS r FROM hit WHERE sim > 0) h ON h.question_id = q.question_id AND h.r = 1)"""

SENSES = """
  nt AS (SELECT mention, title FROM priors JOIN titles USING (entity_id))"""

QUERIES = {
    "cosine_pairs": (neighbours_in_order, f"""
        SELECT a.vec_id AS a, b.vec_id AS b, {r6(cosine_sql('a.vec', 'b.vec'))} AS sim FROM emb a JOIN emb b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3"""),
    "l2_normalize": (scaled, f"""
        SELECT vec_id, {r6('CASE WHEN k = 0 THEN 0 ELSE vec[1] * k / n END')} AS first, {r6('CASE WHEN k = 0 THEN 0 ELSE vec[64] * k / n END')} AS last
        FROM (SELECT vec_id, vec, vec_id % 4 AS k, sqrt(list_dot_product(vec, vec)) * (vec_id % 4) AS n FROM emb)"""),
    "nearest": (nearest_all, f"""
        WITH s AS (SELECT q.vec_id AS query, v.vec_id AS item, round({cosine_sql('q.vec', 'v.vec')}, 6) AS sim FROM emb q, emb v),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM s WHERE sim > -1)
        SELECT query, item, {r6('sim')} AS sim, rank FROM r WHERE rank <= 40"""),
    "nearest_senses": (nearest_used, f"""
        WITH u AS (SELECT s.entity_id AS item, s.vec FROM sense_vectors s JOIN entity_ranks k USING (entity_id) WHERE k.place % 3 > 0),
        s AS (SELECT q.vec_id AS query, u.item, round({cosine_sql('q.vec', 'u.vec')}, 6) AS sim FROM emb q, u),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM s WHERE sim > -1)
        SELECT query, item, {r6('sim')} AS sim, rank FROM r WHERE rank <= 5"""),
    "senses_of_name": (name_senses, f"""
        SELECT title, 'kb' AS sense_kind, entity_id AS sense_key, {r6('vec[1]')} AS first FROM sense_vectors WHERE title IN (SELECT mention FROM priors WHERE n >= 4)"""),
    "analogy": (
        lambda t: analogies(t).select("question_id", "answer", six("sim").alias("sim")),
        "WITH " + SPELLED + f" SELECT question_id, answer, {r6('sim')} AS sim FROM ans"),
    "analogy_accuracy": (analogy_report, "WITH " + SPELLED + f""",
        j AS (SELECT CASE WHEN q.section_no <= 5 THEN 'semantic' ELSE 'syntactic' END AS kind, 's' || q.section_no AS section,
          coalesce(a.answer = a.d, false) AS ok, a.question_id AS seen FROM qs q LEFT JOIN ans a USING (question_id))
        SELECT kind, section, CAST(count_if(ok) AS BIGINT) AS correct, count(seen) AS seen, count(*) AS questions,
          {r6('count_if(ok) / nullif(count(seen), 0)')} AS accuracy FROM j GROUP BY ROLLUP (kind, section)"""),
    "sense_centre": (centres, f"""
        WITH s AS (SELECT e.vec_id, m.label AS sense_key, round({cosine_sql('e.vec', 'm.mu')}, 6) AS sim FROM emb e JOIN label_means m ON m.label % 2 = e.label % 2)
        SELECT vec_id, sense_key, {r6('sim')} AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, sense_key) AS r FROM s) WHERE r = 1"""),
    "word_similarity": (word_sims, "WITH " + SENSES + f""",
        p AS (SELECT a.item_id AS pair_id, a.item AS w1, b.item AS w2 FROM vocab a JOIN vocab b ON b.item_id = a.item_id + 7 WHERE a.item_id > 0),
        v AS (SELECT word, '' AS sense, vec FROM word_vectors UNION ALL
          SELECT w.word, n.title, s.vec FROM word_vectors w JOIN nt n ON n.mention = w.word JOIN sense_vectors s ON s.title = n.title),
        s AS (SELECT p.pair_id, a.sense AS s1, b.sense AS s2, {cosine_sql('a.vec', 'b.vec')} AS sim FROM p JOIN v a ON a.word = p.w1 JOIN v b ON b.word = p.w2)
        SELECT p.pair_id, p.w1, p.w2, {r6("coalesce(max(CASE WHEN s1 = '' AND s2 = '' THEN sim END), 0)")} AS glb, {r6('coalesce(avg(sim), 0)')} AS avg_sim,
          {r6('coalesce(max(sim), 0)')} AS max_sim FROM p LEFT JOIN s USING (pair_id) GROUP BY 1, 2, 3"""),
    "contextual_similarity": (contextual, "WITH " + SENSES + f""",
        hits AS (SELECT doc_id, sent_id, min(pos) AS spot FROM tokens WHERE token IN (SELECT word FROM word_vectors) AND token IN (SELECT mention FROM name_entity) GROUP BY 1, 2),
        vw AS (SELECT t.doc_id, t.sent_id, t.pos, h.spot, w.vec FROM tokens t JOIN hits h USING (doc_id, sent_id) JOIN word_vectors w ON w.word = t.token WHERE t.pos <> h.spot),
        nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, pos < spot ORDER BY abs(pos - spot)) AS d FROM vw),
        ctx AS (SELECT doc_id, sent_id, list(m ORDER BY i) AS vec FROM (
          SELECT doc_id, sent_id, i, avg(vec[i]) AS m FROM (SELECT doc_id, sent_id, vec, unnest(range(1, 65)) AS i FROM nr WHERE d <= 5) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        raw AS (SELECT c.doc_id, c.sent_id, n.title AS sense, s.vec, {cosine_sql('c.vec', 's.mu')} AS w FROM ctx c JOIN hits h USING (doc_id, sent_id)
          JOIN tokens t ON t.doc_id = h.doc_id AND t.sent_id = h.sent_id AND t.pos = h.spot JOIN nt n ON n.mention = t.token JOIN sense_vectors s ON s.title = n.title),
        ws AS (SELECT doc_id || '-' || (sent_id // 2) AS pair, sent_id % 2 AS side, sense, vec,
          w / CASE WHEN sum(w) OVER (PARTITION BY doc_id, sent_id) = 0 THEN 1e-6 ELSE sum(w) OVER (PARTITION BY doc_id, sent_id) END AS w FROM raw),
        pr AS (SELECT a.pair, a.w AS w1, b.w AS w2, {cosine_sql('a.vec', 'b.vec')} AS sim,
          row_number() OVER (PARTITION BY a.pair ORDER BY round(a.w, 6) DESC, a.sense, round(b.w, 6) DESC, b.sense) AS r FROM ws a JOIN ws b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)
        SELECT pr.pair, {r6('sum(w1 * w2 * sim)')} AS avg_sim_c, {r6('max(CASE WHEN r = 1 THEN sim END)')} AS max_sim_c, any_value(c.n) AS senses
        FROM pr JOIN (SELECT pair, count(*) AS n FROM ws GROUP BY pair) c USING (pair) GROUP BY pr.pair"""),
}

QUERIES = {name: (run, with_tables(sql) if sql else None) for name, (run, sql) in QUERIES.items()}
