"""Registered queries: vocabularies, sampling tables and training pairs."""

from pyspark.sql import functions as F

from lorelink.functions.hashing import portable_uniform
from lorelink.operators import features as FE
from lorelink.operators import pairs as P
from lorelink.operators import vocab as V
from lorelink.plans.oracle import alias_sql, drawn_sql, r6, uniform_sql, with_tables
from lorelink.plans.queries_names import six
from lorelink.plans.tables import DIM, Tables

SAMPLE, WINDOW, SEED = 1e-3, 5, 17
LINE = ["doc_id", "sent_id"]


def encoded(t: Tables):
    return V.encode_tokens(t.tokens, V.keep_probability(t.vocab, SAMPLE))


def kept(t: Tables):
    return V.subsample_tokens(encoded(t), SEED, [*LINE, "pos"], portable_uniform)


def sentence_rows(t: Tables, span: str | None = None, source=None):
    return P.sentences(kept(t) if source is None else source, LINE, span=span)


def sentence_sizes(t: Tables):
    return sentence_rows(t).select(*LINE, "chunk", F.size("items").cast("long").alias("n"), F.element_at("items.item", 1).alias("first"))


def skipgrams(t: Tables):
    pairs = P.skipgram_pairs(sentence_rows(t), LINE, WINDOW, SEED, portable_uniform)
    return pairs.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def spans(t: Tables):
    """Name tokens as one-word spans with their entity."""
    named = t.name_entity.select(F.col("mention").alias("token"), F.col("title").alias("entity"))
    return named


def span_contexts(t: Tables, window: int = WINDOW):
    """Contexts of name tokens among the in-vocabulary words of their line."""
    marked = V.encode_tokens(t.tokens, t.vocab).join(
        spans(t).select("token", F.lit(1).alias("_named")), "token", "left"
    ).withColumn("span_id", F.when(F.col("_named") == 1, F.col("pos")))
    rows = P.sentences(marked, LINE, span="span_id")
    return P.anchor_contexts(rows, LINE, window)


def with_entities(t: Tables, window: int = WINDOW):
    places = V.encode_tokens(t.tokens, t.vocab).join(spans(t), "token").select(*LINE, F.col("pos").alias("span_id"), "entity")
    return P.with_entity(span_contexts(t, window), places, LINE, t.entity_vocab.filter("item_id > 0").select(F.col("item").alias("entity")))


def counted(pairs):
    return pairs.groupBy("input", "output").agg(F.count(F.lit(1)).alias("n"))


def context_sums(t: Tables):
    """Size of the mean context vector of every name in the documents, by component sums."""
    means = FE.mention_contexts(t.doc_words, t.mentions, t.word_vectors, DIM, WINDOW)
    return means.select(
        "doc_id", "mention_id", six(F.get("ctx", F.lit(0))).alias("first"), six(F.element_at("ctx", -1)).alias("last")
    )


def negatives(t: Tables):
    """Five draws per outlink pair."""
    spread = V.negative_distribution(t.entity_vocab)
    pairs = P.neighbour_pairs(t.links, t.entity_vocab).withColumnRenamed("output", "positive")
    return V.draw_negatives(pairs, spread, 5, SEED, ["input", "positive"], portable_uniform).select("input", "positive", "draw_no", "negative")


def sampled_words(t: Tables):
    """Word vectors whose word is also a name."""
    names = t.priors.select(F.col("mention").alias("item")).distinct()
    vectors = t.word_vectors.withColumnRenamed("word", "item")
    return V.sample_word_embeddings(vectors, t.vocab, names).select("item", six(F.get("vec", F.lit(0))).alias("first"))


def sampled_senses(t: Tables):
    """Senses named in frequent priors or owning an entity of few links."""
    kb = t.sense_vectors.select("title", F.lit("kb").alias("sense_kind"), F.col("title").alias("sense_key"), "vec")
    nil = t.sense_vectors.select("title", F.lit("nil").alias("sense_kind"), F.concat("title", F.lit("#0")).alias("sense_key"), "vec")
    names = t.priors.filter("n >= 8").select("mention")
    few = t.entity_vocab.filter("item_id > 0 and cn <= 2").select("item")
    return V.sample_sense_embeddings(kb.unionByName(nil), names, few).select("title", "sense_kind", "sense_key")


KEPT = f"""
  total AS (SELECT sum(cn) AS s FROM vocab),
  kp AS (SELECT item_id, item, least(1.0, (sqrt(cn / ({SAMPLE} * s)) + 1) * ({SAMPLE} * s) / cn) AS p FROM vocab, total WHERE item_id > 0),
  kept AS (SELECT doc_id, sent_id, pos, item_id FROM tokens JOIN kp ON item = token WHERE p >= {uniform_sql(SEED, 'doc_id', 'sent_id', 'pos')}),
  numbered AS (SELECT doc_id, sent_id, item_id, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - 1 AS spot FROM kept),
  chunked AS (SELECT doc_id, sent_id, spot // 1000 AS chunk, spot % 1000 AS spot, item_id FROM numbered)"""

SPANS = f"""
  enc AS (SELECT doc_id, sent_id, pos, v.item_id, e.title AS entity FROM tokens t JOIN vocab v ON v.item = t.token AND v.item_id > 0
    LEFT JOIN name_entity e ON e.mention = t.token),
  idx AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - 1 AS spot FROM enc),
  near AS (SELECT s.doc_id, s.sent_id, s.pos AS span_id, s.entity, n.item_id AS word FROM idx s JOIN idx n
    ON s.doc_id = n.doc_id AND s.sent_id = n.sent_id AND s.spot // 1000 = n.spot // 1000 AND n.spot BETWEEN s.spot - {WINDOW} AND s.spot + {WINDOW} AND n.spot <> s.spot
    WHERE s.entity IN (SELECT item FROM entity_vocab))"""

QUERIES = {
    "plain_tokens": (lambda t: t.tokens, "SELECT doc_id, sent_id, pos, token FROM tokens"),
    "word_vocab": (lambda t: t.vocab, "SELECT item_id, item, cn FROM vocab"),
    "vocab_total": (lambda t: V.vocab_total(t.vocab), "SELECT count(*) AS items, CAST(sum(cn) AS BIGINT) AS tokens FROM vocab WHERE item_id > 0"),
    "title_vocab": (
        lambda t: V.title_vocab(V.word_vocab(t.read("part").select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("token")))),
        """SELECT row_number() OVER (ORDER BY count(*) DESC, p_name) AS item_id, p_name AS item, count(*) AS cn FROM part GROUP BY p_name"""),
    "keep_probability": (
        lambda t: V.keep_probability(t.vocab, SAMPLE).select("item", six("keep_p").alias("keep_p")),
        f"""SELECT item, {r6(f'least(1.0, (sqrt(cn / ({SAMPLE} * s)) + 1) * ({SAMPLE} * s) / cn)')} AS keep_p
        FROM vocab, (SELECT sum(cn) AS s FROM vocab)"""),
    "negative_distribution": (
        lambda t: V.cumulative_distribution(V.negative_distribution(t.vocab)).select("item_id", six("p").alias("p"), six("cdf").alias("cdf")),
        f"""SELECT item_id, {r6('w / s')} AS p, {r6('sum(w / s) OVER (ORDER BY item_id)')} AS cdf
        FROM (SELECT item_id, pow(cn, 0.75) AS w, sum(pow(cn, 0.75)) OVER () AS s FROM vocab)"""),
    "alias_table": (
        lambda t: V.alias_table(V.negative_distribution(t.vocab)).select("cell", "own", "other", F.round(F.col("keep") / F.col("full"), 3).alias("share")),
        "WITH " + alias_sql("vocab", "al") + " SELECT cell, own, other, round(keep / total, 3) AS share FROM al"),
    "draw_negatives": (negatives, "WITH " + alias_sql("entity_vocab", "al") + f""",
        pairs AS (SELECT b.item_id AS input, a.item_id AS positive FROM links l JOIN entity_vocab a ON a.item = l.src JOIN entity_vocab b ON b.item = l.dst),
        draws AS (SELECT input, positive, unnest(range(1, 6)) AS k FROM pairs),
        drawn AS (SELECT d.input, d.positive, CAST(k AS INTEGER) AS draw_no, {drawn_sql('al', SEED, ['input', 'positive', 'k'], '(SELECT max(item_id) FROM entity_vocab)')} AS negative
          FROM draws d JOIN al ON al.cell = CAST(floor({uniform_sql(SEED, 'input', 'positive', 'k')} * (SELECT max(n) FROM al)) AS BIGINT))
        SELECT * FROM drawn WHERE negative <> positive"""),
    "subsample_tokens": (
        lambda t: kept(t).select(*LINE, "pos", "item_id"), "WITH " + KEPT + " SELECT doc_id, sent_id, pos, item_id FROM kept"),
    "sentences": (sentence_sizes, "WITH " + KEPT + """
        SELECT doc_id, sent_id, chunk, count(*) AS n, arg_min(item_id, spot) AS first FROM chunked GROUP BY doc_id, sent_id, chunk"""),
    "skipgram_pairs": (skipgrams, "WITH " + KEPT + f""",
        radius AS (SELECT *, CAST(floor({uniform_sql(SEED, 'doc_id', 'sent_id', 'chunk', 'spot')} * {WINDOW}) + 1 AS INTEGER) AS r FROM chunked)
        SELECT c.item_id AS center, n.item_id AS context, count(*) AS n FROM radius c JOIN chunked n
        ON c.doc_id = n.doc_id AND c.sent_id = n.sent_id AND c.chunk = n.chunk AND n.spot BETWEEN c.spot - c.r AND c.spot + c.r AND n.spot <> c.spot GROUP BY 1, 2"""),
    "anchor_contexts": (
        lambda t: with_entities(t).select(*LINE, "span_id", "entity", F.size("context").cast("long").alias("n")),
        "WITH " + SPANS + """
        SELECT s.doc_id, s.sent_id, s.pos AS span_id, s.entity, count(n.word) AS n FROM enc s LEFT JOIN near n
        ON n.doc_id = s.doc_id AND n.sent_id = s.sent_id AND n.span_id = s.pos
        WHERE s.entity IN (SELECT item FROM entity_vocab) GROUP BY 1, 2, 3, 4"""),
    "sense_to_word_pairs": (
        lambda t: counted(P.sense_to_word_pairs(with_entities(t))),
        "WITH " + SPANS + " SELECT entity AS input, word AS output, count(*) AS n FROM near GROUP BY 1, 2"),
    "word_to_entity_pairs": (
        lambda t: counted(P.word_to_entity_pairs(with_entities(t))),
        "WITH " + SPANS + " SELECT word AS input, entity AS output, count(*) AS n FROM near GROUP BY 1, 2"),
    "sense_to_entity_pairs": (
        lambda t: counted(P.sense_to_entity_pairs(with_entities(t))),
        "WITH " + SPANS + " SELECT entity AS input, entity AS output, count(*) AS n FROM enc WHERE entity IN (SELECT item FROM entity_vocab) GROUP BY 1"),
    "cbow_examples": (
        lambda t: P.cbow_examples(with_entities(t)).groupBy("sense", "output").agg(
            F.count(F.lit(1)).alias("examples"), F.sum(F.size("words")).alias("words")),
        "WITH " + SPANS + """
        SELECT entity AS sense, entity AS output, count(DISTINCT (doc_id, sent_id, span_id)) AS examples, count(*) AS words FROM near GROUP BY 1"""),
    "neighbour_pairs": (lambda t: P.neighbour_pairs(t.links, t.entity_vocab), """
        SELECT b.item_id AS input, a.item_id AS output FROM links l JOIN entity_vocab a ON a.item = l.src JOIN entity_vocab b ON b.item = l.dst"""),
    "context_vector": (context_sums, f"""
        WITH near AS (SELECT m.doc_id, m.mention_id, d.token AS word FROM mentions m JOIN doc_tokens d
          ON d.doc_id = m.doc_id AND d.pos BETWEEN m.pos - {WINDOW} AND m.pos + {WINDOW} AND d.pos <> m.pos)
        SELECT doc_id, mention_id, {r6('avg(w.vec[1])')} AS first, {r6('avg(w.vec[64])')} AS last
        FROM near JOIN word_vectors w USING (word) GROUP BY 1, 2"""),
    "sample_words": (sampled_words, f"""
        SELECT word AS item, {r6('vec[1]')} AS first FROM word_vectors WHERE word IN (SELECT mention FROM priors)"""),
    "sample_entities": (
        lambda t: V.sample_entity_embeddings(
            t.entity_vectors.select(F.col("title").alias("item"), "vec"), t.entity_vocab.filter("item_id > 0 and cn >= 2")
        ).select("item", six(F.get("vec", F.lit(0))).alias("first")),
        f"SELECT title AS item, {r6('vec[1]')} AS first FROM entity_vectors WHERE title IN (SELECT item FROM entity_vocab WHERE cn >= 2)"),
    "sample_senses": (sampled_senses, """
        WITH s AS (SELECT title, 'kb' AS sense_kind, title AS sense_key FROM sense_vectors UNION ALL SELECT title, 'nil', title || '#0' FROM sense_vectors),
        names AS (SELECT mention FROM priors WHERE n >= 8)
        SELECT title, sense_kind, sense_key FROM s WHERE title IN (SELECT mention FROM names)
        OR (sense_kind = 'kb' AND title IN (SELECT item FROM entity_vocab WHERE cn <= 2))"""),
}

QUERIES = {name: (run, with_tables(sql) if sql else None) for name, (run, sql) in QUERIES.items()}
