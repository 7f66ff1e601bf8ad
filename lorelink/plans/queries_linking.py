"""Registered queries: disambiguation features and linking."""

from pyspark.sql import functions as F

from lorelink.operators import features as FE
from lorelink.operators import linking as L
from lorelink.operators import metrics as M
from lorelink.operators import priors as R
from lorelink.operators.together import carry, together
from lorelink.plans.oracle import clamped_sql, r6, with_tables
from lorelink.plans.queries_names import six
from lorelink.plans.queries_text import WINDOW
from lorelink.plans.tables import DIM, Tables
from lorelink.session import cut_lineage

GAMMAS = [0.0, 0.05, 0.1, 0.5, 1.0]
TRAIN_SHARE = 0.6


def table(t: Tables):
    """Candidates with everything known before an occurrence is seen."""
    return cut_lineage(
        FE.candidate_table(t.candidates, t.titles, t.priors, R.entity_prior(t.counts), t.model)
    )


def feature_rows(t: Tables, context=None):
    mentions = cut_lineage(t.mentions)
    return FE.features(mentions, t.doc_words, table(t), t.model, context, WINDOW)


def rounded(rows):
    keep = [c for c in rows.columns]
    return rows.select(*[six(c).alias(c) if c in ("pem", "pe", "largest_pe") else F.col(c) for c in keep])


def two_pass(t: Tables):
    """The second pass takes the best prior candidate of the first as document context."""
    mentions, known = cut_lineage(t.mentions), table(t)
    # Dealt out by document once, which serves the choices of its mentions and their counts.
    rows = FE.candidate_rows(mentions.repartition("doc_id"), known.select("mention", "cand_id", "pem"), named=mentions)
    chosen = L.best_candidate(rows.withColumn("score", F.col("pem")))
    passed = FE.features(mentions, t.doc_words, known, t.model, L.predictions_as_context(chosen), WINDOW)
    return passed.select("doc_id", "mention_id", "cand_id", "csim2", "crank2", "csim5", "crank5")


def single_rows(t: Tables):
    rows = FE.features_single_prototype(cut_lineage(t.mentions), table(t), t.model)
    return rows.select("doc_id", "mention_id", "cand_id", "csim1", "crank1", "csim2", "crank2", "csim5", "crank5", "csim6", "crank6")


def offered_candidates(t: Tables):
    """The candidates of each name after the certain ones took over."""
    return cut_lineage(L.certain_candidates(table(t).select("mention", "cand_id", "pem", "sense_vec", "sense_mu")))


def linking_rows(t: Tables, offered=None):
    """Occurrences with their candidate list after the certain ones took over."""
    mentions = cut_lineage(t.mentions)
    offered = offered_candidates(t) if offered is None else offered
    seen = FE.seen_mentions(mentions, t.doc_words, t.word_vectors, DIM, WINDOW)
    return FE.candidate_rows(seen, offered, DIM, named=mentions)


def local(t: Tables):
    return L.link_local(linking_rows(t)).select(*L.KEYS, "cand_id", "wiki_id", "pem", "csim", "score")


def written(rows, source):
    """``rows`` as they are where those of a mention are together, as they meet no other rows then; else written once."""
    return carry(rows, source) if together(source, L.KEYS) else cut_lineage(rows)


def link_global(t: Tables):
    offered = offered_candidates(t)
    scored = L.local_scores(linking_rows(t, offered))
    return L.link_global(carry(scored.drop("ctx", "sense_mu", "score"), scored), DIM, senses=offered)


def accuracy(t: Tables):
    chosen = local(t).select("doc_id", F.col("wiki_id").alias("gold"), F.col("cand_id").alias("predicted"))
    return M.micro_macro_precision(chosen).withColumn("micro", six("micro")).withColumn("macro", six("macro"))


def sweep(t: Tables):
    scored = L.local_scores(linking_rows(t), 0.0)
    rows = written(scored.select(*L.KEYS, "wiki_id", "cand_id", "pem", "csim"), scored)
    return L.gamma_sweep(rows, None, GAMMAS).select("gamma", six("micro").alias("micro"), six("macro").alias("macro"))


def report(t: Tables):
    scored = L.local_scores(linking_rows(t))
    rows = written(scored.drop("ctx", "sense_mu", "sense_vec"), scored)
    return L.linking_report(L.best_beside(rows)).select(*L.KEYS, "mention", "wiki_id", "cand_id", six("pem").alias("pem"), "csim", "score", "kind")


def ranker(t: Tables, trees: int = 50, stretch: int = 25):
    """Trees learned on the earlier documents, judged on the later ones."""
    last = int(t.documents.agg(F.max("doc_id")).first()[0] * TRAIN_SHARE)
    rows = feature_rows(t).select("doc_id", "mention_id", "wiki_id", "cand_id", *L.RANKER_INPUTS)
    rows = cut_lineage(L.split_by_doc(rows, last, last))
    model = L.train_ranker(rows.filter("split = 'train'"), trees, stretch=stretch)
    scored = L.score_candidates(model, rows.filter("split = 'test'"))
    best = L.best_candidate(scored.select(*L.KEYS, "wiki_id", "cand_id", "score"))
    return best.select("doc_id", "mention_id", "wiki_id", "cand_id", "score")


CT = f"""
  ct AS (SELECT c.mention, c.entity_id AS cand_id, trim(regexp_replace(t.title, '\\(.*?\\)$', '')) AS title_text,
    count(*) OVER (PARTITION BY c.mention) AS cand_size, coalesce(p.pem, 0.0) AS pem, coalesce(e.pe, 0.0) AS pe,
    w.vec AS wv, ev.vec AS ev, sv.vec AS sv, sv.mu AS mu, tv.mu AS tv
    FROM cands c JOIN titles t USING (entity_id)
    LEFT JOIN priors p ON p.mention = c.mention AND p.entity_id = c.entity_id LEFT JOIN pe e ON e.entity_id = c.entity_id
    LEFT JOIN word_vectors w ON w.word = c.mention LEFT JOIN entity_vectors ev ON ev.entity_id = c.entity_id
    LEFT JOIN sense_vectors sv ON sv.entity_id = c.entity_id
    LEFT JOIN (SELECT s.title, s.mu FROM sense_vectors s JOIN entity_vectors x USING (entity_id)) tv
      ON tv.title = trim(regexp_replace(t.title, '\\(.*?\\)$', '')))"""
CTX = f"""
  near AS (SELECT m.doc_id, m.mention_id, w.vec FROM mentions m JOIN doc_tokens d
    ON d.doc_id = m.doc_id AND d.pos BETWEEN m.pos - {WINDOW} AND m.pos + {WINDOW} AND d.pos <> m.pos JOIN word_vectors w ON w.word = d.token),
  ctx AS (SELECT doc_id, mention_id, list(m ORDER BY i) AS ctx FROM (
    SELECT doc_id, mention_id, i, avg(vec[i]) AS m FROM (SELECT doc_id, mention_id, vec, unnest(range(1, 65)) AS i FROM near) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def coherence_cte(source: str, mean: bool = True) -> str:
    """Document vectors from (doc_id, entity_id) rows of ``source``."""
    how = "avg" if mean else "sum"
    parts = []
    for name, vectors in (("coh", "entity_vectors"), ("cohs", "sense_vectors")):
        parts.append(f"""
  {name} AS (SELECT doc_id, list(m ORDER BY i) AS v FROM (SELECT doc_id, i, {how}(vec[i]) AS m FROM (
    SELECT s.doc_id, v.vec, unnest(range(1, 65)) AS i FROM {source} s JOIN {vectors} v USING (entity_id)) GROUP BY 1, 2) GROUP BY 1)""")
    return ",".join(parts)


SURE = """
  sure AS (SELECT m.doc_id, c.cand_id AS entity_id FROM mentions m JOIN ct c ON c.mention = m.mention WHERE c.pem > {0})"""
LINKROWS = CT + "," + CTX + f""",
  fl AS (SELECT mention, cand_id, CASE WHEN pem > 0 THEN pem ELSE 1e-6 END AS pem, sv, mu, max(pem) OVER (PARTITION BY mention) AS top, cand_size FROM ct),
  cc AS (SELECT *, CASE WHEN top > 0.98 THEN 1 ELSE cand_size END AS cands FROM fl WHERE top <= 0.98 OR pem > 0.98),
  lr AS (SELECT m.doc_id, m.mention_id, m.mention, m.wiki_id, c.cand_id, c.pem, c.cands,
    round(CASE WHEN x.ctx IS NULL OR c.mu IS NULL THEN 1e-6 ELSE {clamped_sql('x.ctx', 'c.mu')} END, 6) AS csim
    FROM mentions m JOIN cc c ON c.mention = m.mention LEFT JOIN ctx x ON x.doc_id = m.doc_id AND x.mention_id = m.mention_id),
  sl AS (SELECT *, round(csim * pow(pem, 0.1), 6) AS score FROM lr),
  wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, mention_id ORDER BY score DESC, cand_id) AS r FROM sl) WHERE r = 1)"""


def ranks_sql(columns, part="doc_id, mention_id") -> str:
    return ", ".join(f"rank() OVER (PARTITION BY {part} ORDER BY {c} DESC) AS {c.replace('sim', 'rank')}" for c in columns)


def scored_sql() -> str:
    return f"""
  sc AS (SELECT m.doc_id, m.mention_id, m.wiki_id, c.cand_id, c.cand_size, {r6('c.pem')} AS pem, {r6('c.pe')} AS pe, {r6('lp.pe')} AS largest_pe,
    CAST(levenshtein(c.mention, c.title_text) AS DOUBLE) AS raw_distance, CAST(c.mention = c.title_text AS DOUBLE) AS str_sim2, CAST(contains(c.title_text, c.mention) AS DOUBLE) AS str_sim3,
    CAST(starts_with(c.title_text, c.mention) AS DOUBLE) AS str_sim4, CAST(ends_with(c.title_text, c.mention) AS DOUBLE) AS str_sim5,
    round({clamped_sql('c.wv', 'c.ev')}, 6) AS esim1, round({clamped_sql('c.tv', 'c.ev')}, 6) AS esim2, round({clamped_sql('c.wv', 'c.sv')}, 6) AS esim3,
    round({clamped_sql('x.ctx', 'c.ev')}, 6) AS csim1, round({clamped_sql('h.v', 'c.ev')}, 6) AS csim2, round({clamped_sql('x.ctx', 'c.sv')}, 6) AS csim3,
    round({clamped_sql('x.ctx', 'c.mu')}, 6) AS csim4, round({clamped_sql('hs.v', 'c.sv')}, 6) AS csim5
    FROM mentions m JOIN ct c ON c.mention = m.mention LEFT JOIN ctx x ON x.doc_id = m.doc_id AND x.mention_id = m.mention_id
    LEFT JOIN coh h ON h.doc_id = m.doc_id LEFT JOIN cohs hs ON hs.doc_id = m.doc_id
    LEFT JOIN (SELECT m.doc_id, max(c.pe) AS pe FROM mentions m JOIN ct c ON c.mention = m.mention GROUP BY 1) lp ON lp.doc_id = m.doc_id)"""


SIMS = list(FE.SIMILARITIES)
FEATURES_SQL = "WITH " + CT + "," + CTX + "," + SURE.format(0.95) + "," + coherence_cte("sure") + "," + scored_sql()

QUERIES = {
    "candidate_table": (
        lambda t: table(t).select("mention", "cand_id", "title_text", "cand_size", six("pem").alias("pem"), six("pe").alias("pe"),
                                  *[six(c).alias(c) for c in ("esim1", "esim2", "esim3")]),
        "WITH " + CT + f""" SELECT mention, cand_id, title_text, cand_size, {r6('pem')} AS pem, {r6('pe')} AS pe,
        {r6(clamped_sql('wv', 'ev'))} AS esim1, {r6(clamped_sql('tv', 'ev'))} AS esim2, {r6(clamped_sql('wv', 'sv'))} AS esim3 FROM ct"""),
    "candidate_rows": (
        lambda t: FE.candidate_rows(t.mentions, table(t).select("mention", "cand_id", "cand_size")).select("doc_id", "mention_id", "cand_id", "cand_size"),
        "WITH " + CT + " SELECT m.doc_id, m.mention_id, c.cand_id, c.cand_size FROM mentions m JOIN ct c ON c.mention = m.mention"),
    "largest_prior": (
        lambda t: FE.largest_prior(t.mentions, table(t)).select("doc_id", six("largest_pe").alias("largest_pe")),
        "WITH " + CT + f" SELECT m.doc_id, {r6('max(c.pe)')} AS largest_pe FROM mentions m JOIN ct c ON c.mention = m.mention GROUP BY 1"),
    "coherence": (
        lambda t: FE.unambiguous_entities(t.mentions, table(t)),
        "WITH " + CT + "," + SURE.format(0.95) + " SELECT doc_id, entity_id, count(*) AS n FROM sure GROUP BY 1, 2"),
    "features": (
        lambda t: rounded(feature_rows(t)).drop("str_sim1"),
        FEATURES_SQL + f" SELECT * EXCLUDE (raw_distance), {ranks_sql(SIMS)} FROM sc"),
    "features_two_pass": (two_pass, "WITH " + CT + "," + CTX + """,
        picked AS (SELECT doc_id, cand_id AS entity_id FROM (SELECT m.doc_id, c.cand_id, row_number() OVER (PARTITION BY m.doc_id, m.mention_id ORDER BY c.pem DESC, c.cand_id) AS r
          FROM mentions m JOIN ct c ON c.mention = m.mention) WHERE r = 1)""" + "," + coherence_cte("picked") + "," + scored_sql() + f"""
        SELECT doc_id, mention_id, cand_id, csim2, csim5, {ranks_sql(['csim2', 'csim5'])} FROM sc"""),
    "features_single": (single_rows, "WITH " + CT + "," + SURE.format(0.9) + "," + coherence_cte("sure", False) + f""",
        sc AS (SELECT m.doc_id, m.mention_id, c.cand_id, round({clamped_sql('c.wv', 'c.ev')}, 6) AS csim1, round({clamped_sql('c.wv', 'c.tv')}, 6) AS csim2,
          0.0 :: DOUBLE AS csim5, round({clamped_sql('h.v', 'c.ev')}, 6) AS csim6
          FROM mentions m JOIN ct c ON c.mention = m.mention LEFT JOIN coh h ON h.doc_id = m.doc_id)
        SELECT doc_id, mention_id, cand_id, csim1, csim2, csim5, csim6, {ranks_sql(['csim1', 'csim2', 'csim5', 'csim6'])} FROM sc"""),
    "link_local": (local, "WITH " + LINKROWS + " SELECT doc_id, mention_id, cand_id, wiki_id, pem, csim, score FROM wn"),
    "link_global": (link_global, None),
    "linking_accuracy": (accuracy, "WITH " + LINKROWS + f""",
        d AS (SELECT doc_id, count_if(wiki_id = cand_id) AS tp, count(*) AS n FROM wn GROUP BY doc_id)
        SELECT {r6('sum(tp) / sum(n)')} AS micro, {r6('avg(tp / n)')} AS macro, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS docs FROM d"""),
    "gamma_sweep": (sweep, "WITH " + LINKROWS + f""",
        g AS (SELECT CAST(unnest({GAMMAS}) AS DOUBLE) AS gamma),
        s2 AS (SELECT g.gamma, lr.*, round(csim * pow(pem, g.gamma), 6) AS sx FROM lr, g),
        w2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gamma, doc_id, mention_id ORDER BY sx DESC, cand_id) AS r FROM s2) WHERE r = 1),
        d AS (SELECT gamma, doc_id, count_if(wiki_id = cand_id) AS tp, count(*) AS n FROM w2 GROUP BY 1, 2)
        SELECT gamma, {r6('sum(tp) / sum(n)')} AS micro, {r6('avg(tp / n)')} AS macro FROM d GROUP BY gamma"""),
    "linking_report": (report, "WITH " + LINKROWS + f""",
        j AS (SELECT s.*, w.cand_id AS won FROM sl s JOIN wn w USING (doc_id, mention_id)),
        k AS (SELECT *, CASE WHEN cand_id = won THEN 'predicted' WHEN won <> wiki_id AND cand_id = wiki_id THEN 'gold'
          WHEN won = wiki_id AND pem > 0.9 THEN 'rival' END AS kind FROM j)
        SELECT doc_id, mention_id, mention, wiki_id, cand_id, {r6('pem')} AS pem, csim, score, kind FROM k WHERE kind IS NOT NULL"""),
    "answers": (
        lambda t: L.answers(FE.candidate_rows(t.mentions, table(t).select("mention", "cand_id"))).select("doc_id", "mention_id", "cand_id"),
        "WITH " + CT + " SELECT m.doc_id, m.mention_id, c.cand_id FROM mentions m JOIN ct c ON c.mention = m.mention AND c.cand_id = m.wiki_id"),
    "ranker": (ranker, None),
}

QUERIES = {name: (run, with_tables(sql) if sql else None) for name, (run, sql) in QUERIES.items()}
