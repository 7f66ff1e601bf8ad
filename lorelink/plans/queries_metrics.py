"""Registered queries: ranking and correlation metrics over scored vector pairs."""

from pyspark.sql import functions as F

from lorelink.functions.vectors import dot
from lorelink.operators import metrics as M
from lorelink.plans.oracle import r6, with_tables
from lorelink.plans.queries_names import six
from lorelink.plans.tables import Tables


def judged_pairs(t: Tables):
    """Ten candidates per vector; relevance 2 or 1 for the same label, else 0."""
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    offered = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_ql"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("_j"))
    offered = offered.withColumn("cand_id", (F.col("query_id") + F.col("_j") * 37) % n)
    labels = t.embeddings.select(F.col("vec_id").alias("cand_id"), F.col("label").alias("_cl"))
    rel = F.when(F.col("_ql") != F.col("_cl"), 0).when((F.col("query_id") - F.col("cand_id")) % 2 == 0, 2).otherwise(1)
    return offered.join(labels, "cand_id").select("query_id", "cand_id", rel.alias("rel"))


def rankings(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("entity_id"), "vec")
    return M.relatedness_rankings(judged_pairs(t), vectors, lambda a, b: F.round(dot(a, b), 6))


def ranked(t: Tables):
    return rankings(t)[0]


def relatedness_with_gaps(t: Tables):
    """Coverage when a third of the vectors is unknown."""
    vectors = t.embeddings.filter("label % 3 <> 0").select(F.col("vec_id").alias("entity_id"), "vec")
    return M.relatedness_rankings(judged_pairs(t), vectors, lambda a, b: F.round(dot(a, b), 6))[1]


JUDGED = """
  jp AS (SELECT o.query_id, o.cand_id, CASE WHEN o.label <> c.label THEN 0 WHEN (o.query_id - o.cand_id) % 2 = 0 THEN 2 ELSE 1 END AS rel, o.vec AS qv, c.vec AS cv,
    o.label AS ql, c.label AS cl
    FROM (SELECT vec_id AS query_id, label, vec, (vec_id + j * 37) % (SELECT count(*) FROM emb) AS cand_id FROM emb, (SELECT unnest(range(1, 11)) AS j)) o
    JOIN emb c ON c.vec_id = o.cand_id)"""
RANKED = JUDGED + """,
  sc AS (SELECT query_id, cand_id, rel, round(list_dot_product(qv, cv), 6) AS score FROM jp),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM sc)"""
AP = """
  seen AS (SELECT *, sum(CASE WHEN rel <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM rk),
  ap AS (SELECT query_id, coalesce(avg(CASE WHEN rel <> 0 THEN hits / rank END), 0.0) AS ap FROM seen GROUP BY query_id)"""


def ndcg_cte(k: int) -> str:
    return f"""
  d{k} AS (SELECT query_id, sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg,
    sum(CASE WHEN ideal <= {k} THEN rel / log2(ideal + 1) ELSE 0 END) AS best
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM rk) GROUP BY query_id),
  n{k} AS (SELECT query_id, CASE WHEN best = 0 THEN 0.0 ELSE dcg / best END AS ndcg FROM d{k})"""


QUERIES = {
    "ranked_candidates": (
        lambda t: ranked(t).select("query_id", "cand_id", "rel", six("score").alias("score"), "rank"),
        "WITH " + RANKED + f" SELECT query_id, cand_id, rel, {r6('score')} AS score, rank FROM rk"),
    "mrr": (
        lambda t: M.mrr(ranked(t)).select(six("mrr").alias("mrr")),
        "WITH " + RANKED + f"""
        SELECT {r6('avg(coalesce(1.0 / f, 0))')} AS mrr FROM (SELECT query_id, min(CASE WHEN rel <> 0 THEN rank END) AS f FROM rk GROUP BY query_id)"""),
    "r_precision": (
        lambda t: M.r_precision(ranked(t)).select("query_id", six("r_precision").alias("r_precision")),
        "WITH " + RANKED + f"""
        SELECT query_id, {r6('coalesce(sum(CASE WHEN rel <> 0 THEN 1.0 ELSE 0 END) / max(CASE WHEN rel <> 0 THEN rank END), 0)')} AS r_precision FROM rk GROUP BY query_id"""),
    "precision_at_k": (
        lambda t: M.precision_at_k(ranked(t), 5).select("query_id", six("precision").alias("precision")),
        "WITH " + RANKED + f" SELECT query_id, {r6('count_if(rel <> 0 AND rank <= 5) / 5.0')} AS precision FROM rk GROUP BY query_id"),
    "average_precision": (
        lambda t: M.average_precision(ranked(t)).select("query_id", six("ap").alias("ap")),
        "WITH " + RANKED + "," + AP + f" SELECT query_id, {r6('ap')} AS ap FROM ap"),
    "mean_average_precision": (
        lambda t: M.mean_average_precision(ranked(t)).select(six("map").alias("map")),
        "WITH " + RANKED + "," + AP + f" SELECT {r6('avg(ap)')} AS map FROM ap"),
    "dcg_at_k": (
        lambda t: M.dcg_at_k(ranked(t), 5).select("query_id", six("dcg").alias("dcg")),
        "WITH " + RANKED + f"""
        SELECT query_id, {r6('sum(CASE WHEN rank > 5 THEN 0 WHEN rank = 1 THEN rel ELSE rel / log2(rank) END)')} AS dcg FROM rk GROUP BY query_id"""),
    "ndcg_at_k": (
        lambda t: M.ndcg_at_k(ranked(t), 5, 1).select("query_id", six("ndcg").alias("ndcg")),
        "WITH " + RANKED + "," + ndcg_cte(5) + f" SELECT query_id, {r6('ndcg')} AS ndcg FROM n5"),
    "relatedness": (
        lambda t: M.relatedness_report(ranked(t)).select(*[six(c).alias(c) for c in ("ndcg_1", "ndcg_5", "ndcg_10", "map")]),
        "WITH " + RANKED + "," + AP + "," + ndcg_cte(1) + "," + ndcg_cte(5) + "," + ndcg_cte(10) + f"""
        SELECT {r6('avg(n1.ndcg)')} AS ndcg_1, {r6('avg(n5.ndcg)')} AS ndcg_5, {r6('avg(n10.ndcg)')} AS ndcg_10, {r6('avg(ap.ap)')} AS map
        FROM ap JOIN n1 USING (query_id) JOIN n5 USING (query_id) JOIN n10 USING (query_id)"""),
    "relatedness_coverage": (relatedness_with_gaps, "WITH " + JUDGED + """,
        q AS (SELECT query_id, count(*) AS asked, count_if(ql % 3 <> 0 AND cl % 3 <> 0) AS n FROM jp GROUP BY query_id)
        SELECT count(*) AS queries, CAST(count_if(n >= 2) AS BIGINT) AS ranked_queries, CAST(sum(asked) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS covered_pairs FROM q"""),
    "spearman": (
        lambda t: M.spearman(t.read("part"), "p_size", "p_retailprice").select(six("rho").alias("rho")),
        f"""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a,
          rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
        SELECT {r6('corr(a, b)')} AS rho FROM r"""),
    "coverage": (
        lambda t: M.coverage(t.vocab.filter("item_id > 0").join(t.word_vectors.withColumnRenamed("word", "item"), "item", "left"), F.col("vec").isNotNull()),
        """SELECT CAST(count_if(item IN (SELECT word FROM word_vectors)) AS BIGINT) AS loaded,
        CAST(count_if(item NOT IN (SELECT word FROM word_vectors)) AS BIGINT) AS skipped FROM vocab WHERE item_id > 0"""),
}

QUERIES = {name: (run, with_tables(sql) if sql else None) for name, (run, sql) in QUERIES.items()}
