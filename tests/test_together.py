"""Rows of a mention that stand side by side: the same results as by shuffles, and no shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from lorelink.operators import features as FE
from lorelink.operators import linking as L
from lorelink.operators import skew as S
from lorelink.operators import together as T
from lorelink.operators import training as TR

WORDS = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 1.0])]
TEXTS = [(1, "a x b c"), (2, "x y"), (3, "c a b a"), (3, "b ä a"), (3, "b z a"), (None, "a b")]
MENTIONS = [(1, 0, 0, "a", 7), (1, 2, 2, "b", 7), (2, 1, 1, "y", 8), (3, 1, 1, "a", 8), (3, 1, 2, "b", 7), (3, 0, 0, "c", None), (9, 0, 0, "a", 8)]


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


def scored(spark, seed=3):
    """Candidate rows with ties, nulls, NaN and repeated keys, runs side by side."""
    draw = random.Random(seed)
    out = []
    for doc in range(40):
        for mention in sorted(draw.choices(range(6), k=4)):
            for cand in draw.sample(range(9), draw.randint(1, 4)):
                out.append((doc, mention, draw.choice([1, 2, None]), cand, draw.randint(1, 3), draw.choice([0.95, 0.5, 1e-6]), draw.choice([0.0, 0.25, 0.5]), draw.choice([0.5, 0.25, None, float("nan")])))
    out.sort(key=lambda r: r[:2])
    kinds = "doc_id long, mention_id long, wiki_id long, cand_id long, cands long, pem double, csim double, score double"
    df = spark.createDataFrame(out, kinds).coalesce(1)
    return df, T.mark(df.select("*"), L.KEYS)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_best_and_ranks_in_runs(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        apart, close = scored(spark)
        best = S.best_per_key(close, L.KEYS, "score", "cand_id")
        # Of rows equal in score and candidate any may come.
        parts = ["doc_id", "mention_id", "cand_id"]
        assert rows(best.select(*parts)) == rows(S.best_per_key(apart, L.KEYS, "score", "cand_id").select(*parts)) and not shuffles(best)
        sized = lambda df: T.carry(df.withColumn("n", F.lit(4)), df)
        ranked = S.min_rank_within(sized(close), L.KEYS, "cand_id", {"csim": "r", "pem": "q"}, "n")
        assert rows(ranked) == rows(S.min_rank_within(sized(apart), L.KEYS, "cand_id", {"csim": "r", "pem": "q"}, "n")) and not shuffles(ranked)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sweep_and_report_in_runs(spark):
    apart, close = scored(spark)
    judged = lambda df: rows(df.select("gamma", F.round("micro", 12), F.round("macro", 12)))
    want = judged(L.gamma_sweep(apart, apart.select(*L.KEYS, "wiki_id").distinct(), [0.0, 0.5, 1.0]))
    got = L.gamma_sweep(close, None, [0.0, 0.5, 1.0])
    assert judged(got) == want and judged(L.gamma_sweep(apart, None, [0.0, 0.5, 1.0])) == want
    report = L.linking_report(L.best_beside(close))
    assert rows(report) == rows(L.linking_report(L.best_beside(apart)))
    assert rows(report) == rows(L.linking_report(apart, L.best_candidate(apart))) and not shuffles(report)


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_are_linked_where_their_rows_are(spark, seed):
    apart, close = scored(spark, seed)
    senses = spark.createDataFrame([(i, [float(i % 3), 1.0 - i]) for i in range(7)] + [(7, None)], "cand_id long, sense_vec array<double>")
    joined = T.carry(close.join(F.broadcast(senses), "cand_id", "left").select(*close.columns, "sense_vec"), close)
    every = senses.unionByName(spark.createDataFrame([(8, None)], "cand_id long, sense_vec array<double>"))
    got = L.link_global(joined, 2, senses=every)
    assert rows(got) == rows(L.link_global(apart.join(senses, "cand_id", "left"), 2)) and not shuffles(got)


def table_of(spark):
    found = [("a", 7, 2, 0.99, 0.5, [1.0, 0.0], [0.5, 1.0]), ("a", 8, 2, 0.05, 0.2, None, [1.0, 1.0]), ("b", 7, 1, 0.99, 0.5, [1.0, 0.0], None), ("z", 9, 1, 0.5, 0.1, [1.0, 2.0], [0.0, 1.0])]
    own = spark.createDataFrame(found, "mention string, cand_id long, cand_size long, pem double, pe double, entity_vec array<double>, sense_vec array<double>")
    return own.select("*", F.col("mention").alias("title_text"), *[F.lit(0.5).alias(c) for c in [*FE.STRINGS, "esim1", "esim2", "esim3"]], F.col("sense_vec").alias("sense_mu"))


def test_features_shuffle_no_candidate_row(spark, monkeypatch):
    """The same rows by way of joins; a table of candidates too large to travel is cut to the names that occur."""
    words = spark.createDataFrame(WORDS, "word string, vec array<double>")
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string").select("doc_id", F.split("text", " ").alias("tokens"))
    vectors = spark.createDataFrame([(7, [1.0, 0.0]), (9, [1.0, 2.0])], "entity_id long, vec array<double>")
    model = FE.Vectors(2, words, vectors, None, vectors.withColumn("mu", F.col("vec")))
    mentions = spark.createDataFrame(MENTIONS, "doc_id long, mention_id long, pos long, mention string, wiki_id long")
    lone = mentions.unionByName(spark.createDataFrame([(None, 0, 0, "a", 7), (1, None, 0, "a", 7)], mentions.schema))
    table = table_of(spark)
    run = lambda m: FE.features(m, texts, table, model, window=2)
    got, both = run(mentions), run(lone)
    assert "mention_id" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)
    got, both = rows(got), rows(both)
    real = FE.fits_broadcast
    small = lambda df, size, *rest: real(df, size, *rest) if size != 8 * 3 * 2 + 512 else df.count() < 4
    monkeypatch.setattr(FE, "fits_broadcast", small)
    cut = run(mentions)
    assert "_slice" not in cut._jdf.queryExecution().optimizedPlan().toString() and rows(cut) == got
    monkeypatch.setattr(FE, "fits_broadcast", lambda *_: False)
    assert rows(run(mentions)) == got and rows(run(lone)) == both and len(both) > len(got) > 6


def test_words_are_shuffled_as_codes(spark):
    words = spark.createDataFrame(WORDS, "word string, vec array<double>")
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string").select("doc_id", F.split("text", " ").alias("tokens"))
    mentions = spark.createDataFrame(MENTIONS, "doc_id long, mention_id long, pos long, mention string, wiki_id long")
    out = FE.mention_contexts(texts, mentions, words, 2, 2)
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "codes(" in line)
    assert any("Exchange hashpartitioning(doc_id" in line for line in plan[:at])
    tokens = texts.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    assert rows(out) == rows(FE.mention_contexts(tokens, mentions, words, 2, 2)) and out.count() == 5


def test_senses_are_chosen_where_the_contexts_are(spark):
    draw = random.Random(5)
    vec = lambda: [draw.choice([0.0, 1.0, -1.0, 0.5]), draw.choice([0.0, 1.0, 0.25])]
    found = [(i, draw.choice(["t", "u", "none", None]), vec()) for i in range(60) for _ in range(draw.randint(1, 3))]
    contexts = spark.createDataFrame(found, "context_id long, title string, vec array<double>").coalesce(1)
    senses = spark.createDataFrame(
        [("t", "kb", "k1", [1.0, 0.1], 2), ("t", "kb", "k2", [1.0, 0.1], 2), ("t", "nil", "n1", [0.1, 1.0], 1), ("u", "kb", "k3", [1.0, 1.0], 1), ("none", "kb", "k4", [1.0, 1.0], 0)],
        "title string, sense_kind string, sense_key string, mu array<double>, cluster_size long")
    got = TR.assign_sense(T.mark(contexts.select("*"), ["context_id"]), senses, 0.02)
    assert rows(got) == rows(TR.assign_sense(contexts, senses, 0.02)) and not shuffles(got)
