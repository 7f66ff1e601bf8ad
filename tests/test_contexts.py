"""Contexts beside their documents: the same rows as joins, without a vector in any shuffle."""

import pytest
from pyspark.sql import functions as F

from lorelink.operators import features as FE
from lorelink.operators import similarity as Y
from lorelink.operators import training as T
from lorelink.operators import vocab as V
from lorelink.operators.pairs import anchor_contexts

WORDS = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 1.0])]
TEXTS = [(1, "a x b c"), (2, "x y"), (3, "c a b a"), (3, "b x a"), (None, "a b")]
MENTIONS = [(1, 0, 0, "a"), (1, 2, 2, "b"), (2, 1, 1, "y"), (3, 1, 1, "a"), (3, 1, 2, "b"), (3, 0, 0, "c"), (None, 0, 0, "a"), (9, 0, 0, "a"), (1, None, 0, "a")]


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_seen_mentions_are_a_join(spark, how, monkeypatch):
    """Repeated and null keys included; a row per text or a row per token."""
    words = spark.createDataFrame(WORDS, "word string, vec array<double>")
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string").select("doc_id", F.split("text", " ").alias("tokens"))
    tokens = texts.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    mentions = spark.createDataFrame(MENTIONS, "doc_id long, mention_id long, pos long, mention string")
    whole = spark.createDataFrame([(1, [0.5, 0.5]), (3, [1.0, 0.0])], "doc_id long, coh array<double>")
    want = rows(mentions.join(FE.mention_contexts(tokens, mentions, words, 2, 2), FE.KEYS, how).join(whole, "doc_id", "left"))
    assert rows(FE.seen_mentions(mentions, texts, words, 2, 2, how, (whole,))) == want
    assert rows(FE.seen_mentions(mentions, tokens, words, 2, 2, how, (whole,))) == want
    monkeypatch.setattr(FE, "fits_broadcast", lambda *_: False)
    assert rows(FE.seen_mentions(mentions, texts, words, 2, 2, how, (whole,))) == want


def test_no_mention_vector_is_shuffled(spark):
    words = spark.createDataFrame(WORDS, "word string, vec array<double>")
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string").select("doc_id", F.split("text", " ").alias("tokens"))
    mentions = spark.createDataFrame(MENTIONS, "doc_id long, mention_id long, pos long, mention string")
    plan = FE.seen_mentions(mentions.filter("doc_id = 1"), texts, words, 2)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    first = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert not [line for line in lines[:first] if "Exchange" in line]


def test_senses_travel_to_the_contexts(spark, monkeypatch):
    contexts = spark.createDataFrame(
        [(1, "t", [1.0, 0.0]), (1, "t", [1.0, 0.0]), (2, "t", [0.0, 1.0]), (3, "none", [1.0, 1.0]), (4, None, [1.0, 1.0]), (5, "t", [0.0, 0.0])],
        "context_id long, title string, vec array<double>")
    senses = spark.createDataFrame(
        [("t", "kb", "k1", [1.0, 0.1], 2), ("t", "kb", "k2", [1.0, 0.1], 2), ("t", "nil", "n1", [0.1, 1.0], 1), ("u", "kb", "k3", [1.0, 1.0], 1), ("none", "kb", "k4", [1.0, 1.0], 0)],
        "title string, sense_kind string, sense_key string, mu array<double>, cluster_size long")
    got = rows(T.assign_sense(contexts, senses, 0.02))
    monkeypatch.setattr(T, "fits_broadcast", lambda *_: False)
    assert got == rows(T.assign_sense(contexts, senses, 0.02)) and len(got) == 8


def test_target_contexts_with_equal_keys(spark, monkeypatch):
    vectors = spark.createDataFrame(WORDS, "item string, vec array<double>")
    marked = spark.createDataFrame(
        [(1, "t", ["a", "x", "b", "c"], ["c", "y"]), (1, "t", ["c", "b"], ["a"]), (2, "t", ["x"], []), (3, "t", [], ["x", "b", "a", "c"])],
        "k long, target string, before array<string>, after array<string>")
    got = rows(Y.target_contexts(marked, vectors, ["k"], 2, 2).select("k", "target", "vec_n", "vec"))
    monkeypatch.setattr(Y, "fits_broadcast", lambda *_: False)
    assert got == rows(Y.target_contexts(marked, vectors, ["k"], 2, 2).select("k", "target", "vec_n", "vec")) and len(got) == 2


def test_spans_of_several_words_and_parts(spark):
    items = [(10, None), (11, 5), (12, 5), (13, None), (14, 2), (15, 5), (16, None)]
    df = spark.createDataFrame([(1, 0, items), (2, 0, items[:1])], "k long, chunk long, items array<struct<item:long,span_id:long>>")
    got = {r.span_id: r.context for r in anchor_contexts(df, ["k"], 2).collect()}
    assert got == {5: [10, 16], 2: [12, 13, 15, 16]}


def test_target_contexts_skip_null_components(spark):
    vectors = spark.createDataFrame([("a", [1.0, None]), ("b", [3.0, 2.0]), ("c", None)], "item string, vec array<double>")
    marked = spark.createDataFrame([(1, "t", ["a", "c"], ["b"])], "k long, target string, before array<string>, after array<string>")
    (row,) = Y.target_contexts(marked, vectors, ["k"], 2).collect()
    assert (row.vec_n, row.vec) == (2, [2.0, 1.0])


def test_document_vectors_need_one_shuffle_of_names(spark):
    named = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 7, 1), (3, 9, 1), (None, 8, 3)], "doc_id long, entity_id long, n long")
    vectors = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 3.0])], "entity_id long, vec array<double>")
    out = FE.coherence_vectors(named, vectors, 2, "coh")
    assert rows(out) == rows(spark.createDataFrame([(1, [2 / 3, 1.0]), (2, [1.0, 0.0]), (None, [0.0, 3.0])], "doc_id long, coh array<double>"))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_single_prototype_rows_whatever_travels(spark, monkeypatch):
    """The same rows with vectors in the table of candidates, beside it and by way of joins; repeated and null keys included."""
    table = spark.createDataFrame(
        [("a", 7, "a", 2, 0.95, 0.5, [1.0, 0.0]), ("a", 8, "b", 2, 0.05, 0.2, None), ("b", 7, "a", 1, 0.99, 0.5, [1.0, 0.0]), ("c", 9, "c", 1, 0.5, 0.1, [1.0, 2.0])],
        "mention string, cand_id long, title_text string, cand_size long, pem double, pe double, entity_vec array<double>",
    ).select("*", *[F.lit(0.5).alias(c) for c in [*FE.STRINGS, "esim1"]], *[F.lit(None).cast("array<double>").alias(c) for c in ("sense_vec", "sense_mu")])
    entities = spark.createDataFrame([(7, [1.0, 0.0]), (9, [1.0, 2.0])], "entity_id long, vec array<double>")
    words = spark.createDataFrame(WORDS, "word string, vec array<double>")
    model = FE.Vectors(2, words, entities, words.withColumnRenamed("word", "title"))
    mentions = spark.createDataFrame([(*m, 7) for m in MENTIONS], "doc_id long, mention_id long, pos long, mention string, wiki_id long")
    run = lambda: rows(FE.features_single_prototype(mentions, table, model))
    want, sizes = run(), []
    assert len(want) == 13

    def only_small(dim, size, *rest):
        sizes.append(size)
        return size < 8 * 2 + 512

    monkeypatch.setattr(FE, "fits_broadcast", only_small)
    assert run() == want and 8 * 2 + 512 in sizes
    monkeypatch.setattr(FE, "fits_broadcast", lambda *_: False)
    assert run() == want
    assert FE._vectors_by_candidate(table, 2) is None


def test_rare_words_alone_are_shuffled(spark):
    vocab = spark.createDataFrame([(0, "</s>", 9), (1, "a", 5), (2, "b", 4), (3, "c", 2), (4, "d", 1)], "item_id long, item string, cn long")
    tokens = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "x", None, "a", "d", "c", "c", "</s>"])], "pos long, token string")
    want = rows(V.encode_tokens(tokens, vocab).select("pos", "token", "item_id"))
    out = V.encode_tokens(tokens, vocab, limit=2 * 128).select("pos", "token", "item_id")
    assert rows(out) == want and len(want) == 6
    assert "LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()
    again = vocab.unionByName(vocab.filter("item_id = 1").withColumn("item_id", F.lit(5).cast("long")))
    assert rows(V.encode_tokens(tokens, again, limit=3 * 128).select("pos", "token", "item_id")) == rows(V.encode_tokens(tokens, again).select("pos", "token", "item_id"))
