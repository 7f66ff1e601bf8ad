"""Search, linking and training against plain computations."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from lorelink.operators import linking as L
from lorelink.operators import pairs as P
from lorelink.operators import search as S
from lorelink.operators import training as T
from lorelink.operators import vocab as V
from lorelink.plans import train as R


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(5).normal(size=(60, 6))
    return draw, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(draw)], "item int, vec array<double>")


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 3, "block_rows": 13}])
def test_nearest_both_ways(vectors, options):
    draw, df = vectors
    unit = draw / np.linalg.norm(draw, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    got = S.nearest(df.withColumnRenamed("item", "query"), df, 4, **options).orderBy("query", "rank").collect()
    want = [(q, i) for q in range(60) for i in sorted(range(60), key=lambda i: (-sims[q, i], i))[:4]]
    assert [(r.query, r.item) for r in got] == want


def test_pruned_search_is_exact_and_skips_pairs(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 16))
    points = np.concatenate([centres[i % 12] + 0.05 * draw.normal(size=16) for i in range(600)]).reshape(600, 16)
    points[300:330] = points[0]  # ties
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(600, None), (601, [0.0] * 16)]
    df = spark.createDataFrame(rows, "item int, vec array<double>")
    queries = df.withColumnRenamed("item", "query")
    got = S.nearest(queries, df, 9, broadcast_limit=3, block_rows=40).orderBy("query", "rank").collect()
    want = S.nearest(queries, df, 9).orderBy("query", "rank").collect()
    assert got == want and len([r for r in got if r.query < 600]) == 5400
    share = S.pairs_looked_at(queries, df, 9, block_rows=40).first()
    assert share.pairs >= 600 * 600 and 0 < share.looked_at <= share.pairs and share.share < 0.5
    few = S.nearest(queries, df.limit(4), 9, broadcast_limit=3, block_rows=2)
    assert few.filter("query < 600").groupBy("query").count().filter("count != 4").count() == 0
    assert S.nearest(queries, df.limit(0), 9, broadcast_limit=3).count() == 0


def test_top_in_tiles_is_bounded_and_the_same(monkeypatch):
    draw = np.random.default_rng(4)
    queries, items = draw.normal(size=(50, 5)), draw.normal(size=(80, 5))
    ids, names = np.arange(50), np.array([f"w{i:02d}" for i in range(80)], object)
    whole = S._local_top(ids, queries, names, items, 3, 6, -9.0)
    sizes, top = [], S._top_rows
    monkeypatch.setattr(S, "TILE", 400)
    monkeypatch.setattr(S, "_top_rows", lambda sims, *rest: (sizes.append(sims.size), top(sims, *rest))[1])
    tiled = S._local_top(ids, queries, names, items, 3, 6, -9.0)
    assert max(sizes) <= 400 and len(whole[0]) == 150
    assert all((a == b).all() for a, b in zip(whole, tiled))
    assert [len(c) for c in S._local_top(ids[:0], queries[:0], names, items, 3, 6, -9.0)] == [0, 0, 0]


def test_a_vector_is_sent_once_per_party(spark, monkeypatch):
    draw = np.random.default_rng(6).normal(size=(400, 8))
    df = spark.createDataFrame([(f"v{i}", [float(x) for x in p]) for i, p in enumerate(draw)], "item string, vec array<double>")
    queries = df.select(F.substring("item", 2, 9).cast("long").alias("query"), "vec")
    queries = queries.unionByName(queries.filter("query < 3"))
    want = S.nearest(queries, df, 5).orderBy("query", "rank").collect()
    rounds, matched = [], S._matched
    monkeypatch.setattr(S, "_matched", lambda sent, *rest: (rounds.append(sent.count()), matched(sent, *rest))[1])
    monkeypatch.setattr(S, "PARTIES", 4)
    got = S.nearest(queries, df, 5, broadcast_limit=3, block_rows=20)
    assert got.orderBy("query", "rank").collect() == want and len(want) == 2000
    # Only the first round sends queries to blocks, and each to few of them; the lists of a query are not one for every block.
    assert len(rounds) == 1 and rounds[0] < 403 * 5


def test_context_vector_both_ways(spark, monkeypatch):
    words = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 0.0])], "word string, vec array<double>")
    rows = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, ["zz"]), (3, ["b", "b", "a"]), (4, [])], "k int, context array<string>")
    small = {r.k: r.vec for r in P.context_vector(rows, ["k"], words, 2).collect()}
    monkeypatch.setattr(P, "fits_broadcast", lambda *a: False)
    large = {r.k: r.vec for r in P.context_vector(rows, ["k"], words, 2).collect()}
    assert set(small) == set(large) == {1, 3} and small[1] == [2.0, 1.0]
    assert all(small[k] == pytest.approx(large[k]) for k in small)


def test_link_global_follows_the_order(spark):
    draw = np.random.default_rng(2)
    rows, want = [], {}
    for doc in range(3):
        total, used, mentions = np.zeros(4), 0, []
        for m in range(6):
            n = int(draw.integers(1, 4))
            mentions.append((m, [(f"c{k}", float(draw.uniform(0.1, 1)), float(draw.uniform(0, 1)), draw.normal(size=4)) for k in range(n)]))
        rows += [(doc, m, c, len(cs), p, s, [float(x) for x in v]) for m, cs in mentions for c, p, s, v in cs]
        singles = [(m, cs) for m, cs in mentions if len(cs) == 1]
        for m, cs in singles:
            want[doc, m], total, used = cs[0][0], total + cs[0][3], used + 1
        for m, cs in sorted((x for x in mentions if len(x[1]) > 1), key=lambda x: (len(x[1]), x[0])):
            scores = [round(s * p**0.1 * (max(0.0, total @ v / np.linalg.norm(total) / np.linalg.norm(v)) if used else 1e-6), 6) for _, p, s, v in cs]
            best = max(range(len(cs)), key=lambda k: (scores[k], -k))
            want[doc, m], total, used = cs[best][0], total + cs[best][3], used + 1
    df = spark.createDataFrame(rows, "doc_id int, mention_id int, cand_id string, cands long, pem double, csim double, sense_vec array<double>")
    assert {(r.doc_id, r.mention_id): r.cand_id for r in L.link_global(df.repartition(5), 4).collect()} == want


def test_link_global_with_senses_that_travel(spark):
    """The same links as with vectors in the rows, and none of them in the rows that are sorted; a candidate with two vectors keeps them."""
    draw = np.random.default_rng(3)
    vec = {c: None if c == "c5" else [float(x) for x in draw.normal(size=4)] for c in (f"c{k}" for k in range(6))}
    rows = []
    for doc in [*range(4), None]:
        for m in range(7):
            cands = sorted(draw.choice(6, int(draw.integers(1, 4)), replace=False).tolist())
            rows += [(doc, m, f"c{k}", len(cands), float(draw.uniform(0.1, 1)), float(draw.uniform(0, 1)), vec[f"c{k}"]) for k in cands]
    df = spark.createDataFrame(rows, "doc_id int, mention_id int, cand_id string, cands long, pem double, csim double, sense_vec array<double>")
    key = lambda r: (str(r.doc_id), r.mention_id, r.cand_id, r.score)
    want = sorted(map(key, L.link_global(df, 4).collect()))
    found = L.link_global(df.repartition(3), 4, senses=df)
    assert sorted(map(key, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[] AS sense_vec") == 2
    two = df.select("cand_id", "sense_vec").unionByName(spark.createDataFrame([("c0", [1.0, 0.0, 0.0, 0.0])], "cand_id string, sense_vec array<double>"))
    assert sorted(map(key, L.link_global(df, 4, senses=two).collect())) == want


def test_unit_vectors_work_the_norm_out_once(spark):
    from lorelink.functions.vectors import l2_normalize

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "vec array<double>")
    unit = df.select(l2_normalize(F.col("vec")).alias("vec"))
    assert [r.vec for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0], None, [0.0, 0.0]]
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_gradient_matches_finite_differences(spark):
    draw = np.random.default_rng(1)
    ins, outs = draw.normal(size=(3, 4)) * 0.3, draw.normal(size=(3, 4)) * 0.3
    examples = [(0, 1, 1.0, 2), (0, 2, 0.0, 1), (1, 1, 0.0, 1), (2, 0, 1.0, 3)]
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item int, vec array<double>")
    df = spark.createDataFrame(examples, "input int, output int, label double, n long")

    def gain(a, b):
        return sum(n * (np.log(1 / (1 + np.exp(-(a[i] @ b[o])))) if y else np.log(1 - 1 / (1 + np.exp(-(a[i] @ b[o]))))) for i, o, y, n in examples)

    got = {(r.side, r.item): r.grad for r in T.summed_gradients(T.gradients(df, frame(ins), frame(outs), 1.0), 4).collect()}
    for side, table in (("in", ins), ("out", outs)):
        for item in range(3):
            for k in range(4):
                up, down = table.copy(), table.copy()
                up[item, k] += 1e-5
                down[item, k] -= 1e-5
                slope = (gain(up, outs) - gain(down, outs) if side == "in" else gain(ins, up) - gain(ins, down)) / 2e-5
                assert got[side, item][k] == pytest.approx(slope, abs=1e-6)


def test_training_lowers_the_loss(spark):
    rows = [(a, b) for a in range(1, 5) for b in range(1, 5) if a != b and (a <= 2) == (b <= 2)] * 20
    skipgrams = spark.createDataFrame(rows, "center long, context long")
    words = spark.createDataFrame([(0, "</s>", 1), *[(i, f"w{i}", 40) for i in range(1, 5)]], "item_id long, item string, cn long")
    settings = R.Settings(dim=4, epochs=3, batches=2, negatives=2, alpha=0.5)
    items = words.select(R.spaced("w:", "item_id").alias("item"))
    inputs, outputs = T.init_inputs(items, 4, 1), T.init_outputs(items, 4)
    model = R.train([R.text_stage(skipgrams, words)], inputs, outputs, settings)
    pairs = skipgrams.select(R.spaced("w:", "context").alias("input"), R.spaced("w:", "center").alias("output"))
    apart = spark.createDataFrame([("w:1", "w:3"), ("w:2", "w:4"), ("w:3", "w:1")], "input string, negative string")
    judged = T.labelled_examples(pairs, apart)
    assert T.loss(judged, model.inputs, model.outputs).first().loss < T.loss(judged, inputs, outputs).first().loss


def test_induced_senses_separate_clusters(spark):
    rows = [(i, "t", [1.0, 0.02 * i]) for i in range(5)] + [(10 + i, "t", [-1.0, 0.02 * i]) for i in range(5)]
    contexts = spark.createDataFrame(rows, "context_id long, title string, vec array<double>")
    senses = spark.createDataFrame([("t", "kb", "E", [1.0, 0.0], 1)], "title string, sense_kind string, sense_key string, mu array<double>, cluster_size long")
    final, assigned = T.induce_senses(contexts, senses, 2, 0.0, 3)
    kinds = {r.context_id: r.kind for r in assigned.collect()}
    assert all(kinds[i] == "kb" and kinds[10 + i] == "nil" for i in range(5))
    assert {r.sense_key: r.cluster_size for r in final.collect()} == {"E": 6, "t#0": 5}


def test_tokenize_linked_text(spark):
    df = spark.createDataFrame([("see [[Rome|the old city]] and {{big m}} or [[A]] end",)], "line string")
    row = V.tokenize_linked_text(df).first()
    assert [t.token for t in row.tokens] == "see the old city and big m or A end".split()
    assert [(s.start_pos, s.length, s.kind, s.entity) for s in row.spans] == [(1, 3, "entity", "Rome"), (5, 2, "mention", None), (8, 1, "entity", "A")]


def test_sentences_are_cut(spark):
    df = spark.range(25).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), (F.col("id") + 100).alias("item_id"))
    got = {r.chunk: [x.item for x in r["items"]] for r in P.sentences(df, ["doc_id"], max_len=10).collect()}
    assert got == {0: list(range(100, 110)), 1: list(range(110, 120)), 2: list(range(120, 125))}
    assert P.skipgram_pairs(P.sentences(df, ["doc_id"], max_len=10), ["doc_id"], 2).count() == 2 * (17 * 2) + 7 * 2


def test_ranker_in_stretches(spark, tmp_path):
    inputs = ["a", "b"]
    data = [(float(i % 17), float(i * 7 % 23), float((i % 17) * (i * 7 % 23) % 5 > 2)) for i in range(400)]
    df = spark.createDataFrame(data, "a double, b double, label double")
    once = L.train_ranker(df, 6, 0.1, 3, inputs, stretch=6)
    plain = GBTRegressor(labelCol="label", stepSize=0.1, maxDepth=3, lossType="squared", maxIter=6, seed=1).fit(L.ranker_inputs(df, inputs))
    assert [m.totalNumNodes for m in once.stretches] == [plain.totalNumNodes]
    ranker = L.train_ranker(df, 15, 0.1, 3, inputs, stretch=6, path=str(tmp_path / "m"))
    assert [m.getNumTrees for m in ranker.stretches] == [6, 6, 3]
    errors = [r.mse for r in L.stretch_errors(ranker, df, inputs).orderBy("stretch").collect()]
    assert errors == sorted(errors, reverse=True) and errors[-1] < errors[0]
    scored = L.score_candidates(ranker, df, inputs).select("label", "score").collect()
    assert abs(sum((r.label - r.score) ** 2 for r in scored) / len(scored) - errors[-1]) < 1e-9
    again = L.train_ranker(df, 15, 0.1, 3, inputs, stretch=6, path=str(tmp_path / "m"))
    assert [m.uid for m in again.stretches] == [m.uid for m in ranker.stretches]
