"""Alias tables and block-partitioned training steps against plain computations."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorelink.operators import block_training as B
from lorelink.operators import vocab as V
from lorelink.plans import train as R


def alias_shares(spark, weights):
    total = sum(weights)
    frame = spark.createDataFrame([(10 * i, w / total) for i, w in enumerate(weights)], "item_id long, p double")
    rows = V.alias_table(frame.repartition(5)).collect()
    mass = Counter()
    for r in rows:
        assert 0 <= r.keep <= r.full
        mass[r.own] += r.keep
        mass[r.other] += r.full - r.keep
    return frame, rows, mass


@pytest.mark.parametrize("seed", [1, 2])
def test_alias_table_has_every_weight_exactly(spark, seed):
    draw = np.random.default_rng(seed)
    weights = (draw.pareto(0.9, 300) + 0.01).tolist() + [1.0, 1.0]
    frame, rows, mass = alias_shares(spark, weights)
    n, whole = len(rows), {10 * i: round(w / sum(weights) * V.ALIAS_WEIGHT) for i, w in enumerate(weights)}
    assert n == len(weights) and sorted(r.cell for r in rows) == list(range(n))
    # Rounding of p happens in the engine; one unit of 2^36 at most.
    assert all(abs(mass[i] - w * n) <= n for i, w in whole.items()) and sum(mass.values()) == n * rows[0].full


@pytest.mark.parametrize("weights", [[1.0], [1.0] * 8, [1.0, 0.0, 3.0], [5.0, 1.0, 1.0, 1.0], [1.0, 1e-13, 1.0]])
def test_alias_table_edges(spark, weights):
    _, rows, mass = alias_shares(spark, weights)
    assert len(rows) == sum(w > 1e-12 for w in weights)
    assert all(mass[10 * i] / (len(rows) * rows[0].full) == pytest.approx(w / sum(weights), abs=1e-9) for i, w in enumerate(weights))


def test_empty_alias_table(spark):
    assert V.alias_table(spark.createDataFrame([], "item_id long, p double")).count() == 0


def test_alias_table_of_many_items_does_not_grow_with_their_square(spark):
    ids = spark.range(120_000).select(F.col("id").alias("item_id"), (1 + F.pmod(F.xxhash64("id"), F.lit(1000))).alias("w"))
    total = ids.agg(F.sum("w")).first()[0]
    begun = time.time()
    table = V.alias_table(ids.select("item_id", (F.col("w") / total).alias("p")).coalesce(1))
    assert table.count() == 120_000 and time.time() - begun < 60
    mass = table.select(F.explode(F.array(F.struct(F.col("own").alias("item_id"), F.col("keep").alias("m")), F.struct(F.col("other").alias("item_id"), (F.col("full") - F.col("keep")).alias("m")))).alias("_s"))
    shares = mass.groupBy("_s.item_id").agg(F.sum("_s.m").alias("m")).join(ids, "item_id")
    full = table.first().full
    assert shares.filter(F.abs(F.col("m") / 120_000 / full - F.col("w") / total) > 1e-9).count() == 0


def test_examples_have_no_null_vectors(spark):
    params = B.start(*[spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "item string, vec array<double>")] * 2, 4)
    examples = spark.createDataFrame([("a", "b", 1.0, 2)], "input string, output string, label double, n long")
    plan = B.pair_gradients(examples, params, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "null AS other" in plan and "null AS vec" not in plan


def test_draws_in_are_draws_out_and_hits(spark):
    weights = [8.0, 4.0, 2.0, 1.0, 1.0]
    frame, _, _ = alias_shares(spark, weights)
    positives = spark.range(4000).select("id", F.lit(10).cast("long").alias("positive"))
    out = V.draw_negatives(positives, frame, 5, 3, ["id"])
    counts = {r.negative: r["count"] for r in out.groupBy("negative").count().collect()}
    assert 10 not in counts and out.filter("positive <> 10").count() == 0
    every = V.draw_negatives(positives.withColumn("positive", F.lit(-1).cast("long")), frame, 5, 3, ["id"])
    hits = every.filter("negative = 10").count()
    assert every.count() == 20_000 and out.count() == 20_000 - hits
    # Id 0 stands for the sentence end, which a uniform other id replaces.
    assert hits == pytest.approx(20_000 * 4 / 16, rel=0.06) and 0 not in counts


def test_step_matches_plain_arithmetic(spark):
    draw = np.random.default_rng(4)
    n, dim, blocks = 30, 5, 4
    ins, outs = draw.normal(size=(n, dim)), draw.normal(size=(n, dim))
    ins[0] *= 40  # saturates
    pairs = [(int(a), int(b), float(y), int(c)) for a, b, y, c in zip(draw.integers(0, n, 400), draw.integers(0, n, 400), draw.integers(0, 2, 400), draw.integers(1, 9, 400))]
    frame = lambda m: spark.createDataFrame([(f"x{i}", [float(x) for x in v]) for i, v in enumerate(m)], "item string, vec array<double>")
    examples = spark.createDataFrame([(f"x{a}", f"x{b}", y, c) for a, b, y, c in pairs] + [("x1", "nowhere", 1.0, 3)], "input string, output string, label double, n long")
    params = B.start(frame(ins), frame(outs), blocks)
    squares = {"in": np.zeros(n), "out": np.zeros(n)}
    tables = {"in": ins.copy(), "out": outs.copy()}
    for alpha in (0.5, 0.25):
        params = B.updated(params, B.pair_gradients(examples.repartition(3), params, blocks), alpha, blocks)
        grads = {"in": np.zeros((n, dim)), "out": np.zeros((n, dim))}
        for a, b, y, c in pairs:
            f = tables["in"][a] @ tables["out"][b]
            p = 1.0 if f > 6 else 0.0 if f < -6 else 1 / (1 + np.exp(-f))
            grads["in"][a] += (y - p) * c * tables["out"][b]
            grads["out"][b] += (y - p) * c * tables["in"][a]
        for name in ("in", "out"):
            squares[name] += (grads[name] ** 2).sum(axis=1) / dim
            some = squares[name] > 0
            tables[name][some] += alpha * grads[name][some] / np.sqrt(squares[name][some])[:, None]
    got = {(r.side, r.item): r for r in params.collect()}
    assert len(got) == 2 * n
    for name in ("in", "out"):
        for i in range(n):
            assert got[name, f"x{i}"].vec == pytest.approx(tables[name][i], abs=1e-9)
            assert got[name, f"x{i}"].squares == pytest.approx(squares[name][i], abs=1e-9)


def test_planted_clusters_separate(spark):
    """Words that occur together end up closer than words that never do."""
    rows = [(a, b) for a in range(1, 9) for b in range(1, 9) if a != b and (a <= 4) == (b <= 4)] * 30
    skipgrams = spark.createDataFrame(rows, "center long, context long")
    words = spark.createDataFrame([(0, "</s>", 1), *[(i, f"w{i}", 40) for i in range(1, 9)]], "item_id long, item string, cn long")
    settings = R.Settings(dim=6, epochs=6, batch_pairs=250, negatives=3, alpha=0.2)
    stage = R.text_stage(skipgrams, words)
    assert R._prepared(stage, settings).batches == 3
    items = words.select(R.spaced("w:", "item_id").alias("item"))
    from lorelink.operators import training as T

    model = R.train([stage], T.init_inputs(items, 6, 1), T.init_outputs(items, 6), settings)
    v = {r.item: np.array(r.vec) / np.linalg.norm(r.vec) for r in model.inputs.collect()}
    inside = [v[f"w:{a}"] @ v[f"w:{b}"] for a in range(1, 9) for b in range(1, a) if (a <= 4) == (b <= 4)]
    across = [v[f"w:{a}"] @ v[f"w:{b}"] for a in range(1, 5) for b in range(5, 9)]
    assert min(inside) > max(across)
