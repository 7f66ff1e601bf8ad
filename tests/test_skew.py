"""The skew-safe forms give what the plain forms give."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorelink.operators import skew as S


@pytest.fixture
def fact(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["hot", "hot", "hot", "a", "b", f"k{i}"]), i, draw.randint(-3, 3) / 4) for i in range(600)]
    return spark.createDataFrame(rows, "k string, i int, s double")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, fact, how):
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3)], "k string, v int")
    hot = S.hot_keys(fact.groupBy("k").count(), ["k"], "count", 50)
    assert hot.first()["_slices"] > 1
    got = S.salted_join(fact, dim, ["k"], hot, how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fact.join(dim, "k", how).select(*got.columns).collect()))


def test_sequential_ids(fact):
    got = S.sequential_ids(fact, [F.desc("s"), F.asc("i")], "n", 1).orderBy("n").collect()
    want = sorted(((r.k, r.i, r.s) for r in fact.collect()), key=lambda r: (-r[2], r[1]))
    assert [(r.k, r.i, r.s) for r in got] == want and [r.n for r in got] == list(range(1, 601))


@pytest.mark.parametrize("width", [7, 100_000])
def test_running_total(fact, width):
    numbered = fact.withColumn("step", F.row_number().over(W.partitionBy("k").orderBy("i")))
    got = S.running_total(numbered, ["k"], "step", "i", "t", width)
    plain = numbered.withColumn("w", F.sum("i").over(W.partitionBy("k").orderBy("step").rowsBetween(W.unboundedPreceding, 0)))
    assert got.join(plain.select("i", "w"), "i").filter("t <> w").count() == 0 and got.count() == 600


@pytest.mark.parametrize("limit", [1, 50, 1000])
def test_min_rank_long_and_short(fact, limit):
    sized = fact.withColumn("size", F.count("*").over(W.partitionBy("k"))).withColumn("z", F.col("i") % 5 / 5.0)
    got = S.min_rank_within(sized, ["k"], "i", {"s": "r", "z": "q"}, "size", limit=limit)
    for score, rank in (("s", "r"), ("z", "q")):
        want = sized.withColumn("w", F.rank().over(W.partitionBy("k").orderBy(F.desc(score))))
        assert got.join(want.select("i", "w"), "i").filter(F.col(rank) != F.col("w")).count() == 0
    assert got.count() == 600


def test_best_per_key_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("b", 5, None), ("b", 6, -3.0)], "k string, i int, s double")
    assert {r.k: r.i for r in S.best_per_key(df, ["k"], "s", "i").collect()} == {"a": 1, "b": 6}
