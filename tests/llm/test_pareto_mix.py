"""Targets against water filling step by step, inclusion probabilities, and what the mix takes."""

import random
from collections import defaultdict

from lorelink.llm import pareto_mix as pm

SCHEMA = "doc_id long, text string, source string, size string"


def fill(sizes, weights, share, cap=2.0):
    total, full = share * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in full}
        level = (total - sum(full.values())) / sum(free.values()) if free else 0
        above = {s for s, w in free.items() if w * level > cap * sizes[s]}
        if not above:
            return full | {s: w * level for s, w in free.items()}
        full |= {s: cap * sizes[s] for s in above}


def docs(spark, n=600):
    r = random.Random(2)
    rows = []
    for i in range(n):
        source = r.choice(["a"] * 8 + ["b", "B", "ä", "c", None])
        rows.append((i, " ".join(["w"] * int(r.paretovariate(0.9) * 5)), source, "clash"))
    rows += [(n, None, "a", ""), (n + 1, " \t", "c", ""), (n + 2, "", "empty", ""), (5, rows[5][1], rows[5][2], "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_mix(spark):
    df = docs(spark)
    goals = pm.weighted_targets(df, (5.0, 2.0, 1.0), 1.5)
    out = pm.mixed(df, goals, bin_rows=20).collect()
    again = pm.mixed(df.repartition(7), goals, bin_rows=50).collect()
    assert sorted(out, key=repr) == sorted(again, key=repr) and len(out) == 604
    sizes, taken, largest, targets = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        targets[r.source] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5)
    assert all(r.source_size == sizes[r.source] for r in out)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6
        assert abs(taken[s] - targets[s]) <= largest[s]


def test_inclusion_follows_the_probabilities(spark):
    """Over many seeds a document is taken about as often as expected, long ones more often."""
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "a", "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    goals = spark.createDataFrame([("+a", 1360, 680.0)], "source_key string, source_size long, target double")
    counts = defaultdict(int)
    for seed in range(6):
        for r in pm.mixed(df, goals, seed=seed).collect():
            counts[r.size] += r.copies
    assert 0.35 < counts[64] / 120 < 0.65 and 0.08 < counts[4] / 120 < 0.45


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pm.mixed(empty, pm.weighted_targets(empty, (1.0,), 1.5)).collect() == []
    bare = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    out = pm.mixed(bare, pm.weighted_targets(bare, (3.0,), 3.0)).collect()
    assert [(r.size, r.copies, r.target) for r in sorted(out)] == [(2, 2, 6.0), (1, 2, 6.0)]
