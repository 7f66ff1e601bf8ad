"""SimHash classes against brute force over all pairs."""

import random
import re
from collections import Counter

import pytest
import xxhash

from lorelink.llm import simhash
from lorelink.llm.components import components
from lorelink.llm.queries import op2_simhash_near_duplicates

SCHEMA = "doc_id long, text string, fp string"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance=3):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                a_, b_ = sorted((root(a), root(b)))
                parent[b_] = a_
    return {f: root(f) for f in every}


def cloud(seed, n=400):
    """Fingerprints in chains and dense groups."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n // 2)}
    for _ in range(6):
        f = r.getrandbits(64)
        for _ in range(n // 12):
            out.add(f)
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
    return out


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def check_links(spark, fps, **more):
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    rows = components(simhash.near_links(df, **more)).collect()
    groups, roots = {}, classes(fps, more.get("distance", 3))
    for f in fps:
        groups.setdefault(roots[f], set()).add(signed(f))
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    for r in rows:
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == want and all(min(g) == root for root, g in got.items())


def test_links_against_all_pairs(spark):
    check_links(spark, cloud(1, 200))


def test_crowded_halves_give_the_same(spark):
    check_links(spark, cloud(2, 120), crowd=2)


@pytest.mark.parametrize("distance, crowd", [(5, 10_000), (5, 1), (2, 1), (7, 2)])
def test_other_distances(spark, distance, crowd):
    check_links(spark, cloud(distance, 120), distance=distance, crowd=crowd)


def test_links_carried_over_batches(spark):
    """One half shared by many fingerprints, in small batches."""
    r = random.Random(5)
    low = r.getrandbits(32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        check_links(spark, {low | r.getrandbits(7) << 32 for _ in range(60)} | {low ^ 1 | 5 << 32})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark, tmp_path):
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("the of Tree River and stone moon É x").lower() + str(r.randint(0, 30)) for _ in range(n))
    base = [prose(150) for _ in range(12)]
    texts = base + [b.upper() for b in base[:3]] + [b + " end" for b in base[3:6]] + [base[7]] * 5
    texts += [None, "", " \t\n", "one", "one two", "One  two", "x" * 5000, " ".join(["again"] * 9000)]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)] + [(0, base[0], "clash")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    fps = {i: fingerprint(t) for i, t, _ in rows}
    roots = classes(fps.values())
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    got = [(x.doc_id, x.fingerprint, x.component_id) for x in op2_simhash_near_duplicates(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter((i, f"{fps[i]:016x}", least[roots[fps[i]]]) for i, _, _ in rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = simhash.one_per_class(docs).collect()
    assert sorted(x.doc_id for x in kept) == sorted(least.values()) and kept[0].fp == "clash"


def test_null_ids_and_empty_table(spark):
    assert simhash.near_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d", None), (None, "a b c d", None), (None, "other words are here", None), (4, "other words are here", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(r.component_id) for r in simhash.near_classes(df).collect()) == ["4", "4", "None", "None"]
    assert sorted((str(r.doc_id), r.text) for r in simhash.one_per_class(df).collect()) == [("4", "other words are here"), ("None", "a b c d")]
