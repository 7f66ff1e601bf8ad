"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lorelink.llm import runs
from lorelink.llm.queries import op11_periodic_runs
from lorelink.llm.suffix_tree import Extensions


def by_definition(words, times=4, least=6):
    n, found = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            part = words[i : i + length]
            if j > i and length >= max(least, times * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    kind = rng.randrange(4)
    letters = "ab" if kind < 2 else "abcde"
    words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(3)):
        root = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = root * rng.randrange(2, 8) + root[: rng.randrange(len(root))]
    return words


def test_common_extensions():
    rng = random.Random(1)
    for _ in range(60):
        s = np.array([rng.randrange(1, 3) for _ in range(rng.randrange(1, 40))] + [0])
        tree = Extensions(s, 3)
        pairs = [(i, j) for i in range(len(s) + 1) for j in range(len(s) + 1) if i != j]
        want = [next(k for k in range(len(s) + 1) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]) for i, j in pairs]
        i, j = np.array(pairs).T
        assert tree.common(i, j).tolist() == want


def test_runs_of_sequences():
    rng = random.Random(2)
    for times, least in ((4, 6), (2, 2), (3, 1)):
        for _ in range(150):
            texts = [random_words(rng) or ["a"] for _ in range(rng.randrange(1, 4))]
            got = runs.runs_of([np.array([ord(w) - 97 for w in t]) for t in texts], times, least)
            want = [(k, *r) for k, t in enumerate(texts) for r in by_definition(t, times, least)]
            assert sorted(zip(*[c.tolist() for c in got])) == sorted(want)


def test_live_stretches_keep_all_runs():
    rng = random.Random(3)
    for pooled in (8, 1 << 14):
        for _ in range(150):
            texts = [random_words(rng) for _ in range(rng.randrange(1, 5))]
            ids = np.array([ord(w) - 97 for t in texts for w in t], np.int64)
            rows = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
            got = list(zip(*[c.tolist() for c in runs.text_runs(ids, rows, pooled)]))
            base, want = 0, []
            for t in texts:
                want += [(s + base, n, p) for s, n, p in by_definition(t)]
                base += len(t)
            assert got == want


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = by_definition(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(left))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_definition(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(random_words(rng))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "x " * 3000), (304, "é ü é ü é ü é ü"), (None, "a a a a a a a"), (None, None), (5, "b b b b b b"), (5, "b b b b b b")]
    spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, _row int, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path)).select(*NAMES).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(*r)) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 100


def test_query_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id: d.text for d in docs if len(d.text or "") < 6000}
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, folder).select(*NAMES).collect()}
    assert len(got) == len(docs)
    for doc_id, text in short.items():
        assert got[doc_id] == expected(doc_id, text)


def test_operator_edges(spark):
    schema = "id long, text string, collapsed string, `odd.name` int"
    assert runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    long_ = "x" * 300_000
    rows = [(1, "go " * 9 + long_, "old", 3), (2, None, None, None)]
    got = sorted(runs.periodic_runs(spark.createDataFrame(rows, schema)).collect())
    assert [r["odd.name"] for r in got] == [3, None]
    assert got[0].collapsed == "go " + long_ and tuple(got[0].best) == (0, 9, 1) and got[1].best is None and got[1].collapsed == ""
    # Ties: equal exponents go to the first run, and the longer exponent wins over the longer run.
    tied = spark.createDataFrame([(1, "a a a a a a x b b b b b b y c d c d c d c d c d"), (2, "c d c d c d c d z a a a a a a a")], "id long, text string")
    assert [tuple(r.best) for r in sorted(runs.periodic_runs(tied).select("id", "best").collect())] == [(0, 6, 1), (9, 7, 1)]


@pytest.mark.parametrize("n", [60_000])
def test_long_periodic_text(spark, n):
    rng = random.Random(5)
    root = [f"w{rng.randrange(900)}" for _ in range(n // 6)]
    words = ["start"] + (root * 7)[:n] + ["end"]
    got = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "id long, text string")).first()
    assert tuple(got.best) == (1, n, len(root)) and got.collapsed.split(" ") == ["start", *root, "end"]
