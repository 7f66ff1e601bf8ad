"""Loss differences against plain counting, and held-out texts of two kinds."""

import math
import random
from collections import Counter

from lorelink.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, good boolean, difference string"


def rows(seed, n=60):
    r = random.Random(seed)
    kinds = ["the river runs under stone bridges at night".split(), "buy cheap pills now with free shipping today".split()]
    out = []
    for i in range(n):
        words = kinds[i % 2]
        out.append((i, " ".join(r.choice(words if r.random() < 0.9 else kinds[1 - i % 2]) for _ in range(r.randint(3, 60))), i % 2 == 0 if i % 3 else None, "clash"))
    return out


def test_against_plain_counts(spark):
    data = rows(1) + [(100, None, True, ""), (101, "", None, ""), (102, " \n", None, ""), (103, "Stone STONE " * 5000, True, ""), (0, rows(1)[0][1], True, "")]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = lm.score(df, lm.fit(df, "good", bigram_bits=22)).collect()
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    pairs = {}
    for i, (_, t, good, _) in enumerate(data):
        words = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        pairs[i] = list(zip(["<s>", *words], words))
        for m in (0, 1) if good else (1,):
            uni[m].update(words)
            bi[m].update(pairs[i])
    total = [sum(u.values()) for u in uni]
    vocabulary = len(uni[1])

    def loss(m, before, word):
        scale = 1 if m == 0 else total[0] / total[1]
        p = (uni[m][word] * scale + lm.ADDED) / (total[m] * scale + lm.ADDED * vocabulary)
        history = uni[m][before] * scale
        return -math.log2((min(bi[m][before, word] * scale, history) + lm.PRIOR * p) / (history + lm.PRIOR))

    want = sorted((data[i][0], len(p), *(sum(loss(m, *x) for x in p) / len(p) if p else None for m in (0, 1))) for i, p in pairs.items())
    assert len(out) == len(want)
    for r, (i, n, target, background) in zip(sorted(out, key=lambda r: (r.doc_id, r.n_tokens)), want):
        assert (r.doc_id, r.n_tokens) == (i, n)
        if n:
            assert math.isclose(r.target_bits, target, abs_tol=1e-3) and math.isclose(r.background_bits, background, abs_tol=1e-3)
            assert math.isclose(r.difference, target - background, abs_tol=2e-3)
        else:
            assert r.difference is None


def test_held_out_texts_are_told_apart(spark):
    models = lm.fit(spark.createDataFrame([(i, t, i % 2 == 0, "") for i, t, _, _ in rows(2, 200)], SCHEMA), "good")
    out = lm.score(spark.createDataFrame(rows(3), SCHEMA), models).collect()
    assert all((r.difference < 0) == (r.doc_id % 2 == 0) for r in out if r.n_tokens > 10)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    models = lm.fit(empty, "good", unigram_bits=8, bigram_bits=9)
    assert lm.score(empty, models).collect() == []
    assert lm.score(spark.createDataFrame([(1, "a b", None, "")], SCHEMA), models).collect()[0].difference == 0.0


def test_pairs_of_a_large_vocabulary_share_no_counts(spark):
    """Very many word pairs: every pair keeps its own count, in known and in new documents."""
    data = [(i, " ".join(f"w{i}x{j}" for j in range(20000)), i % 2 == 0, "") for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    models = lm.fit(df, "good")
    assert models.pairs.count() == models.vocabulary == 600_000 and models.pairs.filter("b != 1").isEmpty()
    known = {r.doc_id: r.difference for r in lm.score(df.filter("doc_id < 4"), models, counted=True).collect()}
    fresh = {r.doc_id: r.difference for r in lm.score(df.filter("doc_id < 4"), models).collect()}
    assert len(known) == 4 and all(math.isclose(known[i], fresh[i], abs_tol=1e-9) for i in known)


def test_corpus_by_its_own_models(spark, monkeypatch):
    """As the table of all pairs scores it, whatever tasks know: copies, hot words, long, empty and null texts, clashing names."""
    data = rows(4, 80) + [(100, None, True, ""), (101, "", None, ""), (102, " \n", None, ""), (103, "Stone STONE " * 5000, True, ""), (None, "x" * 300_000, True, "")]
    data += [rows(4, 80)[1]] * 40 + [(200 + i, f"{i} the unique{i} the river", i % 2 == 0, None) for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = lm.score(df, lm.fit(df, "good"), counted=True).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.good is None, bool(r.good))
    for known, foremost in ((1 << 18, 512), (4, 2), (0, 0)):
        monkeypatch.setattr(lm, "KNOWN", known)
        monkeypatch.setattr(lm, "FOREMOST", foremost)
        out = lm.score_corpus(df, "good")
        assert out.columns == ["doc_id", "good", "n_tokens", "target_bits", "background_bits", "difference"]
        got = out.collect()
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
            assert key(a) == key(b)
            for c in ("target_bits", "background_bits", "difference"):
                assert (a[c] is None) == (b[c] is None) and (a[c] is None or math.isclose(a[c], b[c], abs_tol=1e-9))
    assert lm.score_corpus(spark.createDataFrame([], SCHEMA), "good").collect() == []
