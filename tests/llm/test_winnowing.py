"""Winnowing against its definition, the order of next documents, and the digest query."""

import hashlib
import random

import numpy as np
import pytest

from lorelink.llm import winnowing
from lorelink.llm.rolling import POSITION_BITS, Prefix

SCHEMA = "doc_id long, text string, fingerprint string"


def plain(text, k, w):
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return []
    if len(codes) < k:
        return [(0, int(Prefix(codes).slices(np.array([0]), np.array([len(codes)]))[0]))]
    h = Prefix(codes).grams(k)
    keys = [int(x) >> POSITION_BITS for x in h]
    chosen = []
    for i in range(max(1, len(h) - w + 1)):
        window = range(i, min(i + w, len(h)))
        best = max(window, key=lambda j: (-keys[j], j))
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [(j, int(h[j])) for j in chosen]


def texts():
    r = random.Random(4)
    some = ["", "a", "short", "é中😀" * 30, "ab" * 100, "x" * 300]
    return some + ["".join(r.choice("abc dé") for _ in range(r.randint(0, 400))) for _ in range(30)]


@pytest.mark.parametrize("k, w", [(5, 8), (16, 64), (3, 1)])
def test_against_definition(k, w):
    for (places, hashes), text in zip(winnowing.winnow(texts(), k, w), texts()):
        assert list(zip(places.tolist(), hashes.tolist())) == plain(text, k, w)


def test_long_text_in_pieces(monkeypatch):
    long = "".join(random.Random(1).choice("abcd ") for _ in range(900))
    monkeypatch.setattr(winnowing, "TOGETHER", 100)
    (places, hashes), = winnowing.winnow([long], 5, 8)
    assert list(zip(places.tolist(), hashes.tolist())) == plain(long, 5, 8)


def test_shared_passages_share_a_hash():
    passage = "a passage of more than window and gram together"
    a, b = winnowing.winnow([f"one {passage} two two two", f"zzz zzz zzz {passage}"], 8, 16)
    assert set(a[1].tolist()) & set(b[1].tolist())


def test_edited_halves(spark):
    rows = [(i * 7 % 101, t, "clash") for i, t in enumerate(texts())] + [(500, None, None), (3, "same id", None), (3, "same id two", None)]
    rows += [(None, "no id at all", None), (None, None, None)]
    out = winnowing.edited_halves(spark.createDataFrame(rows, SCHEMA).repartition(3), k=5, window=8).collect()
    assert len(out) == len(rows)
    tie = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    named = sorted(((i, t or "") for i, t, _ in rows if i is not None), key=lambda x: (-x[0], tie[x[1]]))
    want = []
    for (i, t), (_, n) in zip(named, named[1:] + named[:1]):
        h = len(t) // 2
        want.append((i, len(t), t[: len(t) - h] + n[:h], t, n))
    want += [(None, 12, "no id ", "no id at all", None), (None, 0, "", "", None)]

    def row(i, n, edited, t, follow):
        sets = [{x for _, x in plain(y or "", 5, 8)} for y in (t, edited, follow)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        names = ["".join(f"{x >> 32:08x}" for _, x in plain(y, 5, 8)) for y in (t, edited)]
        return (i, n, hashlib.sha256(edited.encode()).hexdigest(), *names, like(sets[0], sets[1]), None if follow is None else like(sets[0], sets[2]))

    assert sorted(map(tuple, out), key=repr) == sorted((row(*w) for w in want), key=repr)


def test_one_document_and_none(spark):
    one = winnowing.edited_halves(spark.createDataFrame([(1, "abcdef", None)], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0
    assert winnowing.edited_halves(spark.createDataFrame([], SCHEMA)).collect() == []
    found = winnowing.fingerprints(spark.createDataFrame([(1, "x" * 100, "f"), (2, None, "g")], SCHEMA)).collect()
    assert [(r.fingerprint, len(r.hashes)) for r in found] == [("f", len(plain("x" * 100, 16, 64))), ("g", 0)]


def test_short_texts_with_equal_halves_are_near(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(46, 120))), "") for i in range(60)]
    out = winnowing.edited_halves(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 60 and all(x.near_edited > 0 for x in out)
