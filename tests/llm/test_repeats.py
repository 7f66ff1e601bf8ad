"""Exact repeats against brute force, and the interval tree on small suffix arrays."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorelink.llm.common import packed_parts, unpacked
from lorelink.llm.repeats import interval_tree, maximal_repeats, repeat_groups, without_repeats

SCHEMA = "doc_id long, text string, kept string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(b for b, x in zip(t, gone) if not x)))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(r.randint(5, 30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [prose(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 20)
            parts += [s[a : a + r.randint(10, 120)], prose(r.randint(0, 9))]
        texts.append(" ".join(parts))
    return texts + texts[:3] + [texts[5]] * 4 + [None, "", "x", "ab" * 90, "a" * 150, texts[7] + texts[7]]


def got(spark, texts, **more):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    out = without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), **more).collect()
    assert len(out) == len(texts)
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(out, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed, length", [(1, 40), (2, 64)])
def test_against_brute_force(spark, seed, length):
    texts = corpus(seed)
    assert got(spark, texts, length=length) == brute(texts, length)


@pytest.mark.parametrize("largest", [50_000, 3])
def test_shorter_passages_are_told(spark, largest):
    texts = corpus(5)
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"_row": "odd"}).withColumns({"spans": F.lit(1), "_packed": F.lit(2), "row_key": F.lit("k"), "_x": F.lit(3)})
    out = sorted(without_repeats(frame, length=64, shorter=40, largest=largest).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out] == brute(texts, 64)
    assert [r.shares_passage for r in out] == [x[1] > 0 for x in brute(texts, 40)]
    assert {(r.spans, r._packed, r.row_key, r._x) for r in out} == {(1, 2, "k", 3)}


def test_long_repeats_in_three_places_with_a_shorter_passage(spark):
    """What is shared to the right of an anchor is alone longer than the shorter passage, in more than two contexts."""
    r = random.Random(9)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = prose(150)
    texts = [prose(30 + i) + shared[i:] + prose(50) for i in range(5)]
    want = brute(texts, 64)
    assert all(x[1] >= 140 for x in want) and got(spark, texts, length=64, shorter=24) == want


def test_crowded_grams_give_the_same(spark):
    texts = corpus(3)
    assert got(spark, texts, length=40, largest=3) == brute(texts, 40)


def test_crowded_gram_twice_in_a_window(spark):
    """A frequent line that stands twice in one window makes no repeat of what is around it."""
    r = random.Random(8)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = prose(14)
    texts = [prose(90) + line + line + prose(90) for _ in range(6)] + [prose(60) + "-" * 45 + prose(60) for _ in range(5)]
    want = brute(texts, 40)
    assert any(not x[1] for x in want) and got(spark, texts, length=40, largest=1) == want


def test_when_keys_are_too_many_to_travel(spark, monkeypatch):
    monkeypatch.setattr("lorelink.llm.repeats.fits_broadcast", lambda *_: False)
    texts = corpus(6)
    assert got(spark, texts, length=40) == brute(texts, 40)


def test_whole_characters_stay_readable(spark):
    shared = "é" * 3 + "".join(chr(200 + i % 50) for i in range(60))
    texts = ["\xe9" + shared + "\xe8 one", "\xea" + shared + "\xeb two"]
    for n_bytes, removed, spans, kept in got(spark, texts, length=50, characters=True):
        assert kept.decode() in ("éè one", "êë two") and removed == len(shared.encode())


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("lorelink.llm.repeats.CHUNK", 100)
    texts = [*corpus(4)[:20], " ".join(corpus(4)[:30])]
    assert got(spark, texts, length=40) == brute(texts, 40)


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(300))
    rows = [(None, text, None), (None, text, None), (1, "short", None)]
    out = without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.n_removed, r.n_spans) for r in out) == [(0, 0), (len(text), 1), (len(text), 1)]


def test_interval_tree_of_banana():
    # Suffixes in order: a ana anana banana na nana.
    assert interval_tree([1, 3, 0, 0, 2]) == [(3, 1, 2), (1, 0, 2), (2, 4, 5), (0, 0, 5)]


def test_groups_are_maximal_and_hold_all_occurrences():
    contexts = [(left[::-1].encode(), right.encode()) for left, right in [("1xy", "ABCD1"), ("2xy", "ABCD2"), ("3zy", "ABCE3"), ("4zz", "ABQ")]]
    groups = {(right, tuple(sorted(members))) for right, members in maximal_repeats(contexts, 4)}
    assert groups == {(4, ((0, 2), (1, 2))), (3, ((0, 2), (1, 2), (2, 1)))}


def test_group_members_name_every_place(spark):
    shared = "".join(chr(97 + i * 11 % 26) + str(i) for i in range(60))
    rows = [(i, f"{i * 7919} {shared} {i * 104729}", None) for i in range(5)]
    members, groups = repeat_groups(spark.createDataFrame(rows, SCHEMA), 100)
    places = members.join(groups.select("gram", "context", "number"), ["gram", "context"])
    assert {r.n for r in places.groupBy("gram", "number").count().withColumnRenamed("count", "n").collect()} == {5}


def test_packed_texts_are_unpacked_in_parts():
    texts = [b"a" * 500, b"", b"b" * 900, b"c" * 10, b"", b"d" * 2000]
    batch = pa.record_batch(
        [pa.array(range(6)), pa.array([pa.Codec("zstd").compress(t, asbytes=True) for t in texts], pa.binary()), pa.array(list(map(len, texts)))],
        names=["row", "_packed", "_size"],
    )
    parts = list(packed_parts(batch, 1000))
    assert [x for p in parts for x in p.column("row").to_pylist()] == list(range(6))
    assert b"".join(unpacked(p)[0].tobytes() for p in parts) == b"".join(texts)
    assert [len(unpacked(p)[0]) for p in parts] == [500, 910, 2000]
