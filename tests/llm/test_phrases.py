"""Collocations against counting everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lorelink.llm import phrases
from lorelink.llm.queries import op13_phrase_collocations


def by_definition(rows, often=30, top=2000, within=80):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= often}
    out = []
    for lang in total:
        mine = {p: a for (la, p), a in found.items() if la == lang}
        held = Counter()
        for p, a in mine.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held[p[i : i + n]], a)
        ranked = []
        for p, a in mine.items():
            if 100 * held[p] >= within * a:
                continue
            cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(rng, n=300, length=60):
    words = ["the", "of", "New", "York", "city", "über", "état", "a", "b", "c", "xx-y", "don't", *[f"w{i}" for i in range(60)]]
    fixed = ["New York city hall", "the state of the art", "c c c c c", "a b a b a b"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.15 else rng.choice(words[: rng.choice([5, 12, len(words)])]) for _ in range(rng.randrange(length))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "  ", "; "]) for p in parts)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + rows[:40] * 2


@pytest.mark.parametrize("often,top,bits", [(30, 2000, 20), (3, 25, 8)])
def test_collocations(spark, often, top, bits):
    rows = corpus(random.Random(often))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, core int, many string")
    got = sorted(map(tuple, phrases.collocations(docs, often, top, bits=bits).collect()))
    assert got == by_definition(rows, often, top) and len(got) > 20


def test_parse_covers_every_phrase_once():
    rng = np.random.default_rng(1)
    for trigger in (1, 2, 5, 1000):
        pieces = np.cumsum(rng.random(400) < 0.08)
        hashes = rng.integers(0, 6, 400).astype(np.uint64)
        at, core, length = phrases.parse(np.arange(400), pieces, hashes, trigger)
        for n in range(1, 5):
            want = [i for i in range(401 - n) if pieces[i] == pieces[i + n - 1]]
            got = [a + i for a, c, m in zip(at, core, length) for i in range(c) if i + n <= m]
            assert got == want
        assert all(pieces[a] == pieces[a + m - 1] for a, m in zip(at, length))


def test_equal_texts_share_chunks(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([("en", text)] * 50 + [("en", "other start " + text)] * 20, "lang string, text string")
    found = phrases.parsed(docs).collect()
    assert sum(r.many * r.core for r in found) == 50 * 400 + 20 * 402
    assert sum(r.many == 70 for r in found) > 0.7 * len(found)


def test_exact_arithmetic(spark):
    huge = 9_000_000_000_000_000_000
    rows = [("en", "a", huge, 1), ("en", "b", huge - 7, 1), ("en", "a b", huge - 9, 2), ("en", "a b a", huge - 9, 3), ("en", "b a", huge - 8, 2)]
    got = {r.phrase: tuple(r)[2:] for r in phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n long, words int")).collect()}
    assert got["a b"] == (2, huge - 9, huge, huge - 7, 2000000 * (huge - 9) // (2 * huge - 7))
    left, right = 2000000 * (huge - 9) // (huge + huge - 8), 2000000 * (huge - 9) // (huge - 9 + huge)
    assert got["a b a"][1:] == ((huge - 9, huge, huge - 8, left) if left <= right else (huge - 9, huge - 9, huge, right))


def test_edges(spark):
    schema = "lang string, text string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, ""), ("en", " .\n, ")], schema)).count() == 0
    rows = [("en", "x" * 300_000 + " " + "go on " * 40), (None, "go on. " * 30), ("en", "a " * 5000)]
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, schema)).collect()))
    assert got == by_definition(rows)


def test_query_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()
    got = sorted(map(tuple, op13_phrase_collocations(spark, folder).collect()))
    assert got == by_definition([tuple(d) for d in docs])
