"""Classes of alike texts against all pairs, also where shingles are crowded."""

import random

import pytest

import corpus_pipeline as cp
from lorelink.llm import alike

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts):
    """The least id of each component of likeness 0.8."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def corpus(seed):
    r = random.Random(seed)
    prose = lambda n: ["w%d" % r.randrange(3000) for _ in range(n)]
    license_, texts = prose(40), []
    for _ in range(25):
        base = prose(r.randint(12, 200))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 40)):
                copy[r.randrange(len(copy))] = "edit%d" % r.randrange(999)
            texts.append(" ".join(copy + prose(r.randint(0, 4))))
    texts += [" ".join(prose(r.randint(5, 40)) + license_) for _ in range(25)]
    return texts + [texts[0].upper(), texts[1], "a b", "a b", "A  b", "c", "", None, " \n"]


@pytest.mark.parametrize("crowd, several", [(200, 32), (4, 3)])
def test_against_all_pairs(spark, crowd, several):
    texts = corpus(1)
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {r.doc_id for r in alike.one_per_class(df, crowd=crowd, several=several).collect()} == brute(texts)


def test_stage_links_by_likeness(spark):
    texts = corpus(2)
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id for r in cp.simhash_near_dedup(spark, df, "").collect()} == brute(texts)
