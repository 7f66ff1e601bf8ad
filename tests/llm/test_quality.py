"""Quality rules: counts against plain Python, distances against the formula, and the SQL."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from lorelink.llm import quality
from lorelink.llm.queries import OP8_SQL, op8_quality_rules
from tests.oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, kept string, _words string"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def texts():
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice("the of and river stone Über größe 中文 moon 12 x#y").lower() + r.choice(["", ",", "."]) for _ in range(n))
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "River", "stone", "Über", "größe", "中文", "12", "x#y"]) + r.choice(["", ",", "."]) for _ in range(n))
    some = [prose(r.randint(1, 200)) for _ in range(25)]
    some += [prose(30) + "\n" + prose(5) + "\n\n \n" + prose(5), "\n".join([some[0][:60]] * 4), " ".join(["again"] * 9000), "a b c d e f a b c d e f", "x" * 20000]
    return some + [None, "", " \t\n\x0b", "ONE TWO THREE " * 40, "### $$$ ||| " * 60]


def test_counts(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "clash", "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    out = quality.judged(df).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(rows[r.doc_id][1])
        assert not (r.base_failed and r.kept)
    assert quality.judged(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(quality.judged(df.select("doc_id", "text")).collect()) == len(out)


def test_distances(spark):
    limits = quality.Limits(common_words=3, class_chars=1, word_words=1)
    rows = [(1, "the the of xx", "en", "", ""), (2, "THE of of yy zz and", "en", "", ""), (3, "uno dos", "es", "", "")]
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SCHEMA), limits).collect()}

    def distance(p, q):
        term = lambda a, b: (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
        return math.sqrt(max(0.0, sum(term(a, b) for a, b in zip(p, q)) / 2))

    # Of the ten English words: of 3, the 3, and 1 (first by order among single ones).
    q = [0.3, 0.3, 0.1, 0.3]
    assert math.isclose(out[1].word_distance, distance([1 / 4, 2 / 4, 0, 1 / 4], q), abs_tol=1e-12)
    assert math.isclose(out[2].word_distance, distance([2 / 6, 1 / 6, 1 / 6, 2 / 6], q), abs_tol=1e-12)
    assert math.isclose(out[3].word_distance, 0, abs_tol=1e-9) and math.isclose(out[3].class_distance, 0, abs_tol=1e-9)
    both = [(10, 3, 0), (11, 5, 3)]  # lower case, spaces, upper case
    shares = [sum(c) / 32 for c in zip(*both)]
    assert math.isclose(out[1].class_distance, distance([c / 13 for c in both[0]], shares), abs_tol=1e-12)


def test_plain_words_of_a_text_are_those_of_its_words(spark):
    odd = ["\"The' cat. -- sat, (on) the.mat!\n\x0b- x -y- ;z", "...", "- - -", " .the 'the-the \t", "ΑΣ ΣΑΣ. İstanbul,\tΟΔΟΣ", "a . . b", ".,a b;! c"]
    df = spark.createDataFrame([(t,) for t in texts() + odd if t is not None], "text string")
    one_by_one = F.filter(F.transform(quality.split_words(F.col("text")), quality.plain_word), lambda w: w != "")
    for r in df.select(one_by_one.alias("a"), F.filter(quality.plain_words(F.col("text")), lambda w: w != "").alias("b")).collect():
        assert r.a == r.b
    began = time.time()
    rows = spark.createDataFrame([("-" * 400_000 + " the",)], "text string").select(quality.plain_words(F.col("text")).alias("w"))
    assert rows.first().w == ["", "the"] or rows.first().w == ["the"]
    assert time.time() - began < 20


def test_query_against_sql(spark, folder):
    assert compare(spark, connect(folder), folder, op8_quality_rules, OP8_SQL)[0] is None
