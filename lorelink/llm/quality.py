"""Quality rules: counts of a text, and how far its histograms are from those of its language.

Everything is DataFrame expressions. A text is compared with its language twice,
by the Jensen-Shannon distance (base 2, so 0 to 1) of character classes and of
the most common words. The references are taken from all texts of the language.
Short texts have histograms too rough to judge by, so each test has a least length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorelink.llm.common import text_or_empty
from lorelink.operators.skew import fits_broadcast
from lorelink.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
PUNCTUATION = ".,;:!?\"'()-"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """``kept`` needs all of these; a distance counts from the least length on."""

    least_words: int = 10
    repeat_percent: int = 20
    common_words: int = 48
    class_chars: int = 200
    class_distance: float = 0.22
    word_words: int = 60
    word_distance: float = 0.5


# Removed from a text one after the other; what is left is the last class.
CLASSES = {"lower": r"\p{Ll}+", "space": SPACE, "upper": r"\p{Lu}+", "digit": "[0-9]+", "symbol": SYMBOLS, "mark": r"[.,;:!?\"'()\-]+"}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found more than once."""
    last = F.size(words) - window

    def hashed(codes: Column) -> Column:
        """The hash of each window, from the hashes of its words."""
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(window)]))

    grams = F.when(last >= 0, _let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(F.array().cast("array<bigint>"))

    def places(sorted_: Column) -> Column:
        """Starts of windows that have an equal neighbour in hash order."""
        n = F.size(sorted_)
        ahead = F.zip_with(sorted_, F.slice(sorted_, 2, n), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        behind = F.concat(F.array(F.lit(False)), ahead)
        paired = F.zip_with(F.arrays_zip(sorted_.alias("s"), ahead.alias("a")), behind, lambda x, b: F.when(x["a"] | b, x["s"]["i"]))
        return F.array_sort(F.array_compact(paired))

    def covered(starts: Column) -> Column:
        steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(g: Column) -> Column:
        indexed = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(
            F.size(F.array_distinct(g)) < F.size(g), _let(F.sort_array(indexed), lambda s: _let(places(s), covered))
        ).otherwise(0)

    return _let(grams, count).cast("long")


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, the words and class counts.

    A null text is empty and has zero counts; a null or missing language is the language "".
    """
    body = text_or_empty(text)
    language = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")
    rows = docs.withColumns({"_text": body, "_lang": language}).withColumn("_words", split_words(F.col("_text")))
    left, before = F.col("_text"), F.char_length("_text")
    lengths = {}
    for number, (name, pattern) in enumerate(CLASSES.items()):
        rows = rows.withColumn(f"_left{number}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"_left{number}")
        lengths[name] = before - F.char_length(left)
        before = F.char_length(left)
    lengths["other"] = before
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.char_length(F.regexp_replace(x, SPACE, "")) > 0)
    rows = rows.withColumn("_lines", lines).withColumns({f"_class_{n}": c.cast("long") for n, c in lengths.items()})
    return rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.char_length("_text") - F.col("_class_space")).cast("long"),
            "n_symbols": F.col("_class_symbol"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    ).drop("_lines", *[f"_left{i}" for i in range(len(CLASSES))])


def plain_word(word: Column) -> Column:
    """The form in which words are counted: lower case, without marks at the ends."""
    return F.trim(F.lower(word), F.lit(PUNCTUATION))


def language_references(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(_lang, class_share, common, common_share, by_length): one row per language, from all its texts.

    ``common`` are the most frequent words (ties by the word), in order of length, with their share of all
    words. ``by_length`` has, for each length from 0 on, the words of this length and how many come before them.
    """
    language = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")
    rows = docs.select(language.alias("_lang"), text_or_empty(text).alias("_text"))
    left, before, counts = F.col("_text"), F.char_length("_text"), []
    for number, (name, pattern) in enumerate(CLASSES.items()):
        rows = rows.withColumn(f"_left{number}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"_left{number}")
        counts.append(F.sum(before - F.char_length(left)).alias(name))
        before = F.char_length(left)
    counts.append(F.sum(before).alias("other"))
    classes = rows.groupBy("_lang").agg(*counts)
    names = [*CLASSES, "other"]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    classes = classes.filter(total > 0).select("_lang", F.array(*[F.col(n) / total for n in names]).alias("class_share"))

    words = rows.select("_lang", F.explode(split_words(F.col("_text"))).alias("word")).groupBy("_lang", "word").agg(F.count(F.lit(1)).alias("n"))
    plain = cut_lineage(words.groupBy("_lang", plain_word(F.col("word")).alias("word")).agg(F.sum("n").alias("n")))
    totals = plain.groupBy("_lang").agg(F.sum("n").alias("all"))
    # The most frequent of each of 64 parts first, so that no language is sorted in one task.
    order = [F.desc("n"), F.asc("word")]
    part = plain.filter("word != ''").withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(64)))
    part = part.withColumn("_r", F.row_number().over(W.partitionBy("_lang", "_part").orderBy(*order))).filter(F.col("_r") <= limits.common_words)
    top = part.withColumn("rank", F.row_number().over(W.partitionBy("_lang").orderBy(*order))).filter(F.col("rank") <= limits.common_words)
    shares = top.join(totals, "_lang").groupBy("_lang").agg(
        F.sort_array(F.collect_list(F.struct(F.char_length("word").alias("length"), "rank", "word", (F.col("n") / F.col("all")).alias("share")))).alias("_top")
    )

    def of_length(length: Column) -> Column:
        before = F.size(F.filter("_top", lambda t: t["length"] < length))
        return F.struct(before.alias("before"), F.transform(F.filter("_top", lambda t: t["length"] == length), lambda t: t["word"]).alias("words"))

    shares = shares.withColumn("by_length", F.transform(F.sequence(F.lit(0), F.array_max("_top.length")), of_length))
    return classes.join(shares, "_lang", "left").select(
        "_lang", "class_share",
        F.coalesce(F.col("_top.word"), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.col("_top.share"), F.array().cast("array<double>")).alias("common_share"), "by_length",
    )


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to twice the divergence, in natural logarithms."""
    half = (p + q) / 2
    zero = F.lit(0.0)
    return F.when(p > 0, p * F.log(p / half)).otherwise(zero) + F.when(q > 0, q * F.log(q / half)).otherwise(zero)


def _distance(total: Column) -> Column:
    return F.sqrt(F.greatest(total / 2 / F.log(F.lit(2.0)), F.lit(0.0)))


def class_distance() -> Column:
    """Between the class counts of a row and ``class_share``."""
    names = [*CLASSES, "other"]
    chars = sum((F.col(f"_class_{n}") for n in names[1:]), F.col(f"_class_{names[0]}"))
    total = F.lit(0.0)
    for i, n in enumerate(names):
        total = total + _term(F.col(f"_class_{n}") / chars, F.get("class_share", F.lit(i)))
    return F.when(chars > 0, _distance(total))


def plain_words(text: Column) -> Column:
    """The words of a text as ``plain_word`` makes them, from one pass over the whole; words of marks alone are missing or empty.

    No separator is tried from within marks, so that long rows of these are passed once.
    """
    marks, space = r".,;:!?\"'()\-", r"\x20\x09-\x0D"
    return F.split(F.trim(F.lower(text), F.lit(PUNCTUATION)), rf"(?<![{marks}])[{marks}]*+[{space}][{space}{marks}]*+")


def word_distance(limits: Limits = Limits()) -> Column:
    """Between the words of a row and ``common_share``; all other words are one more bin."""
    n = F.size("_words")
    share = F.col("common_share")
    base = limits.common_words + 1

    def code(word: Column) -> Column:
        """Length and place among the common words of this length in one number; a multiple of ``base`` or null if it is none of them."""
        length = F.char_length(word)
        return length * base + F.array_position(F.get("by_length", length)["words"], word)

    def runs(known: Column) -> Column:
        """(code, run): how often each code is there, in order."""
        size = F.size(known)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (i == 0) | (F.get(known, i) != F.get(known, i - 1)))
        each = lambda at: F.transform(
            at, lambda i, k: F.struct(F.get(known, i).alias("code"), (F.coalesce(F.get(at, k + 1), size) - i).alias("run"))
        )
        return F.when(size > 0, _let(starts, each)).otherwise(F.array().cast("array<struct<code:bigint,run:int>>"))

    codes = F.transform(plain_words(F.col("_text")), code)
    known = F.sort_array(F.filter(codes, lambda c: c % base > 0))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def step(acc: Column, found: Column) -> Column:
        before = F.get("by_length", F.floor(found["code"] / base).cast("int"))["before"]
        p, q = found["run"] / n, F.get(share, (before + found["code"] % base - 1).cast("int"))
        return F.struct((acc["sum"] + _term(p, q)).alias("sum"), (acc["p"] + p).alias("p"), (acc["q"] + q).alias("q"))

    def finish(acc: Column) -> Column:
        every = F.aggregate(share, F.lit(0.0), lambda s, x: s + x)
        # Common words that the text lacks add their share times ln 2.
        return acc["sum"] + (every - acc["q"]) * F.log(F.lit(2.0)) + _term(F.greatest(1 - acc["p"], F.lit(0.0)), F.greatest(1 - every, F.lit(0.0)))

    return F.when(n > 0, _distance(F.aggregate(_let(known, runs), start, step, finish)))


def judged(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the counts of ``measured``, ``class_distance, word_distance, base_failed, kept``.

    The distances are null where a text or its language is too short to tell. Null,
    empty and blank texts fail for lack of words; repeated rows are judged alike; an empty
    table gives no rows. Columns of ``docs`` with the names of new ones give way.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept",
             "common", "common_share", "class_share", "by_length"]
    rest = [c for c in docs.columns if c not in added and not c.startswith("_")]
    references = cut_lineage(language_references(docs, limits, text, lang))
    small = fits_broadcast(references, 128 * limits.common_words + 512)
    rows = measured(docs.select(*rest), text, lang).join(F.broadcast(references) if small else references, "_lang", "left")
    rows = rows.withColumns(
        {
            "class_distance": F.when(F.char_length("_text") >= limits.class_chars, class_distance()),
            "word_distance": F.when((F.col("n_words") >= limits.word_words) & (F.size("common") > 0), word_distance(limits)),
            "base_failed": (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")),
            # Keeps a filter on ``kept`` above this step; pushed below, it would evaluate everything again.
            "_row": F.monotonically_increasing_id(),
        }
    )
    far = F.coalesce(F.col("class_distance") > limits.class_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > limits.word_distance, F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far & (F.col("_row") >= 0)).select(*rest, *added[:9])
