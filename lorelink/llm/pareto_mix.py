"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words, perhaps more than it holds. A document is
expected to be taken e times, where e grows with a power of its length and is the
same for all documents of a source and length class. floor(e) copies are certain.
The rest is drawn: with inclusion probability p = e - floor(e) and a uniform u,
documents are ranked by (u / (1 - u)) / (p / (1 - p)) and taken from the front
until the words still missing are reached: a sample of fixed size in words with
nearly the wanted inclusion probabilities. u comes from a hash of the row, so
reruns agree.

Only sums per source and length class (at most 64 a source) are gathered. The cut
in the ranking is found with a histogram of ranks and then inside one bin, so no
source is sorted as a whole.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorelink.llm.common import SPACES, WORD, text_or_empty
from lorelink.operators.skew import fits_broadcast
from lorelink.session import cut_lineage

SEED = 20
CAP = 2.0
# Expected copies grow with length to this power.
LENGTH_POWER = 0.25
CLASSES = 64
# Rows that share a bin of the ranking, about.
BIN_ROWS = 10_000


def word_count(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...], source: str = "source") -> DataFrame:
    """``sources`` (one row each) with ``weight``: the given ones in turn, by code point order, null last."""
    order = W.orderBy(F.col(source).isNull(), F.col(source))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))


def share_targets(sources: DataFrame, total_share: float, cap: float = CAP) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: ``total_share`` of all sizes dealt by weight.

    No target exceeds ``cap`` times its source. What is cut off is dealt again by weight
    among the others until none is above. Sorted by size per weight, full sources come
    first, so how much each of the others gets follows from running sums.
    One row per source is all that is sorted here.
    """
    size, weight = F.col("source_size").cast("double"), F.col("weight")
    ratio = F.when(weight > 0, cap * size / weight).otherwise(float("inf"))
    every = W.partitionBy(F.lit(0))
    over = every.orderBy("_ratio", "source_key").rowsBetween(W.unboundedPreceding, -1)
    rows = sources.withColumn("_ratio", ratio).withColumns(
        {
            "_full": F.coalesce(F.sum(cap * size).over(over), F.lit(0.0)),
            "_left": F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(over), F.lit(0.0)),
            "_all": F.sum(size).over(every) * total_share,
        }
    )
    # The level at each source if all before it are full; sources below their ratio end up at the common level.
    level = (F.col("_all") - F.col("_full")) / F.when(F.col("_left") > 0, F.col("_left"))
    common = F.min(F.when(level < F.col("_ratio"), F.struct("_ratio", level.alias("level")))).over(every)["level"]
    target = F.when(weight > 0, F.least(cap * size, weight * F.coalesce(common, F.lit(float("inf"))))).otherwise(0.0)
    return rows.withColumn("target", target).drop("_ratio", "_full", "_left", "_all")


def _uniform(seed: int, *columns: str) -> Column:
    """Of [0, 1), with 52 bits, from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12).cast("double") + 0.5) / float(1 << 52)


def _expected(pdf: pd.DataFrame, cap: float, power: float) -> pd.DataFrame:
    """Expected copies of each length class of one source: level * mean length ^ power, ``cap`` at most."""
    words, n, target = pdf["words"].to_numpy(float), pdf["n"].to_numpy(float), float(pdf["target"].iloc[0])
    shape = (words / n) ** power
    full = [False] * len(pdf)
    order = sorted(range(len(pdf)), key=lambda i: -shape[i])
    copies = [0.0] * len(pdf)
    if target >= cap * words.sum():
        copies = [cap] * len(pdf)
    else:
        missing = target
        for i in order:  # classes that reach the cap leave the others more
            rest = sum(words[j] * shape[j] for j in order if not full[j])
            if rest <= 0 or missing / rest * shape[i] < cap:
                break
            full[i], copies[i] = True, cap
            missing -= cap * words[i]
        rest = sum(words[j] * shape[j] for j in order if not full[j])
        for j in order:
            if not full[j] and rest > 0:
                copies[j] = max(0.0, missing / rest * shape[j])
    return pd.DataFrame({"source_key": pdf["source_key"], "class": pdf["class"], "copies": copies})


def mixed(
    docs: DataFrame, targets: DataFrame, text: str = "text", source: str = "source", seed: int = SEED,
    cap: float = CAP, power: float = LENGTH_POWER, bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """``docs`` with ``size``, its source's ``source_size`` and ``target``, and ``copies`` to take.

    ``targets`` has (source_key, source_size, target), the key as in ``source_key``. The words taken from a
    source miss its target by less than one document. No document is taken more than ``ceil(cap)``
    times. Rows without words are never taken; rows that agree in doc_id and text share their fate;
    an empty table gives no rows; columns of ``docs`` with the new names give way.
    """
    added = ["size", "source_size", "target", "copies"]
    rest = [c for c in docs.columns if c not in added and not c.startswith("_")]
    ident = "doc_id" if "doc_id" in rest else text
    narrow = docs.select(
        *rest, source_key(docs, source).alias("_source"), word_count(text).alias("size"),
        F.xxhash64(F.col(ident).cast("string"), text_or_empty(text)).alias("_row"),
    ).withColumn("_class", F.when(F.col("size") > 0, F.least(F.floor(F.log2("size") * 2), F.lit(CLASSES - 1))).cast("int"))
    plain = cut_lineage(narrow.select("_source", "size", "_row", "_class"))
    classes = plain.filter("size > 0").groupBy(F.col("_source").alias("source_key"), F.col("_class").alias("class")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
    )
    goals = targets.select("source_key", "source_size", "target")
    expected = classes.join(goals, "source_key").groupBy("source_key").applyInPandas(
        lambda pdf: _expected(pdf, cap, power), "source_key string, class int, copies double"
    )
    # One row per source: expected copies as an array by class.
    table = expected.groupBy("source_key").agg(F.map_from_entries(F.collect_list(F.struct("class", "copies"))).alias("_copies"))
    table = cut_lineage(goals.join(table, "source_key", "left").withColumnRenamed("source_key", "_source"))
    small = fits_broadcast(table, CLASSES * 24 + 128)

    def ranked(df: DataFrame, side: DataFrame) -> DataFrame:
        side = F.broadcast(side) if small else side
        df = df.join(side, "_source", "left")
        copies = F.coalesce(F.try_element_at("_copies", F.col("_class")), F.lit(0.0))
        df = df.withColumns({"_whole": F.floor(copies).cast("int"), "_p": copies - F.floor(copies)})
        u = _uniform(seed, "_row")
        return df.withColumn("_rank", F.when(F.col("_p") > 0, (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))))

    drawn = ranked(plain, table)
    # Bins of equal width in rank / (1 + rank), which lies in (0, 1).
    counts = drawn.groupBy("_source").agg(
        F.count("_rank").alias("_n"), F.sum(F.col("_whole") * F.col("size")).alias("_certain")
    )
    sized = cut_lineage(
        table.select("_source", "target").join(counts, "_source").select(
            "_source", (F.col("target") - F.col("_certain")).alias("_missing"), F.ceil(F.col("_n") / bin_rows).alias("_bins")
        )
    )
    with_bins = drawn.filter("_rank is not null").join(F.broadcast(sized) if small else sized, "_source").withColumn(
        "_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * F.col("_bins"))
    )
    bins = with_bins.groupBy("_source", "_bin", "_missing").agg(F.sum("size").alias("_words"))
    before = F.coalesce(F.sum("_words").over(W.partitionBy("_source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    crossed = bins.withColumn("_before", before).filter((F.col("_before") < F.col("_missing")) & (F.col("_before") + F.col("_words") >= F.col("_missing")))
    crossed = cut_lineage(crossed.select("_source", "_bin", "_before"))
    # Inside the bin that crosses the target: rows in order, up to the one that comes nearest.
    inside = with_bins.join(F.broadcast(crossed) if small else crossed, ["_source", "_bin"]).groupBy(
        "_source", "_rank", "_row", "_missing", "_before"
    ).agg(F.sum("size").alias("_words"))
    order = W.partitionBy("_source").orderBy("_rank", "_row").rowsBetween(W.unboundedPreceding, 0)
    reached = inside.withColumn("_reach", F.sum("_words").over(order) + F.col("_before"))
    taken = reached.filter(F.col("_reach") - F.col("_words") / 2 <= F.col("_missing"))
    last = taken.groupBy("_source").agg(F.max(F.struct("_rank", "_row")).alias("_last"))
    # Nothing of the crossing bin fits, or there is none: rows below it, or all.
    ends = crossed.select("_source", F.col("_bin").alias("_cut")).join(last, "_source", "left")
    sides = table.join(sized, "_source", "left").join(ends, "_source", "left")
    final = ranked(narrow, cut_lineage(sides))
    position = F.floor(F.col("_rank") / (1 + F.col("_rank")) * F.col("_bins"))
    fits = F.struct(F.col("_rank"), F.col("_row")) <= F.struct(F.col("_last._rank").alias("_rank"), F.col("_last._row").alias("_row"))
    extra = (
        F.when(F.col("_rank").isNull() | (F.col("_missing") <= 0), False)
        .when(F.col("_cut").isNull(), True)
        .when(position < F.col("_cut"), True)
        .when((position == F.col("_cut")) & F.col("_last").isNotNull(), fits)
        .otherwise(False)
    )
    return final.withColumn("copies", (F.col("_whole") + extra.cast("int")).cast("int")).select(*rest, *added)


def source_key(docs: DataFrame, source: str = "source") -> Column:
    """The source as a join key: null and a missing column get a key of their own."""
    if source not in docs.columns:
        return F.lit("-")
    return F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))


def source_sizes(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source_key, source, source_size): words per source, pre-summed before the shuffle."""
    name = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    return docs.groupBy(source_key(docs, source).alias("source_key"), name.alias("source")).agg(F.sum(word_count(text)).alias("source_size"))


def weighted_targets(docs: DataFrame, weights: tuple[float, ...], total_share: float, text: str = "text", source: str = "source", cap: float = CAP) -> DataFrame:
    """The targets of ``mixed`` for weights dealt out in turn over the sources."""
    sizes = cut_lineage(source_sizes(docs, text, source))
    return cut_lineage(share_targets(cycled_weights(sizes, weights), total_share, cap).select("source_key", "source_size", "target"))
