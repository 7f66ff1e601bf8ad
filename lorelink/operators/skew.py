"""Joins and rankings that keep working when one key holds much of the data."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lorelink.operators.together import by_runs, first_of_runs, mark, min_ranks, order_in_runs, together
from lorelink.session import cut_lineage

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 2_000_000
# Tables up to this size may travel to every task.
BROADCAST_BYTES = 64 * 1024 * 1024


def hot_keys(counted: DataFrame, keys: list[str], n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys above ``rows_per_task`` with the number of slices each one gets.

    ``counted`` has one row per key, so at most total / rows_per_task keys
    qualify; that bound is what makes broadcasting the result safe.
    """
    return counted.filter(F.col(n) > rows_per_task).select(
        *keys, F.ceil(F.col(n) / rows_per_task).cast("int").alias("_slices")
    )


def salted_join(fact: DataFrame, dim: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``fact`` to ``dim`` with the hot keys of ``fact`` split into slices.

    Rows of a hot key are dealt out by a hash of the whole row and the matching
    ``dim`` rows are repeated once per slice; every other key joins as usual.
    Exact for inner, left, left_semi and left_anti.
    """
    small = F.broadcast(hot)
    dealt = fact.join(small, keys, "left").withColumn(
        "_slice",
        F.when(F.col("_slices").isNotNull(), F.pmod(F.xxhash64(*fact.columns), F.col("_slices")).cast("int")).otherwise(0),
    )
    copied = dim.join(small, keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    )
    return dealt.drop("_slices").join(copied.drop("_slices"), [*keys, "_slice"], how).drop("_slice")


def fits_broadcast(dim: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``dim`` stays below ``limit`` bytes, found out by reading no more rows than that."""
    most = max(1, limit // row_bytes)
    return dim.limit(most + 1).count() <= most


def sized_join(fact: DataFrame, dim: DataFrame, keys: list[str], hot: DataFrame, row_bytes: int, how: str = "inner") -> DataFrame:
    """Broadcast ``dim`` while its checked size allows, else ``salted_join``.

    For dimensions that are written tables, where the check is cheap.
    """
    if fits_broadcast(dim, row_bytes):
        return fact.join(F.broadcast(dim), keys, how)
    return salted_join(fact, dim, keys, hot, how)


def counted_join(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``salted_join`` with the hot keys counted from ``fact`` itself."""
    counted = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return salted_join(fact, dim, keys, hot_keys(counted, keys, "_n"), how)


def sequential_ids(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive ids in a total order without sorting everything in one task.

    The rows are range-partitioned by the order and written once, which fixes
    the partition number of every row; an id is then the rows in the earlier
    partitions plus the position inside the own one.
    """
    parted = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition: the running total over them is small by construction.
    offsets = sizes.select(
        "_part", (F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")).alias("_offset")
    )
    position = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        parted.withColumn("_position", position)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_position") - 1 + start)
        .drop("_part", "_position", "_offset")
    )


def running_total(df: DataFrame, keys: list[str], step: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """Running sum of ``value`` by the integer ``step``, in stretches of ``width`` steps.

    Long groups are cut by step number, so a group of any length spreads over
    tasks; stretch totals are summed up separately and added back.
    """
    cut = df.withColumn("_cut", F.floor(F.col(step) / width))
    local = F.sum(value).over(W.partitionBy(*keys, "_cut").orderBy(step).rowsBetween(W.unboundedPreceding, 0))
    totals = cut.groupBy(*keys, "_cut").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.withColumn("_before", before).filter("_cut > 0").drop("_t")
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*keys, "_cut"], "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_cut", "_local", "_before")
    )


def min_rank_within(df: DataFrame, keys: list[str], ident: str, scores: dict[str, str], size: str, largest: int | None = None, limit: int = 100_000) -> DataFrame:
    """Descending min-rank of several scores inside each group.

    ``size`` holds the group's row count and ``ident`` tells its rows apart.
    Groups up to ``limit`` rows share one window; longer ones are ranked from
    counts per distinct score, with the scores cut into stretches, so no long
    group reaches a single task. ``largest``, when known, saves planning for
    long groups that do not exist.
    """
    if together(df, keys):
        return _ranks_in_runs(df, keys, scores)
    usual = df if largest is not None and largest <= limit else df.filter(F.col(size) <= limit)
    for score, rank in scores.items():
        usual = usual.withColumn(rank, F.rank().over(W.partitionBy(*keys).orderBy(F.desc(score))).cast("long"))
    if largest is not None and largest <= limit:
        return usual
    return usual.unionByName(_ranks_from_counts(df.filter(F.col(size) > limit), keys, ident, scores))


def _ranks_in_runs(df: DataFrame, keys: list[str], scores: dict[str, str]) -> DataFrame:
    """The ranks where the rows of a key stand side by side, and no score is null."""

    def work(batch: pa.RecordBatch, number: np.ndarray) -> pa.RecordBatch:
        ranks = [pa.array(min_ranks(number, batch.column(s).to_numpy(zero_copy_only=False))) for s in scores]
        return pa.record_batch([*batch.columns, *ranks], names=[*batch.schema.names, *scores.values()])

    return mark(by_runs(df, keys, work, T.StructType([*df.schema.fields, *[T.StructField(r, T.LongType()) for r in scores.values()]])), keys)


def _ranks_from_counts(df: DataFrame, keys: list[str], ident: str, scores: dict[str, str]) -> DataFrame:
    """All scores stacked into rows, ranked in one pass, and laid side by side again."""
    stacked = df.select(
        *keys, ident, F.explode(F.array(*[F.struct(F.lit(s).alias("_name"), F.col(s).alias("_value")) for s in scores])).alias("_s")
    ).select(*keys, ident, "_s._name", "_s._value")
    group = [*keys, "_name"]
    # Similarities lie in [-1, 1]; anything outside falls into an end stretch.
    stretch = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - F.col("_value"))) * 2000)
    values = stacked.groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cut", stretch)
    inside = F.sum("_n").over(W.partitionBy(*group, "_cut").orderBy(F.desc("_value")).rowsBetween(W.unboundedPreceding, -1))
    totals = values.groupBy(*group, "_cut").agg(F.sum("_n").alias("_t"))
    before = F.sum("_t").over(W.partitionBy(*group).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.withColumn("_before", before).drop("_t")
    zero = F.lit(0)
    ranks = values.withColumn("_inside", inside).join(offsets, [*group, "_cut"]).select(
        *group, "_value", (1 + F.coalesce("_inside", zero) + F.coalesce("_before", zero)).alias("_rank")
    )
    placed = counted_join(stacked, ranks, [*group, "_value"])
    wide = placed.groupBy(*keys, ident).agg(*[F.max(F.when(F.col("_name") == s, F.col("_rank"))).alias(r) for s, r in scores.items()])
    return df.join(wide, [*keys, ident])


def best_per_key(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score per key (lowest ``tie`` wins), by aggregation.

    A max over a struct combines on the map side, so unlike a window no group
    is sorted in one task. Nulls in ``score`` lose against any value.
    """
    if together(df, keys):
        # Rows of a key are read as a run.
        return mark(by_runs(df, keys, lambda b, n: b.take(pa.array(np.sort(first_of_runs(order_in_runs(b, n, score, tie), n)))), df.schema), keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.coalesce(-F.col(score), F.lit(float("inf"))), F.col(tie))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
