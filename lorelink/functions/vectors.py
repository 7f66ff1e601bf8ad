"""Vector arithmetic: Arrow batches for products, column sums for aggregation."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list array as a float64 matrix, plus the mask of non-null rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    present = np.asarray(vectors.is_valid())
    kept = vectors.drop_null()
    if len(kept) == 0:
        return np.zeros((len(vectors), 0)), present
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(vectors), len(flat) // len(kept)))
    rows[present] = flat.reshape(len(kept), -1)
    return rows, present


def list_array(rows: np.ndarray) -> pa.Array:
    """A float64 matrix as an Arrow list array."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def _row_products(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    left, has_left = matrix(a)
    right, has_right = matrix(b)
    both = has_left & has_right
    if not both.any():
        zero = np.zeros(len(both))
        return zero, zero, zero, both
    return (
        np.einsum("ij,ij->i", left, right),
        np.einsum("ij,ij->i", left, left),
        np.einsum("ij,ij->i", right, right),
        both,
    )


@arrow_udf(DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Inner product; null when a side is null."""
    product, _, _, both = _row_products(a, b)
    return pa.array(product, mask=~both)


@arrow_udf(DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine; null when a side is null, NaN for a zero vector."""
    product, left, right, both = _row_products(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return pa.array(product / np.sqrt(left * right), mask=~both)


def clamped_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine with 0 for missing, undefined or negative values."""
    value = cosine(a, b)
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # The norm in a list of its own, so that it is worked out once and not for each component.
    return F.element_at(
        F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))), 1
    )


def vector_sum(df: DataFrame, keys: list[str], vector: str, dim: int, *extra: Column) -> DataFrame:
    """Element-wise sum per key.

    One sum per component, so Spark combines on the map side and no group is
    ever collected. Output columns: keys, ``vec_sum``, ``vec_n``, then ``extra``.
    """
    source = F.col(vector)
    sums = [F.sum(source[i].cast("double")).alias(f"_s{i}") for i in range(dim)]
    grouped = df.groupBy(*keys).agg(*sums, F.count(source).alias("vec_n"), *extra)
    parts = {f"_s{i}" for i in range(dim)}
    keep = [c for c in grouped.columns if c not in parts]
    return grouped.withColumn(
        "vec_sum", F.when(F.col("vec_n") > 0, F.array(*[F.col(f"_s{i}") for i in range(dim)]))
    ).select(*keep, "vec_sum")


def vector_mean(df: DataFrame, keys: list[str], vector: str, dim: int, *extra: Column) -> DataFrame:
    """Element-wise mean per key as ``vec``; ``vec_n`` counts the rows used."""
    summed = vector_sum(df, keys, vector, dim, *extra)
    return summed.withColumn("vec", F.transform("vec_sum", lambda x: x / F.col("vec_n"))).drop("vec_sum")


def vector_dim(df: DataFrame, vector: str) -> int:
    """Width of the vectors, read from one row."""
    row = df.select(F.size(vector).alias("d")).filter(F.col("d") > 0).first()
    return 0 if row is None else row["d"]


def _means(lists: pa.Array, known: pa.Array, table: np.ndarray) -> pa.Array:
    """Mean vector of the known words of each list, null without any."""
    where = pc.index_in(lists.flatten(), value_set=known)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), sizes)
    hit = np.asarray(where.is_valid())
    return _owned_means(owner[hit], where.drop_null().to_numpy(zero_copy_only=False), len(lists), table)


def _owned_means(owner: np.ndarray, index: np.ndarray, n: int, table: np.ndarray) -> pa.Array:
    """Mean of the rows ``index`` of ``table`` by their rising ``owner``, null for owners without any."""
    out = np.zeros((n, table.shape[1]))
    counts = np.bincount(owner, minlength=n)
    if len(owner):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[starts]] = np.add.reduceat(table[index], starts, axis=0) / counts[owner[starts]][:, None]
    made = list_array(out)
    return pa.ListArray.from_arrays(made.offsets, made.values, mask=pa.array(counts == 0)) if (counts == 0).any() else made


def word_mean(spark, words: pa.Array, rows: np.ndarray):
    """A column function: mean vector of the known words of a list column, null without any.

    ``words`` and ``rows`` are a lookup table of checked size.
    """
    shared = spark.sparkContext.broadcast((words, rows))

    @arrow_udf(ArrayType(DoubleType()))
    def mean(lists: pa.Array) -> pa.Array:
        return _means(lists, *shared.value)

    return mean


def coded_words(words: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``words`` without nulls in the order of their bytes, and their ``rows``."""
    known = np.asarray(words.is_valid())
    names, rows = words.drop_null(), rows[known]
    order = sorted(range(len(names)), key=[w.encode() for w in names.to_pylist()].__getitem__)
    return names.take(pa.array(order, pa.int64())), rows[order]


def _codes(lists: pa.Array, known: pa.Array, names: np.ndarray) -> pa.Array:
    """Lists of words as lists of codes: 2 i + 1 for the i-th of the sorted ``known`` words, an even number between those of its neighbours else."""
    coded = lists.flatten().dictionary_encode()
    found = pc.index_in(coded.dictionary, value_set=known)
    code = 2 * pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    other = np.flatnonzero(~np.asarray(found.is_valid()))
    if len(other):
        words = np.array([w.encode() for w in coded.dictionary.take(pa.array(other)).to_pylist()] + [None], dtype=object)[:-1]
        code[other] = 2 * np.searchsorted(names, words)
    # A word that is null sorts before all others.
    at = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    flat = pa.array(np.where(at < 0, -2, code[at] if len(code) else 0).astype(np.int32))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    missing = lists.is_null()
    return pa.ListArray.from_arrays(offsets, flat, mask=missing) if lists.null_count else pa.ListArray.from_arrays(offsets, flat)


def code_means(lists: pa.Array, table: np.ndarray) -> pa.Array:
    """Mean vector of the known words of each list of codes, null without any."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), sizes)
    hit = (flat & 1) == 1
    return _owned_means(owner[hit], flat[hit] >> 1, len(lists), table)


def word_codes(spark, words: pa.Array, rows: np.ndarray):
    """Two column functions: lists of words as lists of codes, and for lists of lists of codes the mean vectors there are, in order.

    ``words`` and ``rows`` are a lookup table of checked size. Codes sort as their words do.
    """
    known, table = coded_words(words, rows)
    shared = spark.sparkContext.broadcast((known, table))

    @arrow_udf(ArrayType(IntegerType()))
    def codes(lists: pa.Array) -> pa.Array:
        known = shared.value[0]
        return _codes(lists, known, np.array([w.encode() for w in known.to_pylist()] + [None], dtype=object)[:-1])

    @arrow_udf(ArrayType(ArrayType(DoubleType())))
    def means(groups: pa.Array) -> pa.Array:
        found = code_means(groups.flatten(), shared.value[1])
        sizes = pc.fill_null(pc.list_value_length(groups), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(groups)), sizes)[np.asarray(found.is_valid())]
        offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(groups)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found.drop_null())

    return codes, means


def known_words(spark, words: pa.Array):
    """A column function: the words of a list column that are among ``words``, in order."""
    shared = spark.sparkContext.broadcast(words)

    @arrow_udf(ArrayType(StringType()))
    def known(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        hit = pc.is_in(flat, value_set=shared.value)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), sizes)[np.asarray(hit)]
        offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(lists)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat.filter(hit))

    return known
