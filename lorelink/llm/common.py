"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The white space that separates words everywhere in this folder.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
# Python tasks work on about this many characters or bytes at a time.
CHUNK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


def text_or_empty(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_arrow(df: DataFrame, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over single batches; tasks keep nothing between batches."""

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                yield from run(batch)
        # The worker waits for further tasks; what its pool holds for itself would count until then.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(each, schema)


def texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch end to end as bytes, and the n + 1 offsets of the texts. Nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``size`` bytes together; one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(flat: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words end at bytes that are ``between`` words and at the end of a text."""
    inside = ~between[flat]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    # A text that begins or ends inside a run of letters cuts the run.
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    both = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    starts[both] = True
    ends[both - 1] = True
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def pack(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_text`` compressed as ``_packed`` and its ``_size``: texts are the bulk of what joins move."""
    rest = [f for f in rows.schema.fields if f.name != "_text"]
    schema = StructType([*rest, *StructType.fromDDL("_packed binary, _size long").fields])

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        codec, bounds = pa.Codec("zstd", 3), offsets.tolist()
        data = [codec.compress(flat[a:b], asbytes=True) for a, b in zip(bounds, bounds[1:])]
        yield pa.record_batch(
            [*(batch.column(f.name) for f in rest), pa.array(data, pa.binary()), pa.array(np.diff(offsets))], names=[*(f.name for f in rest), "_packed", "_size"]
        )

    return map_arrow(rows, run, schema)


def packed_parts(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A batch of packed texts in slices of about ``size`` bytes of text, so that a task never has the texts of a whole batch unpacked."""
    for first, last in chunks(np.r_[0, np.cumsum(batch.column("_size").to_numpy())], size):
        yield batch.slice(first, last - first)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """What ``texts_as_bytes`` gives, of packed texts."""
    codec, sizes = pa.Codec("zstd"), batch.column("_size").to_numpy()
    data = [codec.decompress(p, n, asbytes=True) for p, n in zip(batch.column("_packed").to_pylist(), sizes.tolist())]
    return np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(sizes)]


def lowered(flat: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many partitions as shuffles use."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spaced(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` one after the other, a space behind each, and where each begins (and the end)."""
    sizes = ends - starts + 1
    at = np.r_[0, np.cumsum(sizes)]
    source = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
    source[at[1:] - 1] = 0  # replaced by the space
    out = flat[source]
    out[at[1:] - 1] = 32
    return out, at
