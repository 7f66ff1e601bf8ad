"""Steps on rows of a key that stand side by side in one partition, without a shuffle.

Spark forgets how rows are dealt out when they pass Python, so tables whose rows of a key are together are noted here,
and narrow steps hand the note on. What is done with the rows of a key then reads them as a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Rows that are handed on at a time.
MOST_ROWS = 20_000

# By which keys the rows of a table are together: by all of them, and by the first alone.
_TOGETHER: WeakKeyDictionary[DataFrame, tuple[str, ...]] = WeakKeyDictionary()


def mark(df: DataFrame, keys: list[str]) -> DataFrame:
    """Note that the rows of each value of ``keys``, and of the first of them, stand side by side in one partition of ``df``."""
    _TOGETHER[df] = tuple(keys)
    return df


def carry(made: DataFrame, source: DataFrame) -> DataFrame:
    """``made`` comes from ``source`` by steps that keep the order of rows and their partitions."""
    if source in _TOGETHER:
        _TOGETHER[made] = _TOGETHER[source]
    return made


def together(df: DataFrame, keys: list[str]) -> bool:
    noted = _TOGETHER.get(df, ())
    return tuple(keys) in (noted, noted[:1]) if noted else False


def codes(column: pa.Array) -> np.ndarray:
    """Equal values, null among them, have equal codes."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows - 1, bool)
    for key in keys:
        found = codes(batch.column(key))
        new |= found[1:] != found[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a run ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _starts(batch, keys)
        first = held and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if held and not first:
            yield pa.concat_batches(held)
            held = []
        if len(cut) == 1:
            held.append(batch)
            continue
        last = int(cut[-1])
        yield pa.concat_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held)


def by_runs(df: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``work`` on batches of whole runs; it gets the number of each row's run."""
    names = schema.names

    def run(batches):
        for batch in _whole(batches, keys):
            starts = _starts(batch, keys)
            # Runs in stretches of about so many rows.
            cuts = starts[np.r_[True, starts[1:] // MOST_ROWS != starts[:-1] // MOST_ROWS]]
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
                part = batch.slice(s, e - s)
                number = np.zeros(e - s, np.int64)
                number[starts[(starts > s) & (starts < e)] - s] = 1
                made = work(part, np.cumsum(number))
                if made.num_rows:
                    yield made.select(names)

    return df.mapInArrow(run, schema)


def order_in_runs(batch: pa.RecordBatch, number: np.ndarray, score: str, tie: str) -> np.ndarray:
    """Rows by run, falling score (null loses against any number, NaN against null) and rising ``tie``, its nulls first."""
    if not len(number) or number[-1] == len(number) - 1:
        return np.arange(len(number))
    value = batch.column(score)
    missing = np.asarray(value.is_null())
    value = -pc.fill_null(value.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) + 0.0
    value = np.where(missing, np.inf, value)
    odd = np.isnan(value)
    own = batch.column(tie)
    ties = pc.rank(own, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
    return np.lexsort((ties, np.where(odd, 0.0, value), odd, number))


def first_of_runs(order: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The first row of each run in ``order``."""
    return order[np.r_[True, number[1:] != number[:-1]]] if len(number) else order


def min_ranks(number: np.ndarray, values: np.ndarray) -> np.ndarray:
    """1 + how many values of the same run are greater."""
    if not len(number) or number[-1] == len(number) - 1:
        return np.ones(len(number), np.int64)
    order = np.lexsort((-values, number))
    run, value = number[order], values[order]
    at = np.arange(len(order))
    run_start = np.maximum.accumulate(np.where(np.r_[True, run[1:] != run[:-1]], at, 0))
    new = np.r_[True, (run[1:] != run[:-1]) | (value[1:] != value[:-1])]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new, at, 0)) - run_start + 1
    return ranks
