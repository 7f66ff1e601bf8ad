"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each classifier sees the features of
the text and the probabilities of all earlier categories. In training these
probabilities come from models that have not seen the row (out of fold), so later
classifiers learn from what they will meet in use.

Features are hashed words and beginnings of words (stems and compounds share
them), weighted by the logarithm of their count. Training takes a bounded sample of
labelled rows (``most_rows``); scoring goes over all rows in Arrow batches with the
model broadcast, whose size is fixed by ``most_features``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.llm.common import chunks, lowered, map_arrow, text_or_empty, texts_as_bytes, word_bounds
from lorelink.llm.rolling import Prefix

BITS = 22
STEMS = (5, 6, 7, 8)  # bytes
MOST_ROWS = 8_000
MOST_FEATURES = 1 << 10
LEAST_ROWS = 4  # labelled rows that a feature must occur in
FOLDS = 3
RIDGE = 0.02
THRESHOLD = 0.2  # clean held-out texts stay below it
STEPS = 100

# Bytes between words: all of ASCII but letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature occurrence: each word, and its first 5 to 8 bytes if it is longer."""
    starts, ends, rows = word_bounds(flat, offsets, _BETWEEN)
    prefix = Prefix(lowered(flat))
    found = [(rows, prefix.slices(starts, ends))]
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        # Another hash than that of the word which is just the stem.
        found.append((rows[longer], ~prefix.slices(starts[longer], starts[longer] + size)))
    hashes = np.concatenate([h for _, h in found])
    return np.concatenate([r for r, _ in found]), (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with the logarithm of 1 + count."""
    keys, counts = np.unique(rows << BITS | buckets, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), np.log2(1 + counts).astype(np.float32)


@dataclass
class Matrix:
    """Sparse rows: values at (row, column)."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    columns: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.columns)

    def only(self, keep: np.ndarray) -> "Matrix":
        place = np.cumsum(keep) - 1
        mine = keep[self.row]
        return Matrix(place[self.row[mine]], self.column[mine], self.value[mine], int(keep.sum()), self.columns)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: Matrix, extra: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of ridge-regularised logistic regression: features, then ``extra`` columns, then the intercept.

    Quasi-Newton steps from the last ten changes of the gradient.
    """
    dense = np.c_[extra, np.ones(len(y))]
    penalty = np.r_[np.full(x.columns + extra.shape[1], ridge), 1e-6]

    def loss(w):
        z = x.times(w[: x.columns]) + dense @ w[x.columns :]
        r = _sigmoid(z) - y
        value = np.logaddexp(0, z).sum() - y @ z + penalty @ (w * w) / 2
        return value, np.r_[x.transposed_times(r), dense.T @ r] + penalty * w

    w = np.zeros(x.columns + dense.shape[1])
    value, gradient = loss(w)
    changes: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(gradient).max() < 1e-6:
            break
        direction, kept = -gradient, []
        for s, g, c in reversed(changes):
            kept.append(c * (s @ direction))
            direction = direction - kept[-1] * g
        if changes:
            s, g, c = changes[-1]
            direction = direction / (c * (g @ g))
        for (s, g, c), k in zip(changes, reversed(kept)):
            direction = direction + s * (k - c * (g @ direction))
        slope, step = gradient @ direction, 1.0 if changes else 1 / max(1.0, np.linalg.norm(gradient))
        for _ in range(30):
            new = w + step * direction
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, g = new - w, new_gradient - gradient
        if s @ g > 1e-12:
            changes = [*changes[-9:], (s, g, 1 / (s @ g))]
        w, value, gradient = new, new_value, new_gradient
    return w


@dataclass
class Chain:
    """A fitted chain: weights of the kept buckets, of earlier probabilities, and intercepts, per category."""

    categories: list[str]
    place: np.ndarray  # bucket to column, -1 for buckets that are not used
    weights: np.ndarray  # category x column
    before: list[np.ndarray]
    intercepts: np.ndarray
    out_of_fold: np.ndarray  # of the training rows

    def probabilities(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """Category x row, for feature occurrences of ``n`` rows."""
        column = self.place[buckets]
        used = column >= 0
        row, column, value = _counted(rows[used], column[used].astype(np.int64))
        out = np.zeros((len(self.categories), n))
        for c in range(len(self.categories)):
            z = np.bincount(row, value * self.weights[c][column], n) + self.intercepts[c]
            for earlier in range(c):
                z += self.before[c][earlier] * out[earlier]
            out[c] = _sigmoid(z)
        return out


def information(has: np.ndarray, both: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Information gain in bits: of ``n`` rows ``positive`` belong to the category, ``has`` hold the feature, ``both`` do both."""
    out = np.zeros(len(has))
    for cell, rows, columns in (
        (both, has, positive), (has - both, has, n - positive), (positive - both, n - has, positive), (n - has - positive + both, n - has, n - positive),
    ):
        some = cell > 0
        expected = (rows * columns / n)[some] if n else cell[some]
        out[some] += cell[some] / n * np.log2(cell[some] / expected)
    return out


def fit_chain(
    row: np.ndarray, bucket: np.ndarray, value: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray,
    most_features: int = MOST_FEATURES, ridge: float = RIDGE, steps: int = STEPS,
) -> Chain:
    """A chain over ``labels`` (0/1 by row, in chain order) from distinct features; ``fold`` numbers the folds of rows."""
    n, folds = len(fold), int(fold.max()) + 1 if len(fold) else 1
    share = {c: float(y.mean()) if n else 0.0 for c, y in labels.items()}
    count = np.bincount(bucket, minlength=1 << BITS)
    # Features are ranked by what they tell about the category they tell most about.
    able = np.flatnonzero(count >= LEAST_ROWS)
    worth = np.zeros(len(able))
    for y in labels.values():
        worth = np.maximum(worth, information(count[able], np.bincount(bucket, y[row], 1 << BITS)[able], n, y.sum()))
    best = np.argsort(-worth, kind="stable")[:most_features]
    kept = np.sort(able[best[worth[best] > 1e-12]])
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    mine = place[bucket] >= 0
    x = Matrix(row[mine], place[bucket[mine]].astype(np.int64), value[mine], n, len(kept))
    earlier = np.zeros((n, 0))
    weights, before, intercepts = [], [], []
    for c, y in labels.items():
        held_out = np.zeros(n)
        for f in range(folds):
            train = fold != f
            if train.all() or not train.any():
                held_out[:] = share[c]
                continue
            w = logistic(x.only(train), earlier[train], y[train], ridge, steps)
            held_out[~train] = _sigmoid(x.only(~train).times(w[: x.columns]) + earlier[~train] @ w[x.columns : -1] + w[-1])
        w = logistic(x, earlier, y, ridge, steps) if n else np.r_[np.zeros(x.columns + earlier.shape[1]), -40.0]
        weights.append(w[: x.columns].astype(np.float32))
        before.append(w[x.columns : -1])
        intercepts.append(w[-1])
        earlier = np.c_[earlier, held_out]
    return Chain(list(labels), place, np.array(weights), before, np.array(intercepts), earlier)


def labelled_sample(labels: DataFrame, categories: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """The ``most_rows`` rows of ``labels`` with the least hash of doc_id: a fixed sample of bounded size, one row per doc_id."""
    rows = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories]
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", most_rows: int = MOST_ROWS, folds: int = FOLDS) -> Chain:
    """A chain from the texts of a bounded sample of ``labels`` (doc_id and a 0/1 column per category; null: 0).

    ``docs`` may lack some of them. Without any labelled text all probabilities are near zero.
    """
    sample = labelled_sample(labels, categories, most_rows)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("_text")).join(F.broadcast(sample), "doc_id")

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        rows, buckets = features(flat, offsets)
        row, bucket, value = _counted(rows, buckets)
        bounds = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(a)) for a in (bucket.astype(np.int32), value)]
        yield pa.record_batch([batch.column("doc_id"), *(batch.column(c) for c in categories), *lists], names=["doc_id", *categories, "bucket", "value"])

    kinds = ", ".join(["doc_id long", *(f"`{c}` int" for c in categories), "bucket array<int>", "value array<float>"])
    # most_rows texts at most: this is the bounded sample.
    table = map_arrow(joined.select("doc_id", *categories, "_text"), run, kinds).toArrow().sort_by("doc_id")
    bucket, value = (table.column(c).combine_chunks() for c in ("bucket", "value"))
    row = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.asarray(bucket.value_lengths(), np.int64))
    # Folds by the order of a hash of the ids, so they do not follow the order of the corpus.
    place = np.argsort(np.argsort(table.column("doc_id").to_numpy() * 2654435761 % (1 << 32), kind="stable"), kind="stable")
    wanted = {c: table.column(c).to_numpy().astype(float) for c in categories}
    return fit_chain(row, np.asarray(bucket.flatten()), np.asarray(value.flatten()), wanted, (place % folds).astype(np.int64))


def score(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its text, with ``p_<category>`` for each category and ``toxic`` (the last one reaches ``threshold``).

    Null and empty texts have no features and get what the intercepts say. Repeated rows score alike,
    an empty table gives no rows, columns with the names of new ones give way.
    """
    added = [f"p_{c}" for c in chain.categories] + ["toxic"]
    rest = [f for f in docs.schema.fields if f.name not in (text, "_text", *added)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{a}` double" for a in added[:-1]] + ["toxic boolean"])
    slim = Chain(chain.categories, chain.place, chain.weights, chain.before, chain.intercepts, np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(slim)

    def run(batch):
        chain = shared.value
        flat, offsets = texts_as_bytes(batch.column("_text"))
        out = np.zeros((len(chain.categories), batch.num_rows))
        for first, last in chunks(offsets):
            rows, buckets = features(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            out[:, first:last] = chain.probabilities(rows, buckets, last - first)
        yield pa.record_batch(
            [*(batch.column(f.name) for f in rest), *(pa.array(p) for p in out), pa.array(out[-1] >= threshold)], names=[*(f.name for f in rest), *added]
        )

    return map_arrow(docs.select(*[f.name for f in rest], text_or_empty(text).alias("_text")), run, schema)
