"""Near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors are one from the start, with their number. Each distinct vector goes to one bucket in each of several tables:
the signs of its products with the random normals of that table. How many tables and signs there are follows from the number
of vectors (``table_plan``), so that a pair at the least similarity meets with probability ``RECALL`` in some table,
whatever the size; closer pairs are likelier to meet.

What travels to a bucket is the vector in one byte per component, with the length of what rounding lost. This bounds
the error of every product, so most pairs are decided in the bucket for certain, and only those within the bound of the least
similarity are compared again in double precision from the vectors themselves. Large buckets are hashed once more
inside their task; buckets of more than ``largest`` vectors are dealt as pairs of pieces over several tasks, which
compares the same pairs.

A pair that meets in several tables counts in the first of them. A bucket returns sums and at most one edge per
vector, never its pairs; components are then found by contraction (``components``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.functions.vectors import matrix
from lorelink.llm.common import map_arrow, spread
from lorelink.llm.components import components
from lorelink.operators.skew import counted_join, fits_broadcast, hot_keys, salted_join
from lorelink.session import cut_lineage

LEAST = 0.9
# Chance that a pair of the least similarity meets in a table, and in a bucket that is hashed once more.
RECALL, RECALL_INSIDE = 0.99, 0.998
SEED = 20_011
# Vectors of a bucket that are all multiplied with each other, and beyond which a bucket is dealt over tasks.
SMALL, LARGEST = 4096, 1 << 17
# Rounding of single-precision products of unit vectors.
SLACK = 2e-5
_BLOCK = 1024


def _tables(bits: int, least: float, recall: float) -> int:
    """Tables of ``bits`` signs in which a pair of similarity ``least`` meets with chance ``recall`` at least."""
    same = (1 - math.acos(max(-1.0, min(least, 1.0))) / math.pi) ** bits
    return 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))


def table_plan(n: int, least: float = LEAST) -> tuple[int, int]:
    """(tables, signs per table) for ``n`` distinct vectors: buckets of about 4,096 vectors, with 4 to 8 signs."""
    bits = min(8, max(4, math.ceil(math.log2(max(1, n) / 4096))))
    return _tables(bits, least, RECALL), bits


def _codes(rows: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The bucket of each row in each table."""
    normals = np.random.default_rng([seed, rows.shape[1]]).standard_normal((tables * bits, rows.shape[1])).astype(np.float32)
    signs = (rows.astype(np.float32) @ normals.T > 0).reshape(len(rows), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _body(tables: int, dim: int) -> np.dtype:
    """What travels of a vector: scale and lost length, number of copies, bucket per table, components."""
    return np.dtype([("scale", "<f4"), ("lost", "<f4"), ("many", "<i8"), ("codes", "u1", (tables,)), ("bytes", "i1", (dim,))])


def _index(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """(key, node, body): a row per vector and table; the key holds dimension, table and bucket."""

    def run(batch):
        sizes = np.asarray(batch.column("vec").value_lengths())
        node, many = (batch.column(c).to_numpy() for c in ("node", "many"))
        for dim in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dim)
            rows, _ = matrix(batch.column("vec").take(pa.array(mine)))
            rows /= np.abs(rows).max(axis=1, keepdims=True)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            codes = _codes(rows, tables, bits, SEED)
            body = np.zeros(len(mine), _body(tables, dim))
            body["scale"] = np.abs(rows).max(axis=1) / 127
            whole = np.rint(rows / body["scale"][:, None].astype(float))
            body["lost"] = np.nextafter(np.linalg.norm(rows - whole * body["scale"][:, None], axis=1).astype(np.float32), np.float32(2))
            body["many"], body["codes"], body["bytes"] = many[mine], codes, np.clip(whole, -127, 127)
            width, data = body.dtype.itemsize, body.tobytes()
            rows_ = pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())
            for t in range(tables):
                yield pa.record_batch([pa.array(dim << 20 | t << 8 | codes[:, t]), pa.array(node[mine]), rows_], names=["key", "node", "body"])

    return map_arrow(vectors.select("node", "many", "vec"), run, "key long, node long, body binary")


class _Bucket:
    """The vectors of one bucket; ``piece`` tells two sides apart of which only pairs across count."""

    def __init__(self, key: int, node: np.ndarray, body: np.ndarray, piece: np.ndarray | None, least: float):
        self.table, self.node, self.piece, self.least = key >> 8 & 0xFFF, node, piece, least
        self.rows = body["bytes"].astype(np.float32) * body["scale"][:, None]
        self.lost, self.codes, self.many = body["lost"].astype(np.float64), body["codes"], body["many"]
        self.inside = None
        self.sums = np.zeros(len(node))
        self.label = np.arange(len(node))
        self.unsure: list[tuple[np.ndarray, np.ndarray]] = []

    def _merge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the components that the pairs connect; a label is the least place of its component."""
        a, b = self.label[i], self.label[j]
        if (a == b).all():
            return
        used, which = np.unique(np.r_[a, b], return_inverse=True)
        a, b = which[: len(a)], which[len(a) :]
        least = np.arange(len(used))
        while (least[a] != least[b]).any():
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, least[a], low)
            np.minimum.at(least, least[b], low)
            least = least[least]
        target = np.arange(len(self.label))
        target[used] = used[least]
        self.label = target[self.label]

    def compare(self, some: np.ndarray, inner: int) -> None:
        """All pairs among ``some`` places, which share their bucket of the inner table ``inner``."""
        rows, lost = self.rows[some], self.lost[some]
        loose = np.float32(self.least - 2 * lost.max() - 3 * lost.max() ** 2 - SLACK)
        for at in range(0, len(some), _BLOCK):
            product = rows[at : at + _BLOCK] @ rows[at:].T
            x, y = np.nonzero(product >= loose)
            ahead = y > x
            x, y = x[ahead], y[ahead]
            value = product[x, y].astype(np.float64)
            a, b = lost[at + x], lost[at + y]
            bound = a + b + 3 * a * b + SLACK
            i, j = some[at + x], some[at + y]
            wanted = value >= self.least - bound
            wanted &= (self.codes[i] == self.codes[j]).argmax(axis=1) == self.table
            if self.inside is not None:
                wanted &= (self.inside[i] == self.inside[j]).argmax(axis=1) == inner
            if self.piece is not None:
                wanted &= self.piece[i] != self.piece[j]
            sure = wanted & (value >= self.least + bound)
            doubt = np.flatnonzero(wanted & ~sure)
            if len(doubt):
                self.unsure.append((self.node[i[doubt]], self.node[j[doubt]]))
            i, j = i[sure], j[sure]
            if len(i):
                n = len(self.sums)
                self.sums += np.bincount(i, self.many[j], n) + np.bincount(j, self.many[i], n)
                self._merge(i, j)

    def solve(self, small: int) -> None:
        n = len(self.node)
        if n <= small:
            return self.compare(np.arange(n), 0)
        bits = max(1, math.ceil(math.log2(n / 128)))
        self.inside = _codes(self.rows, _tables(bits, self.least, RECALL_INSIDE), bits, SEED + 1 + self.table)
        for t in range(self.inside.shape[1]):
            order = np.argsort(self.inside[:, t], kind="stable")
            code = self.inside[order, t]
            for some in np.split(order, np.flatnonzero(code[1:] != code[:-1]) + 1):
                if len(some) > 1:
                    self.compare(np.sort(some), t)

    def results(self) -> pa.RecordBatch:
        """(kind, a, b, n): 0, links of ``a`` here; 1, ``a`` and ``b`` are connected; 2, ``a`` and ``b`` have to be compared exactly."""
        linked = np.flatnonzero(self.sums)
        joined = np.flatnonzero(self.label != np.arange(len(self.label)))
        first, second = (np.concatenate(c) if self.unsure else self.node[:0] for c in (zip(*self.unsure) if self.unsure else ((), ())))
        a = np.concatenate([self.node[linked], self.node[joined], first])
        b = np.concatenate([self.node[linked], self.node[self.label[joined]], second])
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(linked), len(joined), len(first)])
        n = np.r_[self.sums[linked].astype(np.int64), np.zeros(len(joined) + len(first), np.int64)]
        return pa.record_batch([pa.array(c) for c in (kind, a, b, n)], names=["kind", "a", "b", "n"])


def _buckets(index: DataFrame, tables: int, least: float, small: int, largest: int) -> DataFrame:
    """What ``_Bucket.results`` gives, of all buckets."""
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest)
    # Buckets are at most dimensions x tables x 2^signs, so the large ones are few.
    large = cut_lineage(sizes.select("key", F.ceil(F.col("n") / largest).cast("int").alias("_pieces")))
    own = F.pmod(F.xxhash64("node"), F.col("_pieces")).cast("int")
    dealt = index.join(F.broadcast(large), "key", "left").withColumn("piece", F.coalesce(own, F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    dealt = dealt.withColumn("_other", other).select("key", "node", "body", "piece", F.least("piece", "_other").alias("low"), F.greatest("piece", "_other").alias("high"))

    def solved(held):
        key, low, high = held[0][0][0].as_py(), held[0][3][0].as_py(), held[0][4][0].as_py()
        node = np.concatenate([h[1].to_numpy() for h in held])
        body = np.frombuffer(b"".join(b for h in held for b in h[2].to_pylist()), _body(tables, key >> 20))
        piece = np.concatenate([h[5].to_numpy() for h in held]) if low != high else None
        bucket = _Bucket(key, node, body, piece, least)
        bucket.solve(small)
        return bucket.results()

    def run(batches):
        held, before = [], None
        for batch in batches:
            columns = [batch.column(c) for c in ("key", "node", "body", "low", "high", "piece")]
            names = np.c_[tuple(columns[c].to_numpy() for c in (0, 3, 4))]
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)]) if len(names) else []
            for s, e in zip(starts, [*starts[1:], len(names)]):
                if held and tuple(names[s]) != before:
                    yield solved(held)
                    held = []
                before = tuple(names[s])
                held.append([c.slice(s, e - s) for c in columns])
        if held:
            yield solved(held)

    bucketed = spread(dealt, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return bucketed.mapInArrow(run, "kind int, a long, b long, n long")


def _verified(unsure: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, many_a, many_b): pairs whose cosine in double precision is ``least`` or more."""
    sides = unsure.select("a", "b")
    for side in ("a", "b"):
        sides = counted_join(sides, vectors.select(F.col("node").alias(side), F.col("vec").alias(f"vec_{side}"), F.col("many").alias(f"many_{side}")), [side])

    def run(batch):
        (x, _), (y, _) = matrix(batch.column("vec_a")), matrix(batch.column("vec_b"))
        cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        yield pa.record_batch([batch.column(c) for c in ("a", "b", "many_a", "many_b")], names=["a", "b", "many_a", "many_b"]).filter(pa.array(cosine >= least))

    # Pairs share a bucket, so their dimensions are equal; batches of one dimension each.
    sides = sides.withColumn("_dim", F.size("vec_a"))
    return map_arrow_by(sides, "_dim", run, "a long, b long, many_a long, many_b long")


def map_arrow_by(df: DataFrame, name: str, run, schema: str) -> DataFrame:
    """``map_arrow`` with batches in which ``name`` has one value each."""

    def each(batch):
        values = batch.column(name).to_numpy()
        for value in np.unique(values).tolist():
            yield from run(batch.filter(pa.array(values == value)))

    return map_arrow(df, each, schema)


def near_vectors(vectors: DataFrame, least: float = LEAST, vector: str = "embedding", name: str = "vec_id", small: int = SMALL, largest: int = LARGEST) -> DataFrame:
    """(``name``, n_links, component_id, kept) per row of ``vectors``.

    Rows link if the cosine of their vectors is ``least`` or more; ``n_links`` counts the other rows a row links with directly,
    ``component_id`` is the least name reachable, and the row that has it is ``kept``. Null, empty and zero vectors and
    those with null or non-finite components link with nothing; vectors of different dimensions do not link.
    Equal rows and repeated names are rows of their own. A row without a name takes part and is kept only if no
    row that it reaches has a name. An empty table gives no rows; extra columns are left out.
    """
    if not 0 < least < 1:
        raise ValueError("the least similarity lies between 0 and 1")
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(values, lambda x: x != 0)
    keyed = vectors.select(F.col(name).alias("name"), F.when(finite, values).alias("vec")).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    distinct = cut_lineage(
        keyed.filter("node is not null").groupBy("node").agg(F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("many"), F.min("name").alias("least"))
    )
    tables, bits = table_plan(distinct.count(), least)
    found = cut_lineage(_buckets(_index(distinct, tables, bits), tables, least, small, largest))
    close = cut_lineage(_verified(found.filter("kind = 2"), distinct, least))
    links = found.filter("kind = 0").select("a", "n").unionByName(
        close.select(F.explode(F.array(F.struct("a", F.col("many_b").alias("n")), F.struct(F.col("b").alias("a"), F.col("many_a").alias("n")))).alias("_l")).select("_l.*")
    ).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("kind = 1").select("a", "b").unionByName(close.select("a", "b")))
    rooted = cut_lineage(
        distinct.select("node", "many", "least").join(roots, "node", "left").join(links, "node", "left")
        .select("node", "many", "least", F.coalesce("root", "node").alias("root"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(names, "root").select("node", "many", "n_links", "component_id"))
    rows, side = keyed.select("name", "node"), named.select("node", "n_links", "component_id")
    if fits_broadcast(side, 48):
        out = rows.join(F.broadcast(side), "node", "left")
    else:
        # Rows that link with nothing have no node; they do not meet in one task.
        hot = hot_keys(named, ["node"], "many")
        out = salted_join(rows.filter("node is not null"), side, ["node"], hot).unionByName(
            rows.filter("node is null").select("node", "name", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast(rows.schema["name"].dataType).alias("component_id"))
        )
    component = F.when(F.col("node").isNull(), F.col("name")).otherwise(F.col("component_id"))
    return out.select(F.col("name").alias(name), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col(name).eqNullSafe(F.col("component_id"))
    )
