"""Near-duplicates by exact likeness: all pairs of texts whose sets of five-word shingles have a Jaccard likeness of 0.8.

No such pair is missed. In any common order of shingles two sets that alike share one
among the first n - ceil(0.8 n) + 1 of each (the prefix), so sets that share a prefix shingle
are the candidates, and every candidate is compared in full. The order only
decides how many candidates there are: it goes by hash, but shingles in the prefixes of
more than ``crowd`` sets come last, rarer ones first.

Equal sets are one set from the start. Of a shingle with many sets only neighbours in size
and pairs with the smallest set are compared at first; then all pairs that are not yet in
one component, so groups of many copies are not compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.llm.common import chunks, map_arrow, pack, spread, text_or_empty, texts_as_bytes
from lorelink.llm.components import components
from lorelink.llm.simhash import keep_one, text_fingerprint_inputs
from lorelink.operators.skew import BROADCAST_BYTES, counted_join, fits_broadcast
from lorelink.session import cut_lineage

WORDS = 5
# The least likeness as a fraction; whole numbers keep the comparison exact.
OVER, UNDER = 4, 5
# Sets with the same shingle in their prefixes beyond which the shingle moves back in the order.
CROWD = 200
# Sets that are compared pair by pair at once.
SEVERAL = 32
# Rounds of moving crowded shingles back; how many there are decides nothing but the cost.
ROUNDS = 3


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    return np.unique(np.array(text_fingerprint_inputs(data, words), np.uint64))


def is_alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the likeness of two sets is OVER / UNDER at least; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * UNDER >= OVER * (len(a) + len(b) - both)


def _sets(docs: DataFrame, text: str, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, row_key, node, n, prefix): per row its set, named by hash, the size of the set and its prefix."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batch):
        often, many = shared.value
        flat, offsets = texts_as_bytes(batch.column("_text"))
        nodes, sizes, prefixes = [], [], []
        for first, last in chunks(offsets):
            for i in range(first, last):
                grams = shingles(flat[offsets[i] : offsets[i + 1]].tobytes())
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes()))
                sizes.append(len(grams))
                if len(often) and len(grams):
                    at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                    rank = np.where(often[at] == grams, many[at], 0)
                    grams = grams[np.argsort(rank, kind="stable")]
                prefixes.append(grams[: len(grams) - -(-OVER * len(grams) // UNDER) + 1])
        ends = pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32))
        yield pa.record_batch(
            [
                batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes).view(np.int64))),
            ],
            names=["doc_id", "row_key", "node", "n", "prefix"],
        )

    return map_arrow(rows.select("doc_id", F.xxhash64("_text").alias("row_key"), "_text"), run, "doc_id long, row_key long, node long, n int, prefix array<long>")


def _index(found: DataFrame) -> DataFrame:
    """(gram, node, n): the prefixes, equal sets once. A row whose text has the least hash stands for its set."""
    first = found.groupBy("node").agg(F.min("row_key").alias("row_key"))
    one = found.join(first, ["node", "row_key"]).dropDuplicates(["node"])
    return one.select("node", "n", F.explode("prefix").alias("gram"))


def _hot(index: DataFrame, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Crowded shingles, sorted, and how many sets have them; as many as may travel, the most frequent first."""
    counted = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    rows = counted.orderBy(F.desc("n"), "gram").limit(BROADCAST_BYTES // 64).collect()
    grams = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r.n for r in rows], np.int64)[order]


def _pairs(index: DataFrame, several: int, rest: bool) -> DataFrame:
    """Candidates (a, b), sizes in reach of the likeness. With ``rest`` only of shingles with many sets: pairs of different ``root``."""

    def solve(gram, n, node, root):
        new = np.r_[True, gram[1:] != gram[:-1]]
        starts = np.flatnonzero(new)
        counts = np.diff(np.r_[starts, len(gram)])
        if rest:
            for s, many in zip(starts[counts > several].tolist(), counts[counts > several].tolist()):
                held, total = [], 0
                sizes, e = n[s : s + many], s + many
                reach = s + np.searchsorted(sizes, sizes * UNDER // OVER, "right")
                for i in range(s, e):
                    others = np.arange(i + 1, reach[i - s])
                    others = others[root[others] != root[i]]
                    held.append((np.full(len(others), node[i]), node[others]))
                    total += len(others)
                    if total > 200_000:
                        yield _batch(held)
                        held, total = [], 0
                if total:
                    yield _batch(held)
            return
        held, few = [], np.repeat(counts <= several, counts)
        for d in range(1, min(several, len(gram))):
            same = gram[d:] == gram[:-d]
            at = np.flatnonzero(same & (few[d:] | (d == 1)) & (n[d:] * OVER <= n[:-d] * UNDER))
            held.append((node[at], node[at + d]))
            if not same.any():
                break
        first = np.repeat(starts, counts)
        at = np.flatnonzero(~few & (n * OVER <= n[first] * UNDER))
        held.append((node[first[at]], node[at]))
        yield _batch(held)

    def _batch(held):
        x, y = (np.concatenate(c) for c in zip(*held))
        x, y = x[x != y], y[x != y]
        return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "n", "node", "root")])
            rows += batch.num_rows
            if rows < 1 << 17:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            # The last shingle may go on in the next batch.
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield from solve(*[c[:cut] for c in columns])
            held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if rows:
            yield from solve(*[np.concatenate(c) for c in zip(*held)])

    sorted_ = spread(index.select("gram", "n", "node", "root"), "gram").sortWithinPartitions("gram", "n", "node")
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, found: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of sets that are alike, compared in full."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    rows = docs.select(text_or_empty(text).alias("_text")).withColumn("row_key", F.xxhash64("_text"))
    # The rows are picked where they are read if their keys can travel, so that other texts do not move.
    first = cut_lineage(first)
    first = F.broadcast(first) if fits_broadcast(first, 24) else first
    texts = cut_lineage(pack(rows.join(first, "row_key")).dropDuplicates(["node"]).select("node", "_packed", "_size"))
    sides = pairs
    for side in ("a", "b"):
        sides = counted_join(sides, texts.select(F.col("node").alias(side), F.col("_packed").alias(f"_{side}"), F.col("_size").alias(f"_n{side}")), [side])

    def run(batch):
        codec, known = pa.Codec("zstd"), {}

        def grams(node, packed, size):
            if node not in known:
                if len(known) > 256:
                    known.clear()
                known[node] = shingles(codec.decompress(packed, size, asbytes=True))
            return known[node]

        rows = zip(*[batch.column(c).to_pylist() for c in ("a", "_a", "_na", "b", "_b", "_nb")])
        ok = [is_alike(grams(a, x, n), grams(b, y, m)) for a, x, n, b, y, m in rows]
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return map_arrow(sides, run, "a long, b long")


def alike_classes(docs: DataFrame, text: str = "text", crowd: int = CROWD, several: int = SEVERAL) -> DataFrame:
    """(doc_id, row_key, root) per row: texts that are alike, directly or through others, have the same root."""
    hot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for number in range(ROUNDS):
        found = cut_lineage(_sets(docs, text, hot))
        index = cut_lineage(_index(found))
        now = _hot(index, crowd) if number < ROUNDS - 1 else hot
        if np.isin(now[0], hot[0]).all():
            break
        grams = np.union1d(now[0], hot[0])
        many = np.zeros(len(grams), np.int64)
        for some, counts in (hot, now):
            at = np.searchsorted(grams, some)
            many[at] = np.maximum(many[at], counts)
        hot = grams, many
    pairs = cut_lineage(_pairs(index.withColumn("root", F.lit(0).cast("long")), several, rest=False))
    links = cut_lineage(verified(docs, found, pairs, text))
    roots = components(links)

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")

    more = cut_lineage(_pairs(rooted(index), several, rest=True).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        roots = components(links.unionByName(verified(docs, found, more, text)))
    return rooted(found.select("doc_id", "row_key", "node")).select("doc_id", "row_key", "root")


def one_per_class(docs: DataFrame, text: str = "text", crowd: int = CROWD, several: int = SEVERAL) -> DataFrame:
    """``docs`` with one row of each class of alike texts, chosen as ``keep_one`` does."""
    return keep_one(docs, alike_classes(docs, text, crowd, several), text)
