"""Near-duplicate texts by SimHash: candidates from one-wildcard variants of fingerprint segments, five-word likeness checked exactly.

Each text has several independent fingerprints (``PRINTS``) over its set of five-word shingles. Two sets of likeness 0.8 differ in
about 9.7 of 64 bits, so texts are candidates if any of their fingerprints lie within ``DISTANCE`` bits; that
finds such a pair with a chance of 0.93, one of likeness 0.85 with 0.985 and of 0.9 with 0.999. Segments, variants and
keys are those of ``simhash``: six segments of a fingerprint, of which one differs in one bit at most.

Candidates count as near only if their sets have the likeness in fact (``alike``). Equal sets are one from
the start. In a bucket where many texts are near each other only a spanning forest is compared at first; then all candidates
that are not in one component yet, so that a rejected edge of a forest costs no link and a group of copies is not compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.llm.alike import WORDS, shingles, verified
from lorelink.llm.common import chunks, map_arrow, spread, text_or_empty, texts_as_bytes
from lorelink.llm.components import components
from lorelink.llm.rolling import mix
from lorelink.llm.simhash import forest, index_keys, keep_one, majority, segments
from lorelink.session import cut_lineage, discard, release

PRINTS, DISTANCE = 2, 11
# Near pairs per text of a bucket beyond which a spanning forest stands for them.
DENSE = 1
_BLOCK = 512


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, row_key, node, n, fp0, ...): per row its set of shingles, named by hash, its size and fingerprints."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("_text"))
    names = ["doc_id", "row_key", "node", "n", *(f"fp{p}" for p in range(PRINTS))]

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        out = np.zeros((2 + PRINTS, batch.num_rows), np.uint64)
        for first, last in chunks(offsets):
            data, at = flat[offsets[first] : offsets[last]].tobytes(), (offsets[first : last + 1] - offsets[first]).tolist()
            for i in range(last - first):
                grams = shingles(data[at[i] : at[i + 1]], WORDS)
                prints = [majority(grams if not p else mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * p % (1 << 64)))) for p in range(PRINTS)]
                out[:, first + i] = xxhash.xxh64_intdigest(grams.tobytes()), len(grams), *prints
        yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), *(pa.array(c.view(np.int64)) for c in out)], names=names)

    return map_arrow(rows.select("doc_id", F.xxhash64("_text").alias("row_key"), "_text"), run, ", ".join(f"{n} long" for n in names))


def _close(fp: np.ndarray, root: np.ndarray, side: np.ndarray | None, distance: int, every: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of one bucket within ``distance`` bits and of different roots; without ``every`` a forest if there are many."""
    found, total = [], 0
    for at in range(0, len(fp), _BLOCK):
        mine = slice(at, at + _BLOCK)
        near = np.bitwise_count(fp[mine, None] ^ fp[None, at:]) <= distance
        near &= root[mine, None] != root[None, at:]
        if side is not None:
            near &= side[mine, None] != side[None, at:]
        i, j = np.nonzero(near)
        ahead = j > i
        found.append((at + i[ahead], at + j[ahead]))
        total += int(ahead.sum())
        if total > DENSE * len(fp) and not every:
            place = {f: i for i, f in enumerate(fp.tolist())}
            return [tuple(np.array([place[f] for f in c.tolist()], np.int64) for c in edge) for edge in forest(fp, side, distance)]
    return found


def candidates(items: DataFrame, distance: int, every: bool) -> DataFrame:
    """(a, root_a, b, root_b): pairs of fingerprints among ``items`` (fp, root) within ``distance`` bits, of different roots.

    Without ``every`` each fp stands once in ``items``, and pairs of a dense bucket may be a spanning forest of it.
    """
    cuts = segments(distance)
    first, width = np.array(cuts).T

    def keyed(batch):
        fp = batch.column("fp").to_numpy().view(np.uint64)
        keys = index_keys(fp, cuts)
        n = keys.shape[1]
        columns = [keys.ravel().view(np.int64), np.repeat(fp.view(np.int64), n), np.repeat(batch.column("root").to_numpy(), n)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["key", "fp", "root"])

    def solve(key, fp, root):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            if e - s < 2:
                continue
            kind, number = int(key[s]) >> 32 & 63, int(key[s]) >> 40
            # Under a variant only pairs count that differ in the bit taken out; the others meet under the segment itself.
            side = None if kind == width[number] else (fp[s:e] >> np.uint64(kind + first[number])) & np.uint64(1)
            if side is None or (side != side[0]).any():
                out += [(s + i, s + j) for i, j in _close(fp[s:e], root[s:e], side, distance, every)]
        if out:
            i, j = (np.concatenate(c) for c in zip(*out))
            i, j = np.where(fp[i] <= fp[j], i, j), np.where(fp[i] <= fp[j], j, i)
            columns = [fp[i].view(np.int64), root[i], fp[j].view(np.int64), root[j]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["a", "root_a", "b", "root_b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "fp", "root")])
            rows += batch.num_rows
            if rows < 1 << 17:
                continue
            key, fp, root = (np.concatenate(c) for c in zip(*held))
            # The last bucket may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from solve(key[:cut], fp[:cut].view(np.uint64), root[:cut])
            held, rows = [[key[cut:], fp[cut:], root[cut:]]], len(key) - cut
        if rows:
            key, fp, root = (np.concatenate(c) for c in zip(*held))
            yield from solve(key, fp.view(np.uint64), root)

    index = map_arrow(items.select("fp", "root"), keyed, "key long, fp long, root long")
    # In the order of fingerprints, so that the forests of a group begin with the same texts in all its buckets and agree in most edges.
    return spread(index, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, root_a long, b long, root_b long").distinct()


def _node_pairs(nodes: DataFrame, roots: DataFrame | None, distance: int) -> DataFrame:
    """(a, b): pairs of nodes whose fingerprints are close, by way of the least node of each fingerprint (and root).

    ``roots`` (node, root) says what is connected already; pairs within one root are left out.
    """
    out = None
    if roots is not None:
        nodes = cut_lineage(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    for p in range(PRINTS):
        print_ = nodes.select(F.col(f"fp{p}").alias("fp"), "node", *(["root"] if roots is not None else []))
        if roots is None:
            items = print_.groupBy("fp").agg(F.min("node").alias("least")).withColumn("root", F.col("fp"))
            # Different sets with the same fingerprint are compared with the least of them.
            same = print_.join(items.drop("root"), "fp").filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
        else:
            items = print_.groupBy("fp", "root").agg(F.min("node").alias("least"))
            first = items.groupBy("fp").agg(F.min("least").alias("_first"))
            same = items.join(first, "fp").filter("least != _first").select(F.col("_first").alias("a"), F.col("least").alias("b"))
        items = cut_lineage(items)
        found = candidates(items, distance, roots is not None)
        for side in ("a", "b"):
            name = items.select(F.col("fp").alias(side), F.col("root").alias(f"root_{side}"), F.col("least").alias(f"node_{side}"))
            found = found.join(name, [side, f"root_{side}"])
        pairs = cut_lineage(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(same))
        discard(items)
        release(nodes.sparkSession)
        out = pairs if out is None else out.unionByName(pairs)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, row_key, root) per row: near texts, directly or through others, have the same root.

    Texts without words (null, empty, blank) are equal; texts of fewer words than a shingle are one shingle. Rows
    without doc_id take part; repeated rows stay; an empty table gives no rows.
    """
    found = cut_lineage(_sets(docs, text))
    nodes = cut_lineage(found.groupBy("node").agg(F.first("n").alias("n"), *[F.first(f"fp{p}").alias(f"fp{p}") for p in range(PRINTS)]))
    pairs = cut_lineage(_node_pairs(nodes, None, distance))
    links = cut_lineage(verified(docs, found, pairs, text))
    release(docs.sparkSession)
    roots = components(links)
    more = cut_lineage(_node_pairs(nodes, roots, distance).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        roots = components(links.unionByName(cut_lineage(verified(docs, found, more, text))))
    discard(nodes, pairs, more, links)
    release(docs.sparkSession)
    named = found.select("doc_id", "row_key", "node").join(roots, "node", "left")
    return named.select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))


def one_per_class(docs: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each class of near texts, chosen as ``keep_one`` does. All columns pass through."""
    return keep_one(docs, near_classes(docs, text, distance), text)
