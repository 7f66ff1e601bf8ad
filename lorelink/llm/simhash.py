"""Near-duplicates by SimHash, found through one-wildcard variants of fingerprint segments.

Fingerprints of 64 bits link at up to d differing bits. Cut into d // 2 + 1 segments
(two for d = 3), such a pair has a segment that differs in one bit at most. Each
segment is indexed under itself and under its variants with one bit taken out;
fingerprints that agree in a variant meet and are verified. Pairs whose segment is
equal are looked for under the segment itself, pairs that differ in one bit only
under the variant without this bit, so no pair is looked at twice for one segment.

What meets is distinct fingerprints, not documents. In a bucket a search from
fingerprint to fingerprint emits a spanning forest, never all pairs. Segments with
more than ``crowd`` fingerprints are indexed once more by segments of their other
bits, which for d = 3 leaves at most 2^18 fingerprints to a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.llm.common import chunks, map_arrow, spread, text_or_empty, texts_as_bytes
from lorelink.llm.components import components
from lorelink.operators.skew import BROADCAST_BYTES, fits_broadcast
from lorelink.session import cut_lineage

SHINGLE = 3
DISTANCE = 3
SEED = 42
# Distinct fingerprints with the same half beyond which the half is indexed more finely.
CROWD = 16_384


def text_fingerprint_inputs(data: bytes, words: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text; A-Z are lower-cased, words join with one space."""
    parts = data.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    one = xxhash.xxh64_intdigest
    return [one(joined[a:b], seed) for a, b in zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist())]


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, fp): the fingerprint of each row as a signed long.

    A text of fewer words than a shingle is one shingle; one without words
    (null, empty, blank) has fingerprint zero. ``row_key`` is a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("_text"))

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        out = np.zeros(batch.num_rows, np.uint64)
        for first, last in chunks(offsets):
            data = flat[offsets[first] : offsets[last]].tobytes()
            at = (offsets[first : last + 1] - offsets[first]).tolist()
            for i in range(last - first):
                hashes = text_fingerprint_inputs(data[at[i] : at[i + 1]], words, seed)
                out[first + i] = majority(np.array(hashes, np.uint64))
        yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), pa.array(out.view(np.int64))], names=["doc_id", "row_key", "fp"])

    return map_arrow(rows.select("doc_id", F.xxhash64("_text").alias("row_key"), "_text"), run, "doc_id long, row_key long, fp long")


def _variants(value: np.ndarray, width: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """``width`` bits from ``shift`` on without each of its bits, then as they are; and which bit is missing."""
    part = (value >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    kinds = np.arange(width + 1, dtype=np.uint64)
    keep = np.uint64((1 << width) - 1) ^ np.where(kinds < width, np.uint64(1) << np.minimum(kinds, np.uint64(63)), np.uint64(0))
    return part[:, None] & keep, kinds


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    ends = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


_SEGMENT = 40  # the segment number stands above the bit taken out (from bit 32 on) and the value


def index_keys(fp: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """One row of keys per fingerprint: segment number, the bit taken out (the width: none) and the value."""
    parts = []
    for number, (start, width) in enumerate(cuts):
        value, kinds = _variants(fp, width, start)
        parts.append(value | (kinds << np.uint64(32)) | np.uint64(number << _SEGMENT))
    return np.concatenate(parts, axis=1)


def _index(distinct: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """(key, fp): for two segments 66 rows per fingerprint."""

    def run(batch):
        fp = batch.column("fp").to_numpy().view(np.uint64)
        keys = index_keys(fp, cuts)
        yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), keys.shape[1]))], names=["key", "fp"])

    return map_arrow(distinct.select("fp"), run, "key long, fp long")


def _finer(crowded: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """(key, finer, fp): crowded buckets cut by one-wildcard variants of segments of the other bits."""

    def run(batch):
        fps = batch.column("fp").to_numpy().view(np.uint64)
        keys = batch.column("key").to_numpy()
        for number, (start, width) in enumerate(cuts):
            mine = keys >> _SEGMENT == number
            fp, key = fps[mine], keys[mine]
            if not len(fp):
                continue
            low = fp & np.uint64((1 << start) - 1)
            other = low | (fp >> np.uint64(start + width)) << np.uint64(start) if start + width < 64 else low
            ends = [(64 - width) * i // len(cuts) for i in range(len(cuts) + 1)]
            finer = index_keys(other, [(a, b - a) for a, b in zip(ends, ends[1:])])
            n = finer.shape[1]
            yield pa.record_batch(
                [pa.array(np.repeat(key, n)), pa.array(finer.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), n))], names=["key", "finer", "fp"]
            )

    return map_arrow(crowded, run, "key long, finer long, fp long")


def forest(fp: np.ndarray, side: np.ndarray | None, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among ``fp``; with ``side`` only links across it count."""
    edges = []
    left = np.arange(len(fp))
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            block, frontier = frontier[:64], frontier[64:]
            near = np.bitwise_count(fp[block][:, None] ^ fp[left][None, :]) <= distance
            if side is not None:
                near &= side[block][:, None] != side[left][None, :]
            hit = near.any(axis=0)
            if hit.any():
                reached = left[hit]
                edges.append((fp[block[near[:, hit].argmax(axis=0)]], fp[reached]))
                left = left[~hit]
                frontier = np.concatenate([frontier, reached])
    return edges


def _links(distance: int, cuts: list[tuple[int, int]]):
    """Sorted (key, finer, fp) rows to links (a, b); a bucket that batches cut is carried on."""
    several = 6
    first, width = np.array(cuts).T

    def bucket(key: int, fp: np.ndarray):
        kind, number = (key >> 32) & 63, key >> _SEGMENT
        side = None if kind == width[number] else (fp >> np.uint64(kind + first[number])) & np.uint64(1)
        return forest(fp, side, distance) if side is None or (side[0] != side).any() else []

    def solve(key, finer, fp):
        a, b = [], []
        new = np.r_[True, (key[1:] != key[:-1]) | (finer[1:] != finer[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(key)])
        few = np.repeat(sizes <= several, sizes)
        kind, number = (key >> 32) & 63, key >> _SEGMENT
        shift, exact = kind + first[number], kind == width[number]
        for d in range(1, min(several, len(key))):
            same = (key[d:] == key[:-d]) & (finer[d:] == finer[:-d]) & few[d:]
            at = np.flatnonzero(same)
            differ = fp[at] ^ fp[at + d]
            ok = np.bitwise_count(differ) <= distance
            ok &= exact[at] | ((differ >> np.minimum(shift[at], 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a.append(fp[at[ok]])
            b.append(fp[at[ok] + d])
        for s, n in zip(starts[sizes > several].tolist(), sizes[sizes > several].tolist()):
            for x, y in bucket(int(key[s]), fp[s : s + n]):
                a.append(x)
                b.append(y)
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(tuple(batch.column(n).to_numpy() for n in ("key", "finer", "fp")))
            rows += batch.num_rows
            if rows < 1 << 18:
                continue
            key, finer, fp = _columns(held)
            # The last bucket may go on in the next batch.
            cut = len(key) - 1
            ends = np.flatnonzero((key != key[cut]) | (finer != finer[cut]))
            if not len(ends):
                continue
            cut = int(ends[-1]) + 1
            if cut > 1:
                yield solve(key[:cut], finer[:cut], fp[:cut])
            held, rows = [(key[cut:], finer[cut:], fp[cut:].view(np.int64))], 0
        if held:
            columns = _columns(held)
            if len(columns[0]) > 1:
                yield solve(*columns)

    def _columns(held):
        key, finer, fp = (np.concatenate(c) for c in zip(*held))
        return key, finer, fp.view(np.uint64)

    return run


def near_links(distinct: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within ``distance`` bits, directly or through others."""
    if not 0 <= distance <= 13:
        raise ValueError("segments for more than 13 bits would be too short to tell fingerprints apart")
    cuts = segments(max(distance, 2))
    index = _index(distinct, cuts).withColumn("finer", F.lit(-1).cast("long"))

    def whole(batch):
        fp = batch.column("fp").to_numpy().view(np.uint64)
        values = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)) | np.uint64(i << _SEGMENT) for i, (a, n) in enumerate(cuts)]
        yield pa.record_batch([pa.array(np.concatenate(values).view(np.int64))], names=["segment"])

    counts = map_arrow(distinct.select("fp"), whole, "segment long").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.filter(F.col("n") > crowd)
    if not crowded.isEmpty():
        # All keys of a crowded segment, so that both sides of a variant agree on where they meet.
        def keys(batch):
            segment = batch.column("segment").to_numpy()
            for number, (_, width) in enumerate(cuts):
                value, kinds = _variants(segment[segment >> _SEGMENT == number].view(np.uint64), width, 0)
                key = value | (kinds << np.uint64(32)) | np.uint64(number << _SEGMENT)
                yield pa.record_batch([pa.array(key.ravel().view(np.int64))], names=["key"])

        hot = cut_lineage(map_arrow(crowded.select("segment"), keys, "key long").distinct())
        hot = F.broadcast(hot) if fits_broadcast(hot, 16) else hot
        index = index.join(hot, "key", "left_anti").unionByName(_finer(index.drop("finer").join(hot, "key", "left_semi"), cuts))
    sorted_ = spread(index.select("key", "finer", "fp"), "key", "finer").sortWithinPartitions("key", "finer", "fp")
    return sorted_.mapInArrow(_links(distance, cuts), "a long, b long").distinct()


def near_classes(docs: DataFrame, text: str = "text", distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) per row; the component is named by its least doc_id.

    Equal texts share a fingerprint and so a component (``root`` is its least
    fingerprint). Rows without doc_id take part; a component without any id has a
    null name. Repeated rows stay, an empty table gives no rows, and extra columns
    of ``docs`` are left out.
    """
    found = cut_lineage(fingerprints(docs, text))
    distinct = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), distance, crowd))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_lineage(rooted)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(names, "root").select("fp", "root", "component_id"))
    return found.join(named, "fp")


def one_per_class(docs: DataFrame, text: str = "text", distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: least doc_id, then least text hash; repeated rows once.

    Rows without doc_id stay only in classes where no row has one. All columns pass through.
    """
    return keep_one(docs, near_classes(docs, text, distance, crowd), text)


def keep_one(docs: DataFrame, classes: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each of ``classes`` (doc_id, row_key, root), chosen and repeated as ``one_per_class`` says."""
    pairs = cut_lineage(classes.groupBy("root", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"))
    best = pairs.groupBy("root").agg(F.min(order).alias("_best"))
    mine = F.col("_best.d").eqNullSafe(F.col("doc_id")) & (F.col("_best.k") == F.col("row_key"))
    judged = cut_lineage(
        pairs.join(best, "root")
        .select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.when(mine, F.col("n")).otherwise(0).alias("_rows"))
        .filter("_rows != 1")
    )
    small = judged.count() * 40 <= BROADCAST_BYTES
    # The caller's row is one column, so that no name of theirs meets one of ours.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("_own"), F.xxhash64(text_or_empty(text)).alias("_row_key"))
    same = keyed["_own"].eqNullSafe(judged["_id"]) & (keyed["_row_key"] == judged["_key"])
    joined = keyed.join(F.broadcast(judged) if small else judged, same, "left")
    single = joined.filter("_rows is null").select("_row")
    repeated = joined.filter("_rows > 1").dropDuplicates(["_id", "_key"]).select("_row")
    return single.unionByName(repeated).select("_row.*")
