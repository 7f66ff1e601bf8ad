"""Document fingerprints by winnowing.

Hashes of all k-grams of code points roll over the text. Of every ``window`` of
consecutive ones the smallest is chosen, the rightmost of equal ones, and kept
with its position. Two texts that share window + k - 1 characters in a row choose
a common hash there; shared passages shorter than k never match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.llm.common import map_arrow, pack, spread, text_or_empty, unpacked
from lorelink.llm.rolling import POSITION_BITS, Prefix, window_minima

GRAM = 16
WINDOW = 64
# The window of texts that are compared as wholes, so that halves of short ones share hashes too.
EDIT_WINDOW = 8
# Texts are worked on together up to this many characters; longer ones are cut, with overlap.
TOGETHER = 1 << 20


def winnow(texts: list[str], k: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of each text.

    A text with fewer k-grams than a window has one; one shorter than k is one gram as a whole; an empty one has none.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * len(texts)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        if size > TOGETHER:
            out[at] = _long(texts[at], k, window)
        else:
            out[at:end] = _together(texts[at:end], k, window)
        at = end
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _together(texts: list[str], k: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.r_[0, np.cumsum(sizes)]
    prefix = Prefix(_codes("".join(texts)))
    hashes = prefix.grams(k) if offsets[-1] >= k else np.zeros(0, np.uint64)
    least = window_minima(hashes, window)
    out = []
    for start, size in zip(offsets[:-1].tolist(), sizes.tolist()):
        grams = size - k + 1
        if grams >= window:
            chosen = least[start : start + grams - window + 1]
            chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
            out.append((chosen - start, hashes[chosen]))
        elif grams > 0:
            # The same bits are compared as in whole windows.
            keys = hashes[start : start + grams] >> np.uint64(POSITION_BITS)
            best = grams - 1 - int(keys[::-1].argmin())
            out.append((np.array([best]), hashes[start + best : start + best + 1]))
        elif size:
            out.append((np.zeros(1, np.int64), prefix.slices(np.array([start]), np.array([start + size]))))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    return out


def _long(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """One text in overlapping pieces, each with all windows that begin in it."""
    places, hashes = [], []
    for start in range(0, len(text) - k - window + 2, TOGETHER):
        (place, h), = _together([text[start : start + TOGETHER + k + window - 2]], k, window)
        place = place + start
        again = len(places) and place[0] == places[-1][-1]
        places.append(place[1:] if again else place)
        hashes.append(h[1:] if again else h)
        if not len(places[-1]):
            places.pop()
            hashes.pop()
    return np.concatenate(places), np.concatenate(hashes)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def spelled(hashes: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits of each hash, by position."""
    return (hashes >> np.uint64(32)).astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` without its text, with ``positions`` and ``hashes``. Null is empty, repeated rows stay, an empty table gives no rows."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "positions", "hashes", "_text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["positions array<long>", "hashes array<long>"])

    def run(batch):
        found = winnow(batch.column("_text").to_pylist(), k, window)
        offsets = pa.array(np.r_[0, np.cumsum([len(p) for p, _ in found])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c))) for c in ([p for p, _ in found], [h.view(np.int64) for _, h in found])]
        yield pa.record_batch([*(batch.column(f.name) for f in rest), *lists], names=[*(f.name for f in rest), "positions", "hashes"])

    return map_arrow(docs.select(*[f.name for f in rest], text_or_empty(text).alias("_text")), run, schema)


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """About ``parts`` - 1 ids that cut the table into equal ranges: as many numbers as partitions, whatever the size."""
    cuts = docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return sorted({int(c) for c in cuts})


def with_next(docs: DataFrame, each, schema: str, text: str = "text") -> DataFrame:
    """``each(ids, texts, nexts)`` over all rows in descending order of doc_id, with the text of the next row.

    The last row is followed by the first. Rows of one id stand in the order of
    their text hashes. Rows without doc_id stand outside: no text follows (None). ``each``
    gets lists, in blocks, and returns a record batch of ``schema``; its ``nexts``
    is one list of texts, its last entry the text after the block.
    Ids are cut into ranges, more than there are partitions; the head of each range is sent to the range
    before it as well, so texts are shuffled once, compressed, and no task sees more than a few ranges.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_bounds(rows.filter("doc_id is not null"), parts), np.int64)

    def ranges(batch):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.record_batch([pa.array(np.searchsorted(bounds, ids, "left").astype(np.int32)), batch.column("doc_id")], names=["part", "doc_id"])

    heads = map_arrow(rows.filter("doc_id is not null").select("doc_id"), ranges, "part int, doc_id long")
    heads = sorted(heads.groupBy("part").agg(F.max("doc_id").alias("head")).collect())  # one row per range
    # A range is followed by the head of the range with the next smaller ids, the lowest one by the very first row.
    followed: dict[int, list[int]] = {}
    for (part, _), (_, head) in zip(heads, [heads[-1:][0] if heads else None, *heads[:-1]]):
        followed.setdefault(head, []).append(part)

    def deal(batch):
        """Packed rows with their range; heads of ranges once more where they follow."""
        ids = batch.column("doc_id").to_pylist()
        ties = batch.column("_tie").to_pylist()
        part = np.searchsorted(bounds, np.array([0 if i is None else i for i in ids], np.int64), "left").tolist()
        take, to, after = [], [], []
        for row, i in enumerate(ids):
            take.append(row)
            to.append(part[row] if i is not None else -1 - ties[row] % parts)
            after.append(0)
            for other in followed.get(i, ()) if i is not None else ():
                take.append(row)
                to.append(other)
                after.append(1)
        picked = [batch.column(c).take(pa.array(take)) for c in ("doc_id", "_tie", "_packed", "_size")]
        yield pa.record_batch([pa.array(to, pa.int32()), pa.array(after, pa.int32()), *picked], names=["part", "after", "doc_id", "_tie", "_packed", "_size"])

    dealt = map_arrow(pack(rows), deal, "part int, after int, doc_id long, _tie long, _packed binary, _size long")
    dealt = spread(dealt, "part").sortWithinPartitions("part", "after", F.desc("doc_id"), "_tie")

    def run(batches):
        # Rows wait for the row behind them; ``held`` is the last row so far.
        held = None
        for batch in batches:
            sizes = batch.column("_size").to_numpy()
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), TOGETHER)) + at)
                some = batch.slice(at, min(end, batch.num_rows) - at)
                at = min(end, batch.num_rows)
                flat, offsets = unpacked(some)
                data, places = flat.tobytes(), offsets.tolist()
                rows = list(zip(some.column("part").to_pylist(), some.column("after").to_pylist(), some.column("doc_id").to_pylist(),
                                [data[a:b].decode("utf-8", "replace") for a, b in zip(places, places[1:])]))
                rows = ([held] if held else []) + rows
                held = rows[-1]
                yield from _blocks(rows, each)
        if held:
            yield from _blocks([held, (None, 0, None, "")], each)

    return dealt.mapInArrow(run, schema)


def _blocks(rows, each):
    """Runs of rows of one range, each with the row that follows it; copies that only follow are not asked for."""
    ids, texts, follow = [], [], []
    for (part, after, doc_id, text), (next_part, _, _, next_text) in zip(rows, rows[1:]):
        if after:
            continue
        ids.append(doc_id)
        texts.append(text)
        follow.append(next_text if doc_id is not None and next_part == part else None)
    if ids:
        yield each(ids, texts, follow)


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_halves(docs: DataFrame, text: str = "text", k: int = GRAM, window: int = EDIT_WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edit: the last half replaced by the start of the next document's text.

    Next in descending order of doc_id, after the last the first. The last floor(n / 2) characters go,
    as many (or all) of the next text's come. ``near_edited`` and ``near_next`` are the likeness of the
    text's fingerprint to that of the edit and of the next text. Rows without doc_id have no next: they
    lose their last half, and ``near_next`` is null. Null texts are empty, repeated rows stay,
    an empty table gives no rows, further columns are left out.
    """

    def each(ids, texts, follow):
        edits = [t[: len(t) - len(t) // 2] + (n or "")[: len(t) // 2] for t, n in zip(texts, follow)]
        # Texts that follow each other are fingerprinted once.
        index: dict[str, int] = {}
        for t in (*texts, *edits, *(n for n in follow if n is not None)):
            index.setdefault(t, len(index))
        found = [h for _, h in winnow(list(index), k, window)]
        names = [spelled(h) for h in found]
        own, edit = [index[t] for t in texts], [index[t] for t in edits]
        return pa.record_batch(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edits]),
                pa.array([names[i] for i in own]), pa.array([names[i] for i in edit]),
                pa.array([likeness(found[a], found[b]) for a, b in zip(own, edit)]),
                pa.array([None if n is None else likeness(found[a], found[index[n]]) for a, n in zip(own, follow)], pa.float64()),
            ],
            names=[f.split()[0] for f in _EDITED.split(", ")],
        )

    return with_next(docs, each, _EDITED, text)
