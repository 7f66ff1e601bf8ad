"""Exact repeats: suffix arrays at anchors, their common-prefix interval trees, and what repeats cover.

A string of ``length`` bytes that occurs twice picks the same anchor in both
places: the position of the smallest ``GRAM``-byte hash inside it. So it is
enough to compare suffixes that start at anchors, and only those whose first
``GRAM`` bytes occur more than once. For each such gram:

1. The contexts (the bytes up to ``length`` around the anchor) are counted by
   hash first. A context that occurs twice is covered whole, whatever else
   there is; thousands of copies become one row with a count.
2. One context of each kind is fetched. Their suffixes are sorted, neighbours
   give the common prefixes, and a stack scan gives the interval tree.
3. Inside an interval the contexts are ordered by what stands to the left. Runs
   whose left parts are long enough are maximal repeats: they cannot grow to the
   right (the interval) nor to the left (the run), and hold all occurrences.

A gram with more than ``largest`` different contexts does not meet in one task;
its windows are counted by hash instead, which finds the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorelink.llm.common import map_arrow, pack, packed_parts, spread, text_or_empty, texts_as_bytes, unpacked
from lorelink.llm.rolling import Prefix, window_minima
from lorelink.operators.skew import fits_broadcast
from lorelink.session import cut_lineage, discard, release

LENGTH = 400
# Gram length as a share of the length: longer grams are rarer, but anchors are then closer together.
GRAM_SHARE = 0.32
LARGEST = 50_000
# Anchors are looked for in so many bytes at a time; each costs about 80 bytes of memory then.
CHUNK = 1 << 18

# The place of an anchor: its position, and the bytes of context on both sides in 16 bits each.
_ANCHORS = "doc_id long, row_key long, place long, gram long, context long"


def _place(column: str = "place") -> dict[str, Column]:
    """``pos, left, right`` of a packed place."""
    place = F.col(column)
    return {
        "pos": F.shiftright(place, 32).cast("int"),
        "left": F.shiftright(place, 16).bitwiseAND(0xFFFF).cast("int"),
        "right": place.bitwiseAND(0xFFFF).cast("int"),
    }


def gram_length(length: int) -> int:
    return max(1, int(length * GRAM_SHARE))


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """doc_id and a hash of the text name a row; equal rows have equal results anyway."""
    ident = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    return docs.withColumns({"_text": text_or_empty(text), "doc_id": ident.cast("long")}).withColumn("row_key", F.xxhash64("_text"))


def anchors(docs: DataFrame, length: int = LENGTH, text: str = "text", unit: int | None = None) -> DataFrame:
    """One row per anchor: its row, its packed place, hash of gram and of context.

    The context is ``left`` bytes before ``pos`` and ``right`` bytes from ``pos`` on, cut at the ends of the text. Anchors are
    chosen in windows of ``unit`` bytes (``length`` or less), so that repeats from ``unit`` bytes on have one.
    """
    unit = unit or length
    if not 1 <= unit <= length <= 0xFFFF:
        raise ValueError("the length must fit into 16 bits, and the unit into the length")
    gram = gram_length(unit)
    windows = unit - gram + 1
    reach = length - gram

    def pieces(size: int):
        """Long texts in overlapping pieces: data from, to; first and last window start."""
        for first in range(0, max(1, size - unit + 1), CHUNK):
            last = min(first + CHUNK, size - unit + 1)
            # A later piece begins one window early, to know the anchor it continues.
            early = max(0, first - 1)
            yield max(0, early - reach), min(size, last + 2 * length), early, last

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        ids, keys = batch.column("doc_id"), batch.column("row_key")
        sizes = np.diff(offsets)
        long_enough = np.flatnonzero(sizes >= unit)
        todo = [(int(r), *p) for r in long_enough for p in pieces(int(sizes[r]))]
        begin = 0
        while begin < len(todo):
            end, total = begin, 0
            while end < len(todo) and (end == begin or total + todo[end][2] - todo[end][1] <= CHUNK):
                total += todo[end][2] - todo[end][1]
                end += 1
            group = np.array(todo[begin:end], np.int64)
            begin = end
            row, lo, hi, first, last = group.T
            data = np.concatenate([flat[offsets[r] + a : offsets[r] + b] for r, a, b in zip(row, lo, hi)])
            base = np.zeros(len(row) + 1, np.int64)
            np.cumsum(hi - lo, out=base[1:])
            prefix = Prefix(data)
            hashes = prefix.grams(gram)
            least = window_minima(hashes, windows)
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, base[:-1] + first - lo, 1)
            np.add.at(mark, base[:-1] + last - lo, -1)
            chosen = least[np.flatnonzero(np.cumsum(mark)[: len(least)])]
            chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
            piece = np.searchsorted(base, chosen, "right") - 1
            known = np.r_[True, piece[1:] != piece[:-1]] & (first[piece] > 0)
            chosen, piece = chosen[~known], piece[~known]
            from_ = np.maximum(chosen - reach, base[piece])
            to = np.minimum(chosen + length, base[piece + 1])
            context = prefix.slices(from_, to) ^ (chosen - from_).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            rows = pa.array(row[piece])
            yield pa.record_batch(
                [
                    ids.take(rows), keys.take(rows),
                    pa.array((chosen - base[piece] + lo[piece]) << 32 | (chosen - from_) << 16 | (to - chosen)),
                    pa.array(hashes[chosen].view(np.int64)), pa.array(context.view(np.int64)),
                ],
                names=[f.split()[0] for f in _ANCHORS.split(", ")],
            )

    return map_arrow(_identified(docs, text).select("doc_id", "row_key", "_text"), run, _ANCHORS)


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share at their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def interval_tree(common: list[int]) -> list[tuple[int, int, int]]:
    """(value, first, last) of each interval of a common-prefix array, children before parents.

    ``common[i]`` is what sorted suffixes i and i + 1 share. One scan with a stack.
    """
    found, stack = [], []
    for i, value in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > value:
            height, first = stack.pop()
            found.append((height, first, i))
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return found


def maximal_repeats(contexts: list[tuple[bytes, bytes]], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of at least ``length`` shared bytes: (bytes right of the anchor, [(context, bytes left of it)]).

    ``contexts`` are (reversed left part, right part) of different anchors with
    the same gram. The left reach of a member is the longest it shares with any
    other member of its group.
    """
    n = len(contexts)
    if n == 2:
        (la, ra), (lb, rb) = contexts
        right, left = _common(ra, rb), _common(la, lb)
        return [(right, [(0, left), (1, left)])] if right + left >= length else []
    order = sorted(range(n), key=lambda i: contexts[i][1])
    rank = [0] * n
    by_left = sorted(range(n), key=lambda i: contexts[i][0])
    for place, i in enumerate(by_left):
        rank[i] = place
    shared_left = [_common(contexts[a][0], contexts[b][0]) for a, b in zip(by_left, by_left[1:])]
    common = [_common(contexts[a][1], contexts[b][1]) for a, b in zip(order, order[1:])]
    place_of = {i: place for place, i in enumerate(order)}
    longest_left = max(shared_left)
    left_array = np.array(shared_left, np.int32)
    groups = []
    for right, first, last in interval_tree(common):
        need = max(0, length - right)  # what is shared to the right alone may be enough
        if need > longest_left:
            continue
        members = sorted(rank[i] for i in order[first : last + 1])
        # What two places in left order share is the least between them.
        shares = np.minimum.reduceat(left_array, members[:-1]) if members[-1] == n - 1 else np.minimum.reduceat(left_array, members)[:-1]
        if len(members) == n:
            shares = left_array
        run: list[tuple[int, int]] = []
        before = -1
        for place, member in enumerate(members):
            after = int(shares[place]) if place < len(members) - 1 else -1
            if max(before, after) >= need:
                run.append((by_left[member], max(before, after)))
            if after < need and run:
                # Members that all share more to the right are a group of a smaller interval.
                places = [place_of[i] for i, _ in run]
                if min(common[min(places) : max(places)]) == right:
                    groups.append((right, run))
                run = []
            before = after
    return groups


def _solve(unit: int, length: int, covered: bool):
    """Per gram: its maximal repeats of ``unit`` bytes; or only how far those of ``length`` reach around the anchor of each context that occurs once.

    All repeats of a context hold its anchor, so together they cover one stretch. It is empty for contexts whose repeats are all shorter.
    """

    def groups(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][0] != row[0]:
                    yield held
                    held = []
                if not held or held[-1][1] != row[1]:  # repeated rows of documents fetch a context more than once
                    held.append(row)
        if held:
            yield held

    def run(batches):
        out: list[tuple] = []
        for held in groups(batches):
            if len(held) > 1:
                found = maximal_repeats([(h[3], h[4]) for h in held], unit)
                if covered:
                    reach: dict[int, tuple[int, int]] = {}
                    for right, members in found:
                        for i, left in members:
                            a, b = reach.get(i, (0, 0))
                            reach[i] = (max(a, left), max(b, right)) if left + right >= length else (a, b)
                    out += [(held[i][0], held[i][1], 0, left, right) for i, (left, right) in reach.items() if held[i][2] == 1]
                else:
                    for number, (right, members) in enumerate(found):
                        out += [(held[i][0], held[i][1], number, left, right) for i, left in members]
            if len(out) > 20_000:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    def _table(rows):
        names = ["gram", "context", "number", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _contexts(docs: DataFrame, wanted: DataFrame, unit: int, text: str) -> DataFrame:
    """The bytes around one anchor of each kind: (gram, context, many, reversed left part, right part)."""
    places = wanted.withColumns(_place()).groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("pos", "left", "right", "gram", "context", "many")).alias("places")
    )
    rows = _identified(docs, text).filter(F.octet_length("_text") >= unit).select("doc_id", "row_key", "_text")
    few = _concerned(rows, wanted)
    joined = _join_rows(pack(rows if few is None else few), places, "inner")

    def run(whole_batch):
        for batch in packed_parts(whole_batch):
            yield from part(batch)

    def part(batch):
        flat, offsets = unpacked(batch)
        lists = batch.column("places")
        rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        place = lists.flatten()
        pos, left, right = (place.field(n).to_numpy() for n in ("pos", "left", "right"))
        at = offsets[rows] + pos
        whole = flat.tobytes()
        yield pa.record_batch(
            [
                place.field("gram"), place.field("context"), place.field("many"),
                pa.array([whole[a - b : a][::-1] for a, b in zip(at.tolist(), left.tolist())], pa.binary()),
                pa.array([whole[a : a + b] for a, b in zip(at.tolist(), right.tolist())], pa.binary()),
            ],
            names=["gram", "context", "many", "before", "after"],
        )

    return map_arrow(joined.select("_packed", "_size", "places"), run, "gram long, context long, many long, before binary, after binary")


def _join_rows(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, row_key), null ids included."""
    other = other.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    return docs.join(other, docs["doc_id"].eqNullSafe(other["_id"]) & (docs["row_key"] == other["_key"]), how).drop("_id", "_key")


def _concerned(docs: DataFrame, other: DataFrame, how: str = "left_semi") -> DataFrame | None:
    """Rows of ``docs`` with (``left_anti``: without) a match, decided where they are read, if the keys of ``other`` are few enough to travel."""
    keys = other.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    if not fits_broadcast(keys, 32):
        return None
    return docs.join(F.broadcast(keys), docs["doc_id"].eqNullSafe(keys["_id"]) & (docs["row_key"] == keys["_key"]), how)


def _hot_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for grams with very many contexts: windows counted by hash, no group in one task.

    A window belongs to one anchor, its rightmost minimum, so two anchors in one window do not count it twice.
    """

    def run(batch):
        out = []
        for g, c, many, before, after in zip(*[x.to_pylist() for x in batch.columns]):
            data = np.frombuffer(before[::-1] + after, np.uint8)
            starts = np.arange(max(0, len(before) - (length - gram)), len(data) - length + 1)
            starts = starts[starts <= len(before)]
            if len(starts):
                prefix = Prefix(data)
                starts = starts[window_minima(prefix.grams(gram), length - gram + 1)[starts] == len(before)]
            if len(starts):
                hashes = prefix.slices(starts, starts + length).view(np.int64)
                out.append(pa.record_batch(
                    [pa.array([v] * len(starts), pa.int64()) for v in (g, c, many)]
                    + [pa.array((len(before) - starts).astype(np.int32)), pa.array(hashes)],
                    names=["gram", "context", "many", "left", "window"],
                ))
        yield from out

    windows = map_arrow(contexts, run, "gram long, context long, many long, left int, window long")
    # The offset is left out: one text may hold the window twice around one gram.
    often = windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return windows.filter("many = 1").join(often, ["gram", "window"], "left_semi").select(
        "gram", "context", F.lit(-1).alias("number"), "left", (F.lit(length) - F.col("left")).alias("right")
    )


def repeat_groups(
    docs: DataFrame, length: int = LENGTH, text: str = "text", largest: int = LARGEST, covered: bool = False, unit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """All anchors that take part in repeats, and the maximal repeats between different contexts.

    The first table has (doc_id, row_key, pos, left, right, gram, context, many):
    ``many`` anchors share the context, so with ``many`` > 1 all of it repeats.
    The second has (gram, context, number, left, right): context ``context``
    belongs to maximal repeat ``number`` of its gram, which covers ``left`` bytes
    before and ``right`` bytes from its anchor on (number -1: a repeated window of a gram with
    more than ``largest`` contexts). Occurrences of a group are the anchors of its contexts.
    With ``covered`` there is one row for each context with ``many`` = 1 that lies in repeats of ``unit`` bytes, with the
    longest reach of those of ``length`` (0 and 0: none).
    """
    unit = unit or length
    found = cut_lineage(anchors(docs, length, text, unit))
    # Written, so that the join below is plain and a frequent gram can be split.
    often = cut_lineage(found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("least"), F.max("context").alias("most")
    ).filter("n > 1").select("gram", (F.col("least") != F.col("most")).alias("mixed")))
    live = cut_lineage(found.join(often, "gram"))
    discard(found, often)
    release(docs.sparkSession)
    kinds = cut_lineage(
        live.groupBy("gram", "context", "mixed").agg(
            F.count(F.lit(1)).alias("many"), F.min(F.struct("doc_id", "row_key", "place")).alias("_at")
        ).select("gram", "context", "mixed", "many", "_at.*")
    )
    mixed = kinds.filter("mixed")
    hot = mixed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest).select("gram")
    contexts = _contexts(docs, mixed, unit, text)
    if hot.isEmpty():
        usual, crowded = contexts, None
    else:
        contexts = cut_lineage(contexts)
        usual, many = contexts.join(hot, "gram", "left_anti"), contexts.join(hot, "gram", "left_semi").dropDuplicates(["gram", "context"])
        crowded = _hot_spans(many, length, gram_length(unit))
        if unit < length:
            crowded = crowded.unionByName(_hot_spans(many, unit, gram_length(unit)).withColumns({"left": F.lit(0), "right": F.lit(0)}))
    groups = spread(usual, "gram").sortWithinPartitions("gram", "context").mapInArrow(
        _solve(unit, length, covered), "gram long, context long, number int, left int, right int"
    )
    if crowded is not None:
        groups = groups.unionByName(crowded)
    named = kinds.filter("many > 1 or mixed").select("gram", "context", "many")
    return live.drop("mixed").join(named, ["gram", "context"]).withColumns(_place()).drop("place"), groups


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text", largest: int = LARGEST, unit: int | None = None) -> DataFrame:
    """(doc_id, row_key, spans): per text with repeats of ``unit`` bytes, the byte ranges that lie in a repeated string of ``length``."""
    members, groups = repeat_groups(docs, length, text, largest, True, unit)
    whole = members.filter("many > 1").select(
        "doc_id", "row_key", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last")
    )
    # Contexts that occur once have one anchor each, so this join does not multiply rows.
    part = members.filter("many = 1").select("doc_id", "row_key", "pos", "gram", "context").join(
        groups.select("gram", "context", "left", "right"), ["gram", "context"]
    ).select("doc_id", "row_key", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))
    span = F.when(F.col("last") - F.col("first") >= length, F.struct("first", "last"))
    return whole.unionByName(part).groupBy("doc_id", "row_key").agg(F.collect_list(span).alias("spans"))


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges united where they overlap or touch."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > reach[:-1]]
    ends = np.flatnonzero(np.r_[new[1:], True])
    return first[new], reach[ends]


def _kept(data: bytes, first: list[int], last: list[int]) -> bytes:
    parts, at = [], 0
    for a, b in zip(first, last):
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts)


def _whole_characters(data: bytes, first: list[int], last: list[int]) -> tuple[list[int], list[int]]:
    """Ranges cut back to whole UTF-8 characters."""
    for i in range(len(first)):
        while first[i] < last[i] and data[first[i]] & 0xC0 == 0x80:
            first[i] += 1
        while first[i] < last[i] < len(data) and data[last[i]] & 0xC0 == 0x80:
            last[i] -= 1
    return first, last


def without_repeats(
    docs: DataFrame, length: int = LENGTH, text: str = "text", largest: int = LARGEST, characters: bool = False, shorter: int | None = None
) -> DataFrame:
    """``docs`` without its text but with what is left of it: columns ``n_bytes, n_removed, n_spans, kept`` (binary) are added.

    Every byte inside a string of ``length`` bytes that also starts elsewhere goes,
    in all its places. Null and empty texts have nothing to remove; texts shorter
    than ``length`` stay whole; texts that occur twice lose all; repeated rows count
    as two places; an empty table gives no rows. Other columns pass through, but
    for names that this function adds. With ``characters`` only whole characters go, so that
    what is left is UTF-8; a character that straddles the end of a range stays. With ``shorter`` (bytes, less than
    ``length``) a column ``shares_passage`` tells whether any string of so many bytes of the text also starts elsewhere.
    """
    spans = cut_lineage(repeated_spans(docs, length, text, largest, shorter))
    release(docs.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "kept", *(["shares_passage"] if shorter else [])]
    # The caller's columns travel in one, so that no name of theirs meets one of ours.
    own = [f for f in docs.schema.fields if f.name not in (text, *added)]
    row = F.struct(*[F.col(f"`{f.name}`") for f in own]) if own else F.lit(None).cast("string")
    ident = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    rows = docs.select(row.alias("_row"), ident.cast("long").alias("doc_id"), text_or_empty(text).alias("_text")).withColumn("row_key", F.xxhash64("_text"))
    few = _concerned(rows, spans)
    joined = _join_rows(pack(rows if few is None else few), spans, "left")
    schema = StructType([joined.schema["_row"], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary, shares_passage boolean").fields])
    picked = [*[F.col(f"_row.`{f.name}`") for f in own], *added]

    def run(whole_batch):
        for batch in packed_parts(whole_batch):
            yield from part(batch)

    def part(batch):
        flat, offsets = unpacked(batch)
        sizes = np.diff(offsets)
        removed, count = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        whole, lists = flat.tobytes(), batch.column("spans")
        bounds = np.asarray(lists.offsets)
        place = lists.flatten()
        starts = np.asarray(place.field("first"), np.int64)
        ends = np.asarray(place.field("last"), np.int64)
        begin, kept = bounds - bounds[0], []
        for i in range(len(sizes)):
            data = whole[offsets[i] : offsets[i + 1]]
            a, b = begin[i], begin[i + 1]
            if b > a:
                first, last = (x.tolist() for x in _merged(starts[a:b], ends[a:b]))
                if characters:
                    first, last = _whole_characters(data, first, last)
                removed[i], count[i] = sum(last) - sum(first), len(first)
                data = _kept(data, first, last)
            kept.append(data)
        yield pa.record_batch(
            [batch.column("_row"), pa.array(sizes), pa.array(removed), pa.array(count), pa.array(kept, pa.binary()), lists.is_valid()],
            names=["_row", "n_bytes", "n_removed", "n_spans", "kept", "shares_passage"],
        )

    cleaned = map_arrow(joined.select("_row", "_packed", "_size", "spans"), run, schema)
    if few is None:
        return cleaned.select(*picked)
    # Rows without repeats need not move.
    whole = _concerned(rows, spans, "left_anti").select(
        "_row", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("_text").cast("binary").alias("kept"), F.lit(False).alias("shares_passage"),
    )
    return cleaned.unionByName(whole).select(*picked)
