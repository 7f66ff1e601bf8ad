"""Periodic runs of words: maximal stretches that repeat with a period at least four times over.

Every run contains, somewhere in its first periods, the longest Lyndon word at its place for one of two
opposite orders of the words (its Lyndon root). So there are two candidates per word: the stretches up to the next smaller
and up to the next greater suffix. Each is extended in both directions by longest common extensions, from the suffix trees of
the text and of its reversal (``suffix_tree.Extensions``). What then reaches the wanted length is a run, with its smallest period.

Most of a text cannot lie in such runs: a word in a run occurs at least four times in it, and two words that
follow each other at least three times. Texts are cut where this fails, again and again until nothing changes;
only what is left goes into trees. This drops no run: a run has no cut inside.

Memory: what is left of one text is in one tree, about 1 kB a word there; other texts share trees of ``POOLED`` words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorelink.llm.common import chunks, map_arrow, spaced, text_or_empty, texts_as_bytes, word_bounds
from lorelink.llm.suffix_tree import Extensions

# A run holds its period this often, and this many words at least.
TIMES, LEAST = 4, 6
# Words that texts put into one tree together.
POOLED = 1 << 14

ONE = "struct<start: bigint, length: bigint, period: bigint>"


def word_ids(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal words; words are ``spaced`` slices that begin ``at``."""
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _counts(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs, for every place of it."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[which]


def live_stretches(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of words that may hold runs; ``rows`` numbers the texts of the words."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = int(ids.max()) + 1
    place, part = np.arange(len(ids)), rows.astype(np.int64)
    # Whether the next of the places that are left belongs to the same stretch.
    while len(place):
        before = len(place), int(part[-1])
        alive = _counts(part * size + ids[place]) >= TIMES
        place, part = place[alive], part[alive]
        follows = (place[1:] == place[:-1] + 1) & (part[1:] == part[:-1])
        pair = np.flatnonzero(follows)
        often = _counts((part[pair] * size + ids[place[pair]]) * size + ids[place[pair + 1]]) >= TIMES - 1
        joined = np.zeros(max(0, len(place) - 1), bool)
        joined[pair] = often
        part = np.cumsum(np.r_[True, ~joined]) - 1 if len(place) else part
        long_enough = np.bincount(part)[part] >= LEAST if len(part) else np.zeros(0, bool)
        place, part = place[long_enough], part[long_enough]
        if len(part):
            part = np.cumsum(np.r_[False, part[1:] != part[:-1]])
        if len(place) == before[0] and int(part[-1]) == before[1]:
            break
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return place[new], place[np.r_[new[1:], len(place)] - 1] + 1


def _next_beyond(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next with a smaller and the next with a greater rank, or the end."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    down, up = [], []
    for i, r in enumerate(rank):
        while down and rank[down[-1]] > r:
            smaller[down.pop()] = i
        down.append(i)
        while up and rank[up[-1]] < r:
            greater[up.pop()] = i
        up.append(i)
    return smaller, greater


def runs_of(stretches: list[np.ndarray], times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of some sequences: the number of the sequence, start in it, length and smallest period, in this order.

    A run is ``least`` long at least and ``times`` (two or more) its period. Sequences lie end to end in
    one tree, each followed by a symbol of its own that is less than all others.
    """
    k = len(stretches)
    joined = np.concatenate([np.r_[s + (k + 1), i] for i, s in enumerate(stretches)])
    size, n = int(joined.max()) + 1, len(joined)
    ahead = Extensions(joined, size)
    behind = Extensions(np.r_[joined[::-1], k], size)
    smaller, greater = _next_beyond(ahead.rank[:n].tolist())
    i = np.tile(np.arange(n), 2)
    j = np.array(smaller + greater, np.int64)
    wanted = (joined[i] > k) & (j < n)
    i, j = i[wanted], j[wanted]
    period = j - i
    right, left = ahead.common(i, j), behind.common(n - i, n - j)
    length = period + right + left
    found = length >= np.maximum(least, times * period)
    rows = np.unique(np.c_[i - left, period, length][found], axis=0)
    ends = np.cumsum([len(s) + 1 for s in stretches])
    which = np.searchsorted(ends, rows[:, 0], "right")
    return which, rows[:, 0] - np.r_[0, ends[:-1]][which], rows[:, 2], rows[:, 1]


def text_runs(ids: np.ndarray, rows: np.ndarray, pooled: int = POOLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in the words of some texts, by start, then period."""
    first, last = live_stretches(ids, rows)
    found, begin = [np.zeros((0, 3), np.int64)], 0
    total = np.r_[0, np.cumsum(last - first)]
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + pooled, "right")) - 1)
        # Numbered anew, so that the symbols of a tree are few.
        some = np.concatenate([ids[a:b] for a, b in zip(first[begin:end], last[begin:end])])
        parts = np.split(np.unique(some, return_inverse=True)[1], (total[begin + 1 : end] - total[begin]))
        which, start, length, period = runs_of(parts)
        found.append(np.c_[start + first[begin + which], length, period])
        begin = end
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that holds its period most often; of equal ones the first, then that with the shorter period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``runs``, ``best`` (that of greatest length / period) and ``collapsed``.

    ``runs`` lists (start, length, period) of all runs by start, then period; starts count words from 0.
    ``collapsed`` is the text without the words that any run holds after its first period, joined by single
    spaces. Null, empty and blank texts have no words, no runs, a null ``best`` and an empty ``collapsed``.
    Repeated rows are judged alike, an empty table gives no rows, other columns pass through; those
    with the names of new ones give way.
    """
    added = ["n_words", "runs", "best", "collapsed"]
    rest = [f for f in docs.schema.fields if f.name not in (text, *added)]
    row = F.struct(*[F.col(f"`{f.name}`") for f in rest]) if rest else F.lit(None).cast("string")
    packed = docs.select(row.alias("_row"), text_or_empty(text).alias("_text"))
    schema = StructType([packed.schema["_row"], *StructType.fromDDL(f"n_words bigint, runs array<{ONE}>, best {ONE}, collapsed string").fields])

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        for first, last in chunks(offsets):
            own = flat[offsets[first] : offsets[last]]
            starts, ends, rows = word_bounds(own, offsets[first : last + 1] - offsets[first])
            data, at = spaced(own, starts, ends)
            start, length, period = text_runs(word_ids(data, at), rows)
            drop = np.zeros(len(starts) + 1, np.int32)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            kept = np.cumsum(drop)[:-1] == 0
            bounds = np.searchsorted(rows, np.arange(last - first + 1))
            owner = rows[start]
            each = np.searchsorted(owner, np.arange(last - first + 1))
            inside = start - bounds[owner]
            lists = list(zip(inside.tolist(), length.tolist(), period.tolist()))
            named = [dict(zip(("start", "length", "period"), r)) if r else None for r in (_best(lists[a:b]) for a, b in zip(each, each[1:]))]
            left, where = spaced(own, starts[kept], ends[kept])
            edges = where[np.searchsorted(rows[kept], np.arange(last - first + 1))]
            whole = left.tobytes()
            texts = [whole[a : max(a, b - 1)] for a, b in zip(edges.tolist(), edges[1:].tolist())]
            values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (inside, length, period)], names=["start", "length", "period"])
            yield pa.record_batch(
                [
                    batch.column("_row").slice(first, last - first), pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), values), pa.array(named, values.type), pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["_row", *added],
            )

    out = map_arrow(packed, run, schema)
    return out.select(*[F.col(f"_row.`{f.name}`") for f in rest], *added)
