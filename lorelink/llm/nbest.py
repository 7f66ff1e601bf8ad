"""N-best segmentation into pieces of a given vocabulary, and decoding.

A text becomes a lattice: an arc for every piece of the vocabulary that matches
somewhere, and for characters without a piece an arc for their bytes. Forward
Viterbi scores say how good the best way from the start to each place is. They
are exact estimates for a backward A* search from the end: complete paths leave
its queue best first.

No piece holds a space mark after another character (checked on loading), so
lattices fall apart into words. Viterbi runs once over all new words of a batch,
side by side; a task keeps the results of a bounded number of words. The n best
paths of a text differ from the best one only in the n - 1 words with the least
distance between first and second path, so the backward search runs in these.

Log-probabilities are whole multiples of 2^-24, so sums of them are exact and equal
paths have equal scores, however long a word is. As the estimates are exact too, each
of the n best paths costs the search one step per piece. Long words are searched one
by one with a few numbers per character, and are not kept.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.llm.common import chunks, map_arrow, text_or_empty, texts_as_bytes

MARK = "▁"  # stands for a space in pieces
BEST = 4
# Words whose results a Python task keeps; when there are more, those go that were used in one text only.
KEPT_WORDS = 200_000
# A batch is worked off, and handed on, in parts of about this many bytes of text, or pieces in decoding.
PART = 1 << 19
PIECES = 1 << 17
# New words are searched in slices of about this many characters, longer words than ``LONG`` one by one.
SLICE = 1 << 16
LONG = 1000
# Characters of the words that a task keeps.
KEPT_CHARACTERS = 1 << 23
# Scores are multiples of one over this.
UNIT = 1 << 24
# Zipf-Mandelbrot offset, the share of single characters, and the cost of a character without a piece.
ZIPF_OFFSET, CHARACTER_SHARE, UNKNOWN = 2.7, 0.1, 10.0

_HASH = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    pieces: list[str]  # by id; byte pieces as <0xNN>
    scores: np.ndarray  # log-probabilities by id, NaN where a piece is not matched in texts
    byte_ids: list[int]
    longest: int
    unknown: float
    cuts: bool  # words can be treated one by one
    breaks: str  # line ends and tabs that no longer piece holds stand for themselves
    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        self.logs = self.scores.tolist()
        self.ids = {p: i for i, p in enumerate(self.pieces) if not np.isnan(self.scores[i])}
        self.beginnings = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and log-probabilities of a SentencePiece model file.

    A unigram model has its own log-probabilities. A BPE model only has an order,
    most frequent first; its pieces get those of Zipf's law at their rank, merged
    pieces and single characters ranked by themselves.
    """
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    reader = SentencePieceProcessor(model_file=path)
    n = reader.get_piece_size()
    pieces = [reader.id_to_piece(i) for i in range(n)]
    special = [reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i) or reader.is_byte(i) for i in range(n)]
    usual = [i for i in range(n) if not special[i]]
    if model.trainer_spec.model_type == model.trainer_spec.UNIGRAM:
        scores = np.array([reader.get_score(i) for i in range(n)])
    else:
        scores = np.zeros(n)
        for share, ids in ((1 - CHARACTER_SHARE, [i for i in usual if len(pieces[i]) > 1]), (CHARACTER_SHARE, [i for i in usual if len(pieces[i]) == 1])):
            weight = 1 / (np.arange(1, len(ids) + 1) + ZIPF_OFFSET)
            scores[ids] = np.log(share * weight / weight.sum())
    scores[np.array(special)] = np.nan
    bytes_ = {int(p[3:5], 16): i for i, p in enumerate(pieces) if reader.is_byte(i)}
    return vocabulary(pieces, scores, [bytes_[b] for b in range(256)])


def vocabulary(pieces: list[str], scores: np.ndarray, byte_ids: list[int]) -> Vocabulary:
    """``scores`` are rounded to multiples of one over ``UNIT``."""
    scores = np.round(scores * UNIT) / UNIT
    usual = [i for i in range(len(pieces)) if not np.isnan(scores[i])]
    texts = [pieces[i] for i in usual]
    # Beginnings of pieces are entered too, as -2: where a text leaves them, no longer piece can match.
    entries = {_piece_hash(p[:n]): -2 for p in texts for n in range(1, len(p))}
    keys, values = _cuckoo(entries | {_piece_hash(p): i for p, i in zip(texts, usual)})
    cuts = all(MARK not in p.lstrip(MARK) for p in texts)
    breaks = "".join(c for c in "\n\r\t" if not any(c in p for p in texts if len(p) > 1))
    return Vocabulary(pieces, scores, byte_ids, max(map(len, texts)), float(np.nanmin(scores)) - UNKNOWN, cuts, breaks, keys, values)


def _piece_hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = ((h + ord(c) + 1) * int(_HASH)) & (1 << 64) - 1
        h ^= h >> 29
    return h


def _slots(h, bits: int):
    """The two places of a hash in a table of 2^bits."""
    return h >> type(h)(64 - bits), (h >> type(h)(20)) & type(h)((1 << bits) - 1)


def _cuckoo(entries: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A hash table in which each key is in one of two places, at most three eighths full."""
    bits = max(4, (len(entries) * 8 // 3).bit_length())
    while (table := _placed(entries, bits)) is None:
        bits += 1
    keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
    for place, (h, i) in table.items():
        keys[place], values[place] = h, i
    return keys, values


def _placed(entries: dict[int, int], bits: int) -> dict[int, tuple[int, int]] | None:
    table: dict[int, tuple[int, int]] = {}
    for item in entries.items():
        place = _slots(item[0], bits)[0]
        for _ in range(1000):
            item, table[place] = table.get(place), item
            if item is None:
                break
            one, two = _slots(item[0], bits)
            place = two if place == one else one
        else:
            return None
    return table


def _look_up(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Piece ids of hashes, -2 for beginnings of pieces, -1 where there is none."""
    bits = len(v.keys).bit_length() - 1
    one, two = h >> np.uint64(64 - bits), (h >> np.uint64(20)) & np.uint64((1 << bits) - 1)
    return np.where(v.keys[one] == h, v.values[one], np.where(v.keys[two] == h, v.values[two], -1))


def viterbi(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
    """Best score, distance to the second best path (inf: none) and piece ids (as int32 bytes) of each word.

    All words of a slice are treated side by side: piece look-ups over the joined
    words, one step of the search per character. Of equal paths the one whose last
    pieces are longest wins. Unmatched characters are -1 - code point among the ids; the words with such are listed.
    """
    best, gap, ids, odd = np.zeros(len(words)), np.full(len(words), np.inf), [b""] * len(words), []
    # Longest first, so the words still going at a step stand at the front.
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    at = 0
    while at < len(order) and len(words[order[at]]) > LONG:
        i = order[at]
        best[i], gap[i], path = _long_word(v, words[i])
        ids[i] = path.tobytes()
        if path.min() < 0:
            odd.append(i)
        at += 1
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (end == at or size + len(words[order[end]]) <= SLICE):
            size += len(words[order[end]])
            end += 1
        some = order[at:end]
        best[some], gap[some], found, unmatched = _side_by_side(v, [words[i] for i in some])
        odd += [some[i] for i in unmatched]
        for i, path in zip(some, found):
            ids[i] = path
        at = end
    return best, gap, ids, odd


def _arcs(v: Vocabulary, codes: np.ndarray, room: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and piece by length - 1 and start, over joined words; ``room`` is what is left of the word at a place."""
    total = len(codes)
    score, piece = np.full((reach, total), -np.inf), np.full((reach, total), -1, np.int32)
    table = np.append(v.scores, [-np.inf, -np.inf])
    live, h = np.arange(total), np.zeros(total, np.uint64)
    for size in range(1, reach + 1):
        h = (h + codes[live + size - 1] + np.uint64(1)) * _HASH
        h ^= h >> np.uint64(29)
        found = _look_up(v, h)
        piece[size - 1, live] = found
        score[size - 1, live] = table[found]
        on = np.flatnonzero((found != -1) & (room[live] > size))
        live, h = live[on], h[on]
        if not len(live):
            break
    none = piece[0] < 0
    score[0, none] = v.unknown
    piece[0, none] = -1 - codes[none].astype(np.int32)
    return score, piece


def _side_by_side(v: Vocabulary, words: list[str]):
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    longest, total = int(lengths[0]), int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    room = np.repeat(begin + lengths, lengths) - np.arange(total)
    reach = min(v.longest, longest)
    score, piece = _arcs(v, codes, room, reach)
    # Forward scores have one place more than characters for each word.
    first = begin + np.arange(len(words))
    forward, loss, back = np.zeros(total + len(words)), np.full(total + len(words), np.inf), np.zeros(total + len(words), np.int64)
    flat = score.ravel()
    going = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")  # words of at least each length
    sizes = np.arange(reach, 0, -1)[:, None]
    for end in range(1, longest + 1):
        n = int(going[end - 1])
        size = sizes[reach - min(reach, end) :]
        ways = flat.take((size - 1) * total + (begin[:n] + end) - size) + forward.take((first[:n] + end) - size)
        chosen = ways.argmax(axis=0)  # the longest of equal ones comes first
        columns = np.arange(n)
        at = first[:n] + end
        forward[at] = most = ways[chosen, columns]
        back[at] = size[chosen, 0]
        ways[chosen, columns] = -np.inf
        loss[at] = most - ways.max(axis=0)
    # Walk back from all ends together; ids fill each word's part of ``path`` from its end.
    gap, count, path = np.full(len(words), np.inf), np.zeros(len(words), np.int64), np.zeros(total, np.int32)
    who, place = np.arange(len(words)), lengths.copy()
    step = 0
    while len(who):
        at = first[who] + place
        gap[who] = np.minimum(gap[who], loss[at])
        size = back[at]
        place = place - size
        step += 1
        path[begin[who] + lengths[who] - step] = piece[size - 1, begin[who] + place]
        count[who] = step
        who, place = who[place > 0], place[place > 0]
    ends, whole = (begin + lengths) * 4, path.tobytes()
    ids = [whole[a:b] for a, b in zip((ends - count * 4).tolist(), ends.tolist())]
    unmatched = np.unique(np.searchsorted(begin, np.flatnonzero(path < 0), "right") - 1).tolist()
    return forward[first + lengths], gap, ids, unmatched


def _forward(v: Vocabulary, word: str) -> tuple[array, array, array]:
    """By place of a word: the best score from the start, the second best, and the size of the best one's last piece."""
    size = len(word)
    best, second, back = array("d", [-math.inf]) * (size + 1), array("d", [-math.inf]) * (size + 1), array("i", [0]) * (size + 1)
    best[0] = 0.0
    beginnings, ids, logs = v.beginnings, v.ids, v.logs
    for start in range(size):
        here = best[start]
        for end in range(start + 1, min(start + v.longest, size) + 1):
            part = word[start:end]
            i = ids.get(part)
            if i is not None:
                score = here + logs[i]
            elif end == start + 1:
                score = here + v.unknown
            elif part in beginnings:
                continue
            else:
                break
            # Of equal ones the longest came first and stays.
            if score > best[end]:
                best[end], second[end], back[end] = score, best[end], end - start
            elif score > second[end]:
                second[end] = score
    return best, second, back


def _long_word(v: Vocabulary, word: str) -> tuple[float, float, np.ndarray]:
    """Best score, distance to the second best path, and ids of one word as in ``viterbi``."""
    best, second, back = _forward(v, word)
    gap, place, path = math.inf, len(word), array("i")
    while place:
        gap = min(gap, best[place] - second[place])
        start = place - back[place]
        path.append(v.ids.get(word[start:place], -1 - ord(word[start])))
        place = start
    return best[-1], gap, np.array(path, np.int32)[::-1]


def best_paths(v: Vocabulary, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best paths of a word as (loss against the best, ids), by backward A* search.

    The estimate for the rest of a path is the forward score, which is exact, so a
    path is complete the first time it is taken from the queue. Equal ones come in a fixed order.
    Arcs are looked up where the search arrives.
    """
    size = len(word)
    forward = _forward(v, word)[0]
    total = forward[size]
    # Sums are exact, so equal paths compare equal; of those the one that is further goes first.
    queue: list[tuple[float, int, int, tuple, float]] = [(0.0, size, 0, (), 0.0)]
    out, made = [], 0
    while queue and len(out) < n:
        loss, place, _, path, behind = heapq.heappop(queue)
        if not place:
            ids = []
            while path:
                i, path = path
                ids.append(i)
            out.append((loss, tuple(ids)))
            continue
        for start in range(max(0, place - v.longest), place):
            i = v.ids.get(word[start:place])
            if i is None and start < place - 1:
                continue
            score = behind + (v.unknown if i is None else v.logs[i])
            i = -1 - ord(word[start]) if i is None else i
            made += 1
            heapq.heappush(queue, (total - (forward[start] + score), start, made, (i, path), score))
    return out


def combined(best: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` least sums of one loss per list, each list ascending from 0: (sum, index per list)."""
    start = (0.0, (0,) * len(best))
    queue, seen, out = [start], {start[1]}, []
    while queue and len(out) < n:
        total, chosen = heapq.heappop(queue)
        out.append((total, chosen))
        for k in range(len(best)):
            if chosen[k] + 1 < len(best[k]):
                onward = (*chosen[:k], chosen[k] + 1, *chosen[k + 1 :])
                if onward not in seen:
                    seen.add(onward)
                    heapq.heappush(queue, (total - best[k][chosen[k]] + best[k][onward[k]], onward))
    return out


class Encoder:
    """What one task knows: results of words seen so far, up to ``kept`` of them."""

    def __init__(self, v: Vocabulary, n: int, kept: int = KEPT_WORDS):
        self.v, self.n, self.kept = v, n, kept
        alone = f"[{v.breaks}]|" if v.breaks else ""
        self.cut = re.compile(f"{alone}{MARK}+[^{MARK}{v.breaks}]*|[^{MARK}{v.breaks}]+" if v.cuts else "(?s:.+)")
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.held = 0  # characters of the known words
        self.ids: list[bytes] = []
        self.best, self.gap, self.count, self.used = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.paths: dict[str, list] = {}

    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        every = set().union(*texts)
        new = every.difference(self.known)
        if (len(self.known) + len(new) > self.kept or self.held + sum(map(len, new)) > KEPT_CHARACTERS) and self.known:
            self.forget()
            new = every.difference(self.known)
        new = list(new)
        self.held += sum(map(len, new))
        best, gap, ids, odd = viterbi(self.v, new)
        self.known.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        for i in odd:
            ids[i] = self.spelled(np.frombuffer(ids[i], np.int32)).tobytes()
        self.ids += ids
        self.count = np.r_[self.count, np.fromiter(map(len, ids), np.int64, len(ids)) // 4]
        self.best, self.gap, self.used = np.r_[self.best, best], np.r_[self.gap, gap], np.r_[self.used, np.zeros(len(new), np.int32)]

    def forget(self) -> None:
        """Keep the words that more than one text has used since the last time, half of the room at most and no long ones."""
        keep = (self.used > 1) & (np.fromiter(map(len, self.known), np.int64, len(self.known)) <= LONG)
        if keep.sum() > self.kept // 2:
            keep[np.argsort(-self.used, kind="stable")[self.kept // 2 :]] = False
        place = np.cumsum(keep) - 1
        self.known = {w: int(place[i]) for w, i in self.known.items() if keep[i]}
        self.held = sum(map(len, self.known))
        self.ids = [p for p, k in zip(self.ids, keep.tolist()) if k]
        self.count, self.best, self.gap, self.used = self.count[keep], self.best[keep], self.gap[keep], np.zeros(int(keep.sum()), np.int32)

    def spelled(self, path) -> np.ndarray:
        """Ids with unmatched characters as their bytes."""
        path = np.asarray(path, np.int32)
        if len(path) and path.min() < 0:
            path = np.array([j for i in path.tolist() for j in ([i] if i >= 0 else [self.v.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "replace")])], np.int32)
        return path

    def encode(self, words: list[str]) -> tuple[bytes, int, list[float], list[list[tuple[int, int, list[int]]]]]:
        """Ids of the best path as bytes, their number, the scores of the best paths, and the others as changes."""
        if not words:
            return b"", 0, [0.0], []
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids = b"".join(map(self.ids.__getitem__, which.tolist()))
        self.used[which] += 1
        score = float(self.best[which].sum())
        if self.n == 1:
            return ids, len(ids) // 4, [score], []
        gap = self.gap[which]
        some = np.lexsort((np.arange(len(gap)), gap))[: self.n - 1] if len(gap) < 64 else self._least(gap)
        some = sorted(int(i) for i in some if np.isfinite(gap[i]))
        options = []
        for i in some:
            options.append(self.word_paths(words[i]))
        found = combined([[loss for loss, _ in o] for o in options], self.n)
        starts = {i: int(self.count[which[:i]].sum()) for i in some}
        changes = [
            [(starts[i], int(self.count[which[i]]), options[k][c][1]) for k, (i, c) in enumerate(zip(some, chosen)) if c]
            for _, chosen in found[1:]
        ]
        return ids, len(ids) // 4, [score - loss for loss, _ in found], changes

    def word_paths(self, word: str) -> list[tuple[float, list[int]]]:
        """(loss, ids) of the best paths of a word; of equal ones that of ``viterbi`` is first."""
        found = self.paths.get(word)
        if found is None:
            first = np.frombuffer(self.ids[self.known[word]], np.int32).tolist()
            others = [(loss, self.spelled(path).tolist()) for loss, path in best_paths(self.v, word, self.n)]
            found = [(0.0, first), *[f for f in others if f[1] != first]][: self.n]
            if len(word) <= LONG:
                if len(self.paths) > self.kept // 8:
                    self.paths = {}
                self.paths[word] = found
        return found

    def _least(self, gap: np.ndarray) -> np.ndarray:
        """The places of the n - 1 least distances, first places first among equal ones."""
        bound = np.partition(gap, self.n - 2)[self.n - 2]
        some = np.flatnonzero(gap <= bound)
        return some[np.argsort(gap[some], kind="stable")][: self.n - 1]


def encode(docs: DataFrame, vocab: Vocabulary, n: int = BEST, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all but ``text``) with ``ids, scores, others``.

    ``ids`` is the best path, ``scores`` the log-probabilities of the up to ``n`` best
    ones, and ``others`` has the other paths as changes of the best one: from piece
    ``at`` on, ``many`` pieces are replaced by ``ids``. Null and empty texts have no
    pieces and score 0; a space stands before the text as in SentencePiece. Columns
    of ``docs`` with the names of new ones give way. Texts are encoded whole.
    """
    added = ["ids", "scores", "others", "_text"]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in added and (carry is not None or c != text)]
    rows = docs.select(*carry, text_or_empty(text).alias("_text"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text"] + [
        "ids array<int>", "scores array<double>", "others array<array<struct<at:int,many:int,ids:array<int>>>>"])
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    change = pa.struct([("at", pa.int32()), ("many", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = Encoder(shared.value, n)
        for batch in batches:
            for at, end in chunks(texts_as_bytes(batch.column("_text"))[1], PART):
                words = [encoder.words(t) for t in batch.column("_text").slice(at, end - at).to_pylist()]
                encoder.learn(words)
                ids, counts, scores, others = zip(*[encoder.encode(w) for w in words])
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.record_batch(
                    [batch.column(c).slice(at, end - at) for c in carry]
                    + [pa.ListArray.from_arrays(offsets, flat), pa.array(scores, pa.list_(pa.float64())),
                       pa.array([[[{"at": a, "many": m, "ids": i} for a, m, i in path] for path in o] for o in others], pa.list_(pa.list_(change)))],
                    names=[*carry, "ids", "scores", "others"],
                )

    return rows.mapInArrow(run, kinds)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of an id column; null ids give null, ids outside the vocabulary are an error.

    Byte pieces join into characters, malformed ones become U+FFFD, and the space before the text goes.
    """
    special = {i: bytes([b]) for b, i in enumerate(vocab.byte_ids)}
    spelled = [special.get(i, b"" if np.isnan(vocab.scores[i]) else p.replace(MARK, " ").encode()) for i, p in enumerate(vocab.pieces)]
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    shared = df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes))
    rest = [f for f in df.schema.fields if f.name != out]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` string"])

    def text(data: bytes) -> str:
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def run(batch):
        letters, starts, sizes = shared.value
        lists = batch.column(ids)
        bounds = np.asarray(lists.offsets).astype(np.int64)
        bounds, flat, known = bounds - bounds[0], np.asarray(lists.flatten()), lists.is_valid().to_pylist()
        for first, last in chunks(bounds, PIECES):
            some = flat[bounds[first] : bounds[last]]
            size = sizes[some]
            ends = np.cumsum(size)
            data = letters[np.repeat(starts[some] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
            at = np.r_[0, ends][bounds[first : last + 1] - bounds[first]].tolist()
            texts = [text(data[a:b]) if k else None for a, b, k in zip(at, at[1:], known[first:last])]
            yield pa.record_batch(
                [*(batch.column(f.name).slice(first, last - first) for f in rest), pa.array(texts, pa.string())], names=[*(f.name for f in rest), out]
            )

    return map_arrow(df.select(*[f.name for f in rest]), run, kinds)
