"""Cross-entropy difference: how much likelier a text is under a target model than under the background.

Both are bigram models over real words and word pairs, named by 64-bit hashes and counted in one
pass: the background over all documents, the target over the marked ones. They are matched:
same vocabulary, same smoothing, and background counts scaled to the size of the
target, so that neither is better merely for having seen more.

The counts are tables that grow with the corpus: one row per word pair and one per word. Pairs are
combined inside each task before they are sent. A pair's losses are worked out once,
and each document joins those of its distinct pairs (``fit``, ``score``). A corpus that is scored by models
of its own needs no table of pairs: there counts are sent back to the texts (``score_corpus``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelink.llm.common import CHUNK, chunks, lowered, map_arrow, pack, spread, text_or_empty, texts_as_bytes, unpacked, word_bounds
from lorelink.llm.rolling import Prefix, mix
from lorelink.operators.skew import counted_join, fits_broadcast, hot_keys, salted_join
from lorelink.session import cut_lineage, discard, release

# Weight of the unigram model behind the bigrams, in tokens; what is added to each unigram count.
PRIOR, ADDED = 20.0, 0.1

_START = np.uint64(0x5851F42D4C957F2D)  # what stands before the first word


def ngrams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the texts: its row, its hash, the hash of the word before it, and that of both."""
    starts, ends, rows = word_bounds(flat, offsets)
    words = Prefix(lowered(flat)).slices(starts, ends)
    before = np.r_[_START, words[:-1]] if len(words) else words
    if len(words):
        before[np.r_[True, rows[1:] != rows[:-1]]] = _START
    both = mix((before ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + words)
    return rows, words.view(np.int64), before.view(np.int64), both.view(np.int64)


@dataclass(frozen=True)
class Models:
    """Matched bigram models: ``pairs`` (both, word, before, t, b) and ``words`` (word, t, b) with target and background counts."""

    pairs: DataFrame
    words: DataFrame
    tokens: tuple[int, int]
    vocabulary: int

    def losses(self, types: DataFrame) -> DataFrame:
        """``types`` (both, word, before, t, b) with ``target`` and ``background`` bits. A pair's count never exceeds that of its history."""
        small = fits_broadcast(self.words, 64)
        for name, prefix in (("word", "u"), ("before", "h")):
            side = self.words.select(F.col("word").alias(name), F.col("t").alias(f"{prefix}t"), F.col("b").alias(f"{prefix}b"))
            types = types.join(F.broadcast(side), name, "left") if small else counted_join(types, side, [name], "left")
        scale = {"t": 1.0, "b": self.tokens[0] / self.tokens[1] if self.tokens[1] else 1.0}

        def bits(m: str, tokens: int) -> Column:
            scaled = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.lit(scale[m])
            unigram = (scaled(f"u{m}") + ADDED) / (tokens * scale[m] + ADDED * self.vocabulary)
            return -F.log2((F.least(scaled(m), scaled(f"h{m}")) + PRIOR * unigram) / (scaled(f"h{m}") + PRIOR))

        return types.withColumns({"target": bits("t", self.tokens[0]), "background": bits("b", self.tokens[1])})


def fit(docs: DataFrame, target: str, text: str = "text", unigram_bits: int | None = None, bigram_bits: int | None = None) -> Models:
    """The two models from all rows of ``docs``; the column ``target`` marks target rows (null: no). Null texts have no words.

    The widths were those of tables of fixed size; they are taken from callers and have no effect.
    """
    marked = docs.select(F.coalesce(F.col(target).cast("boolean"), F.lit(False)).alias("_target"), text_or_empty(text).alias("_text"))

    def count(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        mine = batch.column("_target").to_numpy(zero_copy_only=False).astype(bool)
        for first, last in chunks(offsets, 4 * CHUNK):
            rows, word, before, both = ngrams(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            some, at, which = np.unique(both, return_index=True, return_inverse=True)
            t = np.bincount(which[mine[first:last][rows]], minlength=len(some)).astype(np.int64)
            b = np.bincount(which, minlength=len(some)).astype(np.int64)
            yield pa.record_batch([pa.array(c) for c in (some, word[at], before[at], t, b)], names=["both", "word", "before", "t", "b"])

    counted = map_arrow(marked, count, "both long, word long, before long, t long, b long")
    sums = [F.sum(c).alias(c) for c in ("t", "b")]
    pairs = cut_lineage(counted.groupBy("both").agg(F.min("word").alias("word"), F.min("before").alias("before"), *sums))
    words = cut_lineage(pairs.groupBy("word").agg(*sums))
    n = words.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
    return Models(pairs, words, (n.t or 0, n.b or 0), max(1, n.n))


def _occurrences(docs: DataFrame, text: str, names: bool) -> DataFrame:
    """(key, both, n), with ``names`` also word and before: the distinct pairs of each text, which is named by its hash."""
    fields = ["key", "both", "n", *(["word", "before"] if names else [])]

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        keys = batch.column("key").to_numpy()
        for first, last in chunks(offsets):
            rows, word, before, both = ngrams(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            order = np.lexsort((both, rows))
            r, p = rows[order], both[order]
            at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])]) if len(r) else np.zeros(0, np.int64)
            columns = [keys[first:last][r[at]], p[at], np.diff(np.r_[at, len(r)]), word[order[at]], before[order[at]]]
            yield pa.record_batch([pa.array(c) for c in columns[: len(fields)]], names=fields)

    rows = docs.select(text_or_empty(text).alias("_text")).withColumn("key", F.xxhash64("_text"))
    return map_arrow(rows.select("key", "_text"), run, ", ".join(f"{f} long" for f in fields))


def score(docs: DataFrame, models: Models, text: str = "text", counted: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``target_bits``, ``background_bits`` per token and ``difference``.

    ``difference`` is the mean of the per-token loss differences, target minus background: the lower, the
    more like the target. Texts without words (null, empty, blank) have null scores. Repeated rows
    score alike, an empty table gives no rows, columns with the names of new ones give way.
    ``counted`` says that all of ``docs`` were counted by the models, so that their pairs are known.
    """
    added = ["n_tokens", "target_bits", "background_bits", "difference"]
    rest = [f for f in docs.schema.fields if f.name not in (text, "_text", "_key", *added)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["_key long", "n_tokens long"])
    if counted:
        types, hot = models.pairs, hot_keys(models.pairs, ["both"], "b")
    else:
        asked = _occurrences(docs, text, True).groupBy("both").agg(F.min("word").alias("word"), F.min("before").alias("before"), F.count(F.lit(1)).alias("many"))
        types = cut_lineage(asked.join(models.pairs.select("both", "t", "b"), "both", "left"))
        hot = hot_keys(types, ["both"], "many")
    losses = models.losses(types).select("both", "target", "background")
    found = _occurrences(docs, text, False)
    hot = cut_lineage(hot)
    joined = found.join(losses, "both") if hot.isEmpty() else salted_join(found, losses, ["both"], hot)
    # Texts that occur several times add up several times, in sums and count alike.
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"{c}_bits")
    scores = cut_lineage(joined.groupBy(F.col("key").alias("_key")).agg(mean("target"), mean("background")))

    def count(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        rows = word_bounds(flat, offsets)[2]
        n = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
        yield pa.record_batch([*(batch.column(f.name) for f in rest), batch.column("_key"), pa.array(n)], names=[*(f.name for f in rest), "_key", "n_tokens"])

    rows = docs.select(*[f.name for f in rest], text_or_empty(text).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    rows = map_arrow(rows, count, schema)
    out = rows.join(F.broadcast(scores), "_key", "left") if fits_broadcast(scores, 64) else counted_join(rows, scores, ["_key"], "left")
    return out.withColumn("difference", F.col("target_bits") - F.col("background_bits")).select(*[f.name for f in rest], *added)


# Scoring a corpus by its own models. Numbers of frequent words, and of frequent pairs of the foremost words, that every task knows;
# all other n-grams are dealt by hash over PASSES rounds, so that a round moves a part of them.
KNOWN, FOREMOST, PASSES = 1 << 18, 2048, 3


def _of_texts(texts: DataFrame, run, schema: str) -> DataFrame:
    """``run(batch rows, words)`` over packed texts, about ``CHUNK`` bytes at a time; ``words`` as of ``ngrams``."""

    def each(batch):
        flat, offsets = unpacked(batch)
        for first, last in chunks(offsets):
            yield run(batch.slice(first, last - first), ngrams(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))

    return map_arrow(texts, each, schema)


def _per_row(rows: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each row: the place of the first of equal ones, how many there are, and which one a place has."""
    if not len(rows):
        return rows, rows, rows
    both = gram.view(np.uint64) ^ (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(both)
    both = both[order]
    new = np.r_[True, both[1:] != both[:-1]]
    starts = np.flatnonzero(new)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return np.minimum.reduceat(order, starts), np.diff(np.r_[starts, len(rows)]), which


def _find(known: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``gram`` in the sorted ``known``, and whether it is there."""
    at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
    return at, known[at] == gram if len(known) else np.zeros(len(gram), bool)


def _of_foremost(foremost: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a word and the word before it, which is the one before in the array, are both among ``foremost``."""
    often = _find(foremost, word)[1]
    both = often.copy()
    both[1:] &= often[:-1]
    return both & (before != _START.view(np.int64))


def _distinct_texts(docs: DataFrame, target: str, text: str) -> DataFrame:
    """(key, _packed, _size, t, b): every text once, with the number of its target rows and of all its rows."""
    marked = F.coalesce(F.col(target).cast("boolean"), F.lit(False)).cast("long")
    rows = docs.select(text_or_empty(text).alias("_text"), marked.alias("t")).withColumn("key", F.xxhash64("_text"))
    one = pack(rows).groupBy("key").agg(F.first("_packed").alias("_packed"), F.first("_size").alias("_size"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("b"))
    return cut_lineage(one)


def _counted(texts: DataFrame, kept=None) -> DataFrame:
    """(gram, t, b): counts of words or, with ``kept`` (sorted words), of the pairs of such words."""

    def run(batch, found):
        rows, word, before, both = found
        if kept is not None:
            some = _of_foremost(kept.value, word, before)
            rows, word = rows[some], both[some]
        gram, which = np.unique(word, return_inverse=True)
        sums = [np.bincount(which, batch.column(c).to_numpy()[rows], len(gram)).astype(np.int64) for c in ("t", "b")]
        return pa.record_batch([pa.array(c) for c in (gram, *sums)], names=["gram", "t", "b"])

    return _of_texts(texts, run, "gram long, t long, b long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("t", "b")])


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram, t, b of a table of bounded size, sorted by gram."""
    arrow = table.select("gram", "t", "b").toArrow()
    gram, t, b = (arrow.column(c).to_numpy() for c in ("gram", "t", "b"))
    order = np.argsort(gram)
    return gram[order], t[order], b[order]


def _by_first(run, width: int = 1 << 17):
    """A function for ``mapInArrow`` over rows sorted by their first column: ``run`` gets all columns, equal values of the first together."""

    def each(batches):
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows < width:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last value may go on in the next batch
            if cut:
                yield run(*[c[:cut] for c in columns])
            held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if rows:
            yield run(*[np.concatenate(c) for c in zip(*held)])

    return each


def _elsewhere(texts: DataFrame, known, pairs, foremost, number: int) -> DataFrame:
    """(key, came): per text the counts of its n-grams of round ``number`` that occur in several texts.

    ``came`` holds three rows of whole numbers: where (twice the place of the n-gram's first word in the text, plus one for pairs), t and b.
    N-grams that every task knows are left out, so none of the rest is in more texts than the least frequent of the foremost words.
    """

    def sent(batch, found):
        rows, word, before, both = found
        begin = np.searchsorted(rows, np.arange(batch.num_rows))
        mine = np.flatnonzero((word.view(np.uint64) >> np.uint64(32)) % np.uint64(PASSES) == number)
        pair = np.flatnonzero(((both.view(np.uint64) >> np.uint64(32)) % np.uint64(PASSES) == number) & (before != _START.view(np.int64)))
        often = _find(foremost.value, word[pair])[1] & _find(foremost.value, before[pair])[1]
        often[often] = _find(pairs.value[0], both[pair[often]])[1]
        pair = pair[~often]
        gram, place = np.r_[word[mine], both[pair]], np.r_[mine, pair]
        at = 2 * (place - begin[rows[place]]) + np.r_[np.zeros(len(mine), np.int64), np.ones(len(pair), np.int64)]
        first, n, _ = _per_row(rows[place], gram)
        asked = ~_find(known.value[0], gram[first])[1] | (at[first] % 2 == 1)
        first, n = first[asked], n[asked]
        row = rows[place[first]]
        columns = [gram[first], batch.column("key").to_numpy()[row], at[first], *(n * batch.column(c).to_numpy()[row] for c in ("t", "b"))]
        return pa.record_batch([pa.array(c) for c in columns], names=["gram", "key", "at", "t", "b"])

    def back(gram, key, at, t, b):
        new = np.r_[True, gram[1:] != gram[:-1]]
        starts = np.flatnonzero(new)
        many = np.diff(np.r_[starts, len(gram)])
        some = np.repeat(many > 1, many)
        sums = [np.repeat(np.add.reduceat(c, starts), many)[some] for c in (t, b)]
        return pa.record_batch([pa.array(c) for c in (key[some], at[some], *sums)], names=["key", "at", "t", "b"])

    def listed(key, at, t, b):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        came = [np.stack(c).tobytes() for c in zip(*(np.split(c, starts[1:]) for c in (at, t, b)))]
        return pa.record_batch([pa.array(key[starts]), pa.array(came, pa.binary())], names=["key", "came"])

    dealt = spread(_of_texts(texts, sent, "gram long, key long, at long, t long, b long"), "gram").sortWithinPartitions("gram")
    found = spread(dealt.mapInArrow(_by_first(back), "key long, at long, t long, b long"), "key").sortWithinPartitions("key")
    return found.mapInArrow(_by_first(listed), "key long, came binary")


def _mean_bits(texts: DataFrame, back: list[DataFrame], known, pairs, foremost, tokens: tuple[int, int], vocabulary: int) -> DataFrame:
    """(key, n_tokens, target_bits, background_bits) of every text, from the counts that tasks know, that came back, or else its own."""
    scale, rounds = (1.0, tokens[0] / tokens[1] if tokens[1] else 1.0), len(back)

    def run(batch, found):
        rows, word, before, both = found
        begin = np.searchsorted(rows, np.arange(batch.num_rows))
        came = [(i, np.frombuffer(c, np.int64).reshape(3, -1)) for k in range(rounds) for i, c in enumerate(batch.column(f"came{k}").to_pylist()) if c]
        at, *sums = np.concatenate([np.zeros((3, 0), np.int64), *(c for _, c in came)], axis=1)
        place = begin[np.repeat([i for i, _ in came], [c.shape[1] for _, c in came]).astype(np.int64)] + at // 2

        def counts(gram, kind, table, asked=None):
            """Target and background count per word of the text; with ``asked`` only those n-grams can be in ``table``."""
            first, n, which = _per_row(rows, gram)
            asked_at = np.arange(len(first)) if asked is None else np.flatnonzero(asked[first])
            where, found = _find(table[0], gram[first[asked_at]])
            where, there = where[found], asked_at[found]
            own = at % 2 == kind
            out = []
            for m, c in enumerate(("t", "b")):
                values = n * batch.column(c).to_numpy()[rows[first]]
                values[there] = table[1 + m][where]
                sent = np.full(len(rows), -1, np.int64)
                sent[place[own]] = sums[m][own]
                sent = sent[first]
                out.append(np.where(sent >= 0, sent, values)[which])
            return out

        unigrams, bigrams = counts(word, 0, known.value), counts(both, 1, pairs.value, _of_foremost(foremost.value, word, before))
        n, bits = np.bincount(rows, minlength=batch.num_rows), []
        for m in (0, 1):
            history = np.r_[0, unigrams[m][:-1]][: len(rows)] * scale[m]
            history[before == _START.view(np.int64)] = 0.0
            alone = (unigrams[m] * scale[m] + ADDED) / (tokens[m] * scale[m] + ADDED * vocabulary)
            loss = -np.log2((np.minimum(bigrams[m] * scale[m], history) + PRIOR * alone) / (history + PRIOR))
            bits.append(np.bincount(rows, loss, batch.num_rows) / np.maximum(n, 1))
        columns = [batch.column("key"), pa.array(n), *(pa.array(b, mask=n == 0) for b in bits)]
        return pa.record_batch(columns, names=["key", "n_tokens", "target_bits", "background_bits"])

    for k, some in enumerate(back):
        texts = texts.join(some.withColumnRenamed("came", f"came{k}"), "key", "left")
    return _of_texts(texts, run, "key long, n_tokens long, target_bits double, background_bits double")


def score_corpus(docs: DataFrame, target: str, text: str = "text") -> DataFrame:
    """What ``score(docs, fit(docs, target), counted=True)`` gives, without tables of all pairs: counts travel to the texts.

    Equal texts are worked on once. Most pairs of a corpus occur in one text only, whose own counts are theirs, so only n-grams
    that occur in several texts come back from counting. All tasks know the ``KNOWN`` most frequent words, and as many pairs of the
    ``FOREMOST`` of them; these sizes are fixed, and all other n-grams are exact by way of the shuffle.
    Nulls, empty texts, repeated rows, empty tables and clashing names are treated as ``score`` does.
    """
    added = ["n_tokens", "target_bits", "background_bits", "difference"]
    context = docs.sparkSession.sparkContext
    texts = _distinct_texts(docs, target, text)
    words = cut_lineage(_counted(texts))
    n = words.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
    known = _arrays(words.orderBy(F.desc("b"), "gram").limit(KNOWN))
    foremost = context.broadcast(np.sort(known[0][np.lexsort((known[0], -known[2]))[:FOREMOST]]))
    known = context.broadcast(known)
    discard(words)
    pairs = context.broadcast(_arrays(_counted(texts, foremost).orderBy(F.desc("b"), "gram").limit(KNOWN)))
    release(docs.sparkSession)
    back = []
    for number in range(PASSES):
        back.append(cut_lineage(_elsewhere(texts, known, pairs, foremost, number)))
        release(docs.sparkSession)
    scores = cut_lineage(_mean_bits(texts, back, known, pairs, foremost, (n.t or 0, n.b or 0), max(1, n.n)))
    discard(texts, *back)
    rest = [c for c in docs.columns if c not in (text, "_key", *added)]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.xxhash64(text_or_empty(text)).alias("_key"))
    named = scores.withColumnRenamed("key", "_key")
    out = rows.join(F.broadcast(named), "_key") if fits_broadcast(named, 64) else counted_join(rows, named, ["_key"])
    return out.withColumn("difference", F.col("target_bits") - F.col("background_bits")).select(*[F.col(f"`{c}`") for c in rest], *added)
