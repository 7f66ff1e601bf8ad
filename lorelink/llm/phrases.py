"""Collocations: phrases of two to four words, scored by their rarest cut, from a prefix-free parse of the corpus.

Texts are cut into pieces at punctuation, and pieces into chunks wherever the next three words hash to a trigger. A chunk
runs to the end of the next trigger, so neighbours overlap by those three words, and a phrase of up to four words lies
whole in the chunk in whose core (what precedes the next trigger) it begins: there, and only there, it is counted. Equal
chunks are one entry of a dictionary with its frequency in the parse; texts that repeat add to frequencies and nothing else.

Counts come from the dictionary, in three steps. A phrase that occurs often consists of frequent words and of frequent
word pairs, so words are counted first, then pairs of frequent words by hash, then phrases of frequent pairs by their text.
What is frequent travels as a bit map of fixed size; a wrong bit costs a row and changes no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorelink.llm.common import chunks, lowered, map_arrow, spaced, text_or_empty, texts_as_bytes, word_bounds
from lorelink.llm.rolling import Prefix, mix
from lorelink.session import cut_lineage, discard, release

LONGEST, OFTEN, TOP = 4, 30, 2000
# One window of words in so many is a trigger.
TRIGGER = 16
# Share of a phrase's occurrences inside one longer phrase from which it is left out, in hundredths.
WITHIN = 80
# Bits of a map of what is frequent: 16 MB.
MAP_BITS = 27
# Parts in which the candidates of a language are ranked first.
PARTS = 32
# Bytes of chunks that a task counts at a time.
BLOCK = 1 << 22

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _PIECE.copy()
_BETWEEN[[0x09, 0x20]] = True
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def parse(starts: np.ndarray, pieces: np.ndarray, hashes: np.ndarray, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, core and length of the chunks of some words, whose pieces are numbered."""
    n, window = len(hashes), LONGEST - 1
    first = np.r_[True, pieces[1:] != pieces[:-1]] if n else np.zeros(0, bool)
    begins = first.copy()
    if n >= window:
        m = n - window + 1
        h = mix(sum(hashes[k : m + k] * _FACTORS[k] for k in range(window)))
        begins[:m] |= (h % np.uint64(trigger) == 0) & (pieces[:m] == pieces[window - 1 :])
    at = np.flatnonzero(begins)
    core = np.diff(np.r_[at, n])
    goes_on = np.r_[~first[at[1:]], False] if n else first
    return at, core, core + np.where(goes_on, window, 0)


def parsed(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, core, chunk, many): the dictionary of the parse. Words of a chunk are lower-cased (A-Z), each with a space behind."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("_text"))

    def run(batch):
        flat, offsets = texts_as_bytes(batch.column("_text"))
        for begin, end in chunks(offsets):
            own = lowered(flat[offsets[begin] : offsets[end]])
            starts, ends, row = word_bounds(own, offsets[begin : end + 1] - offsets[begin], _BETWEEN)
            if not len(starts):
                continue
            # Where the number of marks before a word changes, a piece begins; so it does with a text.
            marks = np.cumsum(_PIECE[own])[starts]
            pieces = np.cumsum(np.r_[True, (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])])
            at, core, length = parse(starts, pieces, Prefix(own).slices(starts, ends))
            stop = np.cumsum(length)
            words = np.arange(stop[-1]) + np.repeat(at - (stop - length), length)
            data, where = spaced(own, starts[words], ends[words])
            yield pa.record_batch(
                [batch.column("lang").take(pa.array(begin + row[at])), pa.array(core.astype(np.int32)), _strings(data, where[np.r_[0, stop]])], names=["lang", "core", "chunk"]
            )

    found = map_arrow(rows, run, "lang string, core int, chunk string")
    return found.groupBy("lang", "core", "chunk").agg(F.count(F.lit(1)).alias("many"))


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts that lie end to end and begin ``at``."""
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class _Words:
    """The words of some dictionary rows: place, position after which a chunk's core ends, weight, hash with the language."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.flat, offsets = texts_as_bytes(rows.column("chunk").combine_chunks())
        self.starts, self.ends, self.row = word_bounds(self.flat, offsets, _SPACE)
        bounds = np.searchsorted(self.row, np.arange(rows.num_rows + 1))
        core, many = (rows.column(c).to_numpy() for c in ("core", "many"))
        self.counted = np.arange(len(self.starts)) < (bounds[:-1] + core)[self.row]
        self.many = many[self.row]
        names, at = texts_as_bytes(rows.column("lang").combine_chunks())
        self.lang = mix(Prefix(names).slices(at[:-1], at[1:]) * _FACTORS[2] + np.uint64(1))[self.row]
        self.hash = mix(Prefix(self.flat).slices(self.starts, self.ends) ^ self.lang)

    def follows(self, n: int) -> np.ndarray:
        """Whether a phrase of ``n`` words that is counted here begins at each word that has ``n`` - 1 words behind it."""
        last = len(self.row) - n + 1
        return self.counted[:last] & (self.row[:last] == self.row[n - 1 :]) if last > 0 else np.zeros(0, bool)

    def pairs(self) -> np.ndarray:
        return mix(self.hash[:-1] * _FACTORS[0] + self.hash[1:] * _FACTORS[1])


def _map_blocks(dictionary: DataFrame, run: Callable[[_Words], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over about ``BLOCK`` bytes of chunks at a time."""

    def each(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("chunk").nbytes
            if size >= BLOCK:
                yield from run(_Words(pa.Table.from_batches(held)))
                held, size = [], 0
        if size:
            yield from run(_Words(pa.Table.from_batches(held)))

    return dictionary.select("lang", "core", "chunk", "many").mapInArrow(each, schema)


def _weighted(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], order[at], np.add.reduceat(many[order], at) if len(at) else many[:0]


def _slices(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    at = np.r_[0, np.cumsum(ends - starts)]
    return _strings(flat[np.arange(at[-1]) + np.repeat(starts - at[:-1], ends - starts)], at)


def word_counts(dictionary: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words."""

    def run(words):
        mine = np.flatnonzero(words.counted)
        # Inside a block words are told apart by 64-bit hashes; blocks are added up by text.
        _, at, n = _weighted(words.hash[mine], words.many[mine])
        at = mine[at]
        langs = words.rows.column("lang").take(pa.array(words.row[at])).combine_chunks()
        yield pa.record_batch([langs, _slices(words.flat, words.starts[at], words.ends[at]), pa.array(n)], names=["lang", "phrase", "n"])

    found = _map_blocks(dictionary, run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_hashes(words: DataFrame) -> DataFrame:
    """``hash`` of each (lang, phrase) of one word, as the words of chunks have it."""
    single = words.select("lang", F.lit(1).alias("core"), F.col("phrase").alias("chunk"), F.col("n").alias("many"))

    def run(words):
        yield pa.record_batch([pa.array(words.hash.view(np.int64))], names=["hash"])

    return _map_blocks(single, run, "hash long")


def bit_map(hashes: DataFrame, bits: int = MAP_BITS) -> Broadcast:
    """Sets the bits that the leading ``bits`` bits of ``hash`` name; 2^bits / 8 bytes whatever comes in."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("mask"))
    table = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _pair_counts(dictionary: DataFrame, frequent: Broadcast) -> DataFrame:
    """(hash, n) of pairs of frequent words."""

    def run(words):
        often = _has(frequent.value, words.hash)
        mine = np.flatnonzero(words.follows(2) & often[:-1] & often[1:])
        hashes, _, n = _weighted(words.pairs()[mine], words.many[mine])
        yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return _map_blocks(dictionary, run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _phrase_counts(dictionary: DataFrame, frequent: Broadcast, pairs: Broadcast) -> DataFrame:
    """(lang, phrase, n) of phrases whose words and pairs are frequent."""

    def run(words):
        often = _has(frequent.value, words.hash)
        # Pairs reach over the end of the core; that the phrase begins inside is asked at its first word.
        linked = _has(pairs.value, words.pairs()) & often[:-1] & often[1:]
        for n in range(2, LONGEST + 1):
            begins = words.follows(n)
            for k in range(n - 1):
                begins &= linked[k : k + len(begins)]
            mine = np.flatnonzero(begins)
            if not len(mine):
                return
            h = sum(words.hash[mine + k] * (_FACTORS[0] + np.uint64(2 * k)) for k in range(n))
            _, at, many = _weighted(mix(h), words.many[mine])
            at = mine[at]
            langs = words.rows.column("lang").take(pa.array(words.row[at])).combine_chunks()
            yield pa.record_batch([langs, _slices(words.flat, words.starts[at], words.ends[at + n - 1]), pa.array(many)], names=["lang", "phrase", "n"])

    return _map_blocks(dictionary, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, often: int = OFTEN, text: str = "text", lang: str = "lang", bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, words) of all phrases of 1 to 4 words with ``often`` occurrences or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    dictionary = cut_lineage(parsed(docs, text, lang), "zstd")
    release(spark)
    words = cut_lineage(word_counts(dictionary))
    release(spark)
    known = words.filter(F.col("n") >= often)
    frequent = bit_map(_word_hashes(known), bits)
    pairs = bit_map(_pair_counts(dictionary, frequent).filter(F.col("n") >= often), bits)
    release(spark)
    longer = _phrase_counts(dictionary, frequent, pairs).filter(F.col("n") >= often)
    both = cut_lineage(known.unionByName(longer).withColumn("words", F.size(F.split("phrase", " "))))
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("n").alias("n")))
    discard(dictionary, words)
    release(spark)
    return both, totals


def _part(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice("_words", first, count), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all phrases of two words or more; the lowest-scoring cut counts, the first of equal ones."""
    several = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("_words"))
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(F.lit(1), F.col("k")).alias("_l"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"))
    for side, count in (("_l", "l"), ("_r", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    score = F.expr("(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r")).alias("_b"))
    return best.select("lang", "phrase", "_b.words", "_b.a", "_b.l", "_b.r", "_b.score")


def collocations(docs: DataFrame, often: int = OFTEN, top: int = TOP, within: int = WITHIN, text: str = "text", lang: str = "lang", bits: int = MAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A candidate occurs ``often`` times (``a``) or more; ``l`` and ``r`` count the parts of its lowest-scoring cut, ``n`` all
    words of the language, and score is floor(2000000 a / (l + r)). Candidates inside a longer candidate that has ``within`` hundredths of
    their occurrences or more are left out. Null languages are ``und``; null, empty and blank texts have no words; repeated rows count
    as often as they stand there; ties are broken by count, then by text; an empty table gives no rows; extra columns are left out.
    """
    phrases, totals = frequent_phrases(docs, often, text, lang, bits)
    found = cut_lineage(scored(phrases))
    long_ = found.filter("words > 2").select("lang", "words", F.col("a").alias("_longer"), F.split("phrase", " ").alias("_words"))
    sizes = long_.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_size"))
    places = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1)).alias("_first"))
    inside = places.select("lang", _part(F.col("_first"), F.col("_size")).alias("phrase"), "_longer").groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    exact = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
    kept = found.join(inside, ["lang", "phrase"], "left").filter(exact("_longer") * 100 < exact("a") * within)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Two steps, so that the candidates of one language do not meet in one task.
    some = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    fewer = kept.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    best = fewer.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
