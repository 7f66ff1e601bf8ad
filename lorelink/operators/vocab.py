"""Tokens, vocabularies and sampling tables.

A line is carried as one row: an array of ``struct<token, span_id>`` plus an
array of spans. Looking tokens up is the only step that leaves that layout.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorelink.functions.hashing import uniform
from lorelink.functions.links import link_label, link_segments, link_title
from lorelink.functions.text import entity_title_prefix, phrase_tokens
from lorelink.operators.skew import BROADCAST_BYTES, ROWS_PER_TASK, fits_broadcast, hot_keys, running_total, salted_join, sequential_ids, sized_join
from lorelink.session import cut_lineage

SENTENCE_END = "</s>"
MENTION_MARK = r"\{\{([^{}]*)\}\}"


def plain_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent_id, pos, token for every line of a plain text."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("sent_id", "_line"))
    tokens = lines.select(key, F.col("sent_id").cast("long"), F.posexplode(phrase_tokens(F.col("_line"))).alias("pos", "token"))
    return tokens.select(key, "sent_id", F.col("pos").cast("long").alias("pos"), "token")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\]\[{}|]+"), lambda w: w != "")


def tokenize_linked_text(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines as ``tokens array<struct<token, span_id>>`` and ``spans``.

    ``[[e|label]]`` and ``{{m}}`` become their words and a span of kind
    ``entity`` or ``mention``; positions count words of the line from 0.
    """
    kept = [c for c in lines.columns if c != text]
    # A mention mark is read like a link whose title carries the mark itself.
    marked = F.regexp_replace(F.col(text), MENTION_MARK, "[[{{}}|$1]]")
    pieces = F.transform(
        link_segments(marked),
        lambda s: F.struct(
            s["is_link"].alias("is_link"),
            F.when(s["is_link"], link_title(s["text"])).alias("title"),
            F.when(s["is_link"], link_label(s["text"])).alias("label"),
            F.when(s["is_link"], _words(link_label(s["text"]))).otherwise(_words(s["text"])).alias("words"),
        ),
    )
    cut = lines.select(*kept, pieces.alias("_p"))
    tokens = F.flatten(
        F.transform(
            "_p",
            lambda p, i: F.transform(
                p["words"], lambda w: F.struct(w.alias("token"), F.when(p["is_link"], i.cast("long")).alias("span_id"))
            ),
        )
    )
    numbered = F.transform("_p", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    spans = F.transform(
        F.filter(numbered, lambda n: n["p"]["is_link"] & (F.size(n["p"]["words"]) > 0)),
        lambda n: F.struct(
            n["i"].cast("long").alias("span_id"),
            F.aggregate(
                F.slice("_p", F.lit(1), n["i"]), F.lit(0).cast("long"), lambda acc, p: acc + F.size(p["words"])
            ).alias("start_pos"),
            F.size(n["p"]["words"]).cast("long").alias("length"),
            F.when(n["p"]["title"] == "{{}}", "mention").otherwise("entity").alias("kind"),
            F.when(n["p"]["title"] != "{{}}", n["p"]["title"]).alias("entity"),
            n["p"]["label"].alias("label"),
        ),
    )
    return cut.select(*kept, tokens.alias("tokens"), spans.alias("spans"))


def word_vocab(tokens: DataFrame, min_count: int = 1, sentences: DataFrame | None = None) -> DataFrame:
    """item_id, item, cn by falling count; id 0 is the sentence end.

    ``sentences`` (one row per line) gives the sentence-end count when known.
    """
    counted = tokens.groupBy(F.col("token").alias("item")).agg(F.count(F.lit(1)).alias("cn")).filter(F.col("cn") >= min_count)
    numbered = sequential_ids(counted, [F.desc("cn"), F.asc("item")], "item_id", 1).select("item_id", "item", "cn")
    spark = tokens.sparkSession
    if sentences is None:
        end = spark.range(1).select(F.lit(0).cast("long").alias("item_id"), F.lit(SENTENCE_END).alias("item"), F.lit(0).cast("long").alias("cn"))
    else:
        end = sentences.agg(F.count(F.lit(1)).alias("cn")).select(
            F.lit(0).cast("long").alias("item_id"), F.lit(SENTENCE_END).alias("item"), "cn"
        )
    return end.unionByName(numbered)


def vocab_total(vocab: DataFrame) -> DataFrame:
    """Kept items and kept tokens."""
    return vocab.filter("item_id > 0").agg(F.count(F.lit(1)).alias("items"), F.sum("cn").alias("tokens"))


def entity_vocab(links: DataFrame, min_count: int = 0) -> DataFrame:
    """Vocabulary over both ends of the outlinks."""
    ends = links.select(F.col("src").alias("token")).unionByName(links.select(F.col("dst").alias("token")))
    return word_vocab(ends, min_count)


def title_vocab(entities: DataFrame) -> DataFrame:
    """Counts summed by bracket-less title, ids by falling count."""
    own = entities.filter("item_id > 0").select(entity_title_prefix(F.col("item")).alias("item"), "cn")
    summed = own.filter("item != ''").groupBy("item").agg(F.sum("cn").alias("cn"))
    return sequential_ids(summed, [F.desc("cn"), F.asc("item")], "item_id", 1).select("item_id", "item", "cn")


def keep_probability(vocab: DataFrame, sample: float) -> DataFrame:
    """Probability to keep an occurrence: (sqrt(cn/(s*T)) + 1) * (s*T)/cn, at most 1."""
    total = vocab.agg(F.sum("cn")).scalar()
    scaled = F.lit(sample) * total
    p = (F.sqrt(F.col("cn") / scaled) + 1) * scaled / F.col("cn")
    return vocab.withColumn("keep_p", F.when(F.col("cn") > 0, F.least(F.lit(1.0), p)).otherwise(1.0))


def encode_tokens(tokens: DataFrame, vocab: DataFrame, rows_per_task: int = ROWS_PER_TASK, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of tokens to the vocabulary.

    A vocabulary of checked small size travels to the tokens. Of a larger one the most
    frequent words travel, as many as ``limit`` bytes hold (ids go by falling count), so
    that only tokens of the rarer words are shuffled; frequent ones of these are salted.
    """
    kept = [c for c in vocab.columns if c not in ("item", "cn")]
    dim = vocab.filter("item_id > 0").select(F.col("item").alias("token"), *kept)
    hot = hot_keys(vocab.select(F.col("item").alias("token"), "cn"), ["token"], "cn", rows_per_task)
    if fits_broadcast(dim, 128, limit):
        return tokens.join(F.broadcast(dim), "token")
    first = dim.filter(F.col("item_id") <= limit // 128).select("token").distinct()
    head = dim.join(F.broadcast(first), "token", "left_semi") if fits_broadcast(first, 128, limit) else None
    if head is None or not fits_broadcast(head, 128, limit):
        return salted_join(tokens, dim, ["token"], hot)
    rest = tokens.join(F.broadcast(first), "token", "left_anti")
    return tokens.join(F.broadcast(head), "token").unionByName(salted_join(rest, dim, ["token"], hot))


def subsample_tokens(encoded: DataFrame, seed: int, keys: list[str], draw=uniform, exempt: Column | None = None) -> DataFrame:
    """Drop a token when its keep probability is below the draw; ``exempt`` rows stay."""
    keep = F.col("keep_p") >= draw(seed, *keys)
    return encoded.filter(keep if exempt is None else keep | exempt)


def negative_distribution(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """Probability of each item as a negative, proportional to cn**power."""
    weighted = vocab.withColumn("_w", F.pow(F.col("cn").cast("double"), F.lit(power)))
    total = weighted.agg(F.sum("_w")).scalar()
    return weighted.withColumn("p", F.col("_w") / total).drop("_w")


def cumulative_distribution(probabilities: DataFrame, width: int = 100_000) -> DataFrame:
    """``cdf`` by item id, summed in stretches of ``width`` ids."""
    cut = probabilities.withColumn("_cut", F.floor(F.col("item_id") / width))
    totals = cut.groupBy("_cut").agg(F.sum("p").alias("_t"))
    # One row per stretch, so this unpartitioned window stays small.
    before = totals.select("_cut", (F.sum("_t").over(W.orderBy("_cut").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_b"))
    local = F.sum("p").over(W.partitionBy("_cut").orderBy("item_id").rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("_l", local).join(before, "_cut").withColumn("cdf", F.col("_l") + F.col("_b")).drop("_cut", "_l", "_b")


# Weights of an alias table add up to about this; with up to 2^26 items their products stay within 64 bits.
ALIAS_WEIGHT = 1 << 36


def alias_table(probabilities: DataFrame) -> DataFrame:
    """cell, own, other, keep, full: one cell per item with a positive probability, shared by two owners at most.

    A cell belongs to ``own`` with probability keep / full and to ``other`` else, so that over all cells each item has
    exactly its whole-number weight. Cells with less than their item needs are light, those with more heavy. Light cells lay what
    they lack end to end on a line, heavy ones what they have left over: a light cell is filled by the heavy item whose stretch
    holds the beginning of its gap, and a heavy cell whose stretch ends inside a gap is filled up by the next heavy item. Both
    are the next event on the line, looked for in stretches of it.
    """
    weights = probabilities.select("item_id", F.round(F.col("p") * ALIAS_WEIGHT).cast("long").alias("w")).filter("w > 0")
    cells = cut_lineage(sequential_ids(weights, [F.asc("item_id")], "cell"))
    n, full = cells.agg(F.count(F.lit(1)), F.sum("w")).first()
    full = full or 0
    over = F.col("w") * n - full
    cells = cells.withColumns({"over": over, "gap": F.greatest(-over, F.lit(0)), "left": F.greatest(over, F.lit(0))})
    cells = running_total(running_total(cells, [], "cell", "gap", "_gaps"), [], "cell", "left", "_lefts")
    # Where a gap begins, where what is left over ends; at equal places heavy cells come first.
    place = F.when(F.col("over") > 0, F.col("_lefts")).otherwise(F.col("_gaps") - F.col("gap"))
    events = cells.filter("over <> 0").select("cell", "item_id", "w", place.alias("place"), (F.col("over") < 0).cast("int").alias("light"))
    parted = cut_lineage(events.repartitionByRange("place", "light").withColumn("_part", F.spark_partition_id()))
    # The next one is the last one before it in falling order: a frame that begins at the current row is summed anew for each row.
    falling = [F.desc("place"), F.desc("light")]
    ahead = W.partitionBy("_part").orderBy(*falling).rowsBetween(W.unboundedPreceding, -1)
    heavy, gap = F.when(F.col("light") == 0, F.col("item_id")), F.when(F.col("light") == 1, F.col("place"))
    # One row per partition: what the later ones begin with.
    order = F.struct("place", "light")
    firsts = parted.groupBy("_part").agg(F.min_by("item_id", F.when(F.col("light") == 0, order)).alias("_h"), F.min(gap).alias("_g"))
    later = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select("_part", F.last("_h", True).over(later).alias("_h"), F.last("_g", True).over(later).alias("_g"))
    found = parted.withColumns({"_heavy": F.last(heavy, True).over(ahead), "_gap": F.last(gap, True).over(ahead)}).join(F.broadcast(firsts), "_part")
    other = F.coalesce("_heavy", "_h", "item_id")
    # Behind the last gap the line ends where all gaps end.
    end = cells.agg(F.sum("gap")).first()[0] or 0
    keep = F.when(F.col("light") == 1, F.col("w") * n).otherwise(F.col("place") - F.coalesce("_gap", "_g", F.lit(end)) + full)
    shared = found.select("cell", F.col("item_id").alias("own"), other.alias("other"), keep.alias("keep"))
    whole = cells.filter("over = 0").select("cell", F.col("item_id").alias("own"), F.col("item_id").alias("other"), F.lit(full).cast("long").alias("keep"))
    return cut_lineage(shared.unionByName(whole).withColumn("full", F.lit(full).cast("long")))


def draw_from_alias(positives: DataFrame, table: DataFrame, k: int, seed: int, keys: list[str], draw=uniform, top: int | None = None) -> DataFrame:
    """k draws per positive from an ``alias_table``, without hits on ``positive``: draw_no and negative are added.

    A draw picks a cell, evenly whatever the frequencies are, and a second one its owner: one equi-join. The sentence end
    (id 0) is replaced by a uniform id from 1 to ``top``.
    """
    n = table.count()
    draws = positives.withColumn("draw_no", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumns(
        {"cell": F.floor(draw(seed, *keys, "draw_no") * n), "_u": draw(seed + 2, *keys, "draw_no")}
    )
    small = table.select("cell", "own", "other", "keep", "full")
    hit = draws.join(F.broadcast(small) if n * 48 <= BROADCAST_BYTES else small, "cell")
    drawn = F.when(F.col("_u") * F.col("full") < F.col("keep"), F.col("own")).otherwise(F.col("other"))
    if top is None:
        top = table.agg(F.max("own")).first()[0]
    uniform_id = (F.floor(draw(seed + 1, *keys, "draw_no") * (top or 0)) + 1).cast("long")
    return hit.withColumn("_d", drawn).withColumn("negative", F.when(F.col("_d") == 0, uniform_id).otherwise(F.col("_d"))).filter("negative <> positive").drop(
        "_u", "_d", "cell", "own", "other", "keep", "full"
    )


def draw_negatives(positives: DataFrame, probabilities: DataFrame, k: int, seed: int, keys: list[str], draw=uniform) -> DataFrame:
    """k draws per positive from the negative distribution, without hits on ``positive``."""
    return draw_from_alias(positives, alias_table(probabilities), k, seed, keys, draw)


def sample_word_embeddings(vectors: DataFrame, vocab_a: DataFrame, vocab_b: DataFrame) -> DataFrame:
    """Word vectors for items in both vocabularies."""
    return vectors.join(vocab_a.select("item"), "item", "left_semi").join(vocab_b.select("item"), "item", "left_semi")


def sample_entity_embeddings(vectors: DataFrame, vocab: DataFrame) -> DataFrame:
    return vectors.join(vocab.select("item"), "item", "left_semi")


def sample_sense_embeddings(senses: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Senses of titles that are mentioned or own a wanted entity.

    A title kept only for its entity loses its induced senses.
    """
    named = mentions.select(F.col("mention").alias("title")).distinct()
    wanted = senses.filter("sense_kind = 'kb'").join(entities.select(F.col("item").alias("sense_key")), "sense_key", "left_semi")
    by_name = senses.join(named, "title", "left_semi")
    by_entity = senses.join(wanted.select("title").distinct(), "title", "left_semi").join(named, "title", "left_anti")
    return by_name.unionByName(by_entity.filter("sense_kind = 'kb'"))
