"""Sentences and the training examples cut from them.

A sentence is one row with its items in order, so windows are array slices:
pair generation adds no shuffle to the one that built the sentences.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelink.functions.hashing import uniform
from lorelink.functions.text import entity_title_prefix
from lorelink.functions.vectors import matrix, vector_mean, word_mean
from lorelink.operators.skew import counted_join, fits_broadcast

MAX_SENTENCE = 1000


def sentences(encoded: DataFrame, keys: list[str], item: str = "item_id", span: str | None = None, max_len: int = MAX_SENTENCE) -> DataFrame:
    """keys, chunk, items: kept tokens of a line re-indexed and cut at ``max_len``.

    The group of a line is the line itself, as long as the text row it came from.
    """
    span_id = F.col(span).cast("long") if span else F.lit(None).cast("long")
    grouped = encoded.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(item).alias("item"), span_id.alias("span_id")))).alias("_all")
    )
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / max_len).cast("int")),
        lambda c: F.slice("_all", c * max_len + 1, F.lit(max_len)),
    )
    return grouped.select(*keys, F.posexplode(chunks).alias("chunk", "items")).withColumn("chunk", F.col("chunk").cast("long"))


def around(items: Column, first: Column, last: Column, radius: Column | int) -> Column:
    """Items up to ``radius`` before index ``first`` and after index ``last`` (from 0)."""
    reach = F.lit(radius) if isinstance(radius, int) else radius
    start = F.greatest(first - reach, F.lit(0))
    return F.concat(F.slice(items, start + 1, first - start), F.slice(items, last + 2, reach))


def skipgram_pairs(rows: DataFrame, keys: list[str], window: int, seed: int | None = None, draw=uniform) -> DataFrame:
    """(center, context) item pairs with their positions in the chunk.

    With a seed the half-window of each center is uniform in 1..window, as is
    usual; without one it is always ``window``.
    """
    where = [F.col(k) for k in keys]
    if seed is None:
        reach = lambda i: F.lit(window)
    else:
        reach = lambda i: (F.floor(draw(seed, *where, F.col("chunk"), i) * window) + 1).cast("int")
    indexed = F.transform("items", lambda x, i: F.struct(x["item"].alias("item"), i.cast("long").alias("at")))
    centers = F.transform(
        "_ix",
        lambda x, i: F.struct(x["item"].alias("center"), x["at"].alias("center_at"), around(F.col("_ix"), i, i, reach(i)).alias("near")),
    )
    wide = rows.withColumn("_ix", indexed).select(*keys, "chunk", F.explode(centers).alias("_c"))
    return wide.select(
        *keys, "chunk", F.col("_c.center").alias("center"), F.col("_c.center_at").alias("center_at"), F.explode("_c.near").alias("_n")
    ).select(*keys, "chunk", "center", "center_at", F.col("_n.item").alias("context"), F.col("_n.at").alias("context_at"))


def anchor_contexts(rows: DataFrame, keys: list[str], window: int) -> DataFrame:
    """keys, chunk, span_id, context: items left and right of each span.

    Span words themselves are skipped; spans whose words were all dropped do
    not appear in the items and so give no row.
    """
    # Places sorted by span: a span is a stretch of them, from its first item to its last.
    places = F.transform("items", lambda x, i: F.struct(x["span_id"].alias("s"), i.alias("i")))
    sorted_ = F.array_sort(F.filter(places, lambda p: p["s"].isNotNull()))
    at = lambda k: F.get("_places", k)
    starts = F.filter(
        F.transform("_places", lambda p, k: k), lambda k: (k == 0) | (at(k)["s"] != at(k - 1)["s"])
    )
    found = F.transform(
        "_starts",
        lambda k, n: F.struct(
            at(k)["s"].alias("span_id"), at(k)["i"].alias("first"), at(F.coalesce(F.get("_starts", n + 1), F.size("_places")) - 1)["i"].alias("last")
        ),
    )
    spans = rows.withColumn("_places", sorted_).withColumn("_starts", starts).select(*keys, "chunk", "items", F.explode(found).alias("_s"))
    near = around(F.transform("items", lambda x: x["item"]), F.col("_s.first"), F.col("_s.last"), window)
    return spans.select(*keys, "chunk", F.col("_s.span_id").alias("span_id"), near.alias("context"))


def with_entity(contexts: DataFrame, spans: DataFrame, keys: list[str], entities: DataFrame) -> DataFrame:
    """Contexts with the span's entity; entities outside the vocabulary or without a title drop out."""
    own = spans.select(*keys, "span_id", "entity")
    return contexts.join(own, [*keys, "span_id"]).join(entities.select("entity"), "entity", "left_semi")


def context_words(contexts: DataFrame, keys: list[str]) -> DataFrame:
    return contexts.select(*keys, F.explode("context").alias("word"))


def lookup(vectors: DataFrame, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Words and vectors of a table of checked size."""
    local = vectors.select("word", "vec").toArrow().combine_chunks()
    if not local.num_rows:
        return pa.array([], local.schema.field("word").type), np.zeros((0, dim))
    return local.column("word").combine_chunks(), matrix(local.column("vec"))[0]


def context_vector(contexts: DataFrame, keys: list[str], vectors: DataFrame, dim: int) -> DataFrame:
    """Mean vector of the known context words per row of ``contexts`` (``vec``).

    ``vectors`` has ``word`` and ``vec``, one row per word; ``keys`` identify a
    context. A vector table of checked small size travels to the contexts,
    which then need no shuffle. A larger one is joined by word, frequent words
    salted, and the mean combines on the map side. Contexts without a known
    word give no row.
    """
    if fits_broadcast(vectors, 8 * dim + 64):
        mean = word_mean(contexts.sparkSession, *lookup(vectors, dim))
        return contexts.select(*keys, mean("context").alias("vec")).filter("vec IS NOT NULL")
    words = context_words(contexts, keys)
    return vector_mean(counted_join(words, vectors, ["word"]), keys, "vec", dim).select(*keys, "vec")


def sense_to_word_pairs(contexts: DataFrame) -> DataFrame:
    """(entity sense -> context word)."""
    return contexts.select(F.col("entity").alias("input"), F.explode("context").alias("output"))


def word_to_entity_pairs(contexts: DataFrame) -> DataFrame:
    """(context word -> entity)."""
    return contexts.select(F.explode("context").alias("input"), F.col("entity").alias("output"))


def sense_to_entity_pairs(contexts: DataFrame) -> DataFrame:
    """(sense of the entity's title -> entity), one per span."""
    return contexts.select(F.col("entity").alias("input"), F.col("entity").alias("output"))


def neighbour_pairs(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(outlink -> head) as entity ids, both in the vocabulary and past the sentence end."""
    known = entities.filter("item_id > 0")
    head = known.select(F.col("item").alias("src"), F.col("item_id").alias("output"))
    tail = known.select(F.col("item").alias("dst"), F.col("item_id").alias("input"))
    return counted_join(links.join(head, "src"), tail, ["dst"]).select("input", "output")


def cbow_examples(contexts: DataFrame) -> DataFrame:
    """One row per span: context words plus the span's sense -> entity."""
    return contexts.filter(F.size("context") > 0).select(
        F.col("context").alias("words"), F.col("entity").alias("sense"), F.col("entity").alias("output")
    )


def single_prototype(contexts: DataFrame) -> DataFrame:
    """Replace the entity by its title, so a title has one vector."""
    return contexts.withColumn("entity", entity_title_prefix(F.col("entity")))
