"""Linking corpora, tagged corpora and evaluation sets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorelink.functions.text import normalize_phrase
from lorelink.operators.skew import sequential_ids
from lorelink.sources.dictionaries import PLACE, line_place

DOC_START = "-DOCSTART-"


def read_conll(spark: SparkSession, path: str, candidates: DataFrame | None = None, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokens (doc_id, pos, token) and mentions (doc_id, mention_id, pos, mention, wiki_id).

    Files are cut at their document marks by the reader, so a document is one
    row and everything else is worked out inside it; documents count from 1 in
    file order. A mention is one item: its B row stands for it and the I rows
    after it vanish. With ``candidates`` (mention, entity_id) only mentions that
    offer their gold entity count as such; with ``words`` (word) other tokens
    must be in the vocabulary.
    """
    docs = spark.read.option("lineSep", DOC_START).text(path)
    placed = docs.select(*line_place(), "value").filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    numbered = sequential_ids(placed, [F.asc(c) for c in PLACE], "doc_id", 1)
    # The first line is what is left of the mark itself.
    cut = numbered.select("doc_id", F.posexplode(F.split("value", "\r?\n")).alias("_at", "_l")).filter("_at > 0")
    column = lambda i: F.get("_c", F.lit(i))
    rows = cut.select("doc_id", "_at", F.split(F.trim("_l"), "\t").alias("_c")).select(
        "doc_id", "_at", column(0).alias("_word"), F.coalesce(column(1), F.lit("")).alias("_tag"), F.size("_c").alias("_n"),
        F.when((column(1) == "B") & (F.size("_c") > 5), column(2)).alias("mention"),
        F.when((column(1) == "B") & (F.size("_c") > 5), column(5)).alias("wiki_id"),
    )
    if candidates is not None:
        offered = candidates.select("mention", F.col("entity_id").alias("wiki_id")).distinct().withColumn("_ok", F.lit(True))
        rows = rows.join(offered, ["mention", "wiki_id"], "left")
        rows = rows.withColumn("mention", F.when(F.col("_ok"), F.col("mention"))).withColumn("wiki_id", F.when(F.col("_ok"), F.col("wiki_id")))
    # Windows inside one document, which is one record of the file.
    order = W.partitionBy("doc_id").orderBy("_at")
    inside = (F.col("_tag") == "I") & (F.col("_n") > 2)
    opened = F.last(F.when(~inside, F.col("mention").isNotNull()), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("_open", opened).filter((F.col("_word") != "") & ~(inside & F.coalesce("_open", F.lit(False))))
    shaped = kept.withColumn("token", normalize_phrase(F.coalesce("mention", "_word")))
    if words is not None:
        known = words.select(F.col("word").alias("token")).distinct().withColumn("_known", F.lit(True))
        shaped = shaped.join(known, "token", "left").filter("mention IS NOT NULL OR _known")
    items = shaped.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    marked = items.filter("mention IS NOT NULL").withColumn("mention_id", (F.row_number().over(order) - 1).cast("long"))
    return items.select("doc_id", "pos", "token"), marked.select("doc_id", "mention_id", "pos", "mention", "wiki_id")


def read_relatedness(spark: SparkSession, path: str) -> DataFrame:
    """query_id, cand_id, rel; the first label of a pair counts."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("_p"), F.struct(*line_place()).alias("_line")).filter(F.size("_p") >= 3)
    rows = lines.select(F.get("_p", F.lit(0)).alias("query_id"), F.get("_p", F.lit(1)).alias("cand_id"), F.trim(F.get("_p", F.lit(2))).cast("int").alias("rel"), "_line")
    return rows.groupBy("query_id", "cand_id").agg(F.min_by("rel", "_line").alias("rel"))


def read_wordsim(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, w1, w2, score."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("_p"), F.monotonically_increasing_id().alias("pair_id")).filter(F.size("_p") >= 3)
    return lines.select(
        "pair_id", F.lower(F.get("_p", F.lit(0))).alias("w1"), F.lower(F.get("_p", F.lit(1))).alias("w2"), F.get("_p", F.lit(2)).try_cast("double").alias("score")
    ).filter("score IS NOT NULL")


def read_scws(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, context1, context2, score from rows of at least eight columns."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("_p"), F.monotonically_increasing_id().alias("pair_id")).filter(F.size("_p") >= 8)
    return lines.select(
        "pair_id", F.get("_p", F.lit(5)).alias("context1"), F.get("_p", F.lit(6)).alias("context2"), F.get("_p", F.lit(7)).try_cast("double").alias("score")
    ).filter("score IS NOT NULL")


def read_analogies(spark: SparkSession, path: str) -> DataFrame:
    """question_id, section_no, section, a, b, c, d.

    Sections are cut at their ``:`` lines by the reader, so a question never has
    to look for its section in other rows.
    """
    blocks = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.filter(F.split("value", r"(?m)^:[ ]*"), lambda b: F.trim(b) != "")).alias("_s", "_b")
    )
    lines = blocks.select((F.col("_s") + 1).cast("long").alias("section_no"), F.split("_b", "\r?\n").alias("_l"))
    rows = lines.select(
        "section_no", F.trim(F.get("_l", F.lit(0))).alias("section"), F.posexplode(F.slice("_l", F.lit(2), F.size("_l"))).alias("_i", "_q")
    ).withColumn("_w", F.split(F.trim("_q"), r"\s+")).filter(F.size("_w") == 4)
    return rows.select(
        (F.col("section_no") * 1_000_000 + F.col("_i")).alias("question_id"), "section_no", "section",
        *[F.get("_w", F.lit(i)).alias(c) for i, c in enumerate("abcd")],
    )


def read_tagged_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder tree of ``word#TAG`` text."""
    return spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("line"))
