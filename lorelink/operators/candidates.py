"""Candidate entities of mentions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.operators.skew import counted_join

# Last training and last development document.
LAST_TRAIN, LAST_DEV = 946, 1162


def ppr_candidates(listed: DataFrame, titles: DataFrame) -> DataFrame:
    """Candidates of a listing, known entities only."""
    return listed.join(titles.select("entity_id"), "entity_id", "left_semi").select("mention", "entity_id").distinct()


def yago_candidates(means: DataFrame, titles: DataFrame) -> DataFrame:
    """Candidates given by title."""
    return means.join(titles, "title").select("mention", "entity_id").distinct()


def wiki_candidates(counts: DataFrame, redirects: DataFrame, titles: DataFrame) -> DataFrame:
    """Lower-cased anchor labels, redirect aliases and page titles with their entities.

    A redirect target that is unknown is tried again with spaces for underscores.
    """
    labels = counts.select(F.lower("label").alias("mention"), "entity_id")
    own = titles.select(F.lower("title").alias("mention"), "entity_id")
    direct = titles.select("title", F.col("entity_id").alias("_direct"))
    spaced = titles.select(F.col("title").alias("_spaced"), F.col("entity_id").alias("_second"))
    aliases = (
        redirects.join(direct, "title", "left")
        .withColumn("_spaced", F.translate("title", "_", " "))
        .join(spaced, "_spaced", "left")
        .select(F.lower("alias").alias("mention"), F.coalesce("_direct", "_second").alias("entity_id"))
        .filter("entity_id is not null")
    )
    return labels.unionByName(aliases).unionByName(own).filter(F.length("mention") > 1).distinct()


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """Mentions, candidates and candidates per mention."""
    sizes = candidates.groupBy("mention").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("mentions"), F.sum("n").alias("candidates"), F.avg("n").alias("average")
    )


def filter_candidates(candidates: DataFrame, titles: DataFrame, senses: DataFrame | None = None) -> DataFrame:
    """Candidates with a known id and, when ``senses`` is given, a sense vector."""
    known = candidates.join(titles.select("entity_id"), "entity_id", "left_semi")
    if senses is not None:
        known = known.join(senses.select("entity_id"), "entity_id", "left_semi")
    return known.select("mention", "entity_id")


def skipped_candidates(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """How many candidates and mentions the filter removed."""
    before = candidates.groupBy("mention").agg(F.count(F.lit(1)).alias("_before"))
    after = kept.groupBy("mention").agg(F.count(F.lit(1)).alias("_after"))
    joined = before.join(after, "mention", "left")
    return joined.agg(
        F.sum(F.col("_before") - F.coalesce("_after", F.lit(0))).alias("skipped_candidates"),
        F.count_if(F.col("_after").isNull()).alias("skipped_mentions"),
    )


def linking_vocab(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities a linking corpus can need: candidates of its mentions and gold entities."""
    named = mentions.select("mention").distinct()
    offered = candidates.join(named, "mention", "left_semi").select("entity_id")
    gold = mentions.filter("gold is not null").select(F.col("gold").alias("entity_id"))
    return offered.union(gold).distinct()


def split_name(doc_id: str = "doc_id", last_train: int = LAST_TRAIN, last_dev: int = LAST_DEV):
    return F.when(F.col(doc_id) <= last_train, "train").when(F.col(doc_id) <= last_dev, "dev").otherwise("test")


def linking_coverage(mentions: DataFrame, candidates: DataFrame, last_train: int = LAST_TRAIN, last_dev: int = LAST_DEV) -> DataFrame:
    """Per split: mentions, summed candidates and mentions without any."""
    sizes = candidates.groupBy("mention").agg(F.count(F.lit(1)).alias("_size"))
    # Mentions are counted per split before they meet their sizes.
    seen = mentions.groupBy(split_name(last_train=last_train, last_dev=last_dev).alias("split"), "mention").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        seen.join(sizes, "mention", "left")
        .groupBy("split")
        .agg(
            F.sum("_n").alias("mentions"),
            F.sum(F.col("_n") * F.coalesce("_size", F.lit(0))).alias("candidates"),
            F.sum(F.when(F.col("_size").isNull(), F.col("_n")).otherwise(0)).alias("without"),
        )
    )


def linkable_mentions(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mentions whose gold entity is among their candidates."""
    offered = candidates.select("mention", F.col("entity_id").alias("gold"))
    return counted_join(mentions, offered, ["mention", "gold"], "left_semi")
