"""Entity and mention priors from anchor counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.functions.text import normalize_phrase
from lorelink.operators.skew import best_per_key


def mention_entity_counts(counts: DataFrame) -> DataFrame:
    """Anchor counts per (normalised label, entity)."""
    return (
        counts.withColumn("mention", normalize_phrase(F.col("label")))
        .filter("mention != ''")
        .groupBy("mention", "entity_id")
        .agg(F.sum("n").alias("n"))
    )


def entity_prior(counts: DataFrame) -> DataFrame:
    """pe = 100 * anchors of the entity / all anchors."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.groupBy("entity_id").agg(F.sum("n").alias("n")).select(
        "entity_id", (100.0 * F.col("n") / total).alias("pe")
    )


def mention_entity_prob(pairs: DataFrame) -> DataFrame:
    """pem = n(mention, entity) / n(mention)."""
    totals = pairs.groupBy("mention").agg(F.sum("n").alias("_total"))
    return pairs.join(totals, "mention").select("mention", "entity_id", "n", (F.col("n") / F.col("_total")).alias("pem"))


def priors(counts: DataFrame) -> DataFrame:
    """mention, entity_id, n, pem, pe."""
    return mention_entity_prob(mention_entity_counts(counts)).join(entity_prior(counts), "entity_id").select(
        "mention", "entity_id", "n", "pem", "pe"
    )


def link_prior(scored: DataFrame, floor: float = 1e-6) -> DataFrame:
    """The most probable entity of each mention."""
    return best_per_key(scored.withColumn("pem", F.greatest("pem", F.lit(floor))), ["mention"], "pem", "entity_id")
