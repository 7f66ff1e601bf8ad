"""Title, redirect and lower-case dictionaries, and name resolution against them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelink.functions.text import entity_title_prefix, normalize_phrase
from lorelink.operators.skew import ROWS_PER_TASK, hot_keys, salted_join


def split_namespaced_titles(titles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean titles, ignored ``ns:title`` rows and duplicated titles; lowest id first."""
    counted = titles.groupBy("title").agg(F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("n"))
    spaced = F.col("title").contains(":")
    clean = counted.filter(~spaced).select("title", "entity_id")
    ignored = counted.filter(spaced).select("title", "entity_id")
    duplicates = counted.filter(F.col("n") > 1).select("title", "n")
    return clean, ignored, duplicates


def unambiguous_lower_map(titles: DataFrame) -> DataFrame:
    """lower(title) -> title for lower forms that belong to one title only."""
    return _single_target(titles.select(F.lower("title").alias("lower_title"), "title"), "lower_title")


def _single_target(pairs: DataFrame, key: str) -> DataFrame:
    # One distinct target exactly when the smallest and largest agree; unlike a
    # distinct count this needs one combining pass.
    bounds = pairs.groupBy(key).agg(F.min("title").alias("title"), F.max("title").alias("_last"))
    return bounds.filter(F.col("title") == F.col("_last")).select(key, "title")


def clean_redirects(redirects: DataFrame, titles: DataFrame) -> DataFrame:
    """Redirects to known titles, without aliases that point to several of them."""
    known = redirects.filter(F.col("alias") != "").join(titles.select("title"), "title", "left_semi")
    bounds = known.groupBy("alias").agg(
        F.min("redirect_id").alias("redirect_id"), F.min("title").alias("title"), F.max("title").alias("_last")
    )
    return bounds.filter(F.col("title") == F.col("_last")).select("redirect_id", "alias", "title")


def extend_lower_map(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """The lower map over titles and redirect aliases; keys with two targets are out."""
    names = titles.select(F.lower("title").alias("lower_title"), "title").unionByName(
        redirects.select(F.lower("alias").alias("lower_title"), "title")
    )
    return _single_target(names, "lower_title")


def resolve_names(names: DataFrame, column: str, titles: DataFrame, redirects: DataFrame, lower_map: DataFrame) -> DataFrame:
    """Add ``resolved``: redirect target, else lower-map title, else the exact title.

    ``names`` should hold each name once; dictionaries have one row per key.
    """
    alias = redirects.select(F.col("alias").alias(column), F.col("title").alias("_by_redirect"))
    lower = lower_map.select(F.col("lower_title").alias("_lower"), F.col("title").alias("_by_lower"))
    exact = titles.select(F.col("title").alias(column)).withColumn("_by_title", F.col(column))
    return (
        names.withColumn("_lower", F.lower(column))
        .join(alias, column, "left")
        .join(exact, column, "left")
        .join(lower, "_lower", "left")
        .withColumn("resolved", F.coalesce("_by_redirect", "_by_lower", "_by_title"))
        .drop("_lower", "_by_redirect", "_by_lower", "_by_title")
    )


def resolve_title(
    df: DataFrame, column: str, titles: DataFrame, redirects: DataFrame, lower_map: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Resolve a column of names with repeats; unresolved names give null.

    Names are reduced to distinct ones first, so a name behind a third of the
    rows passes the dictionary joins once, and the counts of that reduction tell
    which names to salt when the answer is joined back.
    """
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    mapped = resolve_names(counted, column, titles, redirects, lower_map)
    hot = hot_keys(counted, [column], "_n", rows_per_task)
    return salted_join(df, mapped.filter("resolved is not null").drop("_n"), [column], hot, "left")


def title_entity_index(entities: DataFrame, title_vocab: DataFrame) -> DataFrame:
    """Entities with the title they belong to; entities without one are left out."""
    own = entities.withColumn("title", entity_title_prefix(F.col("entity")))
    return own.join(title_vocab.select("title"), "title", "left_semi").select("entity", "title")


def title_coverage(entities: DataFrame, index: DataFrame) -> DataFrame:
    """How many entities found a title."""
    found = entities.join(index.select("entity", F.lit(1).alias("_hit")), "entity", "left")
    return found.agg(F.count(F.lit(1)).alias("entities"), F.count("_hit").alias("with_title"))


def mapping_title(titles: DataFrame, stop_words: list[str]) -> DataFrame:
    """Normalised name -> title, without stop words, short names and numbers."""
    named = titles.select(normalize_phrase(F.col("title")).alias("name"), "title")
    return named.filter((F.length("name") > 2) & (F.col("name") != "dddddd") & ~F.col("name").isin(stop_words)).distinct()


def mapped_name_count(mapping: DataFrame, index: DataFrame) -> DataFrame:
    """Number of mapped names whose title owns at least one entity."""
    owned = index.select("title").distinct().withColumn("_owned", F.lit(1))
    return mapping.join(owned, "title", "left").agg(
        F.count(F.lit(1)).alias("names"), F.count("_owned").alias("names_with_entity")
    )


def id_title_lookup(df: DataFrame, titles: DataFrame, by: str) -> DataFrame:
    """Attach the title to ids (``by='entity_id'``) or the id to titles (``by='title'``)."""
    return df.join(titles.select("title", "entity_id"), by, "left")


def id_filter(df: DataFrame, titles: DataFrame, column: Column | str = "entity_id") -> DataFrame:
    """Rows whose entity id is a known one."""
    known = titles.select(F.col("entity_id").alias("_known"))
    return df.join(known, F.col(column) == F.col("_known") if isinstance(column, str) else column == F.col("_known"), "left_semi")
