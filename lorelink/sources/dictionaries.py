"""Tab-separated dictionaries, ragged count files and candidate lists."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How strictly a titles file is read.
TITLE_POLICIES = ("nonempty", "exact", "filled", "loose")


# Place of a line in its input: file, block of the file, position in the block.
PLACE = ["_file", "_block", "_no"]


def line_place() -> list[Column]:
    """Columns that order lines as they stand in the files, without a sort."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_no"),
    ]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.struct(*line_place()).alias("_line"))


def read_titles(spark: SparkSession, path: str, policy: str = "filled") -> DataFrame:
    """title, entity_id; the last id of a title wins.

    ``nonempty`` wants a title, ``exact`` exactly two columns, ``filled`` at
    least two and a line that is not blank, ``loose`` at least two.
    """
    if policy not in TITLE_POLICIES:
        raise ValueError(f"policy must be one of {TITLE_POLICIES}")
    lines = _numbered(spark, path).withColumn("_p", F.split("value", "\t"))
    width, filled = F.size("_p"), F.trim("value") != ""
    keep: Column = {
        "nonempty": (width >= 2) & (F.get("_p", F.lit(0)) != ""),
        "exact": width == 2,
        "filled": (width >= 2) & filled,
        "loose": width >= 2,
    }[policy]
    named = lines.filter(keep).select(F.get("_p", F.lit(0)).alias("title"), F.trim(F.get("_p", F.lit(1))).alias("entity_id"), "_line")
    return named.groupBy("title").agg(F.max_by("entity_id", "_line").alias("entity_id"))


def read_redirects(spark: SparkSession, path: str, titles: DataFrame) -> DataFrame:
    """redirect_id, alias, title with known targets; the first row of an alias wins."""
    lines = _numbered(spark, path).withColumn("_p", F.split("value", "\t")).filter(F.size("_p") == 3)
    rows = lines.select(
        F.get("_p", F.lit(0)).alias("redirect_id"), F.get("_p", F.lit(1)).alias("alias"), F.trim(F.get("_p", F.lit(2))).alias("title"), "_line"
    ).filter("alias <> ''")
    known = rows.join(titles.select("title"), "title", "left_semi")
    first = known.groupBy("alias").agg(F.min_by(F.struct("redirect_id", "title"), "_line").alias("_r"))
    return first.select("_r.redirect_id", "alias", "_r.title")


def raw_redirects(spark: SparkSession, path: str) -> DataFrame:
    """All three-column rows, for cleaning against the titles."""
    lines = spark.read.text(path).withColumn("_p", F.split("value", "\t")).filter(F.size("_p") == 3)
    return lines.select(
        F.get("_p", F.lit(0)).alias("redirect_id"), F.get("_p", F.lit(1)).alias("alias"), F.trim(F.get("_p", F.lit(2))).alias("title")
    )


def read_lower_map(spark: SparkSession, path: str, titles: DataFrame) -> DataFrame:
    """lower_title, title with known titles; the first row of a key wins."""
    lines = _numbered(spark, path).withColumn("_p", F.split("value", "\t")).filter(F.size("_p") == 2)
    rows = lines.select(F.get("_p", F.lit(0)).alias("lower_title"), F.trim(F.get("_p", F.lit(1))).alias("title"), "_line").filter("lower_title <> ''")
    return rows.join(titles.select("title"), "title", "left_semi").groupBy("lower_title").agg(F.min_by("title", "_line").alias("title"))


def read_mention_counts(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, title, label, n from ragged ``id, title, label::=n ...`` lines."""
    lines = spark.read.text(path).withColumn("_p", F.split("value", "\t")).filter(F.size("_p") >= 3)
    parts = lines.select(
        F.get("_p", F.lit(0)).alias("entity_id"), F.get("_p", F.lit(1)).alias("title"),
        F.explode(F.slice("_p", F.lit(3), F.size("_p"))).alias("_part"),
    ).withColumn("_kv", F.split("_part", "::="))
    sound = parts.filter((F.size("_kv") == 2) & F.get("_kv", F.lit(1)).rlike("^ *[0-9]+ *$"))
    rows = sound.select("entity_id", "title", F.get("_kv", F.lit(0)).alias("label"), F.trim(F.get("_kv", F.lit(1))).cast("long").alias("n"))
    return rows.groupBy("entity_id", "title", "label").agg(F.sum("n").alias("n"))


def read_outlinks(spark: SparkSession, path: str) -> DataFrame:
    """src, dst edges from lines separated by tabs or semicolons, head first."""
    lines = spark.read.text(path).withColumn("_p", F.split("value", "[\t;]"))
    edges = lines.select(F.get("_p", F.lit(0)).alias("src"), F.explode(F.slice("_p", F.lit(2), F.size("_p"))).alias("dst"))
    return edges.select(F.trim("src").alias("src"), F.trim("dst").alias("dst")).filter("src <> '' AND dst <> ''")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """mention, entity_id from ``mention, id, id ...`` lines."""
    lines = spark.read.text(path).withColumn("_p", F.split("value", "\t")).filter(F.size("_p") >= 2)
    rows = lines.select(F.get("_p", F.lit(0)).alias("mention"), F.explode(F.slice("_p", F.lit(2), F.size("_p"))).alias("entity_id"))
    return rows.filter("mention <> '' AND entity_id <> ''").distinct()


def read_ppr_candidates(spark: SparkSession, path: str) -> DataFrame:
    """mention, entity_id from a folder of ENTITY / CANDIDATE listings.

    A file is read as one record, so the ENTITY line that opens a block is found
    inside the record: the text is cut at each ENTITY mark. Hidden files are
    skipped by the reader.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    blocks = whole.select(F.explode(F.slice(F.split("value", r"(?m)^(?=ENTITY)"), 1, 2147483647)).alias("_b")).filter(F.col("_b").startswith("ENTITY"))
    mention = F.regexp_extract("_b", r"^ENTITY[^\n]*?text:([^\t\n]*)", 1)
    ids = F.regexp_extract_all("_b", F.lit(r"(?m)^CANDIDATE[^\n]*?\bid:([^\t\n]*)"), F.lit(1))
    return blocks.select(mention.alias("mention"), F.explode(ids).alias("entity_id")).filter("mention <> ''").distinct()


def read_yago_means(spark: SparkSession, path: str) -> DataFrame:
    """mention, title: quoted names lower-cased, escapes decoded, underscores as spaces."""
    lines = spark.read.text(path).withColumn("_p", F.split("value", "\t")).filter(F.size("_p") >= 2)
    quoted = F.regexp_extract(F.get("_p", F.lit(0)), '"(.*?)"', 1)
    rows = lines.select(F.lower(unescape_unicode(quoted)).alias("mention"), F.translate(unescape_unicode(F.trim(F.get("_p", F.lit(1)))), "_", " ").alias("title"))
    return rows.filter("mention <> '' AND title <> ''")


def unescape_unicode(text: Column) -> Column:
    r"""Decode ``\uXXXX`` escapes.

    The text is cut in front of each escape; a piece that starts with one gets
    its first six characters replaced.
    """
    pieces = F.split(text, r"(?=\\u[0-9a-fA-F]{4})")
    decoded = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^\\u[0-9a-fA-F]{4}"),
            F.concat(F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"), F.substring(p, F.lit(7), F.length(p))),
        ).otherwise(p),
    )
    return F.array_join(decoded, "")
