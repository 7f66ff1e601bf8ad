"""Wiki dumps: pages, site information, redirects."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of templates and modules.
TEMPLATE_NS, MODULE_NS = 10, 828
_PAGE = (
    "title string, ns int, id bigint, redirect struct<_title:string>, "
    "revision struct<id:bigint, text:struct<_VALUE:string>>"
)
_SITE = "base string, sitename string, namespaces struct<namespace:array<struct<_VALUE:string, _key:int>>>"


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, ns, text, is_redirect; of a repeated page id the first row in the file is kept."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path)
    rows = pages.select(
        F.col("id").alias("page_id"),
        "title",
        F.coalesce("ns", F.lit(0)).alias("ns"),
        F.coalesce(F.col("revision.text._VALUE"), F.lit("")).alias("text"),
        F.col("redirect").isNotNull().alias("is_redirect"),
        F.monotonically_increasing_id().alias("_place"),
    )
    rest = ["title", "ns", "text", "is_redirect"]
    return rows.groupBy("page_id").agg(F.min_by(F.struct(*rest), "_place").alias("_first")).select("page_id", *[F.col(f"_first.{c}").alias(c) for c in rest])


def read_siteinfo(spark: SparkSession, path: str) -> DataFrame:
    """base, ns, name: one row per namespace of the site."""
    site = spark.read.format("xml").option("rowTag", "siteinfo").schema(_SITE).load(path)
    spaces = site.select("base", F.explode("namespaces.namespace").alias("_n"))
    return spaces.select("base", F.col("_n._key").alias("ns"), F.coalesce(F.col("_n._VALUE"), F.lit("")).alias("name"))


def url_base(siteinfo: DataFrame) -> Column:
    """The site address without its last path part."""
    return F.regexp_replace(F.first("base"), "/[^/]*$", "")


def article_pages(pages: DataFrame) -> DataFrame:
    """Content pages: no redirects, no templates or modules."""
    return pages.filter(~F.col("is_redirect") & ~F.col("ns").isin(TEMPLATE_NS, MODULE_NS))


def template_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("ns").isin(TEMPLATE_NS, MODULE_NS))


def page_redirects(pages: DataFrame) -> DataFrame:
    """redirect_id, alias, title from bodies that open with a redirect mark."""
    target = F.regexp_extract("text", r"(?i)^\s*#redirect\s*:?\s*\[\[([^\]|#]*)", 1)
    return pages.select(F.col("page_id").alias("redirect_id"), F.col("title").alias("alias"), F.trim(target).alias("title")).filter("title <> ''")
