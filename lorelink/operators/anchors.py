"""Anchors, outlinks and mention statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.functions.links import link_label, link_segments, link_title
from lorelink.functions.text import entity_title, normalize_phrase
from lorelink.operators.dictionary import resolve_names, resolve_title

HTML_ANCHOR = r'<a href="/([^"]*)">([^<]*)</a>'
MIN_LABEL_COUNT = 5


def extract_html_anchors(pages: DataFrame) -> DataFrame:
    """Site-local anchors of HTML pages in order: page_id, pos (from 1), title, label."""
    found = F.regexp_extract_all("html", F.lit(HTML_ANCHOR), F.lit(0))
    return pages.select("page_id", F.posexplode(found).alias("_at", "_a")).select(
        "page_id",
        (F.col("_at") + 1).cast("long").alias("pos"),
        F.regexp_extract("_a", HTML_ANCHOR, 1).alias("title"),
        F.regexp_extract("_a", HTML_ANCHOR, 2).alias("label"),
    )


def segments(lines: DataFrame, text: str = "line") -> DataFrame:
    """One row per piece of a line, links with their title and label."""
    kept = [c for c in lines.columns if c != text]
    cut = lines.select(*kept, F.posexplode(link_segments(F.trim(text))).alias("seg_no", "_s"))
    link = F.col("_s.is_link")
    return cut.select(
        *kept,
        "seg_no",
        link.alias("is_link"),
        F.col("_s.text").alias("text"),
        F.when(link, link_title(F.col("_s.text"))).alias("title"),
        F.when(link, link_label(F.col("_s.text"))).alias("label"),
    )


def extract_anchors(lines: DataFrame, text: str = "line") -> DataFrame:
    """Balanced wiki links of each line with title and label."""
    return segments(lines, text).filter("is_link").drop("is_link", "text")


def resolve_anchors(anchors: DataFrame, titles: DataFrame, redirects: DataFrame, lower_map: DataFrame) -> DataFrame:
    """Add ``resolved`` and the rewritten anchor text; unresolved anchors become their label."""
    done = resolve_title(anchors, "title", titles, redirects, lower_map)
    bare = F.concat(F.lit("[["), F.col("resolved"), F.lit("]]"))
    full = F.concat(F.lit("[["), F.col("resolved"), F.lit("|"), F.col("label"), F.lit("]]"))
    return done.withColumn(
        "rewritten", F.when(F.col("resolved").isNull(), F.col("label")).when(F.col("resolved") == F.col("label"), bare).otherwise(full)
    )


def rebuild_lines(pieces: DataFrame, keys: list[str], titles: DataFrame, redirects: DataFrame, lower_map: DataFrame) -> DataFrame:
    """Lines put together again: ``linked`` with rewritten anchors, ``plain`` with labels.

    ``pieces`` comes from ``segments``. The pieces of one line are regrouped,
    never more than the line they were cut from.
    """
    solved = resolve_anchors(pieces.filter("is_link"), titles, redirects, lower_map)
    links = solved.select(*keys, "seg_no", F.col("rewritten").alias("linked"), F.col("label").alias("plain"))
    texts = pieces.filter("not is_link").select(*keys, "seg_no", F.col("text").alias("linked"), F.col("text").alias("plain"))
    joined = links.unionByName(texts).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg_no", "linked", "plain"))).alias("_p"))
    return joined.select(
        *keys, F.array_join("_p.linked", "").alias("linked"), F.array_join("_p.plain", "").alias("plain")
    )


def mention_counts(anchors: DataFrame, titles: DataFrame, redirects: DataFrame, lower_map: DataFrame) -> DataFrame:
    """entity_id, title, label, n over the resolved anchors.

    Counted before resolving: the dictionary joins see distinct (title, label)
    pairs only.
    """
    counted = anchors.groupBy("title", "label").agg(F.count(F.lit(1)).alias("_n"))
    names = counted.select("title").distinct()
    mapped = resolve_names(names, "title", titles, redirects, lower_map).filter("resolved is not null")
    return (
        counted.join(mapped, "title")
        .groupBy(F.col("resolved").alias("title"), "label")
        .agg(F.sum("_n").alias("n"))
        .join(titles, "title")
        .select("entity_id", "title", "label", "n")
    )


def page_outlinks(anchors: DataFrame, page: str = "page_id") -> DataFrame:
    """Distinct non-empty link titles of each page."""
    return anchors.filter(F.col("title") != "").select(page, "title").distinct()


def clean_outlinks(edges: DataFrame, titles: DataFrame, redirects: DataFrame, lower_map: DataFrame) -> DataFrame:
    """Edges with both ends resolved; unknown heads and neighbours drop out.

    ``edges`` has src and dst names. Names are resolved once each.
    """
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    known = resolve_names(names, "name", titles, redirects, lower_map).filter("resolved is not null")
    heads = known.select(F.col("name").alias("src"), F.col("resolved").alias("_src"))
    tails = known.select(F.col("name").alias("dst"), F.col("resolved").alias("_dst"))
    return (
        edges.join(heads, "src").join(tails, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
    )


def title_mentions(titles: DataFrame, redirects: DataFrame, lower_map: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct (title, mention) from aliases, lower names and anchor labels."""
    return (
        redirects.select("title", F.col("alias").alias("mention"))
        .unionByName(lower_map.select("title", F.col("lower_title").alias("mention")))
        .unionByName(counts.select("title", F.col("label").alias("mention")))
        .join(titles.select("title"), "title", "left_semi")
        .distinct()
    )


def title_mention_sets(titles: DataFrame, redirects: DataFrame, lower_map: DataFrame, counts: DataFrame) -> DataFrame:
    """Per title: number of distinct mentions and total anchors."""
    sizes = title_mentions(titles, redirects, lower_map, counts).groupBy("title").agg(F.count(F.lit(1)).alias("mentions"))
    totals = counts.groupBy("title").agg(F.sum("n").alias("anchors"))
    return sizes.join(totals, "title", "left").select("title", "mentions", F.coalesce("anchors", F.lit(0)).alias("anchors"))


def mention_size_histogram(sets: DataFrame) -> DataFrame:
    """18 bins of ten mentions each, the last one open: mentions, anchors, titles."""
    bin_no = F.least(F.floor((F.col("mentions") - 1) / 10), F.lit(17)).cast("long")
    return sets.groupBy(bin_no.alias("bin")).agg(
        F.sum("mentions").alias("mentions"), F.sum("anchors").alias("anchors"), F.count(F.lit(1)).alias("titles")
    )


def mention_names(lower_map: DataFrame, titles: DataFrame, counts: DataFrame, min_count: int = MIN_LABEL_COUNT) -> DataFrame:
    """mention -> entity from lower names and frequent anchor labels, as distinct pairs."""
    lower = lower_map.join(titles, "title").select(F.col("lower_title").alias("mention"), "entity_id")
    labels = counts.filter(F.col("n") >= min_count).select(F.col("label").alias("mention"), "entity_id")
    return lower.unionByName(labels).distinct()


def load_mention_names(names: DataFrame, titles: DataFrame) -> DataFrame:
    """Mention names with known entities only, as titles."""
    return names.join(titles, "entity_id").select("mention", "title")


def normalized_mention_titles(lower_map: DataFrame, counts: DataFrame) -> DataFrame:
    """Normalised name -> bracket-less title from lower names and anchor labels."""
    both = lower_map.select(F.col("lower_title").alias("name"), "title").unionByName(
        counts.select(F.col("label").alias("name"), "title")
    )
    shaped = both.select(normalize_phrase(F.col("name")).alias("mention"), entity_title(F.col("title")).alias("title"))
    return shaped.filter((F.col("mention") != "") & (F.col("title") != "")).distinct()
