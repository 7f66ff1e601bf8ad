"""URL filters as a sort-merge range join: intervals of reversed hosts, swept with a stack of nested rules.

The key of a host is its labels from the last to the first, each closed by a dot
(``blog.example.com`` is ``com.example.blog.``), so a rule for a host and its
subdomains is the interval of all keys that begin with its own. Such intervals
nest or are disjoint. Rules and URLs are sorted by key together; on the way the
window keeps, for every nesting depth, the last interval opened there: a stack.
A URL takes the longest rule of the open intervals whose path begins its own.

Everything is DataFrame expressions. The sweep runs in cells. A cell is a range
of keys (cut where ``rules_per_cell`` interval borders are reached) and a share of
the URLs in it, so a host with a third of all URLs spreads over many cells. Each
cell gets its range's borders and starts with the stack as it stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorelink.operators.skew import fits_broadcast
from lorelink.session import cut_lineage

RULES_PER_CELL = 5_000
URLS_PER_CELL = 200_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _borders(rules: DataFrame) -> DataFrame:
    """(key, closes, depth, rules): where intervals open and close, with the nesting depth and the rules opened.

    An interval ends before the first key that does not begin with its own: the final
    dot becomes the next character, a slash.
    """
    clean = rules.select(
        F.lower(F.trim("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host is not null and host != ''").distinct()
    hosts = clean.withColumn("key", host_key(F.col("host"))).groupBy("key").agg(
        F.collect_list(F.struct("path", "host", "verdict", F.concat("host", "path").alias("rule"))).alias("rules")
    )
    opens = hosts.select("key", F.lit(0).alias("closes"), F.lit(1).alias("step"), "rules")
    ends = hosts.select(
        F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(-1).alias("closes"), F.lit(-1).alias("step"),
        F.lit(None).cast(hosts.schema["rules"].dataType).alias("rules"),
    )
    # Nested intervals share their first label, so depths are counted label by label.
    first = F.substring_index(F.translate("key", "/", "."), ".", 1)
    order = W.partitionBy(first).orderBy("key", "closes", "step").rowsBetween(W.unboundedPreceding, 0)
    both = opens.unionByName(ends)
    return both.withColumn("depth", F.sum("step").over(order).cast("int"))


def judged(
    urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
    rules_per_cell: int = RULES_PER_CELL, urls_per_cell: int = URLS_PER_CELL,
) -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``.

    ``rules`` has (host, path, verdict); a null path fits all paths, rules without host
    are ignored, of equal rules one counts. The longest fitting rule wins (host and path
    together, then the longer host, then the text and the verdict in order). URLs that no rule
    fits, null ones and ones without ``://`` have a null rule and the verdict ``default``.
    Repeated rows stay; an empty table on either side is fine; columns of ``urls`` with the new names give way.
    """
    added = ["host", "path", "rule", "verdict"]
    rest = [c for c in urls.columns if c not in added]
    borders = cut_lineage(_borders(rules))
    depth = borders.agg(F.max("depth")).first()[0] or 0
    # Rows are dealt to cells by their place in the input, so equal URLs spread too.
    parsed = urls.select(*rest, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not depth:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    # Ranges: every rules_per_cell-th border begins one. Their number is borders / rules_per_cell.
    first = F.substring_index(F.translate("key", "/", "."), ".", 1)
    count = borders.groupBy(first.alias("_first")).agg(F.count(F.lit(1)).alias("_n"))
    many = count.agg(F.max("_n"), F.sum("_n")).first()
    numbered = borders.withColumn("_label", first)
    place = F.row_number().over(W.partitionBy("_label").orderBy("key", "closes", "step"))
    numbered = numbered.withColumn("_at", F.floor((place - 1) / rules_per_cell).cast("int"))
    stack = [f"_slot{d}" for d in range(1, depth + 1)]
    sweep = W.partitionBy("_label").orderBy("key", "closes", "step").rowsBetween(W.unboundedPreceding, 0)

    def stacked(df: DataFrame, over, mark: Column) -> DataFrame:
        """Per depth the last interval opened; slots deeper than the present depth are closed."""
        df = df.withColumn("_depth", F.last("depth", ignorenulls=True).over(over))
        slots = {
            s: F.when(F.col("_depth") >= d, F.last(F.when(mark & (F.col("depth") == d) & F.col("rules").isNotNull(), F.col("rules")), ignorenulls=True).over(over))
            for d, s in enumerate(stack, 1)
        }
        return df.withColumns(slots)

    label = F.when(F.col("host") == "", "").otherwise(F.element_at(F.split("host", r"\."), -1))
    keyed = parsed.withColumns({"_key": host_key(F.col("host")), "_label": label, "_place": F.monotonically_increasing_id()})
    if many[0] <= rules_per_cell:
        # One range per first label.
        events = numbered.select("_label", F.lit(0).alias("_range"), "key", "closes", "step", "depth", "rules")
        ranged = keyed.withColumn("_range", F.lit(0))
    else:
        starts = numbered.groupBy("_label", "_at").agg(F.min("key").alias("_from")).filter("_at > 0")
        froms = starts.groupBy("_label").agg(F.sort_array(F.collect_set("_from")).alias("_froms"))
        small = fits_broadcast(froms, 64 + 64 * (many[0] // rules_per_cell + 1))
        side = F.broadcast(froms) if small else froms
        at = F.coalesce(F.size(F.filter("_froms", lambda f: f <= F.col("_key"))), F.lit(0))
        ranged = keyed.join(side, "_label", "left").withColumn("_range", F.when(F.col("_froms").isNull(), 0).otherwise(at)).drop("_froms")
        placed = numbered.join(side, "_label", "left").withColumn(
            "_range", F.when(F.col("_froms").isNull(), 0).otherwise(F.coalesce(F.size(F.filter("_froms", lambda f: f <= F.col("key"))), F.lit(0)))
        )
        # What is open at the end of a range opens the next one again.
        swept = stacked(placed, sweep, F.lit(True))
        last = W.partitionBy("_label", "_range").orderBy(F.desc("key"), F.desc("closes"), F.desc("step"))
        ends = swept.withColumn("_r", F.row_number().over(last)).filter("_r = 1")
        again = ends.select(
            "_label", (F.col("_range") + 1).alias("_range"), F.posexplode(F.array(*stack)).alias("_pos", "rules")
        ).filter("rules is not null").select(
            "_label", "_range", F.lit("").alias("key"), F.lit(0).alias("closes"), (F.col("_pos") + 1).alias("step"),
            (F.col("_pos") + 1).cast("int").alias("depth"), "rules",
        )
        events = placed.select("_label", "_range", "key", "closes", "step", "depth", "rules").unionByName(again)

    # Cells: a range with many URLs is swept in shares. Ranges without rules need no sweep.
    cells = cut_lineage(ranged.groupBy("_label", "_range").agg(F.count(F.lit(1)).alias("_n")).join(events.select("_label", "_range").distinct(), ["_label", "_range"]))
    cells = cells.select("_label", "_range", F.ceil(F.col("_n") / urls_per_cell).cast("int").alias("_cells"))
    side = F.broadcast(cells) if fits_broadcast(cells, 64) else cells
    kinds = {f.name: f.dataType for f in events.schema.fields}
    data = ranged.join(side, ["_label", "_range"], "left").select(
        "_label", "_range", F.pmod(F.xxhash64("_place"), F.coalesce("_cells", F.lit(1))).cast("int").alias("_cell"), F.col("_key").alias("key"),
        F.lit(1).alias("closes"), F.lit(0).alias("step"), F.lit(None).cast(kinds["depth"]).alias("depth"), F.lit(None).cast(kinds["rules"]).alias("rules"),
        F.struct(*rest, "host", "path").alias("_row"), F.col("_cells").isNull().alias("_free"),
    )
    marks = events.join(side, ["_label", "_range"]).select(
        "_label", "_range", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("_cell"), "key", "closes", "step", "depth", "rules",
        F.lit(None).cast(data.schema["_row"].dataType).alias("_row"), F.lit(False).alias("_free"),
    )
    # A border at a key comes before the URLs of the key: closing ones lie beyond all keys they hold.
    over = W.partitionBy("_label", "_range", "_cell").orderBy("key", "closes", "step").rowsBetween(W.unboundedPreceding, 0)
    out = stacked(data.filter("not _free").unionByName(marks), over, F.lit(True)).filter("_row is not null")
    path = F.col("_row.path")
    open_ = F.flatten(F.array_compact(F.array(*stack)))
    fitting = F.filter(open_, lambda r: F.startswith(path, r["path"]))
    ranked = F.transform(
        fitting, lambda r: F.struct((-F.char_length(r["rule"])).alias("a"), (-F.char_length(r["host"])).alias("b"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    )
    best = F.array_min(ranked)
    swept = out.select("_row.*", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
    free = data.filter("_free").select("_row.*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return swept.unionByName(free)
