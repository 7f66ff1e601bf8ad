"""Writers. All of them are plain Spark writes; nothing passes the driver."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LINE = 10


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated dictionary: titles, ignored titles, redirects, lower map."""
    df.write.mode(mode).csv(path, sep="\t", quote="", escape="", emptyValue="")


def write_linked_text(lines: DataFrame, path: str, column: str = "linked") -> None:
    """Text lines of at least ten characters; ``plain`` gives the plain corpus."""
    lines.filter(F.length(column) >= MIN_LINE).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def ragged_lines(df: DataFrame, head: list[str], part, per_line: int | None = None) -> DataFrame:
    """``head`` columns and parts joined by tabs: one line for each head, as long as it may be.

    With ``per_line`` longer lists continue on further lines with the same head,
    which the readers here add up again. The number of lines of a head is known from its count, and
    parts are dealt to them by hash, so a head with very many parts is many bounded groups.
    """
    if per_line is None:
        grouped = df.withColumn("_part", part).groupBy(*head).agg(F.array_sort(F.collect_list("_part")).alias("_all"))
        return grouped.select(F.concat_ws("\t", *head, F.array_join("_all", "\t")).alias("value"))
    sizes = df.groupBy(*head).agg(F.ceil(F.count(F.lit(1)) / per_line).alias("_lines"))
    parts = df.withColumn("_part", part).join(sizes, head).withColumn("_line", F.pmod(F.xxhash64("_part"), F.col("_lines")))
    grouped = parts.groupBy(*head, "_line").agg(F.array_sort(F.collect_list("_part")).alias("_all"))
    return grouped.select(F.concat_ws("\t", *head, F.array_join("_all", "\t")).alias("value"))


def write_mention_counts(counts: DataFrame, path: str, per_line: int | None = None) -> None:
    part = F.concat(F.col("label"), F.lit("::="), F.col("n").cast("string"))
    shaped = counts.withColumn("entity_id", F.col("entity_id").cast("string"))
    ragged_lines(shaped, ["entity_id", "title"], part, per_line).write.mode("overwrite").text(path)


def write_candidates(candidates: DataFrame, path: str, min_length: int = 2, per_line: int | None = None) -> int:
    """``mention, id ...`` lines of mentions with at least two characters; returns the pairs written."""
    kept = candidates.filter((F.length("mention") >= min_length) & F.col("entity_id").isNotNull()).distinct()
    ragged_lines(kept, ["mention"], F.col("entity_id").cast("string"), per_line).write.mode("overwrite").text(path)
    return kept.count()


def write_mention_names(names: DataFrame, path: str) -> int:
    return write_candidates(names, path, min_length=1)


def write_outlinks(links: DataFrame, path: str, per_line: int | None = None) -> None:
    ragged_lines(links, ["src"], F.col("dst"), per_line).write.mode("overwrite").text(path)


def write_embeddings(params: DataFrame, path: str, epoch: int) -> None:
    """A snapshot under its epoch; centres that are still sums are divided by their size."""
    shaped = params
    if {"mu_sum", "cluster_size"} <= set(params.columns):
        mean = F.transform("mu_sum", lambda x: x / F.col("cluster_size"))
        shaped = params.withColumn("mu", F.when(F.col("cluster_size") > 0, mean)).drop("mu_sum")
    shaped.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def append_rows(rows: DataFrame, path: str) -> None:
    """Feature rows, predictions or answers, appended as headerless CSV."""
    rows.write.mode("append").csv(path)


def write_metrics(report: DataFrame, path: str, run: str) -> None:
    """One report row per run."""
    report.withColumn("run", F.lit(run)).write.mode("append").json(path)


def save_prior(prior: DataFrame, path: str) -> None:
    prior.select("entity_id", "pe").write.mode("overwrite").csv(path, sep="\t")


def write_bounded(lines: DataFrame, path: str, max_bytes: int = 1 << 20, compress: bool = False, column: str | None = None) -> None:
    """Text files of at most ``max_bytes`` bytes before compression, bzip2-compressed on request.

    ``column`` (default: the first one) holds the lines; null is an empty line, and a line longer than the bound
    has a file to itself. Each task packs its lines in their order into rows as long as a file may be, and every row
    becomes a file: no shuffle, and a task holds one file's text.
    """
    packed = lines.select(F.coalesce(F.col(column or f"`{lines.columns[0]}`"), F.lit("")).alias("value")).mapInArrow(_packer(max_bytes), "value string")
    writer = packed.write.mode("overwrite").option("maxRecordsPerFile", 1)
    (writer.option("compression", "bzip2") if compress else writer).text(path)


def _packer(max_bytes: int):
    """Joins lines while their bytes, line ends included, stay within ``max_bytes``."""

    def joined(parts: list[pa.Array]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(["\n".join(line for part in parts for line in part.to_pylist())])], names=["value"])

    def pack(batches):
        parts, held = [], 0
        for batch in batches:
            values = batch.column(0)
            ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = before = 0
            while at < len(values):
                end = int(np.searchsorted(ends, before + max_bytes - held, "right"))
                if end <= at and not held:
                    end = at + 1
                if end > at:
                    parts.append(values.slice(at, end - at))
                    held += int(ends[end - 1]) - before
                    at, before = end, int(ends[end - 1])
                if at < len(values):
                    yield joined(parts)
                    parts, held = [], 0
        if parts:
            yield joined(parts)

    return pack
