"""Parquet and delimited tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelink.operators.features import COLUMNS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than cores before heavy text work.

    A large input has many more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema="item string, cn bigint").filter("item is not null")


def read_embeddings(spark: SparkSession, path: str, space: str | None = None) -> DataFrame:
    """Vectors of one space, without rows that hold NaN or an infinite centre."""
    table = spark.read.parquet(path)
    if space is not None:
        table = table.filter(F.col("space") == space)
    sound = ~F.exists("vec", lambda x: F.isnan(x))
    if "mu" in table.columns:
        infinite = F.exists("mu", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        sound = sound & ~F.coalesce(infinite, F.lit(False))
    return table.filter(sound)


# Feature columns that are not doubles.
_LONGS = {"doc_id", "mention_id", "cand_size"} | {c for c in COLUMNS if "rank" in c}
_STRINGS = {"wiki_id", "cand_id"}


def feature_schema() -> T.StructType:
    kinds = {c: T.LongType() if c in _LONGS else T.StringType() if c in _STRINGS else T.DoubleType() for c in COLUMNS}
    return T.StructType([T.StructField(c, kinds[c]) for c in COLUMNS])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Headerless feature rows, missing numbers read as 0."""
    numbers = [c for c in COLUMNS if c not in _STRINGS]
    return spark.read.csv(path, schema=feature_schema()).fillna(0, subset=numbers)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rows doc_id, mention_id, wiki_id, cand_id, score."""
    schema = "doc_id bigint, mention_id bigint, wiki_id string, cand_id string, score double"
    return spark.read.csv(path, schema=schema).fillna(0, subset=["score"])
