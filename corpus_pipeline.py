"""From raw documents to pieces: quality rules, near-duplicates, repeats, mix, segmentation.

Every stage takes what the stage before kept and returns a DataFrame; ``run``
writes it as Parquet under the shared checkpoint folder and reads it again for the
next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelink.llm import near_text, nbest, pareto_mix, quality, repeats
from lorelink.llm.queries import PASSAGE, PIECES, SHARE, WEIGHTS
from lorelink.session import cut_lineage, discard, release


def _packed(docs: DataFrame, *named: str) -> DataFrame:
    """``docs`` in one column, so that no name there meets one that a stage adds, beside the columns that the stage reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *named)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judged(_packed(docs, "text", "lang")).filter("kept").select("document.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word likeness 0.8), that with the least doc_id."""
    return near_text.one_per_class(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too; documents of which no word is left go."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]).alias("document"), "doc_id", "text")
    left = repeats.without_repeats(rows, PASSAGE, characters=True)
    texts = left.withColumn("text", F.decode("kept", "UTF-8")).withColumn("n_chars", F.char_length("text").cast("long"))
    own = {"text", "n_chars"}
    return texts.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(c) if c in own else F.col(f"document.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    goals = pareto_mix.weighted_targets(docs, WEIGHTS, SHARE)
    taken = pareto_mix.mixed(_packed(docs, "doc_id", "text", "source"), goals).filter("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("document.*")


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = PIECES) -> DataFrame:
    """Piece ids of every document, with the scores of the best segmentations and whether decoding gives the text back."""
    vocab = nbest.load_vocabulary(model)
    coded = nbest.decode(nbest.encode(docs, vocab, carry=["doc_id", "lang", "source", "text"]), vocab)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

# SimHash, repeats, the hash-ranked mix and the lattice search cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        kept = cut_lineage(stage(spark, docs, sf_dir))
        discard(docs)
        release(spark)
        docs = kept
    return docs
