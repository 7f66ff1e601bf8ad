"""The working tables of the registered queries, derived from the driver's tables.

Site-local anchors of ``pages`` give titles, redirects, lower-case names and
mention counts; lines of ``documents`` give tokens and mentions; ``embeddings``
give the vectors of the words and entities of equal frequency rank.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelink.operators import anchors as A
from lorelink.operators import candidates as C
from lorelink.operators import dictionary as D
from lorelink.operators import priors as R
from lorelink.operators import vocab as V
from lorelink.operators.features import Vectors
from lorelink.operators.skew import counted_join, fits_broadcast, sequential_ids
from lorelink.session import cut_lineage
from lorelink.sources.tables import read_table, widen

DIM = 64
MIN_COUNT = 5


class Tables:
    """Derived DataFrames over one folder of parquet tables.

    Dictionaries and vocabularies are read many times per query and are far
    smaller than the text they come from, so each is written once when first
    asked for.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def pages(self) -> DataFrame:
        return widen(self.read("pages"))

    @cached_property
    def documents(self) -> DataFrame:
        return widen(self.read("documents").select("doc_id", "text"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")

    # --- names ---------------------------------------------------------------
    @cached_property
    def anchors(self) -> DataFrame:
        """Written once: every dictionary reads it, and the pages are far larger."""
        return cut_lineage(A.extract_html_anchors(self.pages))

    @cached_property
    def titles(self) -> DataFrame:
        """Link targets that do not end in punctuation."""
        first = F.min(F.col("page_id") * 1_000_000 + F.col("pos")).alias("entity_id")
        return cut_lineage(self.anchors.filter(~F.col("title").rlike("[.,]$")).groupBy("title").agg(first))

    @cached_property
    def raw_redirects(self) -> DataFrame:
        """Targets with trailing punctuation, and page headings pointing to the page's first link."""
        place = F.col("page_id") * 1_000_000 + F.col("pos")
        shorter = (
            self.anchors.filter(F.col("title").rlike("[.,]$"))
            .select(place.alias("redirect_id"), F.col("title").alias("alias"), F.regexp_replace("title", "[.,]+$", "").alias("title"))
        )
        heading = self.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("alias"))
        first = self.anchors.filter("pos = 1").select("page_id", "title")
        headed = heading.join(first, "page_id").select((F.col("page_id") * 1_000_000).alias("redirect_id"), "alias", "title")
        return shorter.unionByName(headed)

    @cached_property
    def redirects(self) -> DataFrame:
        return cut_lineage(D.clean_redirects(self.raw_redirects, self.titles))

    @cached_property
    def lower_map(self) -> DataFrame:
        return cut_lineage(D.extend_lower_map(self.titles, self.redirects))

    @cached_property
    def names(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.titles, self.redirects, self.lower_map

    @cached_property
    def counts(self) -> DataFrame:
        return cut_lineage(A.mention_counts(self.anchors, *self.names))

    @cached_property
    def priors(self) -> DataFrame:
        return cut_lineage(R.priors(self.counts))

    @cached_property
    def links(self) -> DataFrame:
        """Page heading's entity -> linked entity: both are titles after resolution."""
        first = self.anchors.filter("pos = 1").select("page_id", F.col("title").alias("src"))
        edges = self.anchors.filter("pos > 1").select("page_id", F.col("title").alias("dst")).join(first, "page_id")
        return cut_lineage(A.clean_outlinks(edges.select("src", "dst"), *self.names))

    # --- text ----------------------------------------------------------------
    @cached_property
    def tokens(self) -> DataFrame:
        return V.plain_tokens(self.documents)

    @cached_property
    def vocab(self) -> DataFrame:
        lines = self.documents.select(F.explode(F.split("text", "\n")).alias("line"))
        return cut_lineage(V.word_vocab(self.tokens, MIN_COUNT, lines))

    @cached_property
    def entity_vocab(self) -> DataFrame:
        return cut_lineage(V.entity_vocab(self.links))

    @cached_property
    def name_entity(self) -> DataFrame:
        """mention -> its most probable entity and title, for tagging text."""
        best = R.link_prior(self.priors).select("mention", "entity_id")
        return cut_lineage(best.join(self.titles, "entity_id"))

    @cached_property
    def doc_tokens(self) -> DataFrame:
        """doc_id, pos, token over the whole document."""
        from lorelink.functions.text import phrase_tokens

        cut = self.documents.select("doc_id", F.posexplode(phrase_tokens(F.col("text"))).alias("pos", "token"))
        return cut.withColumn("pos", F.col("pos").cast("long"))

    @cached_property
    def doc_words(self) -> DataFrame:
        """doc_id, tokens: the tokens of a document in one array."""
        from lorelink.functions.text import phrase_tokens

        return self.documents.select("doc_id", phrase_tokens(F.col("text")).alias("tokens"))

    @cached_property
    def mentions(self) -> DataFrame:
        """Tokens that are entity names: doc_id, mention_id (= pos), pos, mention, wiki_id.

        The gold entity is the one linked on the pages most often under the name.
        """
        gold = self.name_entity.select(F.col("mention").alias("token"), F.col("entity_id").alias("wiki_id"))
        # Names of checked size travel to the tokens, which then need no shuffle.
        found = self.doc_tokens.join(F.broadcast(gold), "token") if fits_broadcast(gold, 256) else counted_join(self.doc_tokens, gold, ["token"])
        return found.select(
            "doc_id", F.col("pos").alias("mention_id"), "pos", F.col("token").alias("mention"), "wiki_id"
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return C.wiki_candidates(self.counts, self.redirects, self.titles)

    # --- vectors -------------------------------------------------------------
    @cached_property
    def word_vectors(self) -> DataFrame:
        """word, vec: the n-th most frequent word has the n-th embedding."""
        ranked = self.vocab.filter("item_id > 0").select(F.col("item").alias("word"), (F.col("item_id") - 1).alias("vec_id"))
        return cut_lineage(ranked.join(self.embeddings, "vec_id").select("word", "vec"))

    @cached_property
    def entity_ranks(self) -> DataFrame:
        """entity_id, title and place by anchor count."""
        n = self.counts.groupBy("entity_id", "title").agg(F.sum("n").alias("n"))
        return sequential_ids(n, [F.desc("n"), F.asc("entity_id")], "place")

    @cached_property
    def entity_vectors(self) -> DataFrame:
        return self.entity_ranks.join(self.embeddings, F.col("place") == F.col("vec_id")).select("entity_id", "title", "vec", "label")

    @cached_property
    def label_means(self) -> DataFrame:
        from lorelink.functions.vectors import vector_mean

        return vector_mean(self.embeddings, ["label"], "vec", DIM).select("label", F.col("vec").alias("mu"))

    @cached_property
    def sense_vectors(self) -> DataFrame:
        """entity_id, title, vec, mu: embeddings from the end, centres by label."""
        last = self.embeddings.agg(F.max("vec_id")).scalar()
        turned = self.embeddings.withColumn("place", last - F.col("vec_id"))
        return self.entity_ranks.join(turned, "place").join(self.label_means, "label").select("entity_id", "title", "vec", "mu")

    @cached_property
    def model(self) -> Vectors:
        titles = self.entity_vectors.select("title", "entity_id").join(
            self.sense_vectors.select("entity_id", F.col("mu").alias("vec")), "entity_id"
        ).select("title", "vec")
        return Vectors(DIM, self.word_vectors, self.entity_vectors.select("entity_id", "vec"), titles,
                       self.sense_vectors.select("entity_id", "vec", "mu"))
