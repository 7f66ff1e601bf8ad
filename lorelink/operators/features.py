"""Disambiguation features of (mention, candidate) rows.

Everything that does not depend on where a mention stands is computed once per
(mention name, candidate) and joined to the occurrences afterwards.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.functions.text import entity_title, string_features
from lorelink.functions.vectors import clamped_cosine, vector_sum, word_codes
from lorelink.operators.pairs import around, context_vector, lookup
from lorelink.operators.skew import counted_join, fits_broadcast, hot_keys, min_rank_within, salted_join
from lorelink.operators.together import carry, mark
from lorelink.session import cut_lineage

CONTEXT_WINDOW = 5
KEYS = ["doc_id", "mention_id"]
# The feature row in its fixed column order.
BASE = ["doc_id", "mention_id", "wiki_id", "cand_id", "cand_size", "pem", "pe", "largest_pe"]
STRINGS = [f"str_sim{i}" for i in range(1, 6)]
SIMILARITIES = {**{f"esim{i}": f"erank{i}" for i in (1, 2, 3)}, **{f"csim{i}": f"crank{i}" for i in (1, 2, 3, 4, 5)}}
COLUMNS = BASE + STRINGS + [c for pair in SIMILARITIES.items() for c in pair]


@dataclass
class Vectors:
    """Lookup tables of one model: words (word, vec), titles (title, vec),
    entities (entity_id, vec), senses (entity_id, vec, mu). Absent ones are None."""

    dim: int
    words: DataFrame
    entities: DataFrame
    titles: DataFrame | None = None
    senses: DataFrame | None = None


def _documents(tokens: DataFrame) -> DataFrame:
    """doc_id, _w: the words of each document in order.

    ``tokens`` has a row per token (doc_id, pos, token), or a row per text with all of them in the array ``tokens``, which
    saves taking texts apart and putting them together again. Texts of one doc_id are merged by place.
    """
    if "tokens" not in tokens.columns:
        rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_d"))
        return rows.select("doc_id", F.col("_d.token").alias("_w"))
    placed = F.transform("_l", lambda text: F.transform(text, lambda w, i: F.struct(i.alias("pos"), w.alias("token"))))
    merged = F.transform(F.array_sort(F.flatten(placed)), lambda x: x["token"])
    lists = tokens.groupBy("doc_id").agg(F.collect_list("tokens").alias("_l"))
    return lists.select("doc_id", F.when(F.size("_l") == 1, F.get("_l", F.lit(0))).otherwise(merged).alias("_w"))


def document_contexts(tokens: DataFrame, mentions: DataFrame, window: int = CONTEXT_WINDOW) -> DataFrame:
    """doc_id, mention_id, context: words within the window of each mention, itself excluded.

    ``pos`` counts the items of a document from 0. A document is put together
    as one array, as long as the text row it came from, and windows are slices.
    """
    places = mentions.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "mention_id")).alias("_m"))
    words = _documents(tokens).join(places, "doc_id")
    near = F.transform(
        "_m", lambda m: F.struct(m["mention_id"].alias("mention_id"), around(F.col("_w"), m["pos"], m["pos"], window).alias("context"))
    )
    return words.select("doc_id", F.explode(near).alias("_n")).select("doc_id", "_n.mention_id", "_n.context")


def mention_contexts(tokens: DataFrame, mentions: DataFrame, vectors: DataFrame, dim: int, window: int = CONTEXT_WINDOW) -> DataFrame:
    """doc_id, mention_id, ctx: mean of the known word vectors around each mention."""
    if not fits_broadcast(vectors, 8 * dim + 64):
        means = context_vector(document_contexts(tokens, mentions, window), KEYS, vectors, dim)
        return means.withColumnRenamed("vec", "ctx")
    codes, means = word_codes(mentions.sparkSession, *lookup(vectors, dim))
    rows = _placed(mentions.select(*KEYS, "pos").filter("doc_id IS NOT NULL"), tokens, codes, (), "inner")
    near = F.transform("_m", lambda m: F.struct(m["mention_id"].alias("mention_id"), F.array(_near(m, window)).alias("contexts")))
    each = rows.select("doc_id", F.explode(near).alias("_n")).select("doc_id", "_n.mention_id", means("_n.contexts").alias("_means"))
    return each.select(*KEYS, F.explode("_means").alias("ctx"))


def _near(mention, window: int):
    """Items of ``_w`` around a mention."""
    at = mention["pos"].cast("int")
    return around(F.col("_w"), at, at, window)


def seen_mentions(mentions: DataFrame, tokens: DataFrame, vectors: DataFrame, dim: int, window: int = CONTEXT_WINDOW, how: str = "left",
                  documents: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``mentions`` joined (``how``: left or inner) with their ``mention_contexts``, and with each of ``documents`` (one row per doc_id).

    While the word vectors may travel, mentions wait beside the words of their document, and vectors are made and
    attached there: what is shuffled are words and names, never a vector per mention. Mentions that share their keys
    meet each other's contexts, as in a join.
    """
    if not fits_broadcast(vectors, 8 * dim + 64):
        out = mentions.join(mention_contexts(tokens, mentions, vectors, dim, window), KEYS, how)
        for table in documents:
            out = out.join(table, "doc_id", "left")
        return out
    rest = [c for c in mentions.columns if c not in KEYS]
    words, table = lookup(vectors, dim)
    codes, means = word_codes(mentions.sparkSession, words, table)
    keyed = mentions.filter("doc_id IS NOT NULL AND mention_id IS NOT NULL")
    rows = _placed(keyed, tokens, codes, documents, how)
    added = [c for table in documents for c in table.columns if c != "doc_id"]
    # Mentions of one key stand side by side: where each such stretch begins, and what it holds.
    at = lambda i: F.get("_m", i)["mention_id"]
    rows = rows.withColumn("_from", F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    same = F.transform("_from", lambda first, k: F.slice("_m", first + 1, F.coalesce(F.get("_from", k + 1), F.size("_m")) - first))
    groups = F.transform(same, lambda g: F.struct(g.alias("same"), F.transform(g, lambda m: _near(m, window)).alias("contexts")))
    parted = rows.select("doc_id", *added, F.explode(groups).alias("_g")).select("doc_id", *added, "_g.same", "_g.contexts")
    found = parted.select("doc_id", *added, "same", means("contexts").alias("_means"))
    each = (F.explode_outer if how == "left" else F.explode)("_means")
    out = found.select("doc_id", *added, "same", each.alias("ctx")).select("doc_id", *added, "ctx", F.explode("same").alias("_o"))
    columns = [*mentions.columns, "ctx", *added]
    out = out.select(*[F.col(f"_o.{c}") if c in ("mention_id", *rest) else F.col(c) for c in columns])
    if how != "left":
        return mark(out, KEYS)
    lone = _lone(mentions)
    if lone.isEmpty():
        return mark(out, KEYS)
    # Keys that are null meet no context.
    lone = lone.withColumn("ctx", F.lit(None).cast("array<double>"))
    for table in documents:
        lone = lone.join(table, "doc_id", "left")
    return out.unionByName(lone.select(*columns))


def _lone(mentions: DataFrame) -> DataFrame:
    """Mentions whose keys are null."""
    return mentions.filter("doc_id IS NULL OR mention_id IS NULL")


def _placed(mentions: DataFrame, tokens: DataFrame, codes, documents: tuple[DataFrame, ...], how: str) -> DataFrame:
    """doc_id, _m, _w and the columns of ``documents``: one row per document with its mentions in order and its words as ``codes``.

    Codes instead of words are shuffled. They sort as their words do, so that texts of one doc_id merge as before.
    """
    own = F.struct("mention_id", *[c for c in mentions.columns if c not in KEYS])
    listed = mentions.repartition("doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("_m"))
    known = tokens.filter("doc_id IS NOT NULL")
    if "tokens" in tokens.columns:
        words = _documents(known.select("doc_id", codes("tokens").alias("tokens")).repartition("doc_id"))
    else:
        words = _documents(known).select("doc_id", codes("_w").alias("_w"))
    rows = listed.join(words, "doc_id", how)
    for table in documents:
        rows = rows.join(table, "doc_id", "left")
    return rows


def candidate_table(candidates: DataFrame, titles: DataFrame, priors: DataFrame, entity_priors: DataFrame, model: Vectors) -> DataFrame:
    """One row per (mention, cand_id) with sizes, priors, string and embedding features."""
    sizes = candidates.groupBy("mention").agg(F.count(F.lit(1)).alias("cand_size"))
    pem = priors.select("mention", F.col("entity_id").alias("cand_id"), "pem")
    pe = entity_priors.select(F.col("entity_id").alias("cand_id"), "pe")
    label = titles.select(F.col("entity_id").alias("cand_id"), F.col("title").alias("_label"))
    rows = (
        candidates.select("mention", F.col("entity_id").alias("cand_id"))
        .join(sizes, "mention")
        .join(pem, ["mention", "cand_id"], "left")
        .join(pe, "cand_id", "left")
        .join(label, "cand_id")
        .join(model.words.select(F.col("word").alias("mention"), F.col("vec").alias("_word")), "mention", "left")
        .join(model.entities.select(F.col("entity_id").alias("cand_id"), F.col("vec").alias("_entity")), "cand_id", "left")
        .withColumn("_title_text", entity_title(F.col("_label")))
    )
    if model.titles is not None:
        rows = rows.join(model.titles.select(F.col("title").alias("_title_text"), F.col("vec").alias("_title")), "_title_text", "left")
    if model.senses is not None:
        rows = rows.join(
            model.senses.select(F.col("entity_id").alias("cand_id"), F.col("vec").alias("_sense"), F.col("mu").alias("_mu")), "cand_id", "left"
        )
    nothing = F.lit(0.0)
    return rows.select(
        "mention",
        "cand_id",
        F.col("_title_text").alias("title_text"),
        "cand_size",
        F.coalesce("pem", nothing).alias("pem"),
        F.coalesce("pe", nothing).alias("pe"),
        *string_features(F.col("mention"), F.col("_title_text")),
        clamped_cosine("_word", "_entity").alias("esim1"),
        (clamped_cosine("_title", "_entity") if model.titles is not None else nothing).alias("esim2"),
        (clamped_cosine("_word", "_sense") if model.senses is not None else nothing).alias("esim3"),
        F.col("_entity").alias("entity_vec"),
        (F.col("_sense") if model.senses is not None else F.lit(None).cast("array<double>")).alias("sense_vec"),
        (F.col("_mu") if model.senses is not None else F.lit(None).cast("array<double>")).alias("sense_mu"),
    )


def candidate_rows(mentions: DataFrame, table: DataFrame, dim: int = 0, vectors: int = 3, named: DataFrame | None = None) -> DataFrame:
    """Every mention occurrence with its candidates; ``dim`` and ``vectors`` are the size and number of the table's vectors.

    Of a table too large to travel, the rows whose names occur may still be few enough. ``named`` has these names where
    ``mentions`` is more than a table to be read.
    """
    row_bytes = 8 * vectors * dim + 512
    if fits_broadcast(table, row_bytes):
        return carry(mentions.join(F.broadcast(table), ["mention"]), mentions)
    counted = (mentions if named is None else named).groupBy("mention").agg(F.count(F.lit(1)).alias("_n"))
    table = occurring(table, counted)
    if fits_broadcast(table, row_bytes):
        return carry(mentions.join(F.broadcast(table), ["mention"]), mentions)
    return salted_join(mentions, table, ["mention"], hot_keys(counted, ["mention"], "_n"))


def occurring(table: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``table`` with a mention in ``names``, written once."""
    return cut_lineage(table.join(names.select("mention").distinct(), "mention", "left_semi").select(*table.columns))


def largest_prior(mentions: DataFrame, table: DataFrame) -> DataFrame:
    """Largest pe among all candidates of a document."""
    tops = table.groupBy("mention").agg(F.max("pe").alias("_pe"))
    named = mentions.select("doc_id", "mention").distinct()
    return named.join(tops, "mention").groupBy("doc_id").agg(F.max("_pe").alias("largest_pe"))


def unambiguous_entities(mentions: DataFrame, table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """doc_id, entity_id, n: near-certain candidates of each document and how often they occur."""
    sure = table.filter(F.col("pem") > threshold).select("mention", F.col("cand_id").alias("entity_id"))
    named = mentions.groupBy("doc_id", "mention").agg(F.count(F.lit(1)).alias("n"))
    return named.join(sure, "mention").groupBy("doc_id", "entity_id").agg(F.sum("n").alias("n"))


def coherence_vectors(context_entities: DataFrame, vectors: DataFrame, dim: int, name: str, mean: bool = True) -> DataFrame:
    """doc_id and the mean (or sum) of the vectors of its context entities.

    While the vectors may travel, they meet the entities where those of a document are, and sums need no further shuffle.
    """
    known = vectors.select("entity_id", "vec")
    if fits_broadcast(known, 8 * dim + 64):
        met = context_entities.repartition("doc_id").join(F.broadcast(known), "entity_id")
    else:
        met = counted_join(context_entities, known, ["entity_id"])
    weighted = met.select(
        "doc_id", "n", F.transform("vec", lambda x: x.cast("double") * F.col("n")).alias("vec")
    )
    summed = vector_sum(weighted, ["doc_id"], "vec", dim, F.sum("n").alias("_total"))
    scaled = F.transform("vec_sum", lambda x: x / F.col("_total")) if mean else F.col("vec_sum")
    return summed.select("doc_id", scaled.alias(name))


def features(mentions: DataFrame, tokens: DataFrame, table: DataFrame, model: Vectors, context_entities: DataFrame | None = None,
             window: int = CONTEXT_WINDOW, threshold: float = 0.95, coherence_mean: bool = True) -> DataFrame:
    """Feature rows in the fixed column order.

    ``mentions`` has doc_id, mention_id, pos, mention, wiki_id. Context entities
    default to the near-certain candidates of the document; a second pass gives
    the predictions of the first (doc_id, entity_id, n).
    """
    if context_entities is None:
        context_entities = unambiguous_entities(mentions, table, threshold)
    whole = [largest_prior(mentions, table), coherence_vectors(context_entities, model.entities, model.dim, "_coh", coherence_mean)]
    if model.senses is not None:
        whole.append(coherence_vectors(context_entities, model.senses, model.dim, "_coh_sense", coherence_mean))
    seen = seen_mentions(mentions, tokens, model.words, model.dim, window, documents=tuple(whole))
    if model.senses is None:
        seen = carry(seen.withColumn("_coh_sense", F.lit(None).cast("array<double>")), seen)
    rows = candidate_rows(seen, table, model.dim, named=mentions)
    scored = rows.select(
        *BASE, *STRINGS, "esim1", "esim2", "esim3",
        clamped_cosine("ctx", "entity_vec").alias("csim1"),
        clamped_cosine("_coh", "entity_vec").alias("csim2"),
        clamped_cosine("ctx", "sense_vec").alias("csim3"),
        clamped_cosine("ctx", "sense_mu").alias("csim4"),
        clamped_cosine("_coh_sense", "sense_vec").alias("csim5"),
    )
    ranked = rank_features(carry(scored, rows), _largest(table))
    return carry(ranked.select(*COLUMNS), ranked)


def _largest(table: DataFrame) -> int:
    """Candidates of the mention that has most; 0 for an empty table."""
    return table.agg(F.max("cand_size")).first()[0] or 0


def rank_features(scored: DataFrame, largest: int | None = None, digits: int = 6) -> DataFrame:
    """Min-rank of each similarity within its mention; similarities are rounded first."""
    rounded = scored.select(
        *[F.round(c, digits).alias(c) if c in SIMILARITIES else F.col(c) for c in scored.columns]
    )
    return min_rank_within(carry(rounded, scored), KEYS, "cand_id", SIMILARITIES, "cand_size", largest)


def _vectors_by_candidate(table: DataFrame, dim: int) -> DataFrame | None:
    """cand_id, entity_vec, if every candidate has one vector (or none) in all its rows and these may travel."""
    found = table.groupBy("cand_id").agg(
        F.min("entity_vec").alias("entity_vec"), F.max("entity_vec").alias("_last"), F.count("entity_vec").alias("_n"), F.count(F.lit(1)).alias("_all")
    )
    mixed = found.filter(~F.col("entity_vec").eqNullSafe(F.col("_last")) | ((F.col("_n") > 0) & (F.col("_n") < F.col("_all"))))
    vectors = found.select("cand_id", "entity_vec")
    return vectors if fits_broadcast(vectors, 8 * dim + 64) and mixed.isEmpty() else None


# The single-prototype row: similarity columns and their ranks.
SINGLE = {f"csim{i}": f"crank{i}" for i in (1, 2, 3, 4, 5, 6)}


def features_single_prototype(mentions: DataFrame, table: DataFrame, model: Vectors, context_entities: DataFrame | None = None,
                              threshold: float = 0.9) -> DataFrame:
    """Variant with word-entity, word-title and summed document coherence.

    csim3 to csim5 have no source in a single-prototype model: constant 0, rank 1.
    """
    if context_entities is None:
        context_entities = unambiguous_entities(mentions, table, threshold)
    titles = model.titles.select(F.col("title").alias("title_text"), F.col("vec").alias("_title"))
    words = model.words.select(F.col("word").alias("mention"), F.col("vec").alias("_word"))
    # Sense vectors take no part here.
    own = table.drop("sense_vec", "sense_mu").join(words, "mention", "left").join(titles, "title_text", "left")
    own = own.withColumn("csim1", F.col("esim1")).withColumn("csim2", clamped_cosine("_word", "_title")).drop("_word", "_title")
    own = cut_lineage(own)
    seen = mentions.join(largest_prior(mentions, table), "doc_id", "left")
    coherence = coherence_vectors(context_entities, model.entities, model.dim, "_coh", mean=False)
    vectors = None if fits_broadcast(own, 8 * model.dim + 512) else _vectors_by_candidate(own, model.dim)
    if vectors is None:
        rows = candidate_rows(seen.join(coherence, "doc_id", "left"), own, model.dim, vectors=1)
    else:
        # Beyond the table that may travel no vector goes through the join by mention.
        rows = candidate_rows(seen, own.drop("entity_vec")).join(coherence, "doc_id", "left").join(F.broadcast(vectors), "cand_id", "left")
    scored = rows.select(
        *BASE, *STRINGS,
        F.round("csim1", 6).alias("csim1"), F.round("csim2", 6).alias("csim2"),
        *[F.lit(0.0).alias(f"csim{i}") for i in (3, 4, 5)],
        F.round(clamped_cosine("_coh", "entity_vec"), 6).alias("csim6"),
    )
    varying = {k: v for k, v in SINGLE.items() if k in ("csim1", "csim2", "csim6")}
    ranked = min_rank_within(scored, KEYS, "cand_id", varying, "cand_size", _largest(table))
    for i in (3, 4, 5):
        ranked = ranked.withColumn(f"crank{i}", F.lit(1).cast("long"))
    return ranked.select(*BASE, *STRINGS, *[c for pair in SINGLE.items() for c in pair])


def missing_log(mentions: DataFrame, candidates: DataFrame, priors: DataFrame, entity_priors: DataFrame) -> DataFrame:
    """Audit rows (reason, name, n): mentions without candidates, names and entities without a prior."""
    counted = mentions.groupBy("mention").agg(F.count(F.lit(1)).alias("n"))
    names = candidates.select("mention").distinct()
    no_candidates = counted.join(names, "mention", "left_anti").select(F.lit("mention without candidates").alias("reason"), F.col("mention").alias("name"), "n")
    offered = counted.join(names, "mention", "left_semi")
    no_prior = offered.join(priors.select("mention").distinct(), "mention", "left_anti").select(
        F.lit("name without prior").alias("reason"), F.col("mention").alias("name"), "n"
    )
    entities = candidates.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).join(entity_priors.select("entity_id"), "entity_id", "left_anti")
    return no_candidates.unionByName(no_prior).unionByName(
        entities.select(F.lit("entity without prior").alias("reason"), F.col("entity_id").cast("string").alias("name"), "n")
    )
