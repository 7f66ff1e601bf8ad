"""The registered queries of this folder and their SQL: name -> (run(spark, folder), SQL or None)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelink.llm import lm_scoring, nbest, pareto_mix, phrases, quality, repeats, runs, sign_hash, simhash, token_rollup, toxicity, url_rules, winnowing
from lorelink.llm.common import text_or_empty
from lorelink.operators.skew import fits_broadcast
from lorelink.session import cut_lineage, ensure_checkpoint_dir


TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
# What the byte-level tokenizers split texts by.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The rules of op7 (host, path, verdict) and the weights of op5.
RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]
WEIGHTS, SHARE = (5.0, 2.0, 1.0), 1.5
# Bytes of a passage that texts may share; passages of fifty words are longer.
PASSAGE = 240
# Words by which labelled toxic documents are told apart into finer categories.
INSULTS = ["idiot", "moron", "loser", "clown", "scum"]
CONTEMPT = ["stupid", "pathetic", "worthless", "disgusting", "trash"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Loss difference of every document between labelled good documents and all documents."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    good = _table(spark, folder, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    marked = docs.join(F.broadcast(good) if fits_broadcast(good, 24) else good, "doc_id", "left")
    out = lm_scoring.score_corpus(marked, "good")
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_bits", "background_bits", "difference")])


def op2_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_classes(_table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_sentencepiece_nbest(spark: SparkSession, folder: str, model: str = PIECES) -> DataFrame:
    """The four best segmentations of every document, and whether the best one decodes to its text."""
    vocab = nbest.load_vocabulary(model)
    coded = nbest.encode(_table(spark, folder, "documents").select("doc_id", "text"), vocab, carry=["doc_id", "text"])
    back = nbest.decode(coded, vocab)
    score = F.transform("scores", lambda s: F.round(s, 6))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), score.alias("scores"),
        F.transform("others", lambda path: F.aggregate(path, F.size("ids"), lambda n, c: n + F.size(c["ids"]) - c["many"])).alias("other_pieces"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edit, half of which comes from the next document."""
    return winnowing.edited_halves(_table(spark, folder, "documents").select("doc_id", "text"))


def op5_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken from every document in a mix of sources by weight, half as large again as all documents."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    goals = pareto_mix.weighted_targets(docs, WEIGHTS, SHARE)
    out = pareto_mix.mixed(docs, goals)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of insult, contempt and toxicity of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").select("doc_id", "toxic")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    named = docs.join(F.broadcast(toxic) if fits_broadcast(toxic, 16) else toxic, "doc_id").select(
        "doc_id", *[F.arrays_overlap(words, F.array(*[F.lit(w) for w in some])).cast("int").alias(n) for n, some in (("insult", INSULTS), ("contempt", CONTEMPT))]
    )
    finer = labels.join(cut_lineage(named), "doc_id", "left")
    chain = toxicity.train(docs, finer, ["insult", "contempt", "toxic"])
    out = toxicity.score(docs, chain)
    return out.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in chain.categories], "toxic")


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judged(_table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM pages),
fitting AS (
  SELECT n, arg_max({{'rule': rule_host || rule_path, 'verdict': rule_verdict}}, length(rule_host || rule_path)) AS best
  FROM parsed, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parsed LEFT JOIN fitting USING (n)
"""


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    out = quality.judged(_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PLAIN = """trim(lower(w), '.,;:!?"''()-')"""
_TERM = "(CASE WHEN {p} > 0 THEN {p} * ln({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln({q} / (({p} + {q}) / 2)) ELSE 0 END)"
_NAMES = [*quality.CLASSES, "other"]
_LEFT = ["t", *[f"left{i}" for i in range(len(quality.CLASSES))]]
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '{quality.SPACE}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
{"".join(f"cut{i} AS (SELECT *, regexp_replace({_LEFT[i]}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g') AS left{i} FROM {'words' if not i else f'cut{i - 1}'}),{chr(10)}" for i, p in enumerate(quality.CLASSES.values()))}
counted AS (SELECT *, len(ws) AS n, {", ".join(f"length({a}) - length({b}) AS c_{n}" for n, a, b in zip(quality.CLASSES, _LEFT, _LEFT[1:]))}, length({_LEFT[-1]}) AS c_other FROM cut{len(quality.CLASSES) - 1}),
shares AS (SELECT l, {", ".join(f"sum(c_{n}) / sum(length(t)) AS q_{n}" for n in _NAMES)} FROM counted GROUP BY l HAVING sum(length(t)) > 0),
plain AS (SELECT l, {_PLAIN} AS word, count(*) AS n FROM (SELECT l, unnest(ws) AS w FROM words) GROUP BY ALL),
top AS (SELECT l, word, n / every AS q FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, word) AS k FROM plain WHERE word <> '')
  JOIN (SELECT l, sum(n) AS every FROM plain GROUP BY l) USING (l) WHERE k <= {quality.Limits().common_words}),
every AS (SELECT l, sum(q) AS q FROM top GROUP BY l),
found AS (SELECT r, sum({_TERM.format(p="p", q="q")}) AS s, sum(p) AS p, sum(q) AS q FROM (
  SELECT r, count(*) / any_value(n) AS p, any_value(q) AS q FROM (SELECT r, l, n, {_PLAIN} AS word FROM (SELECT r, l, n, unnest(ws) AS w FROM counted)) JOIN top USING (l, word) GROUP BY r, word) GROUP BY r),
five AS (SELECT r, i, {" || ' ' || ".join(["w", *[f"lead(w, {k}) OVER run" for k in range(1, 5)]])} AS gram FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words) WINDOW run AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS m FROM five WHERE gram IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS place FROM grams WHERE m > 1) GROUP BY r),
measured AS (
  SELECT doc_id, c.n AS n_words, length(t) - c_space AS word_chars, c_symbol AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN length(t) >= {quality.Limits().class_chars} THEN sqrt(greatest(({" + ".join(_TERM.format(p=f"(c_{n} / length(t))", q=f"q_{n}") for n in _NAMES)}) / 2 / ln(2), 0)) END AS class_distance,
    CASE WHEN c.n >= {quality.Limits().word_words} AND every.q IS NOT NULL THEN sqrt(greatest((coalesce(s, 0) + (every.q - coalesce(found.q, 0)) * ln(2)
      + {_TERM.format(p="greatest(1 - coalesce(found.p, 0), 0)", q="greatest(1 - every.q, 0)")}) / 2 / ln(2), 0)) END AS word_distance
  FROM counted c LEFT JOIN shares USING (l) LEFT JOIN every USING (l) LEFT JOIN found USING (r) LEFT JOIN repeats USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(class_distance > {quality.Limits().class_distance}, false) AND NOT coalesce(word_distance > {quality.Limits().word_distance}, false) AS kept
FROM based
"""


def op9_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals by source, language and tokenizer after three batches, one of them sent twice.

    All documents are counted and inserted; those not in English move to the tokenizer
    for many languages; those labelled as poor are deleted.
    """
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    few, many = "byte_bpe_50k", "byte_bpe_multi_50k"
    text = F.coalesce("text", F.lit(""))
    moved = F.coalesce(F.col("lang") != "en", F.lit(True))
    counted = token_rollup.count_tokens(docs.select("doc_id", "lang", "source", "text", F.char_length(text).cast("long").alias("chars")),
                                        f"{TOKENIZERS}/{few}.tiktoken", BYTE_PATTERN, few, out="tokens")
    other = F.when(moved, F.col("text"))
    counted = token_rollup.count_tokens(counted.withColumn("text", other), f"{TOKENIZERS}/{many}.tiktoken", BYTE_PATTERN, many, out="other_tokens")
    counted = cut_lineage(counted.drop("text"))
    poor = _table(spark, folder, "labels").filter("quality = 0").select("doc_id").distinct()

    def image(name: str, tokens: str):
        return F.struct("source", "lang", F.lit(name).alias("tokenizer"), F.col(tokens).alias("tokens"), "chars")

    plain, newer = image(few, "tokens"), image(many, "other_tokens")
    nothing = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,tokens:bigint,chars:bigint>")
    ensure_checkpoint_dir(spark)
    rollup = token_rollup.Rollup(spark, f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid4().hex}")
    revised = counted.filter(moved).select(plain.alias("before"), newer.alias("after"))
    rollup.commit("1-insert", counted.select(nothing.alias("before"), plain.alias("after")))
    rollup.commit("2-revise", revised)
    rollup.commit("2-revise", revised)
    rollup.commit("3-delete", counted.join(poor, "doc_id", "left_semi").select(F.when(moved, newer).otherwise(plain).alias("before"), nothing.alias("after")))
    return rollup.totals()


def op10_suffix_array_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each text without strings of 400 bytes that occur elsewhere too, and whether it shares a passage of 240 bytes."""
    out = repeats.without_repeats(_table(spark, folder, "documents").select("doc_id", "text"), shorter=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document; a tenth of the documents, chosen by hash, end in a stretch made periodic."""
    docs = _table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("_words").cast("long")
    words = F.filter(F.split(text_or_empty(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("_words", F.when(h % 10 == 0, words))
    docs = docs.withColumns({"_a": F.when(n > 0, g % n), "_g": g})
    docs = docs.withColumn("_p", F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)) + 1)
    word = lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    ended = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    out = runs.periodic_runs(docs.select("doc_id", F.when(F.col("_a").isNotNull(), ended).otherwise(F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector among all vectors with a cosine of 0.9 or more."""
    return sign_hash.near_vectors(_table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best collocations of every language."""
    return phrases.collocations(_table(spark, folder, "documents").select("lang", "text"))


QUERIES = {
    "op1_lm_scoring": (op1_lm_scoring, None),
    "op2_simhash_near_duplicates": (op2_simhash_near_duplicates, None),
    "op3_sentencepiece_nbest": (op3_sentencepiece_nbest, None),
    "op4_winnowing": (op4_winnowing, None),
    "op5_pareto_mix": (op5_pareto_mix, None),
    "op6_toxicity_chain": (op6_toxicity_chain, None),
    "op7_url_rules": (op7_url_rules, OP7_SQL),
    "op8_quality_rules": (op8_quality_rules, OP8_SQL),
    "op9_token_rollup": (op9_token_rollup, None),
    "op10_suffix_array_repeats": (op10_suffix_array_repeats, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_embedding_near_duplicates": (op12_embedding_near_duplicates, None),
    "op13_phrase_collocations": (op13_phrase_collocations, None),
}
