"""Registered queries: text forms, dictionaries, anchors, priors, candidates."""

from pyspark.sql import functions as F

from lorelink.functions import text as X
from lorelink.operators import anchors as A
from lorelink.operators import candidates as C
from lorelink.operators import dictionary as D
from lorelink.operators import features as FE
from lorelink.operators import priors as R
from lorelink.operators import vocab as V
from lorelink.plans.oracle import phrase_sql, r6, with_tables
from lorelink.plans.tables import Tables

# A short list of frequent words in the four languages of the texts.
STOP_WORDS = ["the", "and", "der", "die", "und", "que", "les", "des", "los", "est", "ist", "was", "for", "por"]


def six(column):
    """Round for comparison; the tiny shift keeps exact halves on one side."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + 1e-10, 6) + 0.0


def link_prior(t: Tables):
    return R.link_prior(t.priors).select("mention", "entity_id", "n", six("pem").alias("pem"), six("pe").alias("pe"))


def titled_parts(t: Tables):
    return t.read("part").select("p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("label"))


def split_titles(t: Tables):
    named = t.pages.select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("page_id").alias("entity_id")).filter("title <> ''")
    clean, ignored, double = D.split_namespaced_titles(named)
    return (
        clean.select("title", F.lit("clean").alias("kind"), F.col("entity_id").alias("value"))
        .unionByName(ignored.select("title", F.lit("ignored").alias("kind"), F.col("entity_id").alias("value")))
        .unionByName(double.select("title", F.lit("double").alias("kind"), F.col("n").alias("value")))
    )


def title_index(t: Tables):
    """Part labels as entities against part names as titles."""
    entities = titled_parts(t).select(F.col("label").alias("entity")).distinct()
    titles = t.read("part").select(F.col("p_name").alias("title")).filter("p_name not like '%ring'").distinct()
    return D.title_entity_index(entities, titles)


def wiki_lines(t: Tables):
    """Paragraph lines of the pages with their local links in wiki form."""
    linked = F.regexp_replace("html", A.HTML_ANCHOR, "[[$1|$2]]")
    cut = t.pages.select("page_id", F.posexplode(F.split(linked, "</(?:p|li|h1|div|title)>")).alias("line_no", "line"))
    return cut.select("page_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", "<[^<>]*>", " ").alias("line"))


def linked_text(t: Tables):
    built = A.rebuild_lines(A.segments(wiki_lines(t)), ["page_id", "line_no"], *t.names)
    return built.filter((F.length("linked") >= 10) & (F.length("plain") >= 10))


WIKI_LINES = """
  wiki_lines AS (SELECT page_id, line_no, trim(regexp_replace(line, '<[^<>]*>', ' ', 'g')) AS line FROM (
    SELECT page_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (
      SELECT page_id, string_split_regex(regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '[[\\1|\\2]]', 'g'), '</(?:p|li|h1|div|title)>') AS l FROM pages)))"""


def tagged_lines(t: Tables):
    """Lines with every word tagged as number or word, cleaned again."""
    words = F.transform(
        F.filter(F.split("line", " "), lambda w: w != ""),
        lambda w: F.concat(w, F.when(w.rlike("^[0-9]+[.,]?$"), F.lit("#NUMBER")).otherwise("#W")),
    )
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    tagged = lines.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.array_join(words, " ").alias("tagged"))
    return tagged.select("doc_id", "sent_id", X.clean_tagged_line(F.col("tagged")).alias("cleaned")).filter("cleaned is not null")


def candidate_strings(t: Tables):
    rows = t.candidates.join(t.titles, "entity_id")
    return rows.select("mention", "entity_id", *X.string_features(F.col("mention"), X.entity_title(F.col("title"))))


def mention_lists(t: Tables):
    """Candidate lists without the pairs the filter takes out, with skip counts."""
    senses = t.sense_vectors.select("entity_id")
    kept = C.filter_candidates(t.candidates, t.titles, senses)
    return C.skipped_candidates(t.candidates, kept)


def one_byte(text: str) -> str:
    """SQL that maps each accented letter to its own control character.

    The checking engine counts bytes in its edit distance.
    """
    letters = "íéßüêäóçöèñÍÉÜÊÄÓÇÖÈÑáúàâîôûùëïœ"
    codes = " || ".join(f"chr({i + 1})" for i in range(len(letters)))
    return f"translate({text}, '{letters}', {codes})"


def documents_mentions(t: Tables):
    return t.mentions.withColumn("gold", F.col("wiki_id"))


def missing(t: Tables):
    """Audit with the priors of frequent labels only, so that gaps exist."""
    frequent = t.priors.filter("n >= 5")
    return FE.missing_log(t.mentions, t.candidates.filter(F.length("mention") > 2), frequent.select("mention"), frequent.select("entity_id").distinct())


QUERIES = {
    "link_prior": (link_prior, f"""
        SELECT mention, entity_id, CAST(n AS BIGINT) AS n, {r6('pem')} AS pem, {r6('pe')} AS pe FROM (
          SELECT *, row_number() OVER (PARTITION BY mention ORDER BY pem DESC, entity_id) AS r FROM priors) WHERE r = 1"""),
    "normalize_phrase": (
        lambda t: t.documents.select("doc_id", X.normalize_phrase(F.col("text")).alias("phrase")),
        f"SELECT doc_id, {phrase_sql('text')} AS phrase FROM documents"),
    "entity_title": (
        lambda t: titled_parts(t).select("p_partkey", "label", X.entity_title(F.col("label")).alias("title"),
                                         X.entity_title_prefix(F.col("label")).alias("prefix")),
        r"""SELECT p_partkey, label, trim(regexp_replace(label, '\(.*?\)$', '')) AS title,
        regexp_extract(label, '^(.*?)(?: ?\(.*)?$', 1) AS prefix
        FROM (SELECT p_partkey, p_name || ' (' || p_type || ')' AS label FROM part)"""),
    "normalize_title": (
        lambda t: t.read("part").select("p_partkey", X.normalize_title(F.concat(F.lit("_"), F.lower("p_type"), F.lit(":  "), F.translate("p_name", " ", "_"), F.lit(" ")), ["Economy"]).alias("title")),
        """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Economy:' ELSE upper(p_type[1]) || lower(p_type[2:]) || ': ' END
        || upper(p_name[1]) || p_name[2:] AS title FROM part"""),
    "tagged_lines": (tagged_lines, r"""
        WITH w AS (SELECT doc_id, sent_id, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM lines),
        c AS (SELECT doc_id, sent_id, list_transform(list_filter(ws, lambda x: NOT contains(x, '#')), lambda x:
          CASE WHEN regexp_full_match(x, '[0-9]+[.,]?') THEN 'dddddd'
          ELSE trim(regexp_replace(x, '[!-/:-@\[-`{-~ \t\n\r\f\v]+', ' ', 'g')) END) AS cs FROM w WHERE len(ws) >= 5),
        s AS (SELECT doc_id, sent_id, list_filter(cs, lambda x, i: i = 1 OR x <> 'dddddd' OR cs[i - 1] <> 'dddddd') AS k FROM c)
        SELECT doc_id, sent_id, array_to_string(k, ' ') AS cleaned FROM s WHERE len(k) > 4"""),
    "anchors": (lambda t: t.anchors, "SELECT page_id, pos, title, label FROM anc"),
    "split_titles": (split_titles, """
        WITH x AS (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id FROM pages),
        g AS (SELECT title, min(page_id) AS id, count(*) AS n FROM x WHERE title <> '' GROUP BY title)
        SELECT title, CASE WHEN contains(title, ':') THEN 'ignored' ELSE 'clean' END AS kind, id AS value FROM g
        UNION ALL SELECT title, 'double', n FROM g WHERE n > 1"""),
    "lower_map": (lambda t: D.unambiguous_lower_map(t.titles), """
        SELECT lower(title) AS lower_title, min(title) AS title FROM titles GROUP BY 1 HAVING count(DISTINCT title) = 1"""),
    "redirect_clean": (lambda t: t.redirects, "SELECT redirect_id, alias, title FROM redirects"),
    "extend_lower_map": (lambda t: t.lower_map, "SELECT lower_title, title FROM lower_map"),
    "resolve_anchors": (
        lambda t: A.resolve_anchors(t.anchors, *t.names),
        """SELECT page_id, pos, title, label, resolved, CASE WHEN resolved IS NULL THEN label
        WHEN resolved = label THEN '[[' || resolved || ']]' ELSE '[[' || resolved || '|' || label || ']]' END AS rewritten FROM resolved"""),
    "linked_text": (linked_text, "WITH " + WIKI_LINES + r""",
        seg AS (SELECT page_id, line_no, string_split_regex(line, '\[\[[^\[\]]*\]\]') AS b,
          regexp_extract_all(line, '\[\[([^\[\]|]*)\|([^\[\]]*)\]\]', 1) AS tt, regexp_extract_all(line, '\[\[([^\[\]|]*)\|([^\[\]]*)\]\]', 2) AS ll FROM wiki_lines),
        pieces AS (SELECT page_id, line_no, unnest(range(len(b))) AS i, unnest(b) AS b, unnest(list_resize(tt, len(b))) AS tt, unnest(list_resize(ll, len(b))) AS ll FROM seg),
        map AS (SELECT DISTINCT title, resolved AS r FROM resolved),
        put AS (SELECT p.*, CASE WHEN ll IS NULL THEN '' WHEN m.r IS NULL THEN ll WHEN m.r = ll THEN '[[' || m.r || ']]' ELSE '[[' || m.r || '|' || ll || ']]' END AS link
          FROM pieces p LEFT JOIN map m ON m.title = p.tt),
        lined AS (SELECT page_id, line_no, string_agg(b || link, '' ORDER BY i) AS linked, string_agg(b || coalesce(ll, ''), '' ORDER BY i) AS plain FROM put GROUP BY page_id, line_no)
        SELECT page_id, line_no, linked, plain FROM lined WHERE length(linked) >= 10 AND length(plain) >= 10"""),
    "mention_counts": (lambda t: t.counts, "SELECT entity_id, title, label, n FROM counts"),
    "page_outlinks": (lambda t: A.page_outlinks(t.anchors), "SELECT DISTINCT page_id, title FROM anc WHERE title <> ''"),
    "clean_outlinks": (lambda t: t.links, "SELECT src, dst FROM links"),
    "mention_sets": (lambda t: A.title_mention_sets(*t.names, t.counts), """
        SELECT m.title, m.mentions, CAST(coalesce(c.anchors, 0) AS BIGINT) AS anchors FROM (
          SELECT title, count(DISTINCT mention) AS mentions FROM (
            SELECT title, alias AS mention FROM redirects UNION ALL SELECT title, lower_title FROM lower_map UNION ALL SELECT title, label FROM counts)
          GROUP BY title) m LEFT JOIN (SELECT title, sum(n) AS anchors FROM counts GROUP BY title) c USING (title)"""),
    "mention_histogram": (lambda t: A.mention_size_histogram(A.title_mention_sets(*t.names, t.counts)), """
        SELECT CAST(least(floor((mentions - 1) / 10), 17) AS BIGINT) AS bin, CAST(sum(mentions) AS BIGINT) AS mentions,
          CAST(sum(anchors) AS BIGINT) AS anchors, count(*) AS titles FROM (
        SELECT m.title, m.mentions, coalesce(c.anchors, 0) AS anchors FROM (
          SELECT title, count(DISTINCT mention) AS mentions FROM (
            SELECT title, alias AS mention FROM redirects UNION ALL SELECT title, lower_title FROM lower_map UNION ALL SELECT title, label FROM counts)
          GROUP BY title) m LEFT JOIN (SELECT title, sum(n) AS anchors FROM counts GROUP BY title) c USING (title)) GROUP BY 1"""),
    "mention_names": (lambda t: A.load_mention_names(A.mention_names(t.lower_map, t.titles, t.counts), t.titles), """
        SELECT DISTINCT mention, title FROM (SELECT lower_title AS mention, title FROM lower_map UNION ALL SELECT label, title FROM counts WHERE n >= 5)"""),
    "normalized_mentions": (lambda t: A.normalized_mention_titles(t.lower_map, t.counts), rf"""
        SELECT DISTINCT mention, title FROM (SELECT {phrase_sql('name')} AS mention, trim(regexp_replace(title, '\(.*?\)$', '')) AS title
        FROM (SELECT lower_title AS name, title FROM lower_map UNION ALL SELECT label, title FROM counts)) WHERE mention <> '' AND title <> ''"""),
    "title_entity_index": (title_index, r"""
        SELECT entity, title FROM (SELECT DISTINCT p_name || ' (' || p_type || ')' AS entity, p_name AS title FROM part) WHERE title NOT LIKE '%ring'"""),
    "title_coverage": (
        lambda t: D.title_coverage(titled_parts(t).select(F.col("label").alias("entity")).distinct(), title_index(t)),
        """SELECT count(*) AS entities, CAST(count_if(title NOT LIKE '%ring') AS BIGINT) AS with_title
        FROM (SELECT DISTINCT p_name || ' (' || p_type || ')' AS entity, p_name AS title FROM part)"""),
    "mapping_title": (lambda t: D.mapping_title(t.titles, STOP_WORDS), f"""
        SELECT DISTINCT name, title FROM (SELECT {phrase_sql('title')} AS name, title FROM titles)
        WHERE length(name) > 2 AND name <> 'dddddd' AND name NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})"""),
    "mapped_names": (
        lambda t: D.mapped_name_count(D.mapping_title(t.titles, STOP_WORDS), t.counts.filter("n >= 5").select("title")),
        f"""SELECT count(*) AS names, CAST(count_if(title IN (SELECT title FROM counts WHERE n >= 5)) AS BIGINT) AS names_with_entity FROM (
        SELECT DISTINCT {phrase_sql('title')} AS name, title FROM titles)
        WHERE length(name) > 2 AND name <> 'dddddd' AND name NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})"""),
    "entity_prior": (
        lambda t: R.entity_prior(t.counts).select("entity_id", six("pe").alias("pe")),
        f"SELECT entity_id, {r6('pe')} AS pe FROM pe"),
    "priors": (
        lambda t: t.priors.select("mention", "entity_id", "n", six("pem").alias("pem"), six("pe").alias("pe")),
        f"SELECT mention, entity_id, n, {r6('pem')} AS pem, {r6('pe')} AS pe FROM priors"),
    "wiki_candidates": (lambda t: t.candidates, "SELECT mention, entity_id FROM cands"),
    "candidate_stats": (
        lambda t: C.candidate_stats(t.candidates).withColumn("average", six("average")),
        f"""SELECT count(*) AS mentions, CAST(sum(n) AS BIGINT) AS candidates, {r6('avg(n)')} AS average
        FROM (SELECT mention, count(*) AS n FROM cands GROUP BY mention)"""),
    "skipped_candidates": (mention_lists, """
        SELECT CAST(sum(b - a) AS BIGINT) AS skipped_candidates, CAST(count_if(a = 0) AS BIGINT) AS skipped_mentions FROM (
        SELECT mention, count(*) AS b, count(s.entity_id) AS a FROM cands c LEFT JOIN sense_vectors s ON s.entity_id = c.entity_id GROUP BY mention)"""),
    "string_features": (candidate_strings, rf"""
        SELECT mention, entity_id, CAST(levenshtein({one_byte('mention')}, {one_byte('title')}) AS DOUBLE) AS str_sim1, CAST(mention = title AS DOUBLE) AS str_sim2,
          CAST(contains(title, mention) AS DOUBLE) AS str_sim3, CAST(starts_with(title, mention) AS DOUBLE) AS str_sim4,
          CAST(ends_with(title, mention) AS DOUBLE) AS str_sim5
        FROM (SELECT c.mention, c.entity_id, trim(regexp_replace(t.title, '\(.*?\)$', '')) AS title FROM cands c JOIN titles t USING (entity_id))"""),
    "linking_vocab": (lambda t: C.linking_vocab(documents_mentions(t), t.candidates), """
        SELECT entity_id FROM cands WHERE mention IN (SELECT mention FROM mentions) UNION SELECT wiki_id FROM mentions"""),
    "linking_coverage": (
        lambda t: C.linking_coverage(t.mentions, t.candidates.filter(F.length("mention") > 2), 600, 800),
        """SELECT split, count(*) AS mentions, CAST(sum(coalesce(n, 0)) AS BIGINT) AS candidates, CAST(count_if(n IS NULL) AS BIGINT) AS without FROM (
        SELECT CASE WHEN doc_id <= 600 THEN 'train' WHEN doc_id <= 800 THEN 'dev' ELSE 'test' END AS split, n FROM mentions
        LEFT JOIN (SELECT mention, count(*) AS n FROM cands WHERE length(mention) > 2 GROUP BY mention) USING (mention)) GROUP BY split"""),
    "linkable_mentions": (
        lambda t: C.linkable_mentions(documents_mentions(t), t.candidates).select("doc_id", "mention_id", "mention", "wiki_id"),
        """SELECT doc_id, mention_id, m.mention, wiki_id FROM mentions m
        WHERE EXISTS (SELECT 1 FROM cands c WHERE c.mention = m.mention AND c.entity_id = m.wiki_id)"""),
    "missing_log": (missing, """
        WITH c AS (SELECT * FROM cands WHERE length(mention) > 2), m AS (SELECT mention, count(*) AS n FROM mentions GROUP BY mention),
        f AS (SELECT * FROM priors WHERE n >= 5)
        SELECT 'mention without candidates' AS reason, mention AS name, n FROM m WHERE mention NOT IN (SELECT mention FROM c)
        UNION ALL SELECT 'name without prior', mention, n FROM m WHERE mention IN (SELECT mention FROM c) AND mention NOT IN (SELECT mention FROM f)
        UNION ALL SELECT 'entity without prior', CAST(entity_id AS VARCHAR), count(*) FROM c
          WHERE entity_id NOT IN (SELECT entity_id FROM f) GROUP BY entity_id"""),
    "outlink_vocab": (lambda t: V.entity_vocab(t.links).filter("item_id > 0"), "SELECT item_id, item, cn FROM entity_vocab"),
}

QUERIES = {name: (run, with_tables(sql) if sql else None) for name, (run, sql) in QUERIES.items()}
