"""SQL for the working tables, so each query can be checked by another engine.

Named table expressions; ``with_tables`` prepends those a statement uses.
"""

import re


def tokens_sql(text: str) -> str:
    """Normalised tokens of a text as a list."""
    spaced = rf"""lower(trim(regexp_replace({text}, '[!-/:-@\[-`{{-~ \t\n\r\f\v]+', ' ', 'g')))"""
    return (
        f"list_transform(list_filter(string_split({spaced}, ' '), lambda t: t <> ''), "
        "lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'dddddd' ELSE t END)"
    )


def phrase_sql(text: str) -> str:
    return f"coalesce(array_to_string({tokens_sql(text)}, ' '), '')"


def uniform_sql(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{seed}'"])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


def alias_sql(vocab: str, name: str) -> str:
    """Named expressions that end in ``name`` (cell, own, other, keep, n, total): the alias table of a vocabulary."""
    n = name
    return f"""
  {n}_w AS (SELECT item_id, CAST(round(pow(cn, 0.75) / sum(pow(cn, 0.75)) OVER () * 68719476736) AS BIGINT) AS w FROM {vocab}),
  {n}_c AS (SELECT item_id, w, row_number() OVER (ORDER BY item_id) - 1 AS cell, count(*) OVER () AS n, CAST(sum(w) OVER () AS BIGINT) AS total FROM {n}_w WHERE w > 0),
  {n}_o AS MATERIALIZED (SELECT *, w * n - total AS left_over FROM {n}_c),
  {n}_l AS MATERIALIZED (SELECT *, CAST(sum(-left_over) OVER (ORDER BY cell) AS BIGINT) + left_over AS place FROM {n}_o WHERE left_over < 0),
  {n}_h AS MATERIALIZED (SELECT *, CAST(sum(left_over) OVER (ORDER BY cell) AS BIGINT) AS place, lead(item_id) OVER (ORDER BY cell) AS following FROM {n}_o WHERE left_over > 0),
  {n}_e AS MATERIALIZED (SELECT place FROM {n}_l UNION ALL SELECT CAST(coalesce(sum(-left_over), 0) AS BIGINT) FROM {n}_l),
  {n} AS MATERIALIZED (
    SELECT l.cell, l.item_id AS own, h.item_id AS other, l.w * l.n AS keep, l.n, l.total FROM {n}_l l ASOF JOIN {n}_h h ON l.place < h.place
    UNION ALL SELECT h.cell, h.item_id, coalesce(h.following, h.item_id), h.total + h.place - e.place, h.n, h.total FROM {n}_h h ASOF JOIN {n}_e e ON h.place <= e.place
    UNION ALL SELECT cell, item_id, item_id, total, n, total FROM {n}_o WHERE left_over = 0)"""


def drawn_sql(table: str, seed: int, keys: list[str], top: str) -> str:
    """What a draw from alias table ``a`` joined to it gives; ``top`` is the largest id."""
    own = f"CASE WHEN {uniform_sql(seed + 2, *keys)} * {table}.total < {table}.keep THEN {table}.own ELSE {table}.other END"
    return f"CASE WHEN {own} = 0 THEN CAST(floor({uniform_sql(seed + 1, *keys)} * {top}) AS BIGINT) + 1 ELSE {own} END"


def r6(value: str) -> str:
    return f"(round(CAST({value} AS DOUBLE) + 1e-10, 6) + 0.0)"


def cosine_sql(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})))"


def clamped_sql(a: str, b: str) -> str:
    return f"greatest(0.0, coalesce({cosine_sql(a, b)}, 0.0))"


ANCHOR = r'<a href="/([^"]*)">([^<]*)</a>'

TABLES = {
    "anc": f"""
        SELECT page_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS title, unnest(l) AS label
        FROM (SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS t, regexp_extract_all(html, '{ANCHOR}', 2) AS l FROM pages)""",
    "titles": """
        SELECT title, min(page_id * 1000000 + pos) AS entity_id FROM anc WHERE NOT regexp_matches(title, '[.,]$') GROUP BY title""",
    "raw_redirects": """
        SELECT page_id * 1000000 + pos AS redirect_id, title AS alias, regexp_replace(title, '[.,]+$', '') AS title
        FROM anc WHERE regexp_matches(title, '[.,]$')
        UNION ALL
        SELECT p.page_id * 1000000, regexp_extract(p.html, '<title>([^<]*)</title>', 1), a.title
        FROM pages p JOIN anc a ON a.page_id = p.page_id AND a.pos = 1""",
    "redirects": """
        SELECT min(redirect_id) AS redirect_id, alias, min(title) AS title FROM raw_redirects
        WHERE alias <> '' AND title IN (SELECT title FROM titles) GROUP BY alias HAVING count(DISTINCT title) = 1""",
    "lower_map": """
        SELECT lower_title, min(title) AS title FROM (
          SELECT lower(title) AS lower_title, title FROM titles UNION ALL SELECT lower(alias), title FROM redirects)
        GROUP BY lower_title HAVING count(DISTINCT title) = 1""",
    "resolved": """
        SELECT a.page_id, a.pos, a.title, a.label, coalesce(r.title, m.title, t.title) AS resolved
        FROM anc a LEFT JOIN redirects r ON r.alias = a.title LEFT JOIN lower_map m ON m.lower_title = lower(a.title)
        LEFT JOIN titles t ON t.title = a.title""",
    "counts": """
        SELECT t.entity_id, t.title, x.label, count(*) AS n FROM resolved x JOIN titles t ON t.title = x.resolved
        GROUP BY t.entity_id, t.title, x.label""",
    "mention_pairs": f"""
        SELECT mention, entity_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {phrase_sql('label')} AS mention, entity_id, n FROM counts)
        WHERE mention <> '' GROUP BY mention, entity_id""",
    "pe": "SELECT entity_id, 100.0 * sum(n) / (SELECT sum(n) FROM counts) AS pe FROM counts GROUP BY entity_id",
    "priors": """
        SELECT m.mention, m.entity_id, m.n, m.n / sum(m.n) OVER (PARTITION BY m.mention) AS pem, p.pe
        FROM mention_pairs m JOIN pe p USING (entity_id)""",
    "name_entity": """
        SELECT p.mention, p.entity_id, t.title FROM (
          SELECT mention, entity_id, row_number() OVER (PARTITION BY mention ORDER BY pem DESC, entity_id) AS r FROM priors) p
        JOIN titles t USING (entity_id) WHERE p.r = 1""",
    "links": """
        SELECT DISTINCT s.resolved AS src, d.resolved AS dst FROM resolved s JOIN resolved d ON s.page_id = d.page_id
        WHERE s.pos = 1 AND d.pos > 1 AND s.resolved IS NOT NULL AND d.resolved IS NOT NULL""",
    "lines": """
        SELECT doc_id, unnest(range(len(l))) AS sent_id, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "tokens": f"""
        SELECT doc_id, sent_id, unnest(range(len(w))) AS pos, unnest(w) AS token
        FROM (SELECT doc_id, sent_id, {tokens_sql('line')} AS w FROM lines)""",
    "vocab": """
        SELECT 0 AS item_id, '</s>' AS item, count(*) AS cn FROM lines
        UNION ALL
        SELECT row_number() OVER (ORDER BY cn DESC, token) AS item_id, token AS item, cn
        FROM (SELECT token, count(*) AS cn FROM tokens GROUP BY token HAVING count(*) >= 5)""",
    "entity_vocab": """
        SELECT row_number() OVER (ORDER BY cn DESC, item) AS item_id, item, cn
        FROM (SELECT item, count(*) AS cn FROM (SELECT src AS item FROM links UNION ALL SELECT dst FROM links) GROUP BY item)""",
    "doc_tokens": f"""
        SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)""",
    "mentions": """
        SELECT d.doc_id, d.pos AS mention_id, d.pos, d.token AS mention, e.entity_id AS wiki_id
        FROM doc_tokens d JOIN name_entity e ON e.mention = d.token""",
    "cands": """
        SELECT DISTINCT mention, entity_id FROM (
          SELECT lower(label) AS mention, entity_id FROM counts
          UNION ALL SELECT lower(r.alias), t.entity_id FROM redirects r JOIN titles t USING (title)
          UNION ALL SELECT lower(title), entity_id FROM titles) WHERE length(mention) > 1""",
    "emb": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings",
    "word_vectors": "SELECT v.item AS word, e.vec FROM vocab v JOIN emb e ON e.vec_id = v.item_id - 1",
    "entity_ranks": """
        SELECT entity_id, title, row_number() OVER (ORDER BY n DESC, entity_id) - 1 AS place
        FROM (SELECT entity_id, title, sum(n) AS n FROM counts GROUP BY entity_id, title)""",
    "entity_vectors": "SELECT r.entity_id, r.title, e.vec, e.label FROM entity_ranks r JOIN emb e ON e.vec_id = r.place",
    "label_means": """
        SELECT label, list(m ORDER BY i) AS mu FROM (
          SELECT label, i, avg(vec[i]) AS m FROM (SELECT label, vec, unnest(range(1, 65)) AS i FROM emb) GROUP BY label, i) GROUP BY label""",
    "sense_vectors": """
        SELECT r.entity_id, r.title, e.vec, m.mu FROM entity_ranks r
        JOIN emb e ON e.vec_id = (SELECT max(vec_id) FROM emb) - r.place JOIN label_means m ON m.label = e.label""",
}


def with_tables(statement: str) -> str:
    """Prepend the named tables a statement needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(statement)
    heads = [f"{name} AS MATERIALIZED ({TABLES[name]})" for name in needed]
    inner = statement.strip()
    if inner[:5].upper() == "WITH ":
        return "WITH " + ", ".join([*heads, inner[5:]])
    return ("WITH " + ", ".join(heads) + " " if heads else "") + inner
