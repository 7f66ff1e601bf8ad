"""Registered queries: gradient steps, sense centres, sense choice, trainers, page cleaning."""

from pyspark.sql import functions as F

from lorelink.functions.hashing import portable_uniform
from lorelink.operators import features as FE
from lorelink.operators import markup as K
from lorelink.operators import pairs as P
from lorelink.operators import training as T
from lorelink.operators.together import carry, mark, together
from lorelink.plans import train as R
from lorelink.plans.oracle import alias_sql, cosine_sql, drawn_sql, r6, uniform_sql, with_tables
from lorelink.plans.queries_linking import CTX
from lorelink.plans.queries_names import six
from lorelink.plans.queries_text import KEPT, SEED, SPANS, WINDOW, negatives, sentence_rows, with_entities
from lorelink.plans.tables import DIM, Tables
from lorelink.session import cut_lineage

LINE = ["doc_id", "sent_id"]
STEP_DIM, ALPHA = 8, 0.5
# The checked training has two mini-batches to a stage and epoch, the others one.
SETTINGS = R.Settings(dim=8, epochs=2, batches=2, negatives=2, alpha=0.1, seed=SEED, draw=portable_uniform)
LIGHT = R.Settings(dim=8, epochs=2, batches=1, negatives=2, alpha=0.1, seed=SEED)
THRESHOLD, MAX_SENSES = 0.02, 3


def first_params(t: Tables):
    """Start vectors of all entities, for inputs and (another seed, wider) outputs."""
    items = t.entity_vocab.filter("item_id > 0").select(F.col("item_id").alias("item"))
    wide = lambda df: df.select("item", F.transform("vec", lambda x: x * STEP_DIM).alias("vec"))
    return tuple(wide(T.init_inputs(items, STEP_DIM, seed, portable_uniform)) for seed in (SEED, SEED + 1))


def step_examples(t: Tables):
    pairs = P.neighbour_pairs(t.links, t.entity_vocab)
    drawn = negatives(t).select("input", "negative")
    return cut_lineage(T.labelled_examples(pairs, drawn))


def step_gradients(t: Tables):
    inputs, outputs = first_params(t)
    _, _, grads = T.sgns_step(step_examples(t), inputs, outputs, ALPHA, STEP_DIM)
    return grads.select("side", "item", *[six(F.get("grad", F.lit(i))).alias(f"g{i + 1}") for i in range(STEP_DIM)])


def step_params(t: Tables):
    inputs, outputs = first_params(t)
    after, _, _ = T.sgns_step(step_examples(t), inputs, outputs, ALPHA, STEP_DIM, damp_above=3.0)
    return after.select("item", *[six(F.get("vec", F.lit(i))).alias(f"v{i + 1}") for i in range(STEP_DIM)])


def step_loss(t: Tables):
    inputs, outputs = first_params(t)
    return T.loss(step_examples(t), inputs, outputs).select(six("loss").alias("loss"))


def mention_means(t: Tables):
    """context_id, title (the name), wiki_id and the mean context vector of every mention."""
    mentions = cut_lineage(t.mentions)
    seen = FE.seen_mentions(mentions, t.doc_words, t.word_vectors, DIM, WINDOW, "inner")
    means = seen.select((F.col("doc_id") * 1_000_000 + F.col("mention_id")).alias("context_id"), F.col("mention").alias("title"), "wiki_id", F.col("ctx").alias("vec"))
    # Equal ids are of one mention as long as no document has so many places.
    own = together(seen, FE.KEYS) and mentions.filter("mention_id < 0 OR mention_id >= 1000000").isEmpty()
    return mark(means, ["context_id"]) if own else means


def old_centres(t: Tables):
    placed = t.sense_vectors.join(t.entity_ranks.select("entity_id", "place"), "entity_id")
    return placed.select(F.col("entity_id").alias("sense_key"), "mu", (F.col("place") % 3).alias("cluster_size"))


def centres(t: Tables):
    found = T.sense_centres(mention_means(t).select(F.col("wiki_id").alias("sense_key"), "vec"), DIM, old_centres(t))
    return found.select("sense_key", "cluster_size", six(F.get("mu", F.lit(0))).alias("first"), six(F.element_at("mu", -1)).alias("last"))


def name_senses(t: Tables):
    """Senses of a name: the entities linked under it, every other one as an induced sense."""
    keyed = t.priors.select(F.col("mention").alias("title"), "entity_id").join(
        t.sense_vectors.select("entity_id", "mu"), "entity_id"
    ).join(t.entity_ranks.select("entity_id", "place"), "entity_id")
    return keyed.select(
        "title", F.when(F.col("place") % 2 == 0, "kb").otherwise("nil").alias("sense_kind"),
        F.col("entity_id").cast("string").alias("sense_key"), "mu", (F.col("place") % 4).alias("cluster_size"),
    )


def chosen_senses(t: Tables):
    means = mention_means(t)
    contexts = carry(means.drop("wiki_id"), means)
    return T.assign_sense(contexts, name_senses(t), THRESHOLD)


def induced(t: Tables):
    contexts = cut_lineage(mention_means(t).drop("wiki_id"))
    final, _ = T.induce_senses(contexts, cut_lineage(name_senses(t)), DIM, THRESHOLD, MAX_SENSES, cut_lineage)
    return final.select("title", "sense_kind", "sense_key", "cluster_size", six(F.get("mu", F.lit(0))).alias("first"))


def corpus(t: Tables):
    """Skip-grams, neighbours and span contexts of the whole corpus, written once."""
    skipgrams = cut_lineage(P.skipgram_pairs(sentence_rows(t), LINE, WINDOW, SEED, portable_uniform).select("center", "context"))
    neighbours = cut_lineage(P.neighbour_pairs(t.links, t.entity_vocab))
    contexts = cut_lineage(with_entities(t).select("entity", "context"))
    return skipgrams, neighbours, contexts, t.vocab, cut_lineage(t.entity_vocab)


def lengths(model: R.Model):
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return model.inputs.select("item", six(size).alias("length"), six(F.get("vec", F.lit(0))).alias("first"))


def trained(recipe, settings=LIGHT):
    return lambda t: lengths(recipe(*corpus(t), settings))


def trained_induction(t: Tables):
    """Sense->word training over the spans of the documents after inducing senses."""
    spans = with_entities(t).select(
        (F.col("doc_id") * 10_000_000 + F.col("sent_id") * 10_000 + F.col("span_id")).alias("context_id"), F.col("entity").alias("title"), "context"
    )
    words = t.vocab.filter("item_id > 0")
    vectors = T.init_inputs(words.select(R.spaced("w:", "item_id").alias("item")), SETTINGS.dim, SEED)
    own = t.entity_vocab.filter("item_id > 0").select(F.col("item").alias("title"))
    start = T.init_inputs(own.select(F.col("title").alias("item")), SETTINGS.dim, SEED + 1).select(
        F.col("item").alias("title"), F.lit("kb").alias("sense_kind"), F.col("item").alias("sense_key"), F.col("vec").alias("mu"), F.lit(1).cast("long").alias("cluster_size")
    )
    model, _, _ = R.train_sense_induction(cut_lineage(spans), cut_lineage(start), words, vectors, LIGHT, 0.0, 2)
    return lengths(model)


def html_text(t: Tables):
    """The text of the pages, cleaned like wiki markup."""
    return K.clean_pages(t.pages, "html")


def page_templates(t: Tables):
    """Page texts in wiki form without markup, links kept: one row per page."""
    wiki = t.pages.select("page_id", F.regexp_replace("html", '<a href="/([^"]*)">([^<]*)</a>', "[[$1|$2]]").alias("text"))
    return K.strip_markup(wiki)


PARAMS = f"""
  it AS (SELECT item_id AS item, unnest(range(1, {STEP_DIM + 1})) AS i FROM entity_vocab),
  pin AS (SELECT item, list(({uniform_sql(SEED, 'item', 'i')} - 0.5) ORDER BY i) AS v FROM it GROUP BY item),
  pout AS (SELECT item, list(({uniform_sql(SEED + 1, 'item', 'i')} - 0.5) ORDER BY i) AS v FROM it GROUP BY item),
{alias_sql('entity_vocab', 'al')},
  pairs AS (SELECT b.item_id AS input, a.item_id AS output FROM links l JOIN entity_vocab a ON a.item = l.src JOIN entity_vocab b ON b.item = l.dst),
  draws AS (SELECT input, output, unnest(range(1, 6)) AS k FROM pairs),
  u AS (SELECT d.input, d.output, {drawn_sql('al', SEED, ['input', 'output', 'k'], '(SELECT max(item_id) FROM entity_vocab)')} AS negative
    FROM draws d JOIN al ON al.cell = CAST(floor({uniform_sql(SEED, 'input', 'output', 'k')} * (SELECT max(n) FROM al)) AS BIGINT)),
  ex AS (SELECT input, output, 1.0 AS label FROM pairs UNION ALL SELECT input, negative, 0.0 FROM u WHERE negative <> output),
  g AS (SELECT e.input, e.output, a.v AS a, b.v AS b, e.label, list_dot_product(a.v, b.v) AS f,
    {ALPHA} * (e.label - CASE WHEN list_dot_product(a.v, b.v) > 6 THEN 1 WHEN list_dot_product(a.v, b.v) < -6 THEN 0 ELSE 1 / (1 + exp(-list_dot_product(a.v, b.v))) END) AS g
    FROM ex e JOIN pin a ON a.item = e.input JOIN pout b ON b.item = e.output)"""

MEANS = CTX + """,
  mc AS (SELECT m.doc_id * 1000000 + m.mention_id AS context_id, m.mention AS title, m.wiki_id, c.ctx FROM mentions m JOIN ctx c USING (doc_id, mention_id))"""


def training_sql(stages: list[tuple[str, str, str]], settings: R.Settings) -> str:
    """A whole training in SQL: ``stages`` have a name (of a table input, output, n), the vocabulary of the negatives and its prefix."""
    dim, steps = settings.dim, settings.epochs * settings.batches * len(stages)
    parts = [alias_sql(vocab, f"al_{vocab}") for vocab in dict.fromkeys(v for _, v, _ in stages)]
    first = "SELECT 'w:' || item_id AS item FROM tv UNION ALL SELECT 'e:' || item_id FROM te UNION ALL SELECT 'e:0'"
    one = f"({uniform_sql(settings.seed, 'item', 'i')} - 0.5) / {dim}"
    parts += [
        f"in_0 AS MATERIALIZED (SELECT item, list({one} ORDER BY i) AS v, 0.0::DOUBLE AS q FROM (SELECT item, unnest(range(1, {dim + 1})) AS i FROM ({first})) GROUP BY item)",
        f"out_0 AS MATERIALIZED (SELECT item, list_transform(v, lambda x: 0.0::DOUBLE) AS v, 0.0::DOUBLE AS q FROM in_0)",
    ]
    for name, _, _ in stages:
        batch = f"CAST(floor({uniform_sql(settings.seed, 'input', 'output', 'o')} * {settings.batches}) AS INTEGER)"
        parts.append(f"o_{name} AS MATERIALIZED (SELECT input, output, o, {batch} AS batch FROM (SELECT input, output, unnest(range(1, n + 1)) AS o FROM {name}))")
    step = 0
    for _ in range(settings.epochs):
        for name, vocab, prefix in stages:
            for batch in range(settings.batches):
                before, step = step, step + 1
                seed, alpha, keys = settings.seed + 7919 * step, T.learning_rate(settings.alpha, before / steps), ["input", "output", "o", "k"]
                g = "e.n * (e.label - CASE WHEN f > 6 THEN 1 WHEN f < -6 THEN 0 ELSE 1 / (1 + exp(-f)) END)"
                parts += [
                    f"b_{step} AS MATERIALIZED (SELECT input, output, o FROM o_{name} WHERE batch = {batch})",
                    f"d_{step} AS (SELECT input, output, '{prefix}' || ({drawn_sql('a', seed, keys, f'(SELECT max(item_id) FROM {vocab})')}) AS negative"
                    f" FROM (SELECT *, CAST(floor({uniform_sql(seed, *keys)} * (SELECT max(n) FROM al_{vocab})) AS BIGINT) AS cell"
                    f" FROM (SELECT *, unnest(range(1, {settings.negatives + 1})) AS k FROM b_{step})) JOIN al_{vocab} a USING (cell))",
                    f"x_{step} AS (SELECT input, output, 1.0 AS label, count(*) AS n FROM b_{step} GROUP BY 1, 2"
                    f" UNION ALL SELECT input, negative, 0.0, count(*) FROM d_{step} WHERE negative <> output GROUP BY 1, 2)",
                    f"g_{step} AS MATERIALIZED (SELECT input, output, a, b, {g} AS g FROM (SELECT x.*, i.v AS a, p.v AS b, list_dot_product(i.v, p.v) AS f"
                    f" FROM x_{step} x JOIN in_{before} i ON i.item = x.input JOIN out_{before} p ON p.item = x.output) e)",
                ]
                for side, item, other in (("in", "input", "b"), ("out", "output", "a")):
                    sums = ", ".join(f"sum(g * {other}[{i}])" for i in range(1, dim + 1))
                    parts.append(
                        f"{side}_{step} AS MATERIALIZED (SELECT item, CASE WHEN s IS NULL OR q = 0 THEN v ELSE list_transform(list_zip(v, s), lambda z: z[1] + {alpha!r} * z[2] / sqrt(q)) END AS v, q FROM ("
                        f" SELECT t.item, v, s, q + coalesce(list_dot_product(s, s), 0) / {dim} AS q FROM {side}_{before} t LEFT JOIN"
                        f" (SELECT {item} AS item, [{sums}] AS s FROM g_{step} GROUP BY {item}) c ON c.item = t.item))"
                    )
    return ",\n".join(parts) + f"\nSELECT item, {r6('sqrt(list_dot_product(v, v))')} AS length, {r6('v[1]')} AS first FROM in_{step}"


TRAIN_SQL = (
    "WITH " + KEPT + "," + SPANS + f""",
  tv AS MATERIALIZED (SELECT item_id, item, cn FROM vocab), te AS MATERIALIZED (SELECT item_id, item, cn FROM entity_vocab),
  radius AS (SELECT *, CAST(floor({uniform_sql(SEED, 'doc_id', 'sent_id', 'chunk', 'spot')} * {WINDOW}) + 1 AS INTEGER) AS r FROM chunked),
  text_pairs AS MATERIALIZED (SELECT 'w:' || n.item_id AS input, 'w:' || c.item_id AS output, count(*) AS n FROM radius c JOIN chunked n
    ON c.doc_id = n.doc_id AND c.sent_id = n.sent_id AND c.chunk = n.chunk AND n.spot BETWEEN c.spot - c.r AND c.spot + c.r AND n.spot <> c.spot GROUP BY 1, 2),
  graph_pairs AS MATERIALIZED (SELECT 'e:' || b.item_id AS input, 'e:' || a.item_id AS output, count(*) AS n
    FROM links l JOIN entity_vocab a ON a.item = l.src JOIN entity_vocab b ON b.item = l.dst GROUP BY 1, 2),
  to_words AS MATERIALIZED (SELECT 'e:' || v.item_id AS input, 'w:' || word AS output, count(*) AS n FROM near JOIN te v ON v.item = entity GROUP BY 1, 2),
  to_entities AS MATERIALIZED (SELECT output AS input, input AS output, n FROM to_words),
"""
    + training_sql([("text_pairs", "tv", "w:"), ("graph_pairs", "te", "e:"), ("to_words", "tv", "w:"), ("to_entities", "te", "e:")], SETTINGS)
)


def components(expression: str, name: str) -> str:
    return ", ".join(f"{r6(expression.format(i))} AS {name}{i}" for i in range(1, STEP_DIM + 1))


QUERIES = {
    "init_params": (
        lambda t: first_params(t)[0].select("item", *[six(F.get("vec", F.lit(i))).alias(f"v{i + 1}") for i in range(STEP_DIM)]),
        "WITH " + PARAMS + f" SELECT item, {components('v[{}]', 'v')} FROM pin"),
    "labelled_examples": (step_examples, "WITH " + PARAMS + """
        SELECT input, output, CAST(label AS DOUBLE) AS label, count(*) AS n FROM ex GROUP BY 1, 2, 3"""),
    "sgns_gradients": (step_gradients, "WITH " + PARAMS + f"""
        SELECT 'in' AS side, input AS item, {components('sum(g * b[{}])', 'g')} FROM g GROUP BY input
        UNION ALL SELECT 'out', output, {components('sum(g * a[{}])', 'g')} FROM g GROUP BY output"""),
    "sgns_step": (step_params, "WITH " + PARAMS + f""",
        s AS (SELECT input AS item, count(*) AS n, {', '.join(f'sum(g * b[{i}]) AS s{i}' for i in range(1, STEP_DIM + 1))} FROM g GROUP BY input)
        SELECT p.item, {components('p.v[{0}] + coalesce(s{0} * least(1.0, 3.0 / n), 0)', 'v')} FROM pin p LEFT JOIN s ON s.item = p.item"""),
    "sgns_loss": (step_loss, "WITH " + PARAMS + f" SELECT {r6('avg(ln(1 + exp(CASE WHEN label > 0 THEN -f ELSE f END)))')} AS loss FROM g"),
    "sense_centres": (centres, "WITH " + MEANS + f""",
        u AS (SELECT wiki_id AS k, ctx AS v FROM mc UNION ALL SELECT s.entity_id, s.mu FROM sense_vectors s JOIN entity_ranks r USING (entity_id) WHERE r.place % 3 > 0)
        SELECT k AS sense_key, count(*) AS cluster_size, {r6('avg(v[1])')} AS first, {r6('avg(v[64])')} AS last FROM u GROUP BY k"""),
    "assign_sense": (chosen_senses, "WITH " + MEANS + f""",
        ns AS (SELECT p.mention AS title, CASE WHEN r.place % 2 = 0 THEN 'kb' ELSE 'nil' END AS kind, CAST(p.entity_id AS VARCHAR) AS sense_key, s.mu, r.place % 4 AS size
          FROM priors p JOIN sense_vectors s USING (entity_id) JOIN entity_ranks r USING (entity_id)),
        us AS (SELECT * FROM ns WHERE size > 0), tot AS (SELECT title, sum(size) AS total FROM us GROUP BY title),
        sc AS (SELECT m.context_id, m.title, u.kind, u.sense_key, round({cosine_sql('m.ctx', 'u.mu')} * u.size, 6) AS c,
          row_number() OVER (PARTITION BY m.context_id, u.kind ORDER BY round({cosine_sql('m.ctx', 'u.mu')} * u.size, 6) DESC, u.sense_key) AS r
          FROM mc m JOIN us u ON u.title = m.title WHERE {cosine_sql('m.ctx', 'u.mu')} * u.size > -1),
        tp AS (SELECT context_id, title, coalesce(max(CASE WHEN kind = 'kb' THEN c END), -1.0) AS kb, max(CASE WHEN kind = 'kb' THEN sense_key END) AS kbk,
          coalesce(max(CASE WHEN kind = 'nil' THEN c END), -1.0) AS nil, max(CASE WHEN kind = 'nil' THEN sense_key END) AS nilk FROM sc WHERE r = 1 GROUP BY 1, 2),
        op AS (SELECT c.context_id, c.title, total, coalesce(kb, -1.0) AS kb, coalesce(nil, -1.0) AS nil, kbk, nilk
          FROM mc c JOIN tot USING (title) LEFT JOIN tp USING (context_id, title)),
        kd AS (SELECT *, CASE WHEN kb / total < {THRESHOLD} AND nil / total < {THRESHOLD} THEN 'new' WHEN kb / total > nil / total THEN 'kb' WHEN nilk IS NOT NULL THEN 'nil' ELSE 'none' END AS kind
          FROM op)
        SELECT m.context_id, m.title, coalesce(k.kind, 'none') AS kind, CASE k.kind WHEN 'kb' THEN kbk WHEN 'nil' THEN nilk END AS sense_key
        FROM mc m LEFT JOIN kd k USING (context_id)"""),
    "induce_senses": (induced, None),
    "train_align": (trained(R.train_align, SETTINGS), TRAIN_SQL),
    "train_multi_prototype": (trained(R.train_multi_prototype), None),
    "train_multi_prototype_cbow": (trained(R.train_multi_prototype_cbow), None),
    "train_single_prototype": (trained(R.train_single_prototype), None),
    "train_sense_induction": (trained_induction, None),
    "strip_markup": (page_templates, None),
    "clean_pages": (html_text, None),
}

QUERIES = {name: (run, with_tables(sql) if sql else None) for name, (run, sql) in QUERIES.items()}
