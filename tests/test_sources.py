"""Readers and writers over small files."""

from pyspark.sql import functions as F

from lorelink.operators import dictionary as D
from lorelink.operators import features as FE
from lorelink.sources import corpora, sinks, tables, wiki
from lorelink.sources import dictionaries as X

DUMP = """<mediawiki><siteinfo><base>http://x.org/wiki/Main</base><namespaces>
<namespace key="0"/><namespace key="10">Template</namespace></namespaces></siteinfo>
<page><title>A</title><ns>0</ns><id>1</id><revision><id>9</id><text>Hello [[B]]</text></revision></page>
<page><title>A</title><ns>0</ns><id>1</id><revision><id>9</id><text>Hello [[B]]</text></revision></page>
<page><title>R</title><ns>0</ns><id>2</id><redirect title="A"/><revision><id>8</id><text>#REDIRECT [[A]]</text></revision></page>
<page><title>Template:T</title><ns>10</ns><id>3</id><revision><id>7</id><text>#redirect [[Template:U]]</text></revision></page></mediawiki>"""


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_dump(spark, tmp_path):
    path = put(tmp_path, "d.xml", DUMP)
    pages = wiki.read_wiki_dump(spark, path)
    assert pages.count() == 3
    assert [r.title for r in wiki.article_pages(pages).collect()] == ["A"]
    assert rows(wiki.page_redirects(pages)) == [(2, "R", "A"), (3, "Template:T", "Template:U")]
    site = wiki.read_siteinfo(spark, path)
    assert rows(site.select("ns", "name")) == [(0, ""), (10, "Template")]
    assert site.select(wiki.url_base(site)).first()[0] == "http://x.org/wiki"


def test_dictionaries(spark, tmp_path):
    titles_file = put(tmp_path, "t", "A\t1\nA\t2\nB\t3\tx\n\t9\nlone\n")
    get = lambda policy: {r.title: r.entity_id for r in X.read_titles(spark, titles_file, policy).collect()}
    assert get("exact") == {"A": "2", "": "9"} and get("nonempty") == {"A": "2", "B": "3"} and get("loose")["B"] == "3"
    titles = X.read_titles(spark, titles_file, "nonempty")
    red = put(tmp_path, "r", "5\tal\tA\n6\tal\tB\n7\tzz\tUnknown\n8\tshort\n9\tal\tB\n4\tok\tA\n")
    assert rows(X.read_redirects(spark, red, titles)) == [("4", "ok", "A"), ("5", "al", "A")]
    # an alias with several targets is out for good, also on a third row
    assert rows(D.clean_redirects(X.raw_redirects(spark, red), titles)) == [("4", "ok", "A")]
    low = put(tmp_path, "l", "a\tA\na\tB\n\tA\nu\tUnknown\n")
    assert rows(X.read_lower_map(spark, low, titles)) == [("a", "A")]
    counts = X.read_mention_counts(spark, put(tmp_path, "m", "1\tA\tx::=2\tbad\ty::=3\n1\tA\tx::=1\n2\tB\n"))
    assert rows(counts) == [("1", "A", "x", 3), ("1", "A", "y", 3)]
    assert rows(X.read_outlinks(spark, put(tmp_path, "o", "h\ta;b\nsolo\n"))) == [("h", "a"), ("h", "b")]


def test_lower_map_blocks_conflicts(spark):
    titles = spark.createDataFrame([("Apple", 1), ("APPLE", 2), ("Pear", 3)], "title string, entity_id int")
    redirects = spark.createDataFrame([(1, "pear", "Apple"), (2, "Fruit", "Apple")], "redirect_id int, alias string, title string")
    assert rows(D.unambiguous_lower_map(titles)) == [("pear", "Pear")]
    assert rows(D.extend_lower_map(titles, redirects)) == [("fruit", "Apple")]


def test_candidate_files(spark, tmp_path):
    put(tmp_path, "ppr/d1/a.txt", "CANDIDATE\tid:0\tx\nENTITY\ttext:Big Name\tq:1\nCANDIDATE\tid:7\tc:1\nCANDIDATE\tid:8\tc:2\nENTITY\ttext:Other\tx\nCANDIDATE\tid:7\tz\n")
    put(tmp_path, "ppr/.hidden", "ENTITY\ttext:No\tx\nCANDIDATE\tid:1\tz\n")
    assert rows(X.read_ppr_candidates(spark, str(tmp_path / "ppr"))) == [("Big Name", "7"), ("Big Name", "8"), ("Other", "7")]
    yago = put(tmp_path, "y", '"Caf\\u00e9"\tCaf\\u00e9_Bar\nnoquote\tX\n')
    assert rows(X.read_yago_means(spark, yago)) == [("café", "Café Bar")]


CONLL = """-DOCSTART- (1 A)
EU\tB\tEU\tx\tu\t10
rejects\t
German\tB\tGerman call\t--\tu\t11
call\tI\tGerman call\t--\tu\t11

Peter\tB\tPeter\t--NME--
Pan\tI\tPeter\t--NME--
-DOCSTART- (2 B)
last\tB\tlast\tx\tu\t12
"""


def test_conll(spark, tmp_path):
    path = put(tmp_path, "c", CONLL)
    tokens, mentions = corpora.read_conll(spark, path)
    assert rows(tokens) == [(1, 0, "eu"), (1, 1, "rejects"), (1, 2, "german call"), (1, 3, "peter"), (1, 4, "pan"), (2, 0, "last")]
    assert rows(mentions) == [(1, 0, 0, "EU", "10"), (1, 1, 2, "German call", "11"), (2, 0, 0, "last", "12")]
    offered = spark.createDataFrame([("EU", "10"), ("German call", "99")], "mention string, entity_id string")
    tokens, mentions = corpora.read_conll(spark, path, offered)
    assert rows(mentions) == [(1, 0, 0, "EU", "10")] and (1, 3, "call") in rows(tokens)


def test_evaluation_sets(spark, tmp_path):
    rel = corpora.read_relatedness(spark, put(tmp_path, "rel", "q\ta\t1\nq\ta\t0\nq\tb\t0\nbad\n"))
    assert rows(rel) == [("q", "a", 1), ("q", "b", 0)]
    ana = corpora.read_analogies(spark, put(tmp_path, "an", ": capital\na b c d\ne f g h\n: family\nm n o p\nx y\n"))
    assert rows(ana.select("section_no", "section", "a", "d")) == [(1, "capital", "a", "d"), (1, "capital", "e", "h"), (2, "family", "m", "p")]
    ws = corpora.read_wordsim(spark, put(tmp_path, "ws", "Word 1\tWord 2\tHuman\nTiger\tcat\t7.35\n"))
    assert rows(ws.select("w1", "w2", "score")) == [("tiger", "cat", 7.35)]
    scws = corpora.read_scws(spark, put(tmp_path, "sc", "1\ta\tn\tb\tn\tx <b> a </b>\ty <b> b </b>\t5.5\t1\nshort\n"))
    assert rows(scws.select("context1", "score")) == [("x <b> a </b>", 5.5)]
    put(tmp_path, "tag/x/1", "a#N b#V\n")
    assert rows(corpora.read_tagged_corpus(spark, str(tmp_path / "tag"))) == [("a#N b#V",)]


def test_ragged_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([(1, "A", f"l{i}", i + 1) for i in range(25)] + [(2, "B", "x", 4)], "entity_id long, title string, label string, n long")
    sinks.write_mention_counts(counts, str(tmp_path / "mc"), per_line=10)
    assert spark.read.text(str(tmp_path / "mc")).count() > 2
    back = X.read_mention_counts(spark, str(tmp_path / "mc"))
    assert rows(back) == rows(counts.withColumn("entity_id", F.col("entity_id").cast("string")))
    cands = spark.createDataFrame([("ab", 1), ("ab", 2), ("c", 3), ("ab", 2)], "mention string, entity_id int")
    assert sinks.write_candidates(cands, str(tmp_path / "ca")) == 2
    assert rows(X.read_candidates(spark, str(tmp_path / "ca"))) == [("ab", "1"), ("ab", "2")]


def test_other_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("short",), ("long enough line",)], "linked string")
    sinks.write_linked_text(lines, str(tmp_path / "lt"))
    assert rows(spark.read.text(str(tmp_path / "lt"))) == [("long enough line",)]
    emb = spark.createDataFrame([("a", [2.0, 4.0], 2), ("b", [1.0, 1.0], 0)], "item string, mu_sum array<double>, cluster_size long")
    sinks.write_embeddings(emb.withColumn("vec", F.col("mu_sum")), str(tmp_path / "e"), 3)
    back = spark.read.parquet(str(tmp_path / "e"))
    assert {r.item: (r.mu, r.epoch) for r in back.collect()} == {"a": ([1.0, 2.0], 3), "b": (None, 3)}
    sinks.write_bounded(lines.select(F.col("linked").alias("value")), str(tmp_path / "b"), 1, True)
    assert rows(spark.read.text(str(tmp_path / "b"))) == [("long enough line",), ("short",)]
    report = spark.createDataFrame([(0.5,)], "micro double")
    sinks.write_metrics(report, str(tmp_path / "r"), "one")
    sinks.write_metrics(report, str(tmp_path / "r"), "two")
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    table = spark.createDataFrame([("A b", "1")], "title string, entity_id string")
    sinks.write_table(table, str(tmp_path / "tt"))
    assert rows(X.read_titles(spark, str(tmp_path / "tt"))) == [("A b", "1")]


def test_files_bounded_by_bytes(spark, tmp_path):
    lines = ["é" * (i * 37 % 90) for i in range(4000)] + ["z" * 5000, "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string").repartition(3)
    sinks.write_bounded(df, str(tmp_path / "b"), 2000, column="value")
    sizes = sorted(f.stat().st_size for f in (tmp_path / "b").glob("part-*"))
    assert sizes[-1] == 5001 and sizes[-2] <= 2000
    total = sum(len((v or "").encode()) + 1 for v in lines)
    assert sum(sizes) == total and len(sizes) <= total / 1800 + 6
    assert rows(spark.read.text(str(tmp_path / "b"))) == sorted(((v or ""),) for v in lines)
    sinks.write_bounded(df.limit(0), str(tmp_path / "none"), 2000, True, "value")
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_vectors_and_features(spark, tmp_path):
    senses = spark.createDataFrame([("w", "a", [1.0, 2.0], [1.0, 1.0]), ("w", "b", [float("nan"), 1.0], [1.0, 1.0]), ("w", "c", [1.0, 1.0], [float("inf"), 0.0])],
                                   "space string, item string, vec array<double>, mu array<double>")
    senses.write.parquet(str(tmp_path / "v"))
    assert [r.item for r in tables.read_embeddings(spark, str(tmp_path / "v"), "w").collect()] == ["a"]
    cells = ["1", "0", "7", "8", "2", "", "0.5"] + ["0"] * (len(FE.COLUMNS) - 7)
    back = tables.read_features(spark, put(tmp_path, "f.csv", ",".join(cells) + "\n")).first()
    assert (back.doc_id, back.wiki_id, back.pem, back.pe) == (1, "7", 0.0, 0.5)
    assert tables.read_vocab(spark, put(tmp_path, "voc", "</s>\t3\nthe\t2\n")).count() == 2
