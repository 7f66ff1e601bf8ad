"""Markup rules, one fixture line per rule."""

import pytest
from pyspark.sql import functions as F

from lorelink.functions import text as X
from lorelink.functions.links import balanced_spans, link_segments
from lorelink.operators import markup as M

CASES = [
    ("a {{x|{{y}}}} b", "a b"),
    ("a {{one}} b {{two}} c", "a b c"),
    ("open {{ stays", "open {{ stays"),
    ("t {| class=x\n|-\n| 1 |} u", "t u"),
    ("see [http://x.org/a the site] now", "see the site now"),
    ("[[Paris]] rocks", "[[Paris|paris]] rocks"),
    ("the [[Paris (city)|Big City]]s end", "the [[Paris (city)|big city]] end"),
    ("glued[[b]] x", "[[b]] x"),
    ("x [[File:a.png|thumb|see [[Rome]]]] y", "x y"),
    ("x [[wikt:word|Word]] y", "x word y"),
    ("x [[:File:a.png]] y", "x y"),
    ("__TOC__text", "text"),
    ("'''bold''' and ''it'' and '''''both'''''", "bold and \"it\" and both"),
    ("a<!-- c -->b", "ab"),
    ("a<br/>b <b>c</b> <ref name=x>gone</ref>d", "ab c d"),
    ("<div>x<div>y</div>z</div>kept", "kept"),
    ("<math>a</math> <math>b</math> <math>a</math> <code>q</code>", "formula_1 formula_2 formula_1 codice_1"),
    ("5 &lt; 6 &amp; &#65;&#x42; &eacute;", "5 < 6 & AB é"),
    ("a << b >> c", "a «b» c"),
    ("wait..... ok", "wait... ok"),
    ("a ,, b", "a, b"),
]


def test_strip_markup_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "page_id int, text string")
    got = {r.page_id: r.text for r in M.strip_markup(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_steps_are_not_repeated_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "page_id int, text string")
    plan = M.strip_markup(df)._jdf.queryExecution().optimizedPlan().toString()
    # A pattern of one of the middle steps, once for the scanner's input and once for the result.
    assert 1 <= plan.count("<!--.*?-->") <= 2
    assert plan.count("__NOTOC__") <= 2


def test_adjacent_links_stay_apart(spark):
    texts = ["[[Ada]][[Bob]]", "[[Ada]]s[[Bob]] x", "[[Ada]] [[Bob]]", "glued[[Ada]]", "see (x[[Ada]])", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for keep, want in ((False, ["ada bob", "ada bob x", "ada bob", "ada", "see ( ada)", None, ""]), (True, ["[[Ada|ada]] [[Bob|bob]]", "[[Ada|ada]] [[Bob|bob]] x", "[[Ada|ada]] [[Bob|bob]]"])):
        out = df.withColumn("got", M._rewrite_links("t", F.lit(keep))).orderBy("id").collect()
        assert [r.got for r in out][: len(want)] == want


def test_links_dropped_when_not_kept(spark):
    df = spark.createDataFrame([(1, "the [[Paris|City of 1889]] end")], "page_id int, text string")
    assert M.strip_markup(df, keep_links=False).first().text == "the city of dddddd end"


def test_long_text_does_not_overflow(spark):
    body = "{{" + "x" * 300_000 + "}} [[" + "y" * 200_000 + "]] <div>" + "z" * 300_000 + "</div> end"
    out = M.strip_markup(spark.createDataFrame([(1, body)], "page_id int, text string"), keep_links=False).first().text
    assert out.strip() == "y" * 200_000 + " end"


def test_compact_sections(spark):
    text = "Intro\n== Empty ==\n== Full ==\n=== Sub ===\nBody\n* item\n: indent\n{| rest\n(note)\n--\nMore\n"
    df = spark.createDataFrame([(text,)], "t string")
    lines = lambda **o: df.select(M.compact_sections(F.col("t"), **o)).first()[0]
    assert lines() == ["Intro", "Full.", "Sub.", "Body", "{| rest", "More"]
    assert lines(keep_sections=False) == ["Intro", "Body", "{| rest", "More"]
    assert lines(keep_lists=True) == ["Intro", "Full.", "Sub.", "Body", "- item", "{| rest", "More"]


def test_code_keeps_its_references_once(spark):
    body = "a &amp;lt; &lt;syntaxhighlight lang=c&gt;x &amp;lt; y &amp;amp;lt; z&lt;/syntaxhighlight&gt; b &amp; &lt;syntaxhighlight l&gt;&#65;&lt;/syntaxhighlight&gt;"
    df = spark.createDataFrame([(1, body), (2, "no &lt;syntax &#66;"), (3, None)], "page_id int, text string")
    got = {r.page_id: r.text for r in df.select("page_id", M.unescape_outside_code(F.col("text")).alias("text")).collect()}
    assert got == {1: "a &lt; x &amp;lt; y &amp;amp;lt; z b & &#65;", 2: "no <syntax B", 3: None}


def test_clean_pages(spark):
    df = spark.createDataFrame([(7, "Born in 1900, [[Rome|ROME]] (x).\n\n== S ==\nNext: [[A]]!")], "page_id int, text string")
    rows = [(r.line_no, r.line) for r in M.clean_pages(df).orderBy("line_no").collect()]
    assert rows == [(0, "born in dddddd [[Rome|rome]] x "), (1, "s "), (2, "next [[A|a]] ")]


@pytest.mark.parametrize("text", ["", "a", "[[a]]", "x[[a|b]]y[[c]]", "[[a [[b]] c]] d [[e]]", "]] [[a]]", "[[a [[b]]", "[[[a]]]", "a [[b"])
def test_segments_match_the_scanner(spark, text):
    pieces = spark.createDataFrame([(text,)], "t string").select(link_segments(F.col("t"))).first()[0]
    assert "".join(p.text for p in pieces) == text
    assert [p.text for p in pieces if p.is_link] == [text[a:b] for a, b in balanced_spans(text)]


def test_tagged_line(spark):
    lines = ["a#N 3#NUMBER 4#NUMBER b_c#V d#X e#Y f#Z", "too#A few#B", "1#NUMBER b#N c#N d#N e#N", "x y z q r#A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.clean_tagged_line(F.col("t")).alias("c")).collect()}
    assert got == {0: "a dddddd b c d e f", 1: None, 2: "dddddd b c d e", 3: None}


def test_titles_and_phrases(spark):
    df = spark.createDataFrame([(" wiki_page  x ", "Mercury (planet)", "It's 1999, ok\t2nd")], "a string, b string, c string")
    row = df.select(
        X.normalize_title(F.col("a"), ["Template"]).alias("title"), X.entity_title(F.col("b")).alias("e"),
        X.entity_title_prefix(F.col("b")).alias("p"), X.normalize_phrase(F.col("c")).alias("n"),
        X.normalize_title(F.lit("template: foo bar"), ["Template"]).alias("ns"), X.normalize_title(F.lit("other: foo"), ["Template"]).alias("o"),
        X.page_url("http://x/w", F.lit(12)).alias("u"), X.title_text_form(F.lit("a\tb")).alias("tf"), X.escape_markup(F.lit("<a&b>")).alias("esc"),
    ).first()
    assert tuple(row) == ("Wiki page x", "Mercury", "Mercury", "it s dddddd ok 2nd", "Template:Foo bar", "Other: Foo", "http://x/w?curid=12", "a b", "&lt;a&amp;b&gt;")
