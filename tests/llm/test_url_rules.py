"""URL rules against a plain loop, in one cell and in many."""

import random

import pytest

from lorelink.llm import url_rules
from lorelink.llm.queries import OP7_SQL, RULES as REGISTERED, op7_url_rules
from tests.oracle import compare, connect

RULES = "host string, path string, verdict string"


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:stop]


def judge(url, rules):
    host, path = parse(url)
    fit = [(-len(h + (p or "")), -len(h), h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = min(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def case(seed, n=400):
    r = random.Random(seed)
    label = lambda: r.choice(["com", "org", "net", "a", "a-b", "b", "x0", "www"])
    host = lambda k: ".".join(label() for _ in range(r.randint(1, k)))
    path = lambda: r.choice(["", "/", "/a", "/a/b", "/en/", "/en/7"])
    rules = [(host(3), r.choice([path(), None]), r.choice(["allow", "block"])) for _ in range(60)] + [(None, "/x", "block"), ("", "/", "block")]
    urls = [f"http://{host(4)}{path()}{r.choice(['', '?q=http://com/en/', '#x', 'z'])}" for _ in range(n)]
    urls += [None, "", "no scheme", "://", "HTTP://WWW.COM/EN/", "http://com", "x://a?b", "http://ÀB.com/en/7", "http://com:80/a"] + ["http://www.a.com/en/7"] * 200
    return urls, rules


@pytest.mark.parametrize("per_cell, urls_per_cell", [(5000, 200_000), (5000, 20), (4, 30), (1, 1000)])
def test_against_a_loop(spark, per_cell, urls_per_cell):
    urls, rules = case(per_cell + urls_per_cell)
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "id long, url string, rule string").repartition(3)
    out = url_rules.judged(df, spark.createDataFrame(rules, RULES), rules_per_cell=per_cell, urls_per_cell=urls_per_cell).collect()
    assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: judge(u, rules) for i, u in enumerate(urls)} and len(out) == len(urls)


def test_empty_tables(spark):
    rules, none = spark.createDataFrame([("com", "/", "block")], RULES), spark.createDataFrame([], RULES)
    pages = spark.createDataFrame([(1, "http://com/")], "id long, url string")
    assert url_rules.judged(pages.limit(0), rules).collect() == []
    assert [(r.rule, r.verdict) for r in url_rules.judged(pages, none).collect()] == [(None, "allow")]


def test_query_against_sql(spark, folder):
    assert compare(spark, connect(folder), folder, op7_url_rules, OP7_SQL)[0] is None


def test_registered_rules(spark, tmp_path):
    """Each rule of the contract with its word, allow or block; page 9 fits none."""
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "http://a.net/de/1", "http://b.example.net/de/8", "http://org/es/", "http://org/en/"]
    spark.createDataFrame(list(enumerate(urls, 4)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: (r.rule, r.verdict) for r in op7_url_rules(spark, str(tmp_path)).collect()}
    assert out == {
        4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"), 6: ("net/de/", "allow"),
        7: ("example.net/de/8", "block"), 8: ("org/es/", "block"), 9: (None, "allow"),
    }
    assert {v for v in out.values()} - {(None, "allow")} == {(h + p, v) for h, p, v in REGISTERED}
