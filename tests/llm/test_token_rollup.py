"""Rollups against plain sums: signs, repeated batches, interrupted commits, compaction; counts against the tokenizer."""

import random
from collections import defaultdict

import tiktoken

from lorelink.llm import token_rollup as tr
from lorelink.llm.queries import BYTE_PATTERN, TOKENIZERS

SIDE = "struct<source:string,lang:string,tokenizer:string,tokens:long,chars:long>"
SCHEMA = f"before {SIDE}, after {SIDE}, note string"


def changes(seed, n=80):
    r = random.Random(seed)
    side = lambda: (r.choice(["a", "b", None]), r.choice(["en", "de"]), r.choice(["v1", "v2"]), r.choice([None, r.randint(0, 50)]), r.randint(0, 99))
    return [(side() if r.random() < 0.6 else None, side() if r.random() < 0.7 else None, "x") for _ in range(n)]


def sums(*batches):
    out = defaultdict(lambda: [0, 0, 0])
    for batch in batches:
        for before, after, _ in batch:
            for sign, side in ((-1, before), (1, after)):
                if side:
                    for i, v in enumerate((1, side[3] or 0, side[4])):
                        out[side[:3]][i] += sign * v
    return sorted(((k, tuple(v)) for k, v in out.items() if any(v)), key=repr)


def got(rollup):
    return sorted((((r.source, r.lang, r.tokenizer), (r.docs, r.tokens, r.chars)) for r in rollup.totals().collect()), key=repr)


def test_batches_count_once(spark, tmp_path):
    rollup = tr.Rollup(spark, f"file://{tmp_path}/r")
    one, two, three = (spark.createDataFrame(changes(s), SCHEMA) for s in (1, 2, 3))
    assert got(rollup) == []
    assert rollup.commit("one", one) and not rollup.commit("one", two)
    assert got(rollup) == sums(changes(1))
    assert rollup.commit("two", two)
    rollup.compact()
    assert got(rollup) == sums(changes(1), changes(2))
    assert not rollup.commit("two", two) and rollup.commit("three", three) and rollup.commit("empty", one.limit(0))
    rollup.compact()
    assert got(tr.Rollup(spark, f"file://{tmp_path}/r")) == sums(changes(1), changes(2), changes(3))


def test_interrupted_commits_are_not_read(spark, tmp_path):
    rollup = tr.Rollup(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame(changes(1), SCHEMA)
    rollup.commit("one", one)
    one.select("note").write.parquet(f"{tmp_path}/r/deltas/two-dead")  # written, never committed
    (tmp_path / "r/commits/two").write_text("")  # the driver died in the marker
    assert got(rollup) == sums(changes(1))
    assert rollup.commit("two", one) and got(rollup) == sums(changes(1), changes(1))


def test_inverse_changes_cancel(spark, tmp_path):
    rollup = tr.Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("there", spark.createDataFrame(changes(4), SCHEMA))
    rollup.commit("back", spark.createDataFrame([(a, b, n) for b, a, n in changes(4)], SCHEMA))
    assert got(rollup) == []


def test_token_counts(spark):
    name, path = "byte_bpe_50k", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    texts = ["Hello world's 12 Größe", "", None, " \n\t", "x" * 3000, "<|endoftext|>", "Hello world's 12 Größe"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' AS n_tokens")
    out = {r.doc_id: r.n_tokens for r in tr.count_tokens(df, path, BYTE_PATTERN, name).collect()}
    import base64

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("test", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert out == {i: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert tr.count_tokens(df.limit(0), path, BYTE_PATTERN, name).collect() == []


def test_batch_committed_during_compaction_counts_once(spark, tmp_path):
    image = "struct<source:string,lang:string,tokenizer:string,tokens:bigint,chars:bigint>"
    changes = lambda n: spark.createDataFrame([(None, ("a", "en", "t", n, n))], f"before {image}, after {image}")
    rollup, other = (tr.Rollup(spark, f"{tmp_path}/r") for _ in range(2))
    rollup.commit("one", changes(10))
    plain = rollup._totals

    def meanwhile(base, commits):
        assert other.commit("two", changes(5))
        return plain(base, commits)

    rollup._totals = meanwhile
    rollup.compact()
    assert [r.tokens for r in other.totals().collect()] == [15]
    other.compact()
    assert [r.tokens for r in other.totals().collect()] == [15]
