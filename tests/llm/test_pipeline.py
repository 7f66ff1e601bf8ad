"""The stages on planted cases: what each one must catch and what must stay."""

import random

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(11)
    words = ["".join(r.choice(["ba", "lo", "mi", "ter", "sun", "é"]) for _ in range(r.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(70)
    texts = {i: prose(160) for i in range(30)}
    texts |= {100: texts[0], 101: texts[0], 102: texts[1] + " end"}
    texts |= {i: f"{prose(90)} {passage} {prose(90)}" for i in (200, 201, 202)}
    texts |= {300: "too short", 301: "### $$$ " * 100, 302: None, 303: "", 304: " ".join(["same line here again"] * 60)}
    return [(i, t, "en", ["a", "a", "b", None][i % 4], len(t or "")) for i, t in texts.items()], passage


def test_stages(spark, tmp_path):
    rows, passage = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for number, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept[name] = docs.collect()
        assert number == 4 or docs.columns == columns
    ids = {name: {r.doc_id for r in found} for name, found in kept.items()}
    assert not ids["quality_rules"] & {300, 301, 302, 303, 304} and set(range(30)) <= ids["quality_rules"]
    assert not ids["simhash_near_dedup"] & {100, 101, 102} and set(range(30)) <= ids["simhash_near_dedup"]
    left = {r.doc_id: r.text for r in kept["suffix_array_dedup"]}
    assert all(passage not in left[i] and len(left[i].split()) >= 150 for i in (200, 201, 202))
    before = {r.doc_id: r.text for r in kept["simhash_near_dedup"]}
    assert all(left[i] == before[i] for i in range(30))
    assert all(r.n_chars == len(r.text) for r in kept["suffix_array_dedup"])
    assert all(r.round_trip and len(r.ids) == r.n_pieces for r in kept["sentencepiece_encoding"])
    assert len(kept["sentencepiece_encoding"]) == len(kept["mix_sources"])
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == sorted(map(str, kept["sentencepiece_encoding"]))


def test_columns_of_any_name_pass_through(spark):
    rows, _ = documents()
    extra = ["_x", "common", "spans", "_rows", "document", "kept", "_row", "size", "copies", "row_key", "_text", "odd.name"]
    schema = SCHEMA + ", " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in extra]) for r in rows], schema)
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in extra)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
