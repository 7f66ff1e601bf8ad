"""The classifier chain: held-out accuracy, out-of-fold training, and what the fit minimises."""

import random

import numpy as np

from lorelink.llm import toxicity as tox
from lorelink.llm.queries import op6_toxicity_chain

SCHEMA = "doc_id long, text string, p_toxic string"
BAD = {"insult": ["idiot", "moron"], "threat": ["crush", "smash"]}


def corpus(seed, n=400):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(["ta", "ro", "mi", "ne", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 80))]
        insult, threat = r.random() < 0.3, r.random() < 0.2
        for kind, there in (("insult", insult), ("threat", threat)):
            for _ in range(3 if there else 0):
                words.insert(r.randrange(len(words)), r.choice(BAD[kind]) + r.choice(["", "s!", ","]))
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(insult), int(threat), int(insult or threat)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    df = spark.createDataFrame(docs, SCHEMA)
    chain = tox.train(df, spark.createDataFrame(labels, "doc_id long, insult int, threat int, toxic int"), ["insult", "threat", "toxic"])
    fresh, truth = corpus(2)
    out = {r.doc_id: r for r in tox.score(spark.createDataFrame(fresh, SCHEMA), chain).collect()}
    right = [out[i].toxic == bool(t) for i, _, _, t in truth]
    assert sum(right) / len(right) > 0.97
    assert all((out[i].p_insult > 0.5) == bool(x) for i, x, _, _ in truth[:100])
    # The last classifier has learned from the earlier ones.
    assert (chain.before[2] > 0).all()


def test_out_of_fold_rows_are_unseen():
    """A feature that names each row fits training rows; out of fold it must not help."""
    n = 200
    y = (np.random.default_rng(0).random(n) < 0.5).astype(float)
    row = np.repeat(np.arange(n), 5)
    chain = tox.fit_chain(row, np.arange(5 * n), np.ones(5 * n, np.float32), {"a": y, "b": y}, np.arange(n) % 4, most_features=5 * n)
    assert len(chain.out_of_fold) == n and abs(np.corrcoef(chain.out_of_fold[:, 0], y)[0, 1]) < 0.5


def test_logistic_reaches_the_minimum():
    r = np.random.default_rng(1)
    dense = r.random((80, 5)) * (r.random((80, 5)) < 0.6)
    y = (dense @ np.array([3, -2, 0, 1, -1]) + r.normal(size=80) * 0.3 > 0.4).astype(float)
    row, column = np.nonzero(dense)
    x = tox.Matrix(row, column, dense[row, column], 80, 5)
    w = tox.logistic(x, np.zeros((80, 0)), y, ridge=1.0, steps=3000)
    error = 1 / (1 + np.exp(-(dense @ w[:5] + w[5]))) - y
    gradient = np.r_[dense.T @ error + w[:5], error.sum()]
    assert np.abs(gradient).max() < 1e-3


def test_sample_is_bounded_and_edges(spark):
    docs, labels = corpus(3, 60)
    table = spark.createDataFrame([*labels, (None, 1, 1, 1), (0, None, 1, 0), (999, 1, 1, 1)], "doc_id long, insult int, threat int, toxic int")
    assert tox.labelled_sample(table, ["toxic"], 10).count() == 10
    df = spark.createDataFrame(docs, SCHEMA)
    chain = tox.train(df, table, ["insult", "toxic"], most_rows=50)
    odd = spark.createDataFrame([(1, None, ""), (1, "", ""), (2, "idiot " * 20000, ""), (None, " \n", "")], SCHEMA)
    out = tox.score(odd, chain).collect()
    assert len(out) == 4 and [r.toxic for r in out if r.doc_id == 2] == [True]
    assert tox.score(df.limit(0), chain).collect() == []
    nothing = tox.train(df, table.limit(0), ["insult", "toxic"])
    assert not any(r.toxic for r in tox.score(df, nothing).collect())


def test_query_tells_insult_from_contempt(spark, tmp_path):
    r = random.Random(5)
    docs, labels, kinds = [], [], {}
    for i in range(400):
        words = ["".join(r.choice(["ta", "ro", "mi", "ne", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 60))]
        kinds[i] = r.choice(["insult", "contempt", "none", "none"])
        for word in {"insult": ["idiot", "Moron!", "clown,"], "contempt": ["stupid", "Trash.", "pathetic,"]}.get(kinds[i], []):
            words.insert(r.randrange(len(words)), word)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kinds[i] != "none")))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for row in op6_toxicity_chain(spark, str(tmp_path)).collect():
        assert (row.p_insult > 0.5) == (kinds[row.doc_id] == "insult")
        assert (row.p_contempt > 0.5) == (kinds[row.doc_id] == "contempt")
