"""Near-duplicate vectors against brute force over all pairs."""

import math

import numpy as np
import pytest

from lorelink.llm import sign_hash
from lorelink.llm.queries import op12_embedding_near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def by_definition(rows, least=0.9):
    """Rows (id, vector or None) to (links, component) by place."""
    n = len(rows)
    usable = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    vecs = [np.array(v, np.float32).astype(float) if ok else None for (_, v), ok in zip(rows, usable)]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and len(vecs[i]) == len(vecs[j]):
                if vecs[i] @ vecs[j] / math.sqrt((vecs[i] @ vecs[i]) * (vecs[j] @ vecs[j])) >= least:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((len(links[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return out


def groups(rng, n, dim, spread=0.25):
    """Vectors in groups, close enough for links and chains, and some alone."""
    rows = []
    while len(rows) < n:
        centre = rng.standard_normal(dim)
        rows += [centre * rng.uniform(0.5, 3) + rng.standard_normal(dim) * rng.uniform(0, spread) * np.linalg.norm(centre) / math.sqrt(dim) for _ in range(int(rng.integers(1, 9)))]
    return [r.astype(np.float32).tolist() for r in rows[:n]]


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sign_hash.near_vectors(frame, **options).collect()


@pytest.mark.parametrize("options", [{}, {"small": 8, "largest": 60}])
def test_groups(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(groups(rng, 400, 24))]
    want = by_definition(rows)
    got = {r.vec_id: r for r in run(spark, rows, **options)}
    exact = sum(got[i].n_links == w[0] for i, w in enumerate(want))
    found, every = sum(r.n_links for r in got.values()), sum(w[0] for w in want)
    assert every > 500 and found <= every and found >= 0.97 * every and exact >= 0.95 * len(rows)
    assert all(got[i].n_links <= w[0] and got[i].component_id >= w[1] for i, w in enumerate(want))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pairs_at_the_limit(spark):
    # One pair just above and one just below the limit, which one byte per component cannot tell apart.
    rows = []
    for k, cosine in enumerate((0.9 + 3e-7, 0.9 - 3e-7, 0.97, 0.8)):
        a, b = np.zeros(16), np.zeros(16)
        a[2 * k], b[2 * k], b[2 * k + 1] = 1, cosine, math.sqrt(1 - cosine * cosine)
        rows += [(10 * k, a.tolist()), (10 * k + 1, b.tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, rows)}
    assert got == {i: w for (i, _), w in zip(rows, by_definition(rows))} and got[0][0] == 1 and got[10][0] == 0


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, -3.0]
    rows = [
        (7, v), (3, v), (3, v), (None, v), (5, [2.0, 4.0, -6.0]), (9, [-1.0, -2.0, 3.0]), (1, None), (2, []), (4, [0.0, 0.0, 0.0]), (6, [0.0, 0.0, 0.0]),
        (8, [1.0, None, 2.0]), (10, [1.0, nan, 2.0]), (11, [inf, 1.0, 1.0]), (12, [1.0, 2.0]), (None, [5.0, 0.0, 0.0]), (13, [-0.0, 0.0, 1e-30]), (14, [0.0, 0.0, 1e30]),
    ]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in run(spark, rows) if r.vec_id is not None)
    want = sorted((i, *w, i == w[1]) for (i, _), w in zip(rows, by_definition(rows)) if i is not None)
    assert got == want and got[2] == (3, 4, 3, True)
    unnamed = sorted((r.n_links, r.component_id, r.kept) for r in run(spark, rows) if r.vec_id is None)
    assert unnamed == [(0, None, True), (4, 3, False)]
    assert run(spark, []) == []
    assert {r.kept for r in run(spark, [(1, None), (2, None)])} == {True}


def test_large_tables_join_rows_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sign_hash, "fits_broadcast", lambda *a: False)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(groups(rng, 60, 8))] + [(100, None), (101, [0.0] * 8)]
    assert sorted((r.vec_id, r.n_links) for r in run(spark, rows)) == [(i, w[0]) for (i, _), w in zip(rows, by_definition(rows))]


def test_table_plan_reaches_the_recall():
    for n in (1, 10**5, 10**7, 10**9):
        tables, bits = sign_hash.table_plan(n)
        meet = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - meet) ** tables >= sign_hash.RECALL and 4 <= bits <= 8


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(groups(rng, 500, 64, 0.3))]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in op12_embedding_near_duplicates(spark, str(tmp_path)).collect()}
    want = by_definition(rows)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(w[0] for w in want)
    assert sum((got[i].n_links, got[i].component_id) == w for i, w in enumerate(want)) >= 0.97 * len(rows)
