import math
import random

import numpy as np
import pytest

from korpusa.llm import knn as K


def brute(rows, k=5, every=50):
    ok = [(i, v, [math.floor(256 * float(np.float32(x))) for x in e]) for i, (v, e) in enumerate(rows) if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in ok:
        if v % every == 0:
            c = sorted((-sum(a * b for a, b in zip(q, s)), w) for j, w, s in ok if j != i)[:k]
            out += [(v, r + 1, w, -n) for r, (n, w) in enumerate(c)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(v, e, "x", 1.5) for v, e in rows], "vec_id long, embedding array<float>, cell string, dist double")
    return sorted(tuple(r) for r in K.top_k(df, **kw).collect())


@pytest.mark.parametrize("limits", [((48, 2048), 1024, 16384, 2048), ((5, 5), 3, 40, 7), ((2, 100), 20, 60, 9)])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("PIVOTS", "QUERIES", "ROWS", "CHUNK"), limits):
        monkeypatch.setattr(K, name, value)
    rng = random.Random(6)
    vec = lambda n=8: [rng.gauss(0, 1) for _ in range(n)]
    hot = vec()
    rows = [(i * 5, vec() if i % 3 else hot) for i in range(300)]
    rows += [(1, None), (50, [1.0, None]), (100, [float("nan")] * 8), (150, [float("inf")] * 8), (None, vec()), (7, vec(3)), (9, []), (0, hot), (0, hot), (2000, [0.0] * 8), (2050, [1000.0] * 8)]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.5, 1.0]), (3, [2.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == [] and run(spark, rows[2:]) == [] and run(spark, [(4, None)]) == []


def test_query_on_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, K.query(spark, sf).collect())) == brute(rows)


def test_clustered_vectors_are_not_sent_everywhere(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERIES", 8)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (20, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    e = np.repeat(centres, 100, axis=0) + rng.normal(0, 0.01, (2000, 6))
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(e)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert K.share_sent(df) < 0.5
    assert sorted(map(tuple, K.top_k(df).collect())) == brute(rows)


def test_large_components(spark):
    got = run(spark, [(0, [3e18, 0.0]), (50, [1.0, 1.0]), (3, [2.0, 2.0])])
    assert {r[0] for r in got} == {0, 50}
