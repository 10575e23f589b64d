import numpy as np
import pytest

from korpusa.operators import vector_index, vectors
from korpusa.operators.vector_index import VectorIndex, recall

SCHEMA = "id long, vec array<double>, label string, extra string"


def made(spark, many=1500, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = [(i, (centres[i % 12] + rng.normal(size=width) * 0.6).tolist(), f"l{i // 12 % 3}", "x") for i in range(many)]
    return spark.createDataFrame(rows, SCHEMA)


def asked_of(data):
    return data.where("id % 25 = 0").withColumnRenamed("id", "query_id")


@pytest.mark.parametrize("same", [None, "label"])
def test_recall_after_batches_and_load(spark, tmp_path, same):
    data = made(spark).cache()
    index = VectorIndex.create(spark, str(tmp_path / "v"), data.where("id % 5 > 0"), same="label", k=5).add(data.where("id % 5 = 0"), same="label")
    index = VectorIndex.load(spark, index.path)
    got, exact = index.search(asked_of(data), 5, same).cache(), vectors.top_cosine(data, asked_of(data), 5, same=same).cache()
    assert recall(got, exact).first().recall >= 0.9
    assert index.model.probes < len(index.model.centres)
    # a score that is there is the exact one
    pairs = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(pairs[r.query_id, r.id] - r.score) < 2e-6 for r in got.collect() if (r.query_id, r.id) in pairs)
    if same:
        label = {r.id: r.label for r in data.collect()}
        assert all(label[r.query_id] == label[r.id] for r in got.collect())


def test_all_cells_probed_equals_exact(spark, tmp_path):
    data = made(spark, 400).cache()
    index = VectorIndex.create(spark, str(tmp_path / "v"), data, k=5)
    index.model = vector_index.Model(index.model.centres, index.model.reach, index.model.error, len(index.model.centres), len(index.model.centres))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in df.collect())
    assert rows(index.search(asked_of(data), 5)) == rows(vectors.top_cosine(data, asked_of(data), 5))


def test_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST", 8)
    monkeypatch.setattr(vector_index, "LISTS", 2)
    one = [1.0, 0.0, 0.0]
    odd = [(1, None, "a", ""), (2, [1.0, None, 0.0], "a", ""), (3, [float("nan"), 0.0, 0.0], "a", ""), (4, [0.0, 0.0, 0.0], "a", ""), (5, [1.0, 0.5], "a", ""), (6, [0.0, 1.0, 0.0, 9.0], "a", ""), (7, one, None, "")]
    copies = [(100 + i, one, "b", "") for i in range(60)] + [(90, one, "b", ""), (90, one, "b", "")]
    data = spark.createDataFrame(odd + copies, SCHEMA)
    index = VectorIndex.create(spark, str(tmp_path / "v"), data, same="label", k=3)
    sizes = [len(r.ids) for r in index.lists().collect()]
    assert sum(sizes) == len(odd) - 3 + len(copies) and max(sizes) <= 8
    ask = spark.createDataFrame([(1, one, "b"), (2, None, "b"), (3, one, None), (4, [0.0, 0.0, 0.0], "b")], "query_id long, vec array<double>, label string")
    got = index.search(ask, 3).collect()
    # ties go to the smaller id, a repeated id is there twice, a zero vector scores 0
    assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == [(7, 1.0), (90, 1.0), (90, 1.0)]
    assert {r.query_id for r in got} == {1, 3, 4} and {r.score for r in got if r.query_id == 4} == {0.0}
    assert {r.query_id for r in index.search(ask, 3, "label").collect()} == {1, 4}  # a null label equals nothing


def test_empty(spark, tmp_path):
    data = made(spark, 30)
    none = data.where("id < 0")
    index = VectorIndex.create(spark, str(tmp_path / "e"), none)
    assert index.search(asked_of(data), 3).count() == 0
    assert VectorIndex.create(spark, str(tmp_path / "f"), data).search(asked_of(none), 3).count() == 0
