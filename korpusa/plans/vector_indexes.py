"""Queries of the stored vector index: its recall, with and without a filter, and what its lists hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..operators.vector_index import VectorIndex, recall
from ..sources.formats import shared_path, written
from .retrieval import K, _vectors


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """All vectors in two batches, read again from the files."""
    data, _ = _vectors(spark, sf_dir)
    index = VectorIndex.create(spark, shared_path(spark, "vector-index"), data.where("id % 4 <> 1"), same="label", k=K).add(data.where("id % 4 = 1"), same="label")
    return VectorIndex.load(spark, index.path)


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against exact search for the queries of vector_topk, and the share of cells it probes."""
    (data, asked), index = _vectors(spark, sf_dir), _index(spark, sf_dir)
    cells = len(index.model.centres)

    def one(same: str | None) -> DataFrame:
        found = written(index.search(asked, K, same), "vector-found")
        probes = index.model.probes_filtered if same else index.model.probes
        return recall(found, vectors.top_cosine(data, asked, K, same=same)).select(F.lit(same or "").alias("filter"), "*", F.lit(round(min(1.0, probes / cells), 4)).alias("share_probed"))

    return one(None).unionByName(one("label"))


def vector_index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label as the lists hold them: every valid row, once."""
    rows = _index(spark, sf_dir).lists().select(F.explode(F.arrays_zip("ids", "labels")).alias("x"))
    return rows.groupBy(F.col("x.labels").cast("bigint").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("x.ids").alias("ids"), F.sum("x.ids").alias("total"))


QUERIES = {f.__name__: f for f in (vector_index_recall, vector_index_lists)}
ORACLES = {
    "vector_index_lists": "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, count(DISTINCT vec_id) AS ids, CAST(sum(vec_id) AS BIGINT) AS total FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) GROUP BY 1"
}
