"""Exact cosine search of a stated query set, in blocks of queries and data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most queries and data vectors of one block, and queries whose scores a task holds at a time.
QUERIES, ROWS, ASKED = 1024, 32_768, 64


def top_cosine(data: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: k most similar rows of ``data(id, vec)`` for each of ``queries(query_id, vec)``.

    ``same`` names a column that both must agree on (a payload filter, applied before ranking). Vectors
    that are null or hold nulls take no part; a vector of length zero scores 0. Scores are rounded to 6 places, ties go to the smaller id.
    """
    whole = lambda df: df.where("vec is not null and not exists(vec, x -> x is null)")
    data, queries = whole(data), whole(queries)
    blocks, parts = max(1, -(-queries.count() // QUERIES)), max(1, -(-data.count() // ROWS))
    keep = [same] if same else []
    q = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), *keep).withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    d = data.select("id", F.col("vec").cast("array<double>").alias("vec"), *keep).withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    q = q.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        rows = column.combine_chunks()
        size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, width = rows.flatten().to_numpy(zero_copy_only=False), int(size.max(initial=0))
        out = np.zeros((len(rows), width))
        out[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        norm = np.linalg.norm(out, axis=1)
        return out / np.where(norm == 0, 1, norm)[:, None]

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = matrix(left["vec"]), matrix(right["vec"])
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        ids, out = right["id"].to_numpy(), ([], [], [])
        labels = (left[same].to_numpy(zero_copy_only=False), right[same].to_numpy(zero_copy_only=False)) if same else None
        scores = (row for at in range(0, len(a), ASKED) for row in np.round(a[at : at + ASKED] @ b.T, 6) + 0.0)
        for i, (qid, s) in enumerate(zip(left["query_id"].to_pylist(), scores, strict=True)):
            at = np.flatnonzero(labels[1] == labels[0][i]) if labels else np.arange(len(ids))
            best = at[np.lexsort((ids[at], -s[at]))[:k]]
            out[0].extend([qid] * len(best))
            out[1].extend(ids[best].tolist())
            out[2].extend(s[best].tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])

    short = q.groupBy("b", "p").cogroup(d.groupBy("b", "p")).applyInArrow(local, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return short.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
