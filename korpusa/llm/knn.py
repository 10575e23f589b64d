"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are quantised to integers; adding one coordinate sqrt(M^2 - |s|^2) to every data vector (M: the
largest norm) turns largest inner product into smallest Euclidean distance, where the join's bounds
hold. Queries and data are put in the cell of their nearest pivot. Summaries of the cells (counts,
distance ranges, the k + 1 smallest distances) give every query cell an upper bound on its k-th
neighbour's distance; a data vector is sent to a group of query cells only if the triangle inequality
leaves it a chance. Each (query group, data block) is solved on its own, cell by cell, skipping cells
that cannot improve a query, and a last ranking merges the blocks' short lists.

Pivots: as many as the square root of the table's rows (PIVOTS[0] at least, PIVOTS[1] at most), chosen by
hash; they affect speed, never results. A task holds at most about QUERIES queries and ROWS data
vectors, hot cells included, since groups and blocks are cut by hash. A group takes neighbouring query
cells until it is full, because the union of two cells' needs is never more than their sum.

``share_sent`` says which part of all (data vector, query group) pairs the bounds let through. Vectors
without structure (isotropic, many dimensions) leave the triangle inequality nothing to prune: then the
share is 1, every group meets all data in blocks, and the join is an exact blocked scan.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors are as if padded with zeros; repeated rows are separate candidates and separate queries; ties
go to the smaller vec_id; a scaled component that fits no long is held at the nearest one, and scores wrap at 64 bits; rows without vec_id take no part; fewer than k candidates are all returned;
an empty table gives an empty result; of the input only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

PIVOTS, QUERIES, ROWS, CHUNK = (48, 2048), 4096, 16_384, 1024
SCALE, EVERY = 256, 50


def quantised(vectors: DataFrame) -> DataFrame:
    """``(rid, vec_id, vec)`` of the rows that take part; vec is packed int64, padded to the longest."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("embedding")
            sizes = e.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = e.flatten().to_numpy(zero_copy_only=False)
            m = np.zeros((len(b), max(longest, 1)), np.int64)
            row = np.repeat(np.arange(len(b)), sizes)
            m[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(SCALE * flat), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            vec = pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), vec], ["vec_id", "vec"])

    packed = rows.mapInArrow(run, "vec_id long, vec binary")
    return durable(packed.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "vec"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), np.int64).reshape(len(got), -1) if got else np.zeros((0, 1), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles while every sum fits 53 bits, else by 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Cells:
    """Pivots in the lifted space, with distances to them."""

    def __init__(self, pivots: np.ndarray, norm2: float):
        self.pivots, self.norm2 = pivots, norm2
        self.lift = np.sqrt(np.maximum(norm2 - (pivots.astype(float) ** 2).sum(axis=1), 0))
        dots = products(pivots, pivots).astype(float) + np.outer(self.lift, self.lift)
        self.between = np.sqrt(np.maximum(2 * norm2 - 2 * dots, 0))
        np.fill_diagonal(self.between, 0)

    def to_data(self, v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.norm2 - (v.astype(float) ** 2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.norm2 - 2 * (products(v, self.pivots) + np.outer(lift, self.lift)), 0))

    def to_queries(self, v: np.ndarray) -> np.ndarray:
        n = (v.astype(float) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(n[:, None] + self.norm2 - 2.0 * products(v, self.pivots), 0))


def best(keep: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise k best of what is kept and what is new: score descending, then place in ``ids`` order."""
    s = np.concatenate([keep[0], scores], axis=1)
    i = np.concatenate([keep[1], np.broadcast_to(ids, scores.shape)], axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


NONE = np.iinfo(np.int64).min + 1


def solve(q: np.ndarray, q_rid: np.ndarray, cells: Cells, s: np.ndarray, s_id: np.ndarray, s_rid: np.ndarray, cell: np.ndarray, dist: np.ndarray, k: int):
    """k best (score, place) of every query among one block; place indexes the rows as given, by vec_id."""
    top = (np.full((len(q), k), NONE), np.full((len(q), k), len(s)))
    to_pivot = cells.to_queries(q)
    n2 = (q.astype(float) ** 2).sum(axis=1)
    slack = 1e-6 * (1 + np.sqrt(cells.norm2))
    present = np.unique(cell)
    for j in present[np.argsort(to_pivot[:, present].mean(axis=0))]:
        rows = np.flatnonzero(cell == j)
        near = np.maximum(np.maximum(to_pivot[:, j] - dist[rows].max(), dist[rows].min() - to_pivot[:, j]) - slack, 0)
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            kth = top[0][:, -1]
            open_ = np.flatnonzero((kth == NONE) | (near**2 <= (n2 + cells.norm2 - 2.0 * kth) * (1 + 1e-9) + slack))
            if not len(open_):
                continue
            scores = products(q[open_], s[part])
            scores[q_rid[open_][:, None] == s_rid[part][None, :]] = NONE
            kth = kth[open_]
            live = np.flatnonzero((scores >= kth[:, None]).any(axis=1))
            if not len(live):
                continue
            who, scores = open_[live], scores[live]
            m = min(k, scores.shape[1])
            if scores.shape[1] <= 4 * k:
                pick = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
            elif np.abs(np.where(scores == NONE, 0, scores)).max() < 1 << 40:  # score, then place, in one unique key
                key = np.where(scores == NONE, -(1 << 62), scores * (1 << 20) - np.arange(scores.shape[1]))
                pick = np.argpartition(-key, m - 1, axis=1)[:, :m]
            else:
                pick = np.argsort(-scores, axis=1, kind="stable")[:, :m]
            kept = best((top[0][who], top[1][who]), np.take_along_axis(scores, pick, 1), part[pick], k)
            top[0][who], top[1][who] = kept
    return top


@dataclass
class Layout:
    """What is sent where: every group's bounds on the distance to each data cell's pivot, and its data blocks."""

    cells: Cells
    data: DataFrame
    queries: DataFrame
    first_of: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray
    share: float


SCHEMA = "rid long, vec_id long, vec binary, cell int, dist double"


def layout(rows: DataFrame, k: int, every: int) -> Layout | None:
    """Pivots, cells, summaries and groups of quantised ``rows``; None without queries."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = (matrix(b.column("vec")).astype(float) ** 2).sum(axis=1).max(initial=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([top])], ["n2"])

    norm2 = rows.select("vec").mapInArrow(norms, "n2 double").agg(F.max("n2")).first()[0]
    if norm2 is None:
        return None
    n_rows = rows.count()
    wanted = int(min(max(PIVOTS[0], n_rows**0.5), PIVOTS[1]))
    # twice as many by hash as needed, so that the sort is of few rows; at most PIVOTS[1] are collected
    least = min(2**63 - 1, int(min(1.0, 2 * wanted / n_rows) * 2**64) - 2**63)
    by_hash = rows.select("vec", "rid", F.xxhash64("vec", "rid").alias("h"))
    sample = by_hash.where(F.col("h") <= least).orderBy("h", "rid").select("vec").limit(wanted).collect()
    if not sample:
        sample = by_hash.orderBy("h", "rid").select("vec").limit(wanted).collect()
    cells = Cells(np.unique(np.stack([np.frombuffer(r.vec, np.int64) for r in sample]), axis=0), norm2)
    n_cells = len(cells.pivots)

    def assign(lifted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(b.column("vec"))
                d = (cells.to_data if lifted else cells.to_queries)(v)
                c = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(c.astype(np.int32)), pa.array(d[np.arange(len(c)), c])], [*b.schema.names, "cell", "dist"]
                )

        return run

    data = rows.mapInArrow(assign(True), SCHEMA)
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(assign(False), SCHEMA)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        facts: dict[int, list] = {}
        for b in batches:
            c, d = b.column("cell").to_numpy(), b.column("dist").to_numpy()
            for j in np.unique(c).tolist():
                x = d[c == j]
                near[j] = np.sort(np.concatenate([near.get(j, x[:0]), x]))[: k + 1]
                n, low, high = facts.get(j, [0, np.inf, 0.0])
                facts[j] = [n + len(x), min(low, x.min()), max(high, x.max())]
        if facts:
            cols = [pa.array(list(facts), pa.int32()), *(pa.array([f[i] for f in facts.values()]) for i in range(3)), pa.array([near[j].tolist() for j in facts])]
            yield pa.RecordBatch.from_arrays(cols, ["cell", "n", "low", "high", "near"])

    def summarised(df: DataFrame) -> list:
        parts = df.select("cell", "dist").mapInArrow(summary, "cell int, n long, low double, high double, near array<double>")
        # a row a cell; each holds k + 1 distances
        return (
            parts.groupBy("cell")
            .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
            .collect()
        )

    s_cells, q_cells = summarised(data), summarised(queries)
    if not q_cells:
        return None
    slack = 1e-6 * (1 + float(np.sqrt(norm2)))
    low_at, high_at = np.full((n_cells, n_cells), np.inf), np.full((n_cells, n_cells), -np.inf)  # [query cell, data cell]
    for r in q_cells:
        reach = np.sort(np.concatenate([r.high + cells.between[r.cell, s.cell] + np.array(s.near) for s in s_cells]))
        theta = reach[min(k, len(reach) - 1)] if len(reach) > k else np.inf
        for s in s_cells:
            gap = cells.between[r.cell, s.cell]
            low_at[r.cell, s.cell], high_at[r.cell, s.cell] = gap - r.high - theta - slack, gap + r.high + theta + slack
    # groups: neighbouring query cells up to QUERIES queries; a larger cell is cut by hash
    left, groups = sorted(q_cells, key=lambda r: r.cell), []
    while left:
        seed = left.pop(0)
        group, n = [seed], seed.n
        for r in sorted(left, key=lambda r: cells.between[seed.cell, r.cell]):
            if n + r.n <= QUERIES:
                group.append(r)
                n += r.n
        left = [r for r in left if r not in group]
        groups.append(([r.cell for r in group], -(-n // QUERIES)))
    first_of, cuts, low_g, high_g, blocks, sent = np.zeros(n_cells, np.int64), np.ones(n_cells, np.int64), [], [], [], 0
    for members, cut in groups:
        low, high = low_at[members].min(axis=0), high_at[members].max(axis=0)
        n = sum(s.n for s in s_cells if s.high >= low[s.cell] and s.low <= high[s.cell])
        first_of[members], cuts[members], sent = len(blocks), cut, sent + cut * n
        for _ in range(cut):
            low_g.append(low)
            high_g.append(high)
            blocks.append(max(1, -(-n // ROWS)))
    share = sent / max(1, len(blocks) * sum(s.n for s in s_cells))
    return Layout(cells, data, queries, first_of, cuts, np.array(low_g), np.array(high_g), np.array(blocks), share)


def share_sent(vectors: DataFrame, k: int = 5, every: int = EVERY) -> float:
    """Share of all (data vector, query group) pairs that the bounds let through, counted by cells; 0 without queries."""
    found = layout(quantised(vectors), k, every)
    return found.share if found else 0.0


def top_k(vectors: DataFrame, k: int = 5, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: queries are the rows whose vec_id is divisible by ``every``."""
    rows = quantised(vectors)
    plan = layout(rows, k, every)
    if plan is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, data, queries, first_of, cuts, low_g, high_g, blocks = plan.cells, plan.data, plan.queries, plan.first_of, plan.cuts, plan.low, plan.high, plan.blocks

    def mixed(rid: np.ndarray) -> np.ndarray:
        return (rid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    def emit(b: pa.RecordBatch, row: np.ndarray, g: np.ndarray, blk: np.ndarray) -> pa.RecordBatch:
        took = b.take(pa.array(row))
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(blk.astype(np.int32)), *took.columns], ["g", "blk", *b.schema.names])

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, h = b.column("cell").to_numpy(), mixed(b.column("rid").to_numpy())
            g = first_of[c] + h % cuts[c]
            row = np.repeat(np.arange(len(b)), blocks[g])
            yield emit(b, row, g[row], np.arange(len(row)) - np.repeat(np.cumsum(blocks[g]) - blocks[g], blocks[g]))

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, d, h = b.column("cell").to_numpy(), b.column("dist").to_numpy(), mixed(b.column("rid").to_numpy())
            for g in range(len(blocks)):
                row = np.flatnonzero((d >= low_g[g][c]) & (d <= high_g[g][c]))
                if len(row):
                    yield emit(b, row, np.full(len(row), g), h[row] % blocks[g])

    def local(q: pa.Table, s: pa.Table) -> pa.Table:
        s = s.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        qs, ids = matrix(q["vec"]), s["vec_id"].to_numpy()
        score, place = solve(qs, q["rid"].to_numpy(), cells, matrix(s["vec"]), ids, s["rid"].to_numpy(), s["cell"].to_numpy(), s["dist"].to_numpy(), k)
        r, c = np.nonzero(score != NONE)
        cols = [q["rid"].to_numpy()[r], q["vec_id"].to_numpy()[r], ids[place[r, c]] if len(ids) else r, score[r, c]]
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in cols], names=["rid", "query_id", "vec_id", "score"])

    moved = "g int, blk int, " + SCHEMA
    left_side = queries.mapInArrow(send_queries, moved).groupBy("g", "blk")
    right_side = data.mapInArrow(send_data, moved).groupBy("g", "blk")
    short = left_side.cogroup(right_side).applyInArrow(local, "rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return short.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
