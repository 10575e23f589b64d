"""Stored vector index: inverted lists over learned cells, residuals at one byte a dimension, exact scores for the short list.

Cells, code range and number of probed cells are learned on the driver from a bounded sample (SAMPLE numbers, so 65,536 vectors of
64); every row is indexed. Lists are rows of a Parquet table with a folder a cell, at most LIST vectors each, so a cell that holds a third
of all vectors is many rows and a search reads probed cells only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..sources.formats import written

#: Numbers of the vectors that the model is learned from, most cells, vectors of one list, lists and queries of one task's group, and sampled queries that fix the probes.
SAMPLE, CELLS, LIST, LISTS, ASKED, TRIALS = 1 << 22, 1_024, 4_096, 16, 1_024, 256
ROUNDS, SEED = 8, 7


def valid(vec: str) -> str:
    return f"{vec} is not null and not exists({vec}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def unit_rows(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows divided by their whole length (zero stays zero), then cut or filled with zeros to ``width``."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    norm = np.linalg.norm(out, axis=1)
    out /= np.where(norm == 0, 1, norm)[:, None]
    if width is None or out.shape[1] == width:
        return out
    return np.pad(out, ((0, 0), (0, max(0, width - out.shape[1]))))[:, :width]


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    blocks = [(rows[i : i + LIST] @ centres.T).argmax(axis=1) for i in range(0, len(rows), LIST)]
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def learned_cells(rows: np.ndarray, many: int) -> np.ndarray:
    """Spherical k-means: unit centres; a cell without rows is left where it was."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    centres = rows[np.random.default_rng(SEED).permutation(len(rows))[:many]].copy()
    for _ in range(ROUNDS):
        at = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0][:, None]
    return centres


@dataclass(frozen=True)
class Model:
    """Centres, half the code range a dimension, error of coded scores (99.9 % of trials), probed cells without and with a filter."""

    centres: np.ndarray
    reach: np.ndarray
    error: float
    probes: int
    probes_filtered: int

    def code(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        step = np.where(self.reach > 0, self.reach / 127, 1)
        return np.clip(np.rint((rows - self.centres[at]) / step), -127, 127).astype(np.int8)

    def residuals(self, codes: np.ndarray) -> np.ndarray:
        return codes * (self.reach / 127)


def _probes(rows: np.ndarray, at: np.ndarray, centres: np.ndarray, k: int, target: float, labels: np.ndarray | None) -> int:
    """Fewest nearest cells that hold ``target`` of the k nearest sampled rows of TRIALS sampled rows, themselves left out.

    The rows must not be those that the centres were learned from. In the whole table neighbours are nearer than in a sample of it,
    so the share found there is higher.
    """
    ask = np.arange(min(TRIALS, len(rows)))
    scores = rows[ask] @ rows.T
    scores[ask, ask] = -2
    if labels is not None:
        scores[labels[ask][:, None] != labels[None, :]] = -2
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(rows[ask] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(ask), 0), axis=1)
    needed = np.take_along_axis(place, at[best], axis=1)[np.take_along_axis(scores, best, axis=1) > -2]
    return int(np.quantile(needed, target, method="higher")) + 1 if len(needed) else len(centres)


def learn(data: DataFrame, k: int = 10, target: float = 0.97, same: str | None = None) -> Model:
    """A model for ``data(id, vec)``: 2 * sqrt(rows) cells, at most CELLS and an eighth of the rows they are learned from.

    Half of the sample gives the centres, the other half the probes and the error. ``same`` names the column that filtered searches compare.
    """
    data = data.where(valid("vec"))
    n, width = data.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    most = max(1, SAMPLE // max(1, width))
    share = F.pmod(F.xxhash64(F.lit(SEED), "id", "vec"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))
    # the limit binds only where one and the same row makes up much of the table
    got = data.where(share).limit(2 * most).select(F.col("vec").cast("array<double>").alias("vec"), F.xxhash64(same).alias("label") if same else F.lit(0).alias("label")).toArrow()
    rows, labels = unit_rows(got["vec"]), got["label"].to_numpy()
    order = np.random.default_rng(SEED).permutation(len(rows))
    rows, labels = rows[order], labels[order]
    half = (len(rows) + 1) // 2
    centres = learned_cells(rows[:half], max(1, min(CELLS, half // 8, int(2 * n**0.5))))
    if not len(rows):
        return Model(centres, np.zeros(rows.shape[1]), 0.0, 1, 1)
    at = nearest(rows, centres)
    model = Model(centres, np.abs(rows - centres[at]).max(axis=0), 0.0, 1, 1)
    off = rows - centres[at] - model.residuals(model.code(rows, at))
    error = float(np.quantile(np.abs(rows[-TRIALS:] @ off.T), 0.999))
    rows, at, labels = rows[half:], at[half:], labels[half:]
    plain = _probes(rows, at, centres, k, target, None)
    return Model(centres, model.reach, error, plain, _probes(rows, at, centres, k, target, labels) if same else plain)


class VectorIndex:
    """An index in a folder: ``model`` (one row), ``lists`` (cell, ids, labels, codes) and ``vectors`` (id, vec) for exact scores."""

    def __init__(self, spark: SparkSession, path: str, model: Model) -> None:
        self.spark, self.path, self.model = spark, path, model

    @classmethod
    def create(cls, spark: SparkSession, path: str, data: DataFrame, same: str | None = None, k: int = 10) -> VectorIndex:
        """Learns a model from ``data(id, vec[, same])`` and indexes all of it. Rows whose vector is null or holds null or non-finite values take no part."""
        model = learn(data, k, same=same)
        row = (model.centres.tolist(), model.reach.tolist(), model.error, model.probes, model.probes_filtered)
        spark.createDataFrame([row], "centres array<array<double>>, reach array<double>, error double, probes int, probes_filtered int").coalesce(1).write.parquet(f"{path}/model")
        return cls(spark, path, model).add(data, same)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        row = spark.read.parquet(f"{path}/model").first()
        centres = np.array(row.centres, dtype=float).reshape(len(row.centres), -1)
        return cls(spark, path, Model(centres, np.array(row.reach, dtype=float), row.error, row.probes, row.probes_filtered))

    def add(self, data: DataFrame, same: str | None = None) -> VectorIndex:
        """Codes and appends rows with the cells as they are; nothing stored before is touched. Many rows unlike those that the cells were learned from lower the recall."""
        whole = data.where(valid("vec")).select("id", F.col("vec").cast("array<double>").alias("vec"), (F.col(same).cast("string") if same else F.lit(None).cast("string")).alias("label"))
        whole.select("id", "vec").write.mode("append").parquet(f"{self.path}/vectors")
        model = self.model  # a few hundred kilobytes: CELLS centres at most
        width = model.centres.shape[1]

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Lists of this task's batches, each cut from one sorted batch: short lists in small cells, none longer than LIST."""
            for b in batches:
                rows = unit_rows(b["vec"], width)
                at = nearest(rows, model.centres)
                codes, order = model.code(rows, at), np.argsort(at, kind="stable")
                ends = np.flatnonzero(np.diff(at[order])) + 1
                cuts = [c[i : i + LIST] for c in np.split(order, ends) for i in range(0, len(c), LIST)]
                ids, labels = b["id"], b["label"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(at[c[0]]) for c in cuts], pa.int32()),
                        pa.array([ids.take(pa.array(c)).to_pylist() for c in cuts], pa.list_(pa.int64())),
                        pa.array([labels.take(pa.array(c)).to_pylist() for c in cuts], pa.list_(pa.string())),
                        pa.array([codes[c].tobytes() for c in cuts], pa.binary()),
                    ],
                    names=["cell", "ids", "labels", "codes"],
                )

        # rows of a cell come together first, or every task would write a short list for every cell
        near = whole.mapInArrow(self._assigned(), "id long, vec array<double>, label string, cell int")
        together = near.withColumn("salt", F.pmod(F.xxhash64("id", "vec"), F.lit(self._salts(whole)))).repartition("cell", "salt").sortWithinPartitions("cell")
        lists = together.select("id", "vec", "label").mapInArrow(listed, "cell int, ids array<long>, labels array<string>, codes binary")
        lists.write.mode("append").partitionBy("cell").parquet(f"{self.path}/lists")
        return self

    def _assigned(self):  # noqa: ANN202
        centres = self.model.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = nearest(unit_rows(b["vec"], centres.shape[1]), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "cell"])

        return run

    def _salts(self, rows: DataFrame) -> int:
        """Parts that each cell is dealt to, about four lists each when cells are even; one cell's rows never need one task."""
        return max(1, -(-rows.count() // (4 * LIST * len(self.model.centres))))

    def lists(self) -> DataFrame:
        return self.spark.read.schema("ids array<long>, labels array<string>, codes binary, cell int").parquet(f"{self.path}/lists")

    def short_list(self, queries: DataFrame, k: int, same: str | None = None, probes: int | None = None) -> DataFrame:
        """``(query_id, id)``: rows of the probed cells whose coded score reaches the k-th best less twice the error of coded scores; no fixed number."""
        model, probes = self.model, probes or (self.model.probes_filtered if same else self.model.probes)
        width, centres = model.centres.shape[1], model.centres
        asked = queries.where(valid("vec")).select("query_id", F.col("vec").cast("array<double>").alias("vec"), (F.col(same).cast("string") if same else F.lit(None).cast("string")).alias("label"))

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = np.argsort(-(unit_rows(b["vec"], width) @ centres.T), axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(b.num_rows), cells.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(cells.ravel(), pa.int32())], names=[*b.schema.names, "cell"])

        # lists of a cell in groups of LISTS, queries of a cell in groups of about ASKED: each pair of groups meets once
        left = asked.mapInArrow(probed, "query_id long, vec array<double>, label string, cell int")
        met = [r.cell for r in left.select("cell").distinct().collect()]  # CELLS at most; only their folders are read
        lists = self.lists().where(F.col("cell").isin(met)).withColumn("g", F.pmod(F.xxhash64("codes", "ids"), F.lit(1 << 30)))
        sizes = lists.groupBy("cell").agg(F.ceil(F.count("*") / LISTS).cast("int").alias("groups"))
        parts = max(1, -(-asked.count() // ASKED))
        left = left.join(F.broadcast(sizes), "cell")  # CELLS rows at most
        left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("p", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).drop("groups")
        right = lists.join(F.broadcast(sizes), "cell").withColumn("g", F.pmod("g", "groups").cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("groups")

        def local(a: pa.Table, b: pa.Table) -> pa.Table:
            asked, rows, near = ([np.zeros(0, kind)] for kind in (np.int64, np.int64, np.float64))  # a short list may hold a tenth of all rows: no Python objects
            if a.num_rows and b.num_rows:
                q = unit_rows(a["vec"], width)
                ids = b["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                labels = b["labels"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(b["codes"].to_pylist()), np.int8).reshape(len(ids), width)
                base = q @ centres[a["cell"][0].as_py()]
                for i, (one, label) in enumerate(zip(a["query_id"].to_pylist(), a["label"].to_pylist(), strict=True)):
                    fit = np.flatnonzero((labels == label) & (label is not None)) if same else np.arange(len(ids))
                    s = base[i] + codes[fit] @ (q[i] * (model.reach / 127))
                    least = np.partition(s, len(s) - k)[len(s) - k] - 2 * model.error if len(s) > k else -np.inf
                    kept = np.flatnonzero(s >= least)
                    asked.append(np.full(len(kept), one, np.int64))
                    rows.append(ids[fit[kept]])
                    near.append(s[kept])
            return pa.table([pa.array(np.concatenate(x)) for x in (asked, rows, near)], names=["query_id", "id", "near"])

        keys = ("cell", "g", "p")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(local, "query_id long, id long, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"))
        kth = F.min(F.when(F.col("r") <= k, F.col("near"))).over(Window.partitionBy("query_id"))
        return found.withColumn("r", F.row_number().over(order)).withColumn("least", kth - 2 * model.error).where("near >= least").select("query_id", "id").distinct()

    def search(self, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
        """``(query_id, id, score, rank)`` as ``vectors.top_cosine`` gives it, but for neighbours in cells that are not probed.

        ``same`` must be the column given when rows were added; rows that differ in it never enter the ranking, null equals nothing.
        A repeated id gives a row each time. Ties go to the smaller id. Queries whose probed cells hold fewer than ``k`` rows that fit
        are asked again of all cells, so no list is short that needn't be.
        """
        asked = queries.where(valid("vec")).select("query_id", F.col("vec").cast("array<double>").alias("asked"))
        stored = self.spark.read.schema("id long, vec array<double>").parquet(f"{self.path}/vectors")
        short = written(self.short_list(queries, k, same), "short-list")
        enough = short.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        lacking = written(queries.where(valid("vec")).join(enough, "query_id", "left_anti"), "lacking")
        if (self.model.probes_filtered if same else self.model.probes) < len(self.model.centres) and not lacking.isEmpty():
            short = short.join(enough, "query_id", "left_semi").unionByName(self.short_list(lacking, k, same, len(self.model.centres)))
        met = short.join(stored, "id").join(asked, "query_id")
        scored = met.select("query_id", "id", (F.round(cosine(F.col("asked"), F.col("vec")), 6) + 0.0).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(queries, wanted, got, recall)``: share of the exact lists' places filled by a row that scores at least the list's last score."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("wanted"))
    hits = found.join(last.select("query_id", "least"), "query_id").groupBy("query_id").agg(F.count_if(F.col("score") >= F.col("least")).alias("got"))
    both = last.join(hits, "query_id", "left").select("wanted", F.least("wanted", F.coalesce("got", F.lit(0))).alias("got"))
    return both.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), F.sum("got").alias("got")).withColumn("recall", F.round(F.col("got") / F.col("wanted"), 4))
