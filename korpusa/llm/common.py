"""What the operators of this subpackage share: table access, durable cut points, joins on hot keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written by stored() that nothing has discarded yet, oldest first.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, where all is one machine, gets a temporary folder when the setting is missing.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="korpusa-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or the first of base_1, base_2, ... that is no column of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    names = [base, *(f"{base}_{i}" for i in range(1, len(taken) + 1))]
    return next(n for n in names if n.lower() not in taken)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    A lost executor therefore never loses a cut-off lineage.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut of the lineage that is read by columns."""
    where = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    _WRITTEN.append(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    name = where.rpartition("/")[2]
    _WRITTEN[:] = [w for w in _WRITTEN if w.rpartition("/")[2] != name]


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        for where in {f.rpartition("/")[0] for f in t.inputFiles()}:
            _delete(t.sparkSession, where)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what stored() writes inside the block, but for the tables that the block puts into the yielded list.

    For work whose result is itself stored before the block ends: a lazy result would still read its parts.
    """
    before, keep = set(_WRITTEN), []
    yield keep
    kept = {f.rpartition("/")[0].rpartition("/")[2] for t in keep for f in t.inputFiles()}
    for where in [w for w in _WRITTEN if w not in before and w.rpartition("/")[2] not in kept]:
        _delete(spark, where)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that are behind a stored table.

    Spark removes them when the driver's garbage collector finds their plans unused, which on a large
    heap may be long after; a multi-step operator would meanwhile hold the disk of all its steps.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that texts are not all unpacked at once; what the task freed goes back to the machine at its end."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory of a Python worker, which lives on for tasks of other stages, to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def packed_rows(column: pa.BinaryArray, kind: str) -> list[np.ndarray]:
    """The rows of a binary column as arrays over its own memory."""
    size = np.dtype(kind).itemsize
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    return [np.frombuffer(values, kind, (y - x) // size, x) if y > x else np.zeros(0, kind) for x, y in zip(at, at[1:], strict=False)]


#: A key is heavy with more rows than this, or than its share of all rows where that is more.
HEAVY, HEAVY_SHARE = 50_000, 10_000


def heavy_keys(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Keys with more than max(HEAVY, rows / HEAVY_SHARE) rows: fewer than HEAVY_SHARE, whatever the table.

    One count with map-side sums; of a key's rows none is gathered. ``counts``: the rows of each key
    as ``(*keys, c__)`` where an earlier step has counted them.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("c__")) if counts is None else counts
    heavy = counts.where(F.col("c__") > HEAVY)
    total = F.broadcast(counts.agg((F.sum("c__") / HEAVY_SHARE).alias("share__")))  # one row
    return heavy.join(total, F.col("c__") > F.col("share__")).select(*keys)


def split_join(rows: DataFrame, unique: DataFrame, keys: list[str], total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (one row a key) where a key may hold a third of all rows.

    The heavy keys, fewer than HEAVY_SHARE by their definition, meet their partner by broadcast, where
    the rows are; all other keys are shuffled and none has more than its small share of the rows.
    ``total``: the number of rows where it is known, which saves the count of few; ``counts`` as in heavy_keys.
    """
    few = total is not None and total <= HEAVY
    heavy = [] if few else [tuple(r) for r in heavy_keys(rows, keys, counts).collect()]  # fewer than HEAVY_SHARE rows
    if not heavy:
        return rows.join(unique, keys)
    spark = rows.sparkSession
    named = F.broadcast(spark.createDataFrame(heavy, rows.select(*keys).schema))
    hot = rows.join(named, keys, "left_semi").join(F.broadcast(unique.join(named, keys, "left_semi")), keys)
    return hot.unionByName(rows.join(named, keys, "left_anti").join(unique, keys))


#: Shares that the rows of a heavy key are dealt over.
SALTS = 64


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], apart: list[str]) -> DataFrame:
    """Inner join where a key may hold a third of ``rows`` and any number of rows of ``other``.

    The rows of a heavy key are dealt over SALTS shares by a hash of the columns ``apart``, the same
    in every attempt of a task, and each share meets a copy of the key's rows of ``other``. Only the
    keys' names are broadcast, fewer than HEAVY_SHARE; ``rows`` is read twice and should be stored.
    """
    heavy = [tuple(r) for r in heavy_keys(rows, keys).collect()]  # fewer than HEAVY_SHARE rows
    if not heavy:
        return rows.join(other, keys)
    named = F.broadcast(rows.sparkSession.createDataFrame(heavy, rows.select(*keys).schema).withColumn("hot__", F.lit(True)))
    share = F.when(F.col("hot__"), F.pmod(F.xxhash64(*apart), F.lit(SALTS))).otherwise(0).cast("int")
    shares = F.when(F.col("hot__"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(named, keys, "left").withColumn("share__", share).drop("hot__")
    right = other.join(named, keys, "left").withColumn("share__", F.explode(shares)).drop("hot__")
    return left.join(right, [*keys, "share__"]).drop("share__")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each round replaces a node's links by links to
    the smallest node it sees, as joins and partial minima, so no adjacency list is ever gathered
    in one place; in both steps a hub's rows meet its minimum by split_join. Links and labels stay distributed;
    the driver sees one count and one checksum a round. A round's table replaces that before it.
    """
    e, last = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), None
    before, rounds, step = None, 0, None
    while True:
        e = stored(e)
        for t in (last, step):
            if t is not None:
                discard(t)
        last, step = e, None
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or now[0] == 0:
            break
        if rounds >= max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        before, rounds = tuple(now), rounds + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, low, ["u"], 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if 2 * now[0] > HEAVY:  # what split_join counts before it joins is worked out once
            large = step = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, ["u"], 2 * now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
