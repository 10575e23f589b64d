"""A keyed table kept by numbered batches of changes; a batch that comes again changes nothing.

Rows lie in buckets of their key. A batch rewrites the buckets its keys fall in, below its own number, and then
writes a ledger line: which version each bucket has now, and how many rows were imported, updated, skipped and
deleted. Readers follow the newest line, so a batch is seen whole or not at all, and one that failed half-way is
done again over its own leavings.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.formats import written

STATES = ("imported", "updated", "skipped", "deleted", "missing")


class KeyedStore:
    """``key`` is unique; the other ``columns`` are given as a schema string. ``buckets`` is fixed at the first batch."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def ledger(self) -> list[dict]:
        """Lines of all batches, in the order in which they were applied."""
        try:
            lines = self.spark.read.text(f"{self.path}/ledger").select("value").collect()  # a line a batch
        except AnalysisException:
            return []
        return sorted((json.loads(r[0]) for r in lines), key=lambda x: x["turn"])

    def rows(self, ledger: list[dict] | None = None, only: list[int] | None = None) -> DataFrame:
        lines = self.ledger() if ledger is None else ledger
        now = {int(b): v for b, v in lines[-1]["versions"].items() if only is None or int(b) in only} if lines else {}
        empty = self.spark.createDataFrame([], self.schema)
        if not now:
            return empty
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(now.items())]
        return self.spark.read.schema(empty.schema).parquet(*paths)

    def apply(self, batch: int, changes: DataFrame) -> dict[str, int]:
        """Applies ``changes``, rows of the schema with ``order`` (the last change of a key counts) and ``gone`` (a delete).

        Gives the counters; those on record for a batch that was applied before. Rows without key are left out;
        a change that leaves a row as it is, is skipped; a delete of an unknown key is missing.
        """
        lines = self.ledger()
        for line in lines:
            if line["batch"] == batch:
                return line["counters"]
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rest = [c for c in names if c != self.key]
        newest = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("order")))
        last = changes.where(F.col(self.key).isNotNull()).withColumn("newest", newest).where("newest = 1")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        last = written(last.select(*names, F.coalesce("gone", F.lit(False)).alias("gone"), bucket.alias("bucket")), "changes")
        touched = sorted(r[0] for r in last.select("bucket").distinct().collect())  # no more than there are buckets
        old = self.rows(lines, touched).select(*[F.col(c).alias(f"old_{c}") for c in names])
        both = last.join(old, F.col(self.key) == F.col(f"old_{self.key}"), "full_outer")
        was, new = F.col(f"old_{self.key}").isNotNull(), F.col(self.key).isNotNull()
        same = F.struct(*rest).eqNullSafe(F.struct(*[F.col(f"old_{c}").alias(c) for c in rest])) if rest else F.lit(True)
        state = F.when(~new, "kept").when(F.col("gone") & ~was, "missing").when(F.col("gone"), "deleted").when(~was, "imported").when(same, "skipped").otherwise("updated")
        kept = [F.when(new, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in names]
        place = F.coalesce("bucket", F.pmod(F.xxhash64(f"old_{self.key}"), F.lit(self.buckets)).cast("int"))
        met = written(both.select(*kept, state.alias("state"), place.alias("bucket")), "merged")
        counted = dict(met.where("state <> 'kept'").groupBy("state").count().collect())
        counters = {s: counted.get(s, 0) for s in STATES}
        turn = len(lines)
        full = met.where("state not in ('deleted', 'missing')").drop("state")
        full.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{turn}")
        held = {r[0] for r in full.select("bucket").distinct().collect()}
        before = {b: v for b, v in (lines[-1]["versions"] if lines else {}).items() if int(b) not in touched}
        line = json.dumps({"turn": turn, "batch": batch, "counters": counters, "versions": before | {str(b): turn for b in held}})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.path}/ledger/turn={turn}")
        return counters

    def sink(self, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a stream's batches, each applied once however often the stream starts again."""

        def write(batch: DataFrame, number: int) -> None:
            self.apply(number, shape(batch))

        return write
