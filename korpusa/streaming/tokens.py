"""Revoked tokens until they expire, as state with event-time timers.

A use of a token is refused from a revocation on until that revocation's expiry. Rows of a token wait until the
watermark has passed them and are then judged in the order of their times, so rows that come late, within the
watermark, give the same verdicts as rows in order. A token's state is one time and what waits; it goes when
the last revocation has expired. A batch appends a frame's rows at once and sets one timer, for the earliest of them;
that timer judges all that are due and sets the next, so a token costs a few calls a batch however many its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.formats import shared_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -(1 << 62)


class Guard(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, use long, until long")
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            at = pdf["at"].tolist()
            self.waiting.appendList(list(zip(at, pdf["use"].tolist(), pdf["until"].tolist(), strict=True)))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * timerValues.getCurrentWatermarkInMs()  # rows up to it are all here: the first timer judges them, others find none
        rows = [tuple(r) for r in self.waiting.get()]
        # a revocation comes before uses at the same time; it is a row whose expiry is set
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], r[2] == NEVER, r[1]))
        later = [r for r in rows if r[0] > now]
        held = self.until.get()
        until = NEVER if held is None else held[0]
        verdicts = []
        for at, use, ends in due:
            if ends != NEVER:
                until = max(until, ends)
            else:
                verdicts.append((key[0], use, at < until))
        if due and later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1)
        elif due:
            self.waiting.clear()
        if until > now:
            if held is None or until != held[0]:
                self.until.update((until,))
                self.handle.registerTimer(until // 1000 + 1)
        elif held is not None and not any(r[0] < until for r in later):
            self.until.clear()
        if verdicts:
            yield pd.DataFrame(verdicts, columns=["token", "use", "refused"])

    def close(self) -> None:
        return None


def judged(rows: DataFrame) -> DataFrame:
    """``(token, use, refused)`` of a stream ``rows(token, ts, use, until)`` with a watermark on ``ts``.

    ``until`` is set on revocations only; they give no verdict. Needs the state store STORE.
    """
    keyed = rows.select(F.col("token").cast("long").alias("token"), "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("use").cast("long"), F.lit(-1)).alias("use"), F.coalesce(F.unix_micros("until"), F.lit(NEVER)).alias("until"))
    return keyed.groupBy("token").transformWithStateInPandas(Guard(), outputStructType="token long, use long, refused boolean", outputMode="Append", timeMode="EventTime")


def run_judged(spark: SparkSession, folder: str, late: str = "1 hour", files: int = 1000) -> DataFrame:
    """Reads the Parquet files ``(token, ts, use, until)`` of a folder as a stream, in batches of ``files``, and returns all verdicts.

    A last row beyond all others, of a token of its own, moves the watermark past them.
    """
    session = spark.newSession()  # the state store is a setting of a session
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = session.read.parquet(folder)
    end, out = shared_path(spark, "token-end"), shared_path(spark, "token-out")
    last = rows.agg((F.max("ts") + F.expr(f"interval {late}") + F.expr("interval 1 second")).alias("ts"))
    last.select(F.lit(None).cast("long").alias("token"), "ts", F.lit(None).cast("long").alias("use"), F.lit(None).cast("timestamp").alias("until")).where("ts is not null").write.parquet(f"{end}/last")

    def stream(path: str) -> DataFrame:
        return session.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # again the same where a batch comes again

    for k, path in enumerate((folder, f"{end}/last")):
        if k:  # a second run of the same query goes on from its state and reads the closing row
            session.read.parquet(path).write.mode("append").parquet(folder)
        plan = judged(stream(folder).withWatermark("ts", late))
        query = plan.writeStream.foreachBatch(keep).option("checkpointLocation", f"{end}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("token long, use long, refused boolean").parquet(out).where("token is not null").select("token", "use", "refused")
