"""Readers and writers of the formats around a document store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pdf_listing(spark: SparkSession, folder: str, most_bytes: int = 50 << 20) -> DataFrame:
    """``(path, length, modificationTime)`` of the PDFs below a folder, without their content; larger files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", "length", "modificationTime").where(F.col("length") <= most_bytes)


def expired(files: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return files.where(F.col("modificationTime") < as_of - F.make_interval(days=F.lit(days)))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that holds one array or object; a corrupt file gives no rows."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.cache().where("_corrupt_record is null").drop("_corrupt_record")


def read_ground_truth_csv(spark: SparkSession, path: str, schema: str, metadata: str, keys: str) -> DataFrame:
    """CSV with header and quoted cells, one of which is JSON text: ``metadata`` becomes a struct of ``keys``, null when malformed."""
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.withColumn(metadata, F.from_json(metadata, keys, {"mode": "PERMISSIVE"}))


def sse_frames(logs: DataFrame, text: str, key: str) -> DataFrame:
    """``(key, place, event, data)`` of the frames of server-sent-event logs; frames without data are skipped."""
    frames = logs.select(key, F.posexplode(F.split(text, "\n\n")).alias("place", "frame"))
    event, data = F.regexp_extract("frame", r"(?m)^event:\s*(.*)$", 1), F.regexp_extract("frame", r"(?m)^data:\s*(.*)$", 1)
    return frames.select(key, "place", event.alias("event"), data.alias("data")).where("data <> ''")


def sse_text(rows: DataFrame, event: str, data: str) -> DataFrame:
    """One frame a row, ready for a text sink."""
    return rows.select(F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n")).alias("value"))


def sse_stream(spark: SparkSession, folder: str, fields: str, files: int = 8) -> DataFrame:
    """A stream of ``(event, data, broken)`` from logs of server-sent events, new files as they come, ``files`` a batch.

    The reader's record separator is the blank line, so a frame that lies across two splits of a file is one record of the first.
    Several ``data:`` lines are joined by line feeds, comments and other fields are skipped, an event without a name is "message", frames
    without data are none. ``data`` is JSON of ``fields``; where it can't be parsed it is null and ``broken`` holds it.
    """
    raw = spark.readStream.format("text").option("lineSep", "\n\n").option("maxFilesPerTrigger", files).load(folder)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.contains(":") & ~x.startswith(":"))
    of = lambda name: F.transform(F.filter("l", lambda x: F.substring_index(x, ":", 1) == name), lambda x: F.regexp_replace(x, rf"^{name}: ?", ""))
    told = raw.select(lines.alias("l")).select(F.coalesce(F.try_element_at(of("event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(of("data"), "\n").alias("text"), F.size(of("data")).alias("n"))
    read = told.where("n > 0").withColumn("data", F.from_json("text", f"{fields}, broken_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_"}))
    return read.select("event", F.when(F.col("data.broken_").isNull(), F.col("data").dropFields("broken_")).alias("data"), F.col("data.broken_").alias("broken"))


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or Markdown bullets of a result."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in rows.columns]
        rows.select(F.concat(F.lit("- "), F.concat_ws("; ", *cells)).alias("value")).write.mode("overwrite").text(path)


def add_missing_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive migration: rows of both, columns that one side lacks as null."""
    return old.unionByName(new, allowMissingColumns=True)


def rebuild_if_stale(source: DataFrame, spark: SparkSession, path: str, force: bool = False) -> bool:
    """Rewrites a derived table when its row count differs from its source's; says whether it did."""
    try:
        same = spark.read.parquet(path).count() == source.count()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        same = False
    if same and not force:
        return False
    source.write.mode("overwrite").parquet(path)
    return True


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Only a local master, where all is one machine, gets a temporary folder when the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="korpusa-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what several later steps read is worked out once."""
    where = shared_path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
