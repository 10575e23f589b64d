"""Streaming queries; their SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.formats import shared_path, sse_stream, sse_text
from ..sources.tables import load
from ..streaming import events as E


def events_without_blacklisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = load(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(3).select("user_id")
    return E.run_once(spark, E.without_blacklisted(E.event_stream(spark, sf_dir), listed), "append")


def events_relayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events written as logs of server-sent events, each with a malformed frame for every seventh, and read back as a stream."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.to_json(F.struct("event_id", "user_id", "value")).alias("json"))
    good = e.select("event_type", "json")
    cut = e.where("event_id % 7 = 0").select("event_type", F.substring("json", 1, 9).alias("json"))
    logs = shared_path(spark, "event-logs")
    sse_text(good.unionByName(cut), "event_type", "json").write.text(logs)
    rows = sse_stream(spark, logs, "event_id long, user_id long, value double").where("broken is null")
    return E.run_once(spark, rows.select(F.col("event").alias("event_type"), "data.*"), "append")


QUERIES = {
    "events_relayed": events_relayed,
    "events_tumbling": E.streamed(E.tumbling),
    "events_sliding": E.streamed(E.sliding),
    "events_session": E.streamed(E.sessions),
    "events_deduplicated": E.streamed(E.deduplicated, "append"),
    "events_without_blacklisted": events_without_blacklisted,
}
ORACLES = {
    "events_relayed": "SELECT event_type, CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, value FROM events",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "WITH b AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS t FROM events WHERE event_type = 'error') SELECT t - o * INTERVAL 6 HOUR AS start, user_id, count(*) AS failures, count(*) > 5 AS alert FROM b, range(4) r(o) GROUP BY 1, 2",
    "events_session": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
    "events_deduplicated": "SELECT DISTINCT event_id, event_type FROM events",
    "events_without_blacklisted": "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 3)",
}
