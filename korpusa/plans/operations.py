"""Operational queries: catalog counts, reconciliation, sessions, security events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_non_blank, legacy_id, safe_int, session_title, snippet
from ..operators import relational as R
from ..sources.tables import load


def doc_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return R.with_counts(docs, load(spark, sf_dir, "labels"), "doc_id", "n_labels")


def orphan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def visible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    return load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("longest"), F.coalesce(F.min(size), F.lit(0)).cast("bigint").alias("shortest"),
        F.round(F.avg(size), 4).alias("mean"), F.expr("sum(length(text)) div count(*)").alias("whole_mean"),
    )


def oversized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("size")).where("size > 3000")
    return docs.orderBy(F.desc("size"), "doc_id")


def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the stores side by side."""
    one = lambda t: load(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("store"), "n")
    return one("documents").unionByName(one("embeddings")).unionByName(one("labels")).unionByName(one("pages"))


def count_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows against documents by source: delta and whether it is within 70 percent."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    counts = R.with_counts(docs, load(spark, sf_dir, "labels"), "doc_id", "c").groupBy("source").agg(F.count("*").alias("documents"), F.sum("c").alias("labelled"))
    return counts.withColumn("delta", F.col("labelled") - F.col("documents")).withColumn("ok", -F.col("delta") <= 0.7 * F.col("documents"))


def sync_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    states = R.sync_state(docs, labels, "doc_id", F.col("t.quality") == 1)
    return states.groupBy("state").agg(F.count("*").alias("n"))


def replace_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert: balances of one segment replaced by zero."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return R.replace_by_key(c, c.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


def top_bottom_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return R.both_ends(rows.select("s_suppkey", "n_name", "s_acctbal"), 10, "s_acctbal", "s_suppkey")


def first_matching_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first line as its parent text, flagged on the first child only."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    parents = lines.groupBy("l_orderkey").agg(F.min_by("part", "l_linenumber").alias("parent"), F.min("l_linenumber").alias("first"))
    return lines.join(parents, "l_orderkey").select("l_orderkey", "l_linenumber", "parent", (F.col("l_linenumber") == F.col("first")).alias("is_first"))


def docs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of ten documents, newest id first."""
    return R.page(load(spark, sf_dir, "documents").select("doc_id", "source"), [F.desc("doc_id")], 20, 10)


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five documents of each source and whether there are more."""
    order, whole = Window.partitionBy("source").orderBy("doc_id"), Window.partitionBy("source")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    first = docs.withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 5")
    totals = docs.groupBy("source").agg(F.count("*").alias("total"))
    return first.join(totals, "source").select("source", "doc_id", "place", (F.col("total") > 5).alias("has_more"))


def event_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, with the total as a row of its own."""
    e = load(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"))
    return e.select(F.coalesce("event_type", F.lit("(all)")).alias("event_type"), "n")


def failed_by_user_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.alerts(load(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 5)


def recent_failures_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures within 24 hours of the newest event (an explicit as-of, never the clock)."""
    e = load(spark, sf_dir, "events")
    as_of = e.agg(F.max("ts").alias("as_of"))
    recent = e.where("event_type = 'error'").join(F.broadcast(as_of), F.col("ts") >= F.expr("as_of - interval 24 hours"))  # one row
    return recent.groupBy("user_id").agg(F.count("*").alias("failures"))


def events_of_user_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("user_id = 8 and ts between timestamp_ntz'2024-01-02 00:00:00' and timestamp_ntz'2024-01-12 00:00:00'")
    return e.select("event_id", "event_type", "value").orderBy(F.desc("event_id"))


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id", "event_type").distinct()


def event_json_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant JSON: the k of an event's details, null when missing or malformed."""
    k = F.from_json("props", "k string", {"mode": "PERMISSIVE"})["k"]
    return load(spark, sf_dir, "events").withColumn("k", safe_int(k)).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def next_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup: each click with the user's next purchase after it, if within one hour."""
    e = load(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    later = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    e = e.withColumn("nxt", F.first(bought, ignorenulls=True).over(later)).where("event_type = 'click'")
    soon = F.when(F.col("nxt.ts") <= F.expr("ts + interval 1 hour"), F.col("nxt.event_id"))
    return e.select("event_id", "user_id", soon.alias("purchase_id"))


def session_history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_turns(load(spark, sf_dir, "conversations"), 10).select("conv_id", "turn", "role", "place")


def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", session_title("t").alias("title"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the turns before and after it, and the question it belongs to."""
    talk = load(spark, sf_dir, "conversations")
    talk = R.carry_forward(talk, "conv_id", "turn", "turn", F.col("role") == "user", "question_turn")
    order = Window.partitionBy("conv_id").orderBy("turn")
    return talk.select("conv_id", "turn", "question_turn", F.lag("role").over(order).alias("before"), F.lead("role").over(order).alias("after"), F.right(F.lag("text").over(order), F.lit(20)).alias("tail"))


def group_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group to role mapping: many to many, distinct and sorted."""
    mapping = spark.createDataFrame([("BUILDING", "admin"), ("BUILDING", "user"), ("MACHINERY", "user"), ("HOUSEHOLD", "auditor"), ("HOUSEHOLD", "user")], "c_mktsegment string, role string")
    c = load(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    roles = c.join(F.broadcast(mapping), "c_mktsegment").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return roles.withColumn("may_audit", F.arrays_overlap(F.split("roles", ","), F.array(F.lit("admin"), F.lit("auditor"))))


def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is healthy when every hour of it has fewer than 60 failures."""
    e = load(spark, sf_dir, "events").withColumn("bad", (F.col("event_type") == "error").cast("int"))
    hours = e.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum("bad").alias("bad"))
    days = hours.groupBy(F.to_date("h").alias("day")).agg(F.bool_and(F.col("bad") < 60).alias("ok"), F.sum("bad").alias("failures"))
    return days.select(F.col("day").cast("string").alias("day"), F.when(F.col("ok"), "healthy").otherwise("degraded").alias("status"), "failures")


def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", first_non_blank(F.lit(" "), "source", F.lit("x")).alias("key"), legacy_id(F.concat("source", F.col("doc_id").cast("string"))).alias("legacy"), snippet("text", 20).alias("snippet"))


def first_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows grouped by the first filled key field; the first row's fields are kept."""
    docs = load(spark, sf_dir, "documents").withColumn("key", first_non_blank("lang", "source"))
    return docs.groupBy("key").agg(F.min_by("source", "doc_id").alias("source"), F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    doc_catalog_counts, orphan_docs, visible_docs, chunk_size_stats, oversized_chunks, global_counts, count_alignment, sync_states, replace_customers, top_bottom_10,
    first_matching_parent, docs_page, preview_rows, event_type_summary, failed_by_user_alert, recent_failures_24h, events_of_user_between, distinct_pairs, event_json_details,
    next_purchase, session_history_last_n, session_titles, turn_pairs, group_roles, health_rollup, canonical_ids, first_key_groups,
)}
ORACLES = {
    "doc_catalog_counts": "SELECT d.doc_id, source, lang, coalesce(c, 0) AS n_labels FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS c FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id",
    "orphan_docs": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "visible_docs": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)",
    "chunk_size_stats": "SELECT lang, count(*) AS n, max(length(text)) AS longest, min(length(text)) AS shortest, round(avg(length(text)), 4) AS mean, CAST(sum(length(text)) // count(*) AS BIGINT) AS whole_mean FROM documents GROUP BY lang",
    "oversized_chunks": "SELECT doc_id, source, length(text) AS size FROM documents WHERE length(text) > 3000",
    "global_counts": "SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages",
    "count_alignment": "SELECT source, documents, labelled, labelled - documents AS delta, documents - labelled <= 0.7 * documents AS ok FROM (SELECT source, count(*) AS documents, CAST(sum(coalesce(c, 0)) AS BIGINT) AS labelled FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1)",
    "sync_states": "SELECT CASE WHEN l.doc_id IS NULL THEN 'imported' WHEN d.doc_id IS NULL THEN 'orphaned' WHEN quality = 1 THEN 'skipped' ELSE 'updated' END AS state, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "replace_customers": "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "top_bottom_10": "SELECT * FROM (SELECT s_suppkey, n_name, s_acctbal, 'top' AS side, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, n_name, s_acctbal, 'bottom', row_number() OVER (ORDER BY s_acctbal, s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE rank <= 10",
    "first_matching_parent": "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, first_value(part) OVER w AS parent, l_linenumber = first_value(l_linenumber) OVER w AS is_first FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)",
    "docs_page": "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 10 OFFSET 20",
    "preview_rows": "SELECT source, doc_id, place, total > 5 AS has_more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE place <= 5",
    "event_type_summary": "SELECT coalesce(event_type, '(all)') AS event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)",
    "failed_by_user_alert": "SELECT user_id, count(*) AS failures, count(*) > 5 AS alert FROM events WHERE event_type = 'error' GROUP BY 1",
    "recent_failures_24h": "SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1",
    "events_of_user_between": "SELECT event_id, event_type, value FROM events WHERE user_id = 8 AND ts BETWEEN '2024-01-02' AND '2024-01-12'",
    "distinct_pairs": "SELECT DISTINCT user_id, event_type FROM events",
    "event_json_details": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "next_purchase": "WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase')), n AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN {'ts': ts, 'id': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e) SELECT event_id, user_id, CASE WHEN nxt.ts <= ts + INTERVAL 1 HOUR THEN nxt.id END AS purchase_id FROM n WHERE event_type = 'click'",
    "session_history_last_n": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 10",
    "session_titles": r"SELECT conv_id, trim(substr(array_to_string(string_split(trim(string_split_regex(trim(regexp_replace(t, '\s+', ' ', 'g')), '[.!?]')[1]), ' ')[1:8], ' '), 1, 64)) AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)",
    "turn_pairs": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question_turn, lag(role) OVER w AS before, lead(role) OVER w AS after, right(lag(text) OVER w, 20) AS tail FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "group_roles": "WITH m(c_mktsegment, role) AS (VALUES ('BUILDING', 'admin'), ('BUILDING', 'user'), ('MACHINERY', 'user'), ('HOUSEHOLD', 'auditor'), ('HOUSEHOLD', 'user')) SELECT c_nationkey, string_agg(role, ',' ORDER BY role) AS roles, bool_or(role IN ('admin', 'auditor')) AS may_audit FROM (SELECT DISTINCT c_nationkey, role FROM customer JOIN m USING (c_mktsegment)) GROUP BY 1",
    "health_rollup": "SELECT CAST(CAST(h AS DATE) AS VARCHAR) AS day, CASE WHEN bool_and(bad < 60) THEN 'healthy' ELSE 'degraded' END AS status, CAST(sum(bad) AS BIGINT) AS failures FROM (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1) GROUP BY CAST(h AS DATE)",
    "canonical_ids": "SELECT doc_id, source AS key, 'legacy_' || substr(sha1(source || doc_id), 1, 12) AS legacy, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS snippet FROM documents",
    "first_key_groups": "SELECT coalesce(nullif(trim(lang), ''), nullif(trim(source), '')) AS key, arg_min(source, doc_id) AS source, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
}
