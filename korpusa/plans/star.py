"""Extensions on the star schema: joins, grouping sets, frames, set operations, statistics.

The capability survey lists these as absent in the system this engine replaces; they come with Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, disc = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2001-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"),
    )


def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, line, n, r = (load(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "nation", "region"))
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return rows.groupBy("r_name", "c_mktsegment").agg(revenue.alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return cube.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means overall and by language in one pass over the label metrics (grouping sets)."""
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows.createOrReplaceTempView("metric_rows__")
    return spark.sql(
        "SELECT coalesce(lang, '(all)') AS doc_type, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, round(avg(CASE WHEN n_chars > 0 THEN n_chars END), 4) AS latency, count(*) AS n "
        "FROM metric_rows__ GROUP BY GROUPING SETS ((), (lang))"
    )


def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(by.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.avg("o_totalprice").over(by.rowsBetween(-2, 0)), 4).alias("recent"), F.rank().over(by).cast("bigint").alias("place"),
        F.ntile(4).over(by).cast("bigint").alias("quarter"),
    )


def top_parts_per_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    rows = sold.join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("p_brand").orderBy(F.desc("qty"), "p_partkey")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 3").select("p_brand", "p_partkey", "qty", "rank")


def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, t: df.select("k", F.lit(t).alias("op"))
    return tag(c.union(s).distinct(), "union").unionByName(tag(c.intersect(s), "both")).unionByName(tag(c.exceptAll(s).distinct(), "extra"))


def priority_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    p = o.groupBy("y").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return p.select("y", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"n_{c.lower()}") for c in ("F", "O", "P")])


def value_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"),
        F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"),
    )


QUERIES = {f.__name__: f for f in (
    pricing_summary, segment_revenue, order_cube, metric_means, running_balance, top_parts_per_brand, customers_without_large_orders, set_operations, priority_pivot, value_statistics,
)}
ORACLES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= '2001-09-02' GROUP BY 1, 2",
    "segment_revenue": "SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "order_cube": "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "metric_means": "SELECT coalesce(lang, '(all)') AS doc_type, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, round(avg(CASE WHEN n_chars > 0 THEN n_chars END), 4) AS latency, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))",
    "running_balance": "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent, rank() OVER w AS place, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "top_parts_per_brand": "SELECT p_brand, p_partkey, qty, rank FROM (SELECT p_brand, p_partkey, qty, row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, p_partkey) AS rank FROM (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey) WHERE rank <= 3",
    "customers_without_large_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "set_operations": "SELECT k, 'union' AS op FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'both' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT k, 'extra' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)",
    "priority_pivot": "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "value_statistics": "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, count(*) FILTER (WHERE value > 50) AS large, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
}
