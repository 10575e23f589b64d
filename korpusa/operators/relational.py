"""Catalog, session and security-event operators as plain relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` with how many rows of ``right`` share its key, 0 for none: one grouped side, one left join."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def sync_state(source: DataFrame, target: DataFrame, key: str, same: Column) -> DataFrame:
    """``(key, state)``: imported (source only), updated or skipped (both), orphaned (target only).

    Columns of the two sides are read as ``s.*`` and ``t.*`` in ``same``.
    """
    both = source.alias("s").join(target.alias("t"), F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")
    state = (
        F.when(F.col(f"t.{key}").isNull(), "imported").when(F.col(f"s.{key}").isNull(), "orphaned").when(same, "skipped").otherwise("updated")
    )
    return both.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), state.alias("state"))


def replace_by_key(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with every row of a key in ``rows`` replaced by those rows; new keys are added."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def both_ends(df: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    """The n best and n worst rows, with ``side`` and ``rank``; a missing score counts as -1."""
    value = F.coalesce(F.col(score), F.lit(-1.0))
    down, up = Window.orderBy(F.desc("v__"), tie), Window.orderBy("v__", tie)
    df = df.withColumn("v__", value)
    # each side is a top-n of partial top-n rows; only n rows are numbered
    best = df.orderBy(F.desc("v__"), tie).limit(n).withColumn("side", F.lit("top")).withColumn("rank", F.row_number().over(down))
    worst = df.orderBy("v__", tie).limit(n).withColumn("side", F.lit("bottom")).withColumn("rank", F.row_number().over(up))
    return best.unionByName(worst).drop("v__").withColumn("rank", F.col("rank").cast("bigint"))


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def last_turns(talk: DataFrame, n: int) -> DataFrame:
    """The newest n turns of every conversation with their place in chronological order."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = talk.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)
    place = F.max("k").over(Window.partitionBy("conv_id")) - F.col("k") + 1
    return kept.withColumn("place", place.cast("bigint")).drop("k")


def alerts(events: DataFrame, who: str, more_than: int) -> DataFrame:
    """Failures by originator with an alert flag when there are more than a limit."""
    counts = events.groupBy(who).agg(F.count("*").alias("failures"))
    return counts.withColumn("alert", F.col("failures") > more_than)


def carry_forward(df: DataFrame, group: str, order: str, value: str, when: Column, name: str) -> DataFrame:
    """Last ``value`` of a row that satisfies ``when``, up to and including the current row."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(when, F.col(value)), ignorenulls=True).over(upto))
