"""Global row numbers without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.formats import written

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
PLACE_BITS = 33


def laid_out(rows: DataFrame, order: list[Column], at: str = "at__") -> DataFrame:
    """``rows`` by ranges of ``order``, sorted in each partition, with ``at``: partition and place in it. Write it before it is read twice."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())


def placed(laid: DataFrame, name: str, at: str = "at__") -> DataFrame:
    """``name``, the number 1, 2, ... of each row of a written ``laid_out()`` table, in place of ``at``.

    The driver sees one count a partition.
    """
    part = F.shiftright(at, PLACE_BITS)
    counts = sorted(map(tuple, laid.groupBy(part.alias("part__")).count().collect()))
    before = accumulate((n for _, n in counts), initial=0)
    offsets = laid.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part__ long, before__ long")
    number = F.col("before__") + F.col(at).bitwiseAND((1 << PLACE_BITS) - 1) + 1
    rest = [c for c in laid.columns if c != at]
    return laid.withColumn("part__", part).join(F.broadcast(offsets), "part__").select(*rest, number.alias(name))


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, their number 1, 2, ... in ``order``, which should be total.

    Rows are dealt out by ranges of the order and sorted where they are; a row's number is its place in its
    partition plus the rows of the partitions before it. Rows alike in all of ``order`` are numbered in some
    order; no rows give no rows.
    """
    return placed(written(laid_out(rows, order), "numbered"), name)
