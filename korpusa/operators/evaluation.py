"""Hit rate and mean reciprocal rank of ranked lists against ground truth: chunk ids, or metadata pairs by containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth_ids(text: Column | str) -> Column:
    """All numbers of a text such as "CHUNK 1, CHUNK 3", as longs; none for null, empty or numberless texts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("long")))


def agrees(pairs: Column, meta: Column) -> Column:
    """Whether each pair's value contains, or is contained in, what the row has for its key, without case; no pairs agree with nothing.

    A missing or empty value is contained in every text, so it agrees.
    """

    def one(entry: Column) -> Column:
        want, have = F.lower(F.coalesce(entry["value"], F.lit(""))), F.lower(F.coalesce(F.try_element_at(meta, entry["key"]), F.lit("")))
        return want.contains(have) | have.contains(want)

    return (F.size(F.map_keys(pairs)) > 0) & F.forall(F.map_entries(pairs), one)


def matched(found: DataFrame, truths: DataFrame) -> DataFrame:
    """``(query_id, at)``: the rank of the first row of ``found(query_id, chunk, rank, meta)`` that a question's truth names; null for none.

    ``truths(query_id, ids, pairs)``: a row a question. A row matches by its id or else by all pairs. One equi-join on the question.
    """
    hit = F.coalesce(F.array_contains("ids", F.col("chunk")), F.lit(False)) | F.coalesce(agrees(F.col("pairs"), F.col("meta")), F.lit(False))
    met = truths.join(found, "query_id", "left")
    return met.groupBy("query_id").agg(F.min(F.when(F.col("rank").isNotNull() & hit, F.col("rank"))).alias("at"))


def scores(first: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``(k, questions, hit_rate, mrr)`` over all questions, a question without a match counting as 0."""
    sums = [x for k in ks for x in (F.avg((F.coalesce("at", F.lit(k + 1)) <= k).cast("double")).alias(f"h{k}"), F.avg(F.when(F.col("at") <= k, 1.0 / F.col("at")).otherwise(0.0)).alias(f"m{k}"))]
    one = first.agg(F.count("*").alias("questions"), *sums)
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col("questions"), F.round(f"h{k}", 6).alias("hit_rate"), F.round(f"m{k}", 6).alias("mrr")) for k in ks])
    return one.select(F.explode(rows).alias("x")).select("x.*")
