"""Audit of answers: article and clause claims near a citation against what the cited sources are about. Native expressions.

Sources are a column ``array<struct<id int, section string, context_header string, pasal string, ayat string>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of claims and citations: fixed values.
ARTICLE = r"(?i)pasal\s+(\d+)"
CLAUSE = r"(?i)ayat\s*\(?\s*(\d+)\s*\)?"
CITED = r"\[(\d+)\]"
SCRUBBED = r"\s+[Aa]yat\s*\(\d+\)"
FIELDS = ("segments", "claims", "mismatches", "unverifiable")


def numbers(text: Column, pattern: str) -> Column:
    """Distinct numbers of a pattern as they are written."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))


def subjects(sources: Column) -> Column:
    """``(id, pasals, ayats)`` of each source with an id; a clause field that is a number only counts where nothing else names one."""

    def one(s: Column) -> Column:
        pasals = F.array_union(F.array_union(numbers(s["pasal"], ARTICLE), numbers(s["section"], ARTICLE)), numbers(s["context_header"], ARTICLE))
        ayats = F.array_union(F.array_union(numbers(s["section"], CLAUSE), numbers(s["context_header"], CLAUSE)), numbers(s["ayat"], CLAUSE))
        return F.struct(s["id"].cast("string").alias("id"), pasals.alias("pasals"), F.when(F.size(ayats) > 0, ayats).otherwise(numbers(s["ayat"], r"(\d+)")).alias("ayats"))

    return F.transform(F.filter(F.coalesce(sources, F.expr("array()").cast("array<struct<id:int,section:string,context_header:string,pasal:string,ayat:string>>")), lambda s: s["id"].isNotNull()), one)


def audited(rows: DataFrame, answer: str = "answer", sources: str = "sources") -> DataFrame:
    """``rows`` with ``audit``: a struct for each line of the answer that has claims and known citations.

    Its fields are ``line, cited, pasals, ayats, missing_pasals, missing_ayats, open_pasals, open_ayats``. A line's citations are those of
    itself and of the lines beside it. Claims that no cited source names are missing; where the cited sources name none of a kind
    at all, its claims are open. Blank lines are left out first; null answers have no lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    # each step is a column of its own, so that no line works out all lines again
    df = rows.withColumn("l__", lines).withColumn("k__", subjects(F.col(sources)))
    df = df.withColumn("f__", F.transform("l__", lambda x: F.struct(x.alias("line"), numbers(x, CITED).alias("ids"), numbers(x, ARTICLE).alias("pasals"), numbers(x, CLAUSE).alias("ayats"))))

    def beside(x: Column, i: Column) -> Column:
        none = F.array().cast("array<string>")
        near = [F.coalesce(F.get("f__", i + d)["ids"], none) for d in (-1, 1)]
        ids = F.array_union(F.array_union(near[0], x["ids"]), near[1])
        return F.struct(x["line"].alias("line"), x["pasals"].alias("pasals"), x["ayats"].alias("ayats"), F.filter("k__", lambda s: F.array_contains(ids, s["id"])).alias("cited"))

    df = df.withColumn("n__", F.filter(F.transform("f__", beside), lambda x: (F.size(x["cited"]) > 0) & (F.size(x["pasals"]) + F.size(x["ayats"]) > 0)))
    both = F.transform("n__", lambda x: F.struct(x.alias("x"), F.array_distinct(F.flatten(F.transform(x["cited"], lambda s: s["pasals"]))).alias("pasals"), F.array_distinct(F.flatten(F.transform(x["cited"], lambda s: s["ayats"]))).alias("ayats")))
    df = df.withColumn("a__", both)

    def judged(y: Column) -> Column:
        none, x = F.array().cast("array<string>"), y["x"]
        missing = [F.when(F.size(y[k]) > 0, F.array_except(x[k], y[k])).otherwise(none).alias(f"missing_{k}") for k in ("pasals", "ayats")]
        still = [F.when(F.size(y[k]) == 0, x[k]).otherwise(none).alias(f"open_{k}") for k in ("pasals", "ayats")]
        return F.struct(x["line"].alias("line"), F.transform(x["cited"], lambda s: s["id"]).alias("cited"), x["pasals"].alias("pasals"), x["ayats"].alias("ayats"), *missing, *still)

    return df.withColumn("audit", F.transform("a__", judged)).drop("l__", "k__", "f__", "n__", "a__")


def totals(rows: Column) -> list[Column]:
    """Counts over ``audited()``: segments, claims, mismatches, unverifiable, and whether nothing is mismatched."""
    total = lambda *fields: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + sum((F.size(x[f]) for f in fields[1:]), F.size(x[fields[0]])))
    wrong = total("missing_pasals", "missing_ayats")
    return [F.size(rows).cast("long").alias("segments"), total("pasals", "ayats").alias("claims"), wrong.alias("mismatches"), total("open_pasals", "open_ayats").alias("unverifiable"), (wrong == 0).alias("is_consistent")]


def scrubbed(answer: Column, unknown: Column) -> Column:
    """The answer without its clause references where some of them are not in the context (``unknown``); else as it is."""
    return F.when(unknown, F.regexp_replace(answer, SCRUBBED, "")).otherwise(answer)
