"""Answers and their sources: reference blocks, cited sources, footers, grounding checks. All native expressions.

Sources are a column ``array<struct<id int, title string, section string>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_ids

MOST_LISTED, DEFAULT_SOURCES = 8, 3
#: Heading and footer of answers, fixed values.
HEADING = "Referensi Dokumen:"
FOOTER = "Catatan referensi: Poin di atas disintesis dari sumber "
#: Phrases of answers from beyond the context, fixed values.
BEYOND = [
    "berdasarkan pengetahuan saya", "menurut pengalaman", "pada umumnya", "biasanya dalam praktik", "secara umum diketahui", "menurut sumber lain", "di luar konteks",
    "tidak disebutkan tetapi",
]


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def with_reference_block(answer: Column | str, sources: Column) -> Column:
    """The answer with one line a cited source below it (the first three sources where none is cited), at most eight."""
    base = F.trim(text_of(answer))
    cited = F.array_sort(citation_ids(base))
    ids = F.when(F.size(cited) > 0, cited).otherwise(F.transform(F.slice(sources, 1, DEFAULT_SOURCES), lambda s: s["id"].cast("bigint")))
    named = F.transform(F.slice(ids, 1, MOST_LISTED), lambda i: F.get(F.filter(sources, lambda s: s["id"] == i), F.lit(0)))
    section = lambda s: F.trim(text_of(s["section"]))
    title = lambda s: F.trim(F.coalesce(F.nullif(s["title"], F.lit("")), F.lit("Dokumen")))
    line = lambda s: F.concat(F.lit("["), s["id"].cast("string"), F.lit("] "), title(s), F.when(section(s) != "", F.concat(F.lit(" | "), section(s))).otherwise(""))
    lines = F.transform(F.filter(named, lambda s: s.isNotNull()), line)
    as_is = (base == "") | (F.size(lines) == 0) | base.rlike(r"(?im)^referensi\s+dokumen\s*:")
    return F.when(as_is, base).otherwise(F.concat(base, F.lit(f"\n\n{HEADING}\n"), F.array_join(lines, "\n")))


def without_reference_block(answer: Column | str) -> Column:
    return F.trim(F.get(F.split(text_of(answer), r"(?im)^Referensi[ \t]+Dokumen[ \t]*:[ \t]*$", 2), F.lit(0)), F.lit(" \n"))


def used_sources(answer: Column | str, sources: Column) -> Column:
    """Sources that the answer cites, numbered anew; the first three where it cites none."""
    cited = citation_ids(text_of(answer))
    kept = F.filter(sources, lambda s: F.array_contains(cited, s["id"].cast("bigint")))
    anew = F.transform(kept, lambda s, i: F.struct((i + 1).alias("id"), s["title"].alias("title"), s["section"].alias("section")))
    return F.when(F.size(cited) == 0, F.slice(sources, 1, DEFAULT_SOURCES)).otherwise(anew)


def with_footer(answer: Column | str, sources: Column) -> Column:
    """An answer without any citation names all its sources in a footer."""
    a = text_of(answer)
    tags = F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))), ", ")
    return F.when((F.size(sources) > 0) & ~a.rlike(r"\[[0-9]+\]"), F.concat(a, F.lit(f"\n\n{FOOTER}"), tags, F.lit("."))).otherwise(a)


def ground(df: DataFrame, context: str, answer: str) -> DataFrame:
    """Adds what an answer claims beyond its context, and is_valid and confidence from it.

    citation_count; invalid_citations beyond the context's numbered blocks; unknown_articles and unknown_clauses;
    missing_letters of a lettered list that the answer has in part; beyond, phrases that point elsewhere.
    """
    core, around = without_reference_block(answer), text_of(context)
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    cited = every(core, r"\[([0-9]+)\]")
    blocks = F.coalesce(F.array_max(F.transform(every(around, r"(?m)^\[([0-9]+)\]"), lambda x: x.try_cast("bigint"))), F.lit(0))
    letters = every(core, r"(?m)^([a-z])\.")
    less = lambda a, b: F.array_sort(F.array_except(a, b))
    found = {
        "invalid_citations": F.filter(cited, lambda x: F.coalesce(x.try_cast("bigint") > blocks, F.lit(True))),
        "unknown_articles": less(every(core, r"(?i)pasal\s+([0-9]+)"), every(around, r"(?i)pasal\s+([0-9]+)")),
        "unknown_clauses": less(every(core, r"[Aa]yat\s*\(([0-9]+)\)"), every(around, r"\(([0-9]+)\)")),
        "missing_letters": F.when(F.size(letters) > 0, less(every(around, r"(?m)^([a-z])\."), letters)).otherwise(F.array().cast("array<string>")),
        "beyond": F.filter(F.array(*map(F.lit, BEYOND)), lambda p: F.contains(F.lower(core), p)),
    }
    df = df.withColumns({"citation_count": F.size(cited).cast("bigint"), **{k: F.array_join(v, ",") for k, v in found.items()}})
    unknown = (F.col("unknown_articles") != "") | (F.col("unknown_clauses") != "")
    confidence = F.when(F.col("beyond") != "", "low").when(unknown, "medium").when(F.col("citation_count") == 0, "low").otherwise("high")
    return df.withColumns({"is_valid": (F.col("invalid_citations") == "") & (F.col("beyond") == ""), "confidence": confidence})
