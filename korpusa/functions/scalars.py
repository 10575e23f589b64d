"""Column-level helpers: missing values, casts, titles, scores, identifiers. All native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_non_blank(*cols: Column | str) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cols])


def safe_int(c: Column | str) -> Column:
    """Integer value of a text, null when it is not one."""
    return F.expr(f"try_cast({c} as int)") if isinstance(c, str) else c.try_cast("int")


def comma_decimal(c: Column | str) -> Column:
    """``"3,25"`` as 3.25, null when it is no number."""
    return F.replace(col(c), F.lit(","), F.lit(".")).try_cast("double")


def one_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def title_from_filename(c: Column | str) -> Column:
    """Stem of a file name with ``_`` and ``-`` as spaces."""
    return F.trim(F.translate(F.regexp_replace(F.regexp_replace(col(c), r"^.*/", ""), r"\.[^.]*$", ""), "_-", "  "))


def safe_filename(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^A-Za-z0-9_.-]", "_")


def snippet(c: Column | str, size: int = 200) -> Column:
    return F.when(F.length(col(c)) > size, F.concat(F.substring(col(c), 1, size), F.lit("..."))).otherwise(col(c))


def canonical_doc_id(doc_id: Column | str, number: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(col(doc_id)), F.lit("")), col(number).cast("string"))


def legacy_id(c: Column | str) -> Column:
    return F.concat(F.lit("legacy_"), F.substring(F.sha1(col(c)), 1, 12))


def display_score(raw: Column, rank: Column) -> Column:
    """Raw retrieval score on the 0-99.9 display scale, slightly lower for each later rank (from 1)."""
    shown = F.when(raw < 0.1, F.least(F.lit(75.0), 65.0 + raw * 300)).otherwise(F.least(F.lit(99.9), 75.0 + raw * 8.5))
    exact = F.greatest(F.lit(0.0), shown - rank * 0.14).cast("decimal(20,9)")  # so that a half is one wherever it is computed
    return F.round(exact, 2).cast("double")


def roman_to_int(c: Column | str) -> Column:
    """Value of a roman numeral, 0 for text without one."""
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    table = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    digits = F.transform(F.split(F.regexp_replace(F.upper(col(c)), "[^IVXLCDM]", ""), ""), lambda x: F.coalesce(F.get(F.array(F.element_at(table, x)), F.lit(0)), F.lit(0)))
    folded = F.aggregate(
        digits,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, d: F.struct((a["sum"] + d - F.when(d > a["last"], 2 * a["last"]).otherwise(0)).alias("sum"), d.alias("last")),
    )
    return folded["sum"]


def session_title(c: Column | str, words: int = 8, size: int = 64) -> Column:
    """First sentence of a message, at most ``words`` words and ``size`` characters."""
    sentence = F.element_at(F.split(one_space(c), r"[.!?]"), 1)
    return F.trim(F.substring(F.array_join(F.slice(F.split(F.trim(sentence), " "), 1, words), " "), 1, size))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays, 0 when either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(col(x), col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
