"""Answer quality: grounding, citations, scores, retrieval metrics, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_ids, focus_terms, key_tokens

#: Phrases that claim something is unavailable, and words that are local evidence against the claim; fixed values.
UNAVAILABLE = ("tidak tercantum", "tidak tersedia", "tidak ditemukan", "tidak ada informasi", "belum tersedia", "tidak secara eksplisit", "belum dijelaskan")
EVIDENCE = (
    r"\b[0-9]+(?:[.,][0-9]+)?\b", r"tahap\s+(?:persiapan|pelaksanaan|pelaporan)", r"indikator\s*[0-9]", r"aspek\s*[0-9]", r"domain\s*[0-9]",
    r"\b(?:sangat\s+baik|baik|cukup|kurang|memuaskan)\b", r"bobot[^\n]{0,40}[0-9]", r"\[[0-9]+\]",
)
PARTIAL = r"hanya\s+(?:mencantumkan|memuat)[^\n\r\.;:]{0,140}\b(?:tanpa|tidak|belum|sementara)\b"
LIST_INTENT = r"\b(?:apa saja|sebutkan|daftar|rincian|langkah|tahap|komponen|indikator|poin)\b|\b(?:tabel|table)\s*(?:ke[-\s]*)?[0-9]{1,3}\b"
ORDINALS = r"\b(?:pertama|kedua|ketiga|keempat|kelima|keenam)\b"
AROUND = 140


def unavailable(answer: Column) -> Column:
    """Whether the answer claims that something is unavailable with no evidence within 140 characters of the claim."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    found = []
    for pattern in [*UNAVAILABLE, PARTIAL]:
        hits, pieces = F.regexp_extract_all(low, F.lit(f"({pattern})"), F.lit(1)), F.split(low, pattern, -1)
        near = _around(hits, pieces)
        found.append(F.exists(near, lambda w: ~w.rlike("|".join(EVIDENCE))))
    return reduce(lambda a, b: a | b, found)


def _around(hits: Column, pieces: Column) -> Column:
    return F.transform(hits, lambda h, i: F.concat(F.right(F.get(pieces, i), F.lit(AROUND)), h, F.left(F.get(pieces, i + 1), F.lit(AROUND))))


def quality(df: DataFrame, question: str, context: str, answer: str, sources: str) -> DataFrame:
    """Adds focus_coverage, citation_count, list_ok, has_unavailable, conflicting, score and retry_reasons."""
    text = F.trim(F.coalesce(F.col(answer), F.lit("")))
    low, around = F.lower(text), F.lower(F.coalesce(F.col(context), F.lit("")))
    word = lambda where, t: F.regexp_like(where, F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])"), t, F.lit(r"(?:[^\p{L}\p{N}_]|$)")))
    df = df.withColumn("focus", F.filter(focus_terms(question), lambda t: word(around, t)))
    hit = F.size(F.filter("focus", lambda t: word(low, t)))
    df = df.withColumn("coverage__", F.when(F.size("focus") > 0, hit / F.size("focus")).otherwise(1.0))
    wants = F.lower(F.coalesce(F.col(question), F.lit(""))).rlike(LIST_INTENT)
    lists = text.rlike(r"(?m)^\s*(?:[0-9]+[\.)]|[-*])\s+") | (F.regexp_count(low, F.lit(ORDINALS)) >= 2)
    df = df.withColumns(
        {
            "citation_count": F.regexp_count(text, F.lit(r"\[[0-9]+\]")).cast("bigint"),
            "list_ok": ~wants | lists,
            "has_unavailable": unavailable(text),
            "size__": F.length(text),
        }
    ).withColumn("conflicting", F.col("has_unavailable") & (F.size("focus") > 0))
    score = (
        F.least(F.lit(12), F.floor(F.col("size__") / 120))
        + F.floor(F.col("coverage__") * 10)
        + F.when(F.col("citation_count") > 0, 4).otherwise(-4)
        + F.when(F.col("list_ok"), 3).otherwise(-4)
        + F.when(F.col(sources) > 0, 2).otherwise(-8)
        - F.when(F.col("has_unavailable"), 4).otherwise(0)
        - F.when(F.col("conflicting"), 6).otherwise(0)
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("conflicting"), "conflict"), F.when((F.col("coverage__") < 0.45) & (F.size("focus") > 0), "coverage"), F.when(~F.col("list_ok"), "list"),
            F.when(F.col("citation_count") == 0, "citation"), F.when(F.col("size__") < 180, "short"),
        ),
        lambda x: x.isNotNull(),
    )
    return df.withColumns({"score": score.cast("bigint"), "retry_reasons": F.array_join(reasons, ","), "focus_coverage": F.round("coverage__", 4)}).drop("coverage__", "size__", "focus")


def validate(df: DataFrame, question: str, context: str, answer: str, sources: str) -> DataFrame:
    """Adds invalid_citations, unknown_articles and confidence: what the answer cites that sources or context lack."""
    cited = citation_ids(answer)
    bad = F.filter(cited, lambda n: (n < 1) | (n > F.col(sources)))
    articles = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"pasal\s+([0-9]+)"), F.lit(1)))
    unknown = F.array_except(articles(answer), F.array_union(articles(context), articles(question)))
    confidence = F.when((F.size(cited) == 0) | (F.size(unknown) > 0), "low").when(F.size(bad) > 0, "medium").otherwise("high")
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return df.withColumns({"invalid_citations": text(bad), "unknown_articles": text(F.array_sort(unknown)), "confidence": confidence})


def token_recall(truth: Column | str, other: Column | str) -> Column:
    """Share of the truth's tokens of four letters or more that occur in the other text; 0 without any."""
    t = key_tokens(truth)
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.array_intersect(t, key_tokens(other))) / F.size(t))


def hit_metrics(found: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``(k, hit_rate, mrr)`` from one row a question with ``found_at`` (null: not found)."""
    at = F.col("found_at")
    rows = found.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "found_at")
    hit = (at <= F.col("k")) & at.isNotNull()
    return rows.groupBy("k").agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 4).alias("hit_rate"), F.round(F.avg(F.when(hit, 1.0 / at).otherwise(0.0)), 4).alias("mrr"))


def compare(base: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, before, now, delta, status)``: improve over .001, REGRESS under -.05, minor under -.001, else same."""
    both = base.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("now")), key)
    delta = F.round(F.col("now") - F.col("before"), 6)
    status = F.when(delta > 0.001, "improve").when(delta < -0.05, "REGRESS").when(delta < -0.001, "minor").otherwise("same")
    return both.withColumn("delta", delta).withColumn("status", status)


def dropped(base: Column, now: Column, share: float = 0.15) -> Column:
    """Whether a score fell by more than a share of a positive baseline."""
    return F.coalesce((base > 0) & ((base - now) / base > share), F.lit(False))
