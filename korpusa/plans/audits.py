"""Audits of answers: claims against the cited sources, clause references that the context lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, cited
from .answers import _endowed
from .regulations import PIECES, _pieces


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer a document: a claim and a cited line for each of its lines; four sources that name articles, and partly clauses."""
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    pair = lambda x, i: F.array(s("Menurut Pasal ", i % 6, " Ayat (", i % 3 + 1, ")"), F.lit(""), s(x, " [", (F.col("doc_id") + i) % 5 + 1, "]"))
    source = lambda i, header, ayat: F.struct(F.lit(i).alias("id"), F.lit(f"Pasal {i}").alias("section"), F.lit(header).alias("context_header"), F.lit("").alias("pasal"), F.lit(ayat).alias("ayat"))
    given = F.array(source(1, "Ayat (2)", ""), source(2, "ayat 3", ""), source(3, "", "1"), source(4, "", ""))
    return _pieces(spark, sf_dir).select("doc_id", F.array_join(F.flatten(F.transform("p", pair)), "\n").alias("answer"), given.alias("sources"))


def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audited(_claims(spark, sf_dir))
    return rows.select("doc_id", *audit.totals(F.col("audit")))


def scrubbed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without the clause references that their context lacks, and the check after it."""
    rows = _endowed(spark, sf_dir)
    first = cited.ground(rows, "context", "answer").withColumn("answer", audit.scrubbed(F.col("answer"), F.col("unknown_clauses") != ""))
    again = cited.ground(first.select(*rows.columns), "context", "answer")
    return again.select("conv_id", "turn", F.sha2("answer", 256).alias("sha256"), "unknown_articles", "unknown_clauses")


QUERIES = {"citation_audit": citation_audit, "scrubbed_answers": scrubbed_answers}
_NUMBERS = "list_distinct(regexp_extract_all(lower({c}), '{p}', 1))"
_PASAL, _AYAT = (_NUMBERS.replace("{p}", p) for p in (r"pasal\s+(\d+)", r"ayat\s*\(?\s*(\d+)\s*\)?"))
ORACLES = {
    "citation_audit": f"""
WITH {PIECES},
l AS (
  SELECT doc_id, 2 * i AS n, concat('Menurut Pasal ', i % 6, ' Ayat (', i % 3 + 1, ')') AS line FROM pc
  UNION ALL SELECT doc_id, 2 * i + 1, concat(x, ' [', (doc_id + i) % 5 + 1, ']') FROM pc),
w AS (SELECT *, concat_ws(' ', lag(line) OVER o, line, lead(line) OVER o) AS near FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(near, '\\[(\\d+)\\]', 1)), lambda x: x IN ('1', '2', '3', '4')) AS ids, {_PASAL.format(c='line')} AS p, {_AYAT.format(c='line')} AS y FROM w),
k AS (SELECT *, ids AS ap, list_filter(['1', '2', '3'], lambda a: list_contains(ids, CASE a WHEN '2' THEN '1' WHEN '3' THEN '2' ELSE '3' END)) AS ay FROM c WHERE len(ids) > 0 AND len(p) + len(y) > 0),
t AS (
  SELECT doc_id, len(p) + len(y) AS claims, len(list_filter(p, lambda x: NOT list_contains(ap, x))) + CASE WHEN len(ay) > 0 THEN len(list_filter(y, lambda x: NOT list_contains(ay, x))) ELSE 0 END AS bad,
    CASE WHEN len(ay) = 0 THEN len(y) ELSE 0 END AS unknown FROM k)
SELECT src.doc_id, count(t.doc_id) AS segments, coalesce(sum(claims), 0)::BIGINT AS claims, coalesce(sum(bad), 0)::BIGINT AS mismatches, coalesce(sum(unknown), 0)::BIGINT AS unverifiable, coalesce(sum(bad), 0) = 0 AS is_consistent
FROM src LEFT JOIN t USING (doc_id) GROUP BY src.doc_id""",
}
