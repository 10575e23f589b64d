"""Answer validation, retrieval metrics and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cited, lexical
from ..operators import quality as Q
from ..sources.tables import load
from . import fixtures as fx


def _answers(spark: SparkSession) -> DataFrame:
    return fx.frame(spark, fx.ANSWERS, fx.ANSWER_SCHEMA)


def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality(_answers(spark), "question", "context", "answer", "sources").select("id", "score", "focus_coverage", "citation_count", "list_ok", "has_unavailable", "conflicting", "retry_reasons")


def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate(_answers(spark), "question", "context", "answer", "sources").select("id", "invalid_citations", "unknown_articles", "confidence")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the assistant turn after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    talk = load(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(order), "by": F.lead("role").over(order)})
    return talk.where("role = 'user' and by = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def conversation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("n", F.lit(1))
    return Q.quality(pairs, "question", "question", "answer", "n").select("conv_id", "turn", "score", "focus_coverage", "citation_count", "retry_reasons")


def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(Q.token_recall("question", "answer"), 6).alias("recall"), F.round(Q.token_recall("answer", "question"), 6).alias("coverage"))


def hit_rate_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark questions against documents by BM25; a hit is a document labelled good."""
    docs, asked = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    ranked = lexical.bm25(docs, asked, 10)
    good = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    found = ranked.join(good, "id", "left_semi").groupBy("query_id").agg(F.min("rank").alias("found_at"))
    return Q.hit_metrics(asked.select("query_id").join(found, "query_id", "left"))


def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value by type, first half of the log against the second."""
    e = load(spark, sf_dir, "events")
    mid = e.agg((F.max("event_id") / 2).alias("m")).first().m
    mean = lambda df: df.groupBy("event_type").agg(F.round(F.avg("value") / 100, 6).alias("v"))
    return Q.compare(mean(e.where(F.col("event_id") <= mid)), mean(e.where(F.col("event_id") > mid)), "event_type", "v")


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose event count fell more than 15 percent from the day before."""
    days = load(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("d"))  # one row a day
    return days.withColumn("before", before).select(F.col("d").cast("string").alias("day"), "n", Q.dropped(F.col("before"), F.col("n")).alias("regression"))


def top_failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most frequent retry reasons over all conversation answers."""
    rows = conversation_quality(spark, sf_dir).where("retry_reasons <> ''").select(F.explode(F.split("retry_reasons", ",")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)


def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanity verdict of every answer: long enough, cited, no open claim; with pass and fail counts."""
    q = conversation_quality(spark, sf_dir)
    ok = (F.col("score") >= 5) & (F.col("citation_count") > 0)
    return q.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count_if(~ok & (F.col("focus_coverage") < 0.45)).alias("uncovered"))


def canary_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected words, allowed sources, least score."""
    q = Q.quality(_answers(spark), "question", "context", "answer", "sources")
    exp = fx.frame(spark, [(1, "bobot,domain", 10), (2, "persiapan", 0), (3, "pimpinan", 99)], "id bigint, any string, least int")
    met = q.join(exp, "id")
    words = F.exists(F.split("any", ","), lambda w: F.lower("answer").contains(w))
    return met.select("id", (words & (F.col("score") >= F.col("least"))).alias("pass"), F.concat_ws(",", F.when(~words, "keyword"), F.when(F.col("score") < F.col("least"), "score")).alias("reasons"))


#: Endings put to conversation answers, whose synthetic words neither cite nor number anything.
ENDINGS = [" [1]", "\nPasal 4 ayat (2) [2]", " pada umumnya [9] [1]", "\na. satu [2]\nReferensi Dokumen:\n[1] x", "", "\nPasal 3 Ayat (7) di luar konteks", " [3] [1] [3]"]
CONTEXT = "\n[2] Pasal 3 (2)\na. satu\nb. dua"


def _endowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation answers with endings, contexts and three sources each (none for every eleventh conversation)."""
    ends = F.element_at(F.array(*map(F.lit, ENDINGS)), F.expr(f"cast(pmod(conv_id + turn, {len(ENDINGS)}) + 1 AS int)"))
    source = lambda i, section: F.struct(F.lit(i).alias("id"), F.concat(F.lit(f"Sumber {i} "), F.col("conv_id").cast("string")).alias("title"), F.lit(section).alias("section"))
    given = F.array(source(1, "Pasal 1"), source(2, ""), source(3, " BAB II "))
    return _pairs(spark, sf_dir).withColumns(
        {"answer": F.concat("answer", ends), "context": F.concat(F.lit("[1] "), "question", F.lit(CONTEXT)), "sources": F.when(F.col("conv_id") % 11 == 10, F.slice(given, 1, 0)).otherwise(given)}
    )


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cited.ground(_endowed(spark, sf_dir), "context", "answer")
    return rows.select("conv_id", "turn", "citation_count", "invalid_citations", "unknown_articles", "unknown_clauses", "missing_letters", "beyond", "is_valid", "confidence")


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with footer and reference block, and the sources that they use."""
    rows = _endowed(spark, sf_dir).withColumn("answer", F.trim("answer"))
    used = F.array_join(F.transform(cited.used_sources("answer", F.col("sources")), lambda s: F.concat(s["id"].cast("string"), F.lit("="), s["title"])), ";")
    whole = cited.with_reference_block(cited.with_footer("answer", F.col("sources")), F.col("sources"))
    return rows.select("conv_id", "turn", used.alias("used"), F.sha2(whole, 256).alias("sha256"), F.length(whole).cast("bigint").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    answer_quality, answer_validation, conversation_quality, context_recall, hit_rate_mrr, report_compare, regression_gate, top_failure_reasons, audit_verdicts, canary_expectations,
    grounded_answers, cited_answers,
)}

from .retrieval import _ctes  # noqa: E402
from .rules import FOCUS, STOP  # noqa: E402

PAIRS = "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nxt = 'assistant'"
KEYS = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4))"
_EVIDENCE = "|".join(Q.EVIDENCE)
_CLAIMS = " OR ".join(
    f"len(list_filter(range(1, len(regexp_extract_all(low, '{p}')) + 1), lambda i: NOT regexp_matches(right(regexp_split_to_array(low, '{p}')[i], {Q.AROUND}) || regexp_extract_all(low, '{p}')[i] || left(regexp_split_to_array(low, '{p}')[i + 1], {Q.AROUND}), '{_EVIDENCE}'))) > 0"
    for p in (*Q.UNAVAILABLE, Q.PARTIAL)
)


def _quality_sql(rows: str, keys: str) -> str:
    """SQL of quality() over ``rows`` with the columns keys, text (the question), context, answer, sources."""
    word = r"'(^|[^\p{L}\p{N}_])' || t || '([^\p{L}\p{N}_]|$)'"
    return f"""
(WITH a AS (SELECT {keys}, text, lower(coalesce(context, '')) AS around, trim(coalesce(answer, '')) AS said, lower(trim(coalesce(answer, ''))) AS low, sources, coalesce({FOCUS.format(stop=STOP)}, '') AS terms FROM {rows}),
b AS (SELECT *, list_filter(string_split(terms, ' '), lambda t: t <> '' AND regexp_matches(around, {word})) AS focus FROM a),
c AS (SELECT *, CASE WHEN len(focus) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(focus, lambda t: regexp_matches(low, {word}))) / len(focus) END AS cov,
  len(regexp_extract_all(said, '\\[[0-9]+\\]')) AS citation_count,
  NOT regexp_matches(lower(coalesce(text, '')), '{Q.LIST_INTENT}') OR regexp_matches(said, '(?m)^\\s*(?:[0-9]+[\\.)]|[-*])\\s+') OR len(regexp_extract_all(low, '{Q.ORDINALS}')) >= 2 AS list_ok,
  {_CLAIMS} AS has_unavailable FROM b),
d AS (SELECT *, has_unavailable AND len(focus) > 0 AS conflicting FROM c)
SELECT {keys}, low, round(cov, 4) AS focus_coverage, citation_count, list_ok, has_unavailable, conflicting,
  CAST(least(12, floor(length(said) / 120)) + floor(cov * 10) + CASE WHEN citation_count > 0 THEN 4 ELSE -4 END + CASE WHEN list_ok THEN 3 ELSE -4 END
    + CASE WHEN sources > 0 THEN 2 ELSE -8 END - CASE WHEN has_unavailable THEN 4 ELSE 0 END - CASE WHEN conflicting THEN 6 ELSE 0 END AS BIGINT) AS score,
  concat_ws(',', CASE WHEN conflicting THEN 'conflict' END, CASE WHEN cov < 0.45 AND len(focus) > 0 THEN 'coverage' END, CASE WHEN NOT list_ok THEN 'list' END,
    CASE WHEN citation_count = 0 THEN 'citation' END, CASE WHEN length(said) < 180 THEN 'short' END) AS retry_reasons
FROM d)"""


_TOLD = _quality_sql(f"(SELECT conv_id, turn, question AS text, question AS context, answer, 1 AS sources FROM ({PAIRS}))", "conv_id, turn")
_FIXED = fx.values(fx.ANSWERS, fx.ANSWER_SCHEMA)
_RATED = _quality_sql(f"(SELECT id, question AS text, context, answer, sources FROM {_FIXED})", "id")


def _quoted(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


_ENDOWED = f"""(SELECT conv_id, turn, '[1] ' || question || {_quoted(CONTEXT)} AS context, answer || [{', '.join(map(_quoted, ENDINGS))}][(conv_id + turn) % {len(ENDINGS)} + 1] AS answer, CASE WHEN conv_id % 11 = 10 THEN 0 ELSE 3 END AS n FROM ({PAIRS}))"""
_LESS = "list_sort(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x)))"
_GROUND = rf"""
WITH a AS (SELECT conv_id, turn, context, trim(string_split_regex(answer, '(?im)^Referensi[ \t]+Dokumen[ \t]*:[ \t]*$')[1], ' ' || chr(10)) AS core FROM {_ENDOWED}),
b AS (SELECT conv_id, turn, core, regexp_extract_all(core, '\[([0-9]+)\]', 1) AS ids, coalesce(list_max(CAST(regexp_extract_all(context, '(?m)^\[([0-9]+)\]', 1) AS BIGINT[])), 0) AS blocks,
  {_LESS.format(a="regexp_extract_all(core, '(?i)pasal\\s+([0-9]+)', 1)", b="regexp_extract_all(context, '(?i)pasal\\s+([0-9]+)', 1)")} AS articles,
  {_LESS.format(a="regexp_extract_all(core, '[Aa]yat\\s*\\(([0-9]+)\\)', 1)", b="regexp_extract_all(context, '\\(([0-9]+)\\)', 1)")} AS clauses,
  CASE WHEN regexp_matches(core, '(?m)^[a-z]\.') THEN {_LESS.format(a="regexp_extract_all(context, '(?m)^([a-z])\\.', 1)", b="regexp_extract_all(core, '(?m)^([a-z])\\.', 1)")} ELSE [] END AS letters,
  list_filter([{', '.join(f"'{p}'" for p in cited.BEYOND)}], lambda p: contains(lower(core), p)) AS phrases FROM a),
c AS (SELECT *, list_filter(ids, lambda x: CAST(x AS BIGINT) > blocks) AS bad FROM b)
SELECT conv_id, turn, len(ids) AS citation_count, array_to_string(bad, ',') AS invalid_citations, array_to_string(articles, ',') AS unknown_articles, array_to_string(clauses, ',') AS unknown_clauses,
  array_to_string(letters, ',') AS missing_letters, array_to_string(phrases, ',') AS beyond, len(bad) = 0 AND len(phrases) = 0 AS is_valid,
  CASE WHEN len(phrases) > 0 THEN 'low' WHEN len(articles) + len(clauses) > 0 THEN 'medium' WHEN len(ids) = 0 THEN 'low' ELSE 'high' END AS confidence
FROM c
"""
_CITED = rf"""
WITH a AS (SELECT conv_id, turn, trim(answer) AS answer, n, [x for x in list_distinct(CAST(regexp_extract_all(answer, '\[([0-9]+)\]', 1) AS BIGINT[]))] AS ids,
  (['Sumber 1 ' || conv_id, 'Sumber 2 ' || conv_id, 'Sumber 3 ' || conv_id])[1:n] AS titles FROM {_ENDOWED}),
b AS (SELECT *, CASE WHEN len(ids) = 0 THEN range(1, n + 1) ELSE list_filter(range(1, n + 1), lambda i: list_contains(ids, i)) END AS kept,
  answer || CASE WHEN n > 0 AND len(ids) = 0 THEN chr(10) || chr(10) || '{cited.FOOTER}' || array_to_string(list_transform(range(1, n + 1), lambda i: '[' || i || ']'), ', ') || '.' ELSE '' END AS noted FROM a),
c AS (SELECT *, list_transform(list_filter(list_sort(CASE WHEN noted <> answer THEN range(1, n + 1) ELSE ids END)[1:8], lambda i: i BETWEEN 1 AND n), lambda i: '[' || i || '] ' || titles[i] || (['| Pasal 1', '', '| BAB II'])[i]) AS lines0 FROM b),
d AS (SELECT *, list_transform(lines0, lambda l: replace(l, '|', ' |')) AS lines FROM c),
e AS (SELECT *, CASE WHEN len(lines) = 0 OR regexp_matches(noted, '(?im)^referensi\s+dokumen\s*:') THEN trim(noted) ELSE trim(noted) || chr(10) || chr(10) || '{cited.HEADING}' || chr(10) || array_to_string(lines, chr(10)) END AS whole FROM d)
SELECT conv_id, turn, array_to_string(list_transform(range(1, len(kept) + 1), lambda i: i || '=' || titles[kept[i]]), ';') AS used, sha256(whole) AS sha256, length(whole) AS n_chars FROM e
"""
ORACLES = {
    "answer_quality": f"SELECT id, score, focus_coverage, citation_count, list_ok, has_unavailable, conflicting, retry_reasons FROM {_RATED}",
    "answer_validation": rf"""
WITH a AS (SELECT id, sources, CAST(regexp_extract_all(answer, '\[([0-9]+)\]', 1) AS BIGINT[]) AS ids,
  {_LESS.format(a="regexp_extract_all(lower(answer), 'pasal\\s+([0-9]+)', 1)", b="regexp_extract_all(lower(context || ' ' || question), 'pasal\\s+([0-9]+)', 1)")} AS unknown FROM {_FIXED}),
b AS (SELECT *, list_filter(ids, lambda x, i: list_position(ids, x) = i AND (x < 1 OR x > sources)) AS bad FROM a)
SELECT id, array_to_string(bad, ',') AS invalid_citations, array_to_string(unknown, ',') AS unknown_articles, CASE WHEN len(ids) = 0 OR len(unknown) > 0 THEN 'low' WHEN len(bad) > 0 THEN 'medium' ELSE 'high' END AS confidence FROM b""",
    "conversation_quality": f"SELECT conv_id, turn, score, focus_coverage, citation_count, retry_reasons FROM {_TOLD}",
    "top_failure_reasons": f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(retry_reasons, ',')) AS reason FROM {_TOLD}) WHERE reason <> '' GROUP BY 1 ORDER BY n DESC, reason LIMIT 5",
    "audit_verdicts": f"SELECT count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE NOT ok AND focus_coverage < 0.45) AS uncovered FROM (SELECT *, score >= 5 AND citation_count > 0 AS ok FROM {_TOLD})",
    "canary_expectations": f"SELECT id, words AND score >= least AS pass, concat_ws(',', CASE WHEN NOT words THEN 'keyword' END, CASE WHEN score < least THEN 'score' END) AS reasons FROM (SELECT *, len(list_filter(string_split(wanted, ','), lambda w: contains(low, w))) > 0 AS words FROM {_RATED} JOIN (VALUES (1, 'bobot,domain', 10), (2, 'persiapan', 0), (3, 'pimpinan', 99)) e(id, wanted, least) USING (id))",
    "grounded_answers": _GROUND,
    "cited_answers": _CITED,
    "context_recall": f"SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS recall, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, q)) / len(a) END, 6) AS coverage FROM (SELECT conv_id, turn, {KEYS.format(c='question')} AS q, {KEYS.format(c='answer')} AS a FROM ({PAIRS}))",
    "hit_rate_mrr": f"WITH {_ctes(10)}, f AS (SELECT query_id, min(rank) AS found_at FROM bm_top WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1), r AS (SELECT item_id AS query_id, found_at FROM benchmark LEFT JOIN f ON item_id = query_id) SELECT k, round(avg(CASE WHEN found_at <= k THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(avg(CASE WHEN found_at <= k THEN 1.0 / found_at ELSE 0.0 END), 4) AS mrr FROM r, (VALUES (1), (3), (5), (10)) t(k) GROUP BY k",
    "report_compare": "WITH m AS (SELECT event_type, event_id > (SELECT max(event_id) / 2 FROM events) AS late, round(avg(value) / 100, 6) AS v FROM events GROUP BY 1, 2) SELECT a.event_type, a.v AS before, b.v AS now, round(b.v - a.v, 6) AS delta, CASE WHEN round(b.v - a.v, 6) > 0.001 THEN 'improve' WHEN round(b.v - a.v, 6) < -0.05 THEN 'REGRESS' WHEN round(b.v - a.v, 6) < -0.001 THEN 'minor' ELSE 'same' END AS status FROM m a JOIN m b ON a.event_type = b.event_type AND NOT a.late AND b.late",
    "regression_gate": "SELECT CAST(d AS VARCHAR) AS day, n, coalesce((b - n) / b > 0.15, false) AS regression FROM (SELECT d, n, lag(n) OVER (ORDER BY d) AS b FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1))",
}
