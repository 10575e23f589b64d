"""Parsers of other document kinds, earlier retrieval rules, guardrails, session and token states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import GUARDRAIL_STOPWORDS, TABLE_NUMBER, focus_terms
from ..operators import parsers as P
from ..operators.structure import lines
from ..sources.tables import load
from . import fixtures as fx

APPENDIX = (
    "Domain 1: Kebijakan\nAspek 2: Tata Kelola\nIndikator 5: Tim Koordinasi\nApakah ada tim koordinasi?\nTingkat 1\nBelum ada.\nBelum ada.\nTingkat 2\nAda konsep.\nJawaban: 2\nlain\n"
    "Indikator 6: Layanan\nBagaimana layanan?\n1\nRintisan.\n5\nOptimum."
)
MARKDOWN = "# Laporan\npengantar\n## Hasil\nbaris a\nbaris b\n### Rinci\nrinci satu\n## Saran\nsaran satu\n# Lampiran\nisi lampiran\nGambar 1. Alur\nakhir"
LETTER = "SURAT EDARAN\nYth. Para Pimpinan Instansi\n1. Latar Belakang\nDalam rangka evaluasi.\n2. Maksud dan Tujuan\nMaksud satu.\nTujuan dua.\n3. Penutup\nDemikian."


NOISY = [(i, q, t) for q in (1, 2) for i, t in enumerate(["Daftar Tabel: tabel 2 dan tabel 13", "tabel 2 isi", "tabel 13 isi", "tabel 2 nilai", "tabel 13 nilai"][: 5 if q == 1 else 3])]
NOISY_SCHEMA = "id bigint, query_id bigint, text string"
NAMES = [("tim koordinasi",), ("layanan pengaduan",)]
CALLED = [(1, "Aspek yang dinilai adalah tim koordinasi dan lainnya."), (2, "Indikator pada aspek ini: layanan pengaduan."), (3, "Tidak ada.")]
ROLES = [(1, '["user", "admin", "user"]'), (2, "oops"), (3, None), (4, "[]")]


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return lines(fx.frame(spark, [(1, text), (2, text + "\ntambahan")], "doc_id bigint, text string"))


def indicator_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.indicator_blocks(_lines(spark, APPENDIX))
    return rows.withColumn("criteria", F.array_join(F.transform("criteria", lambda c: F.concat(c["k"], F.lit("="), c["v"])), "|"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.markdown_sections(_lines(spark, MARKDOWN))


def letter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.letter_sections(_lines(spark, LETTER))


def table_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut between lines, 600 characters with 100 of overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, len(c)) for d, t in zip(b.doc_id, b.text, strict=True) for i, c in enumerate(P.split_rows(t or "", 600, 100))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "size"])

    return load(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index int, size int")


def figure_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, [(1, MARKDOWN)], "doc_id bigint, text string")
    figures = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(s).alias("summary")) for n, s in (("Gambar 1", "alur layanan "), ("Gambar 9", "peta"), ("Gambar 2", ""))])
    return rows.select("doc_id", P.inject_summaries(F.col("text"), figures).alias("text"))


def _met(spark: SparkSession) -> DataFrame:
    q = fx.frame(spark, fx.QUESTIONS, fx.QUESTION_SCHEMA).select("query_id", F.lower("text").alias("q"), F.regexp_extract(F.lower("text"), TABLE_NUMBER, 1).alias("no")).where("no <> ''")
    c = fx.frame(spark, fx.CHUNKS, fx.CHUNK_SCHEMA)
    mentioned = c.select("*", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TABLE_NUMBER), F.lit(1)))).alias("no"))
    return q.join(mentioned, "no")


def scored_table_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that mention a question's table, by nine additive rules."""
    meta, low = F.lower(F.concat_ws(" ", "document_title", "context_header", "bab")), F.lower("text")
    index = low.contains("daftar tabel")
    word = lambda n: (n != "") & F.regexp_like(meta, F.concat(F.lit(r"\b"), n, F.lit(r"\b")))
    rules = [
        (meta.contains("lampiran") | F.substring(low, 1, 500).contains("lampiran"), 0.30), (word(F.regexp_extract("q", r"nomor\s+([0-9]+)", 1)), 0.25),
        (word(F.regexp_extract("q", r"tahun\s+([0-9]{4})", 1)), 0.25), (F.col("pasal") != "", -0.10), (index, -0.95), (index & F.col("q").contains("isi"), -0.35),
        (F.length(F.trim("text")) < 280, -0.25), (F.col("is_table"), 0.50), (F.lower("table_label") == F.concat(F.lit("tabel "), "no"), 0.30),
    ]
    score = F.lit(2.5)
    for test, w in rules:
        score = score + F.when(test, w).otherwise(0.0)
    return _met(spark).select("query_id", "id", F.round(score, 2).alias("score"))


def index_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index-page chunks are dropped from a question's candidates only when at least four others remain."""
    noisy = fx.frame(spark, NOISY, NOISY_SCHEMA)
    low = F.lower("text")
    noise = low.contains("tabel") & low.contains("daftar tabel") & ~low.rlike("persamaan|perbedaan|pemantauan spbe|evaluasi spbe") & (F.length("text") < 420)
    marked = noisy.withColumn("noise", noise)
    clean = F.count_if(~F.col("noise")).over(Window.partitionBy("query_id"))
    return marked.withColumn("clean", clean).where("not noise or clean < 4").select("query_id", "id")


def grounding_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic words of a question that its context holds; none means no instruction."""
    rows = fx.frame(spark, fx.ANSWERS, fx.ANSWER_SCHEMA)
    terms = F.filter(focus_terms("question", 8, GUARDRAIL_STOPWORDS), lambda t: F.regexp_like(F.lower("context"), F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])"), t, F.lit(r"(?:[^\p{L}\p{N}_]|$)"))))
    lists = F.lower("question").rlike(r"\b(?:apa saja|sebutkan|daftar|rincian|langkah|tahap|komponen|indikator)\b")
    return rows.select("id", F.array_join(terms, ", ").alias("must_cover"), ((F.size(terms) > 0) & lists).alias("as_list"))


def hierarchy_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators that an answer calls aspects: aspek but not indikator in the 200 characters before the name."""
    names = fx.frame(spark, NAMES, "name string")
    answers = fx.frame(spark, CALLED, "id bigint, answer string")
    met = answers.join(F.broadcast(names), F.contains(F.lower("answer"), F.col("name")))
    at = F.expr("instr(lower(answer), name)")
    before = F.right(F.substring(F.lower("answer"), F.lit(1), at - 1), F.lit(200))
    return met.where(before.contains("aspek") & ~before.contains("indikator")).select("id", "name")


def role_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON role lists: malformed is empty; distinct and sorted when written back."""
    rows = fx.frame(spark, ROLES, "id bigint, roles string")
    parsed = F.coalesce(F.from_json("roles", "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
    return rows.select("id", F.to_json(F.array_sort(F.array_distinct(parsed))).alias("roles"))


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that no closing event removed (soft delete): every one whose last turn is the user's stays."""
    talk = load(spark, sf_dir, "conversations")
    last = talk.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
    return last.withColumn("is_active", F.col("role") == "user").where("turns > 1").select("conv_id", "turns", "last_turn", "is_active")


def anchor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor pairs (words in sequence) of a whole benchmark text that its best document holds; retry when under half."""
    from .retrieval import bm25_topk

    best = bm25_topk(spark, sf_dir).where("rank = 1").select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))
    w = F.expr("regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}_]+)', 1)")
    both = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    pairs = load(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).select("item_id", both.alias("anchors"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array_join(w, " ").alias("flat"))
    met = pairs.join(best, "item_id").join(docs, "doc_id")
    n = F.size(F.filter("anchors", lambda a: F.contains(F.col("flat"), a)))
    return met.select("item_id", n.cast("bigint").alias("found"), (n < F.greatest(F.lit(1), F.size("anchors") / 2)).alias("retry"))


QUERIES = {f.__name__: f for f in (
    indicator_blocks, markdown_sections, letter_sections, table_row_chunks, figure_injection, scored_table_literals, index_noise_filter, grounding_guardrails, hierarchy_confusion,
    role_lists, active_sessions, anchor_coverage,
)}
from .retrieval import CHUNKS, QUESTIONS, _ctes  # noqa: E402
from .rules import FOCUS  # noqa: E402

_STOP = ", ".join(f"'{w}'" for w in GUARDRAIL_STOPWORDS)
_TABLE = r"'\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{1,3})\b'"
ORACLES = {
    "active_sessions": "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, arg_max(role, turn) = 'user' AS is_active FROM conversations GROUP BY 1 HAVING count(*) > 1",
    "index_noise_filter": f"""
WITH n AS (SELECT *, lower(text) AS low FROM {fx.values(NOISY, NOISY_SCHEMA)}),
m AS (SELECT *, contains(low, 'tabel') AND contains(low, 'daftar tabel') AND NOT regexp_matches(low, 'persamaan|perbedaan|pemantauan spbe|evaluasi spbe') AND length(text) < 420 AS noise FROM n)
SELECT query_id, id FROM m QUALIFY NOT noise OR count(*) FILTER (WHERE NOT noise) OVER (PARTITION BY query_id) < 4""",
    "hierarchy_confusion": f"""
WITH m AS (SELECT id, name, right(lower(answer)[1:strpos(lower(answer), name) - 1], 200) AS before FROM {fx.values(CALLED, 'id bigint, answer string')}, {fx.values(NAMES, 'name string')} WHERE contains(lower(answer), name))
SELECT id, name FROM m WHERE contains(before, 'aspek') AND NOT contains(before, 'indikator')""",
    "role_lists": f"SELECT id, CAST(to_json(list_sort(list_distinct(coalesce(TRY(CAST(CAST(roles AS JSON) AS VARCHAR[])), [])))) AS VARCHAR) AS roles FROM {fx.values(ROLES, 'id bigint, roles string')}",
    "grounding_guardrails": rf"""
WITH a AS (SELECT id, lower(context) AS around, lower(question) AS text, coalesce({FOCUS.format(stop=_STOP)}, '') AS terms FROM (SELECT id, context, question, question AS text FROM {fx.values(fx.ANSWERS, fx.ANSWER_SCHEMA)})),
b AS (SELECT *, list_filter(string_split(terms, ' '), lambda t: t <> '' AND regexp_matches(around, '(^|[^\p{{L}}\p{{N}}_])' || t || '([^\p{{L}}\p{{N}}_]|$)')) AS kept FROM a)
SELECT id, array_to_string(kept, ', ') AS must_cover, len(kept) > 0 AND regexp_matches(text, '\b(?:apa saja|sebutkan|daftar|rincian|langkah|tahap|komponen|indikator)\b') AS as_list FROM b""",
    "anchor_coverage": f"""
WITH {_ctes(5)},
w AS (SELECT query_id AS item_id, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) AS anchors FROM q),
m AS (SELECT item_id, anchors, len(list_filter(anchors, lambda a: contains(array_to_string(d.toks, ' '), a))) AS found FROM w JOIN bm_top ON query_id = item_id AND rank = 1 JOIN d USING (id))
SELECT item_id, found, found < greatest(1, len(anchors) / 2) AS retry FROM m""",
    "scored_table_literals": rf"""
WITH q AS (SELECT query_id, lower(text) AS q, regexp_extract(lower(text), {_TABLE}, 1) AS no FROM {QUESTIONS}),
c AS (SELECT *, unnest(list_distinct(regexp_extract_all(lower(text), {_TABLE}, 1))) AS no, lower(concat_ws(' ', document_title, context_header, bab)) AS meta, lower(text) AS low FROM {CHUNKS}),
m AS (SELECT *, regexp_extract(q, 'nomor\s+([0-9]+)', 1) AS num, regexp_extract(q, 'tahun\s+([0-9]{{4}})', 1) AS yr, contains(low, 'daftar tabel') AS idx FROM q JOIN c USING (no) WHERE no <> '')
SELECT query_id, id, CAST(round(2.5 + CASE WHEN contains(meta, 'lampiran') OR contains(low[1:500], 'lampiran') THEN 0.30 ELSE 0 END
  + CASE WHEN num <> '' AND regexp_matches(meta, '\b' || num || '\b') THEN 0.25 ELSE 0 END + CASE WHEN yr <> '' AND regexp_matches(meta, '\b' || yr || '\b') THEN 0.25 ELSE 0 END
  - CASE WHEN pasal <> '' THEN 0.10 ELSE 0 END - CASE WHEN idx THEN 0.95 ELSE 0 END - CASE WHEN idx AND contains(q, 'isi') THEN 0.35 ELSE 0 END - CASE WHEN length(trim(text)) < 280 THEN 0.25 ELSE 0 END
  + CASE WHEN is_table THEN 0.50 ELSE 0 END + CASE WHEN lower(table_label) = 'tabel ' || no THEN 0.30 ELSE 0 END, 2) AS DOUBLE) AS score FROM m""",
}
