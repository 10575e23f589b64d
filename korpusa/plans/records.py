"""Chunk records, source paths, figure chunks and expectations over the given tables; metadata by fixed templates of doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FIGURE_KINDS
from ..operators import quality as Q
from ..operators import records as R
from ..sources.tables import load
from .answers import PAIRS, _pairs, _quality_sql

#: Stored metadata as found in practice; ``#`` stands for the document's id.
METADATA = (
    '{"chunk_index": 7, "doc_type": "peraturan", "tentang": "Aturan #", "bab": "BAB III", "bagian": "Bagian Kedua", "pasal": 38, "ayat": "4", "is_parent": true, "chunk_part": "2", "chunk_parts_total": 5}',
    '{"chunk_index": "12", "doc_type": "audit", "filename": "Laporan_#.pdf", "section": "hasil AUDIT tahap-#a", "section_part": 3, "is_indexed": false, "text": ""}',
    '{"chunk_index": "x", "hierarchy": "Bab # > Umum", "context_header": "Umum", "document_title": "Dokumen #", "is_table": 1, "table_label": "Tabel #", "original_table": "| a |"}',
    '{"doc_type": null, "bab": null, "context_header": "Kepala #", "chunk_part": 99999999999, "is_parent": "", "chunk_type": "figure", "raw_text": "asli #"}',
    '{"doc_type": "peraturan", "pasal": "1"',
    '[{"bab": "#"}]',
    "",
    '{"text": "teks #", "chunk_text": "lain", "doc_type": "peraturan", "pasal": "#", "is_parent": 0, "chunk_index": -1}',
    None,
)
CAPTIONS = ("Gambar 1. Diagram alur #", "Gambar 2. Foto presiden #", "Gambar 3. Grafik batang #", None, "Gambar 4. Capaian indeks 2020", "")


def _template(values: tuple, at: Column) -> Column:
    """The value at ``at`` modulo their number, with doc_id in it."""
    one = F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    return F.replace(one, F.lit("#"), F.col("doc_id").cast("string"))


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored chunk with metadata, mapped to a record."""
    d = load(spark, sf_dir, "documents")
    r = d.select(R.chunk_record(F.col("doc_id"), F.lit(3), F.col("text"), _template(METADATA, F.col("doc_id"))).alias("r")).select("r.*")
    return r.withColumns({c: F.md5(c) for c in ("text", "raw_text")})


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits a document as numbered sources, by kind and by law alone."""
    hits = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*[_template(METADATA, F.col("doc_id") * 3 + k) for k in range(3)])).alias("at", "metadata"))
    r = hits.withColumn("r", R.chunk_record(F.col("doc_id"), F.col("at"), F.lit(""), F.col("metadata")))
    r = r.select("doc_id", (F.col("at") + 1).cast("bigint").alias("id"), R.source_path(F.col("r")).alias("s"), R.legal_path(F.col("r")).alias("l"))
    return r.select("doc_id", "id", "s.document", "s.section", F.col("l.document").alias("legal_document"), F.col("l.section").alias("legal_section"))


def figure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four figures a document, one of them twice, described by its whole text."""
    k = F.col("k")
    f = load(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).withColumn("caption", _template(CAPTIONS, F.col("doc_id") + k))
    f = f.select(
        "doc_id", F.concat(F.lit("f"), k.cast("string")).alias("figure_id"), (F.lit(9) - k).alias("page"), F.regexp_extract(F.coalesce("caption", F.lit("")), r"^Gambar [0-9]+", 0).alias("figure_number"), "caption",
        (F.lit(100) * (k + 1)).alias("width"), F.lit(160).alias("height"), F.md5((k % 4).cast("string")).alias("hash"), F.when(F.pmod(F.col("doc_id") + k, F.lit(7)) == 6, "failed").otherwise("ocr").alias("method"), F.col("text").alias("detail"),
    )
    return R.figure_chunks(f).withColumn("text", F.md5("text"))


def canary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation answers against expectations and a baseline score, both by a rule of conversation and turn."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), lambda c: c.cast("string")
    told = Q.quality(_pairs(spark, sf_dir).withColumn("n", F.lit(1)), "question", "question", "answer", "n")
    reasons = R.unmet(
        F.col("answer"), F.array(text(conv), F.concat(F.lit(" "), text(conv + turn % 3)), F.lit("")), F.col("score"), F.col("has_unavailable"),
        F.when(conv % 4 != 0, F.array(F.split(F.coalesce("question", F.lit("")), " ")[0], F.lit("BOBOT"))),
        F.when(conv % 3 != 0, F.array(text(conv), text(conv + 1))), F.when(conv % 5 < 4, conv % 5 * 2), F.when(turn % 4 == 0, turn % 8 == 4),
    )
    return told.select("conv_id", "turn", (F.size(reasons) == 0).alias("pass"), F.array_join(reasons, ",").alias("reasons"), Q.dropped(F.col("score") + conv % 4, F.col("score")).alias("regression"))


QUERIES = {f.__name__: f for f in (chunk_records, source_paths, figure_chunks, canary_gate)}


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _of(values: tuple, at: str) -> str:
    return f"replace(({_list(values)})[({at}) % {len(values)} + 1], '#', CAST(doc_id AS VARCHAR))"


_INT = "CASE WHEN regexp_matches(j ->> '{n}', '^[ ]*[+-]?[0-9]+[ ]*$') THEN TRY_CAST(trim(j ->> '{n}') AS INTEGER) END"
_TEXT = "coalesce(j ->> '{n}', '')"


def _records(rows: str) -> str:
    """SQL of chunk_record over ``rows`` with doc_id, i (the index), text and meta."""
    fields = [f"{_TEXT.format(n=n)} AS {n}" for n in R.TEXTS] + [f"{_INT.format(n=n)} AS {n}" for n in R.NUMBERS]
    fields += [f"coalesce(lower(j ->> '{n}') NOT IN ('false', '0', ''), {str(d).lower()}) AS {n}" for n, d in R.FLAGS.items()]
    return f"""(SELECT doc_id, i, doc_id AS id, coalesce({_INT.format(n='chunk_index')}, i) AS chunk_index,
  coalesce(nullif(j ->> 'text', ''), nullif(j ->> 'chunk_text', ''), text, '') AS text, coalesce(nullif(j ->> 'raw_text', ''), nullif(text, ''), j ->> 'text', '') AS raw_text,
  coalesce(nullif(j ->> 'chunk_type', ''), 'text') AS chunk_type, {', '.join(fields)}
FROM (SELECT *, CASE WHEN json_type(TRY_CAST(meta AS JSON)) = 'OBJECT' THEN TRY_CAST(meta AS JSON) END AS j FROM {rows}))"""


_FILE = "replace(replace(filename, '.pdf', ''), '_', ' ')"
_CAPITAL = r"array_to_string(list_transform(regexp_extract_all(lower(section), '\p{L}+|[^\p{L}]+'), lambda w: upper(w[1]) || w[2:]), '')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{kind}'" for kind, p in FIGURE_KINDS) + " WHEN width / height > 2.5 THEN 'timeline_image' ELSE 'diagram' END"
_TOLD = _quality_sql(f"(SELECT conv_id, turn, question AS text, question, question AS context, answer, 1 AS sources FROM ({PAIRS}))", "conv_id, turn, question")
ORACLES = {
    "chunk_records": f"SELECT * EXCLUDE (doc_id, i) REPLACE (md5(text) AS text, md5(raw_text) AS raw_text) FROM {_records('(SELECT doc_id, 3 AS i, text, ' + _of(METADATA, 'doc_id') + ' AS meta FROM documents)')}",
    "source_paths": f"""
SELECT doc_id, CAST(i + 1 AS BIGINT) AS id, coalesce(nullif(tentang, ''), nullif(document_title, ''), nullif({_FILE}, ''), 'Dokumen') AS document,
  CASE doc_type WHEN 'peraturan' THEN concat_ws(' > ', nullif(bab, ''), nullif(bagian, ''), 'Pasal ' || nullif(pasal, ''), 'Ayat (' || nullif(ayat, '') || ')')
    WHEN 'audit' THEN concat_ws(' > ', nullif({_CAPITAL}, ''), 'Bagian ' || nullif(section_part, '')) ELSE coalesce(nullif(hierarchy, ''), context_header) END AS section,
  coalesce(nullif(document_title, ''), nullif({_FILE}, ''), nullif(tentang, ''), 'Dokumen') AS legal_document, concat_ws(' > ', nullif(bab, ''), nullif(pasal, ''), 'Ayat (' || nullif(ayat, '') || ')') AS legal_section
FROM {_records('(SELECT doc_id, i, chr(0)[1:0] AS text, ' + _of(METADATA, 'doc_id * 3 + i') + ' AS meta FROM documents, range(3) t(i))')}""",
    "figure_chunks": rf"""
WITH f AS (SELECT doc_id, text, k, {_of(CAPTIONS, 'doc_id + k')} AS caption, 100 * (k + 1) AS width, 160 AS height FROM documents, range(5) t(k)),
g AS (SELECT *, {_KIND} AS kind FROM (SELECT *, lower(coalesce(caption, '')) AS c FROM f)),
w AS (SELECT * FROM g WHERE kind <> 'photo' AND (doc_id + k) % 7 <> 6 AND regexp_matches(text, '[^\x09-\x0D\x20]') QUALIFY row_number() OVER (PARTITION BY doc_id, k % 4 ORDER BY 9 - k) = 1)
SELECT doc_id, 'f' || k AS figure_id, kind, 'Figure: ' || coalesce(nullif(regexp_extract(caption, '^Gambar [0-9]+'), ''), 'Figure') AS context_header, coalesce(caption, '') AS section,
  kind || '|f' || k || '|page:' || (9 - k) || '|ocr' AS table_context, md5(CASE WHEN coalesce(caption, '') = '' THEN text ELSE regexp_replace(caption || chr(10) || chr(10) || text, '{R.EDGES}', '', 'g') END) AS text
FROM w""",
    "canary_gate": f"""
SELECT conv_id, turn, len(reasons) = 0 AS pass, array_to_string(reasons, ',') AS reasons, coalesce(score + conv_id % 4 > 0 AND (conv_id % 4) / (score + conv_id % 4) > 0.15, false) AS regression
FROM (SELECT *, list_filter([
    CASE WHEN conv_id % 4 <> 0 AND NOT contains(low, lower(string_split(coalesce(question, ''), ' ')[1])) AND NOT contains(low, 'bobot') THEN 'keyword' END,
    CASE WHEN conv_id % 3 <> 0 AND turn % 3 = 2 THEN 'leakage:' || (conv_id + 2) END,
    CASE WHEN conv_id % 5 < 4 AND score < conv_id % 5 * 2 THEN 'score' END,
    CASE WHEN turn % 4 = 0 AND (turn % 8 = 4) <> has_unavailable THEN 'unavailable' END], lambda x: x IS NOT NULL) AS reasons FROM {_TOLD})""",
}
