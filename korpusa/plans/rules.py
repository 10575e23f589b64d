"""Text rules over questions, chunks, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import structure
from ..sources import formats
from ..sources.tables import load
from . import fixtures as fx

QUESTIONS, CHUNKS, ANSWERS = fx.values(fx.QUESTIONS, fx.QUESTION_SCHEMA), fx.values(fx.CHUNKS, fx.CHUNK_SCHEMA), fx.values(fx.ANSWERS, fx.ANSWER_SCHEMA)
FILES = [(1, "docs/Perpres_95-2018.pdf", "XIV", "3,25"), (2, "laporan akhir.PDF", "IX", "x"), (3, "", "", ""), (4, "a.b.c.txt", "MCMXC", "4"), (5, "no_dot", "III", "-1,5")]
FILE_SCHEMA = "id bigint, name string, bab string, value string"
FILE_VALUES = fx.values(FILES, FILE_SCHEMA)
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


ERRORS = [(1, "CUDA out of memory"), (2, "File is encrypted"), (3, "timed out after 60"), (4, "No such file"), (5, "weird"), (6, "Corrupt xref"), (7, None)]
ERROR_SCHEMA = "id bigint, message string"
FIGURES = [
    (1, "h1", "Gambar 1. Struktur organisasi", 800, 600), (2, "h1", "Gambar 1. Struktur organisasi", 800, 600), (3, "h2", "Tabel hasil", 900, 300), (4, "h3", "", 1000, 200),
    (5, "h4", "Grafik nilai", 400, 300), (6, "h5", "foto", 10, 10), (7, "h6", "Gambar 12 Diagram lingkaran", 10, 0), (8, "h7", "Tren capaian", 5, 5), (9, "h8", "Lini masa", 5, 5),
    (10, "h9", "Tim Pelaksanaan SPBE", 5, 5), (11, "h10", None, 10, 0), (12, "h11", "Diagram batang", 5, 5), (13, "h12", "Indeks SPBE 2019", 5, 5),
]
FIGURE_SCHEMA = "id bigint, hash string, caption string, w int, h int"
CAPTIONS = [(1, 10, "image", "a"), (1, 60, "caption", "Gambar 1"), (1, 90, "caption", "Gambar 2"), (1, 100, "image", "b"), (1, 700, "caption", "Gambar 3"), (2, 5, "image", "c"), (2, 6, "image", "d"), (2, 40, "caption", "Gambar 4")]
CAPTION_SCHEMA = "page bigint, place bigint, kind string, name string"


def _questions(spark: SparkSession) -> DataFrame:
    return fx.frame(spark, fx.QUESTIONS, fx.QUESTION_SCHEMA)


def _chunks(spark: SparkSession) -> DataFrame:
    return fx.frame(spark, fx.CHUNKS, fx.CHUNK_SCHEMA)


def classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark).select("query_id", T.classify_query("text").alias("kind"))


def query_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of all conversation turns."""
    return load(spark, sf_dir, "conversations").groupBy("role", T.classify_query("text").alias("kind")).agg(F.count("*").alias("n"))


def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark).where("trim(text) <> ''").select("query_id", F.posexplode(T.expand_query("text")).alias("place", "variant"))
    return rows.select("query_id", F.col("place").cast("bigint").alias("place"), "variant")


def focus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark).select("query_id", F.array_join(T.focus_terms("text"), " ").alias("terms"))


def benchmark_focus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_join(T.focus_terms("text", 8, T.GUARDRAIL_STOPWORDS), " ")
    return load(spark, sf_dir, "benchmark").select("item_id", terms.alias("terms"))


def table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill of table metadata: flag and label from the text."""
    return _chunks(spark).select("id", T.is_table_like("text").alias("table_like"), T.table_label("text").alias("label"), T.is_pipe_table("text").alias("pipe_table"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a file name made of their source, as the rules look at both."""
    d = load(spark, sf_dir, "documents")
    kinds = F.array(*map(F.lit, FILE_KINDS))
    return d.select("doc_id", F.concat(F.element_at(kinds, (F.col("doc_id") % len(FILE_KINDS) + 1).cast("int")), F.lit("_"), "source", F.lit(".pdf")).alias("name"), "text")


FILE_KINDS = ["Perpres", "laporan evaluasi", "Evaluasi SPBE", "audit", "pedoman aparatur reformasi", "catatan", "PP", "tentang 5 tahun 2020"]


def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three detectors of a document's type, on every document."""
    return _named(spark, sf_dir).select("doc_id", T.stored_type("name", "text").alias("stored"), T.structure_type("name", "text").alias("structure"), T.upload_type("name").alias("upload"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best title of every document: its first line against its file name."""
    d = _named(spark, sf_dir).withColumn("title", F.substring_index("text", " ", 4))
    return d.select("doc_id", T.clean_title("name").alias("clean"), T.regulation_type("name").alias("regulation"), T.suspicious_title("name").alias("suspicious"), T.best_title("title", "name").alias("title"))


def cover_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, COVERS, COVER_SCHEMA).select("id", T.about_text("about").alias("about"), T.cover_title("title", "name", "about").alias("cover"))


COVERS = [
    (1, "Peraturan Presiden Nomor 95 Tahun 2018", "Perpres_95_2018.pdf", "TENTANG SISTEM SPBE DAN TIK"), (2, "tentang 59 Tahun 2020", "permenpan_59.PDF", "tentang Evaluasi"),
    (3, "", "", "Tata Kelola"), (4, None, None, None), (5, "Pedoman", "Pedoman_Menteri_2020.pdf", "tentang 5 tahun 2020"), (6, "Laporan Evaluasi tentang Layanan", "x.pdf", "Layanan"), (7, "Perpres 95", "laporan_2020.pdf", "PAN RB LAYANAN"),
]
COVER_SCHEMA = "id bigint, title string, name string, about string"


def figure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and detail of figure descriptions and of recognised text, on every document text."""
    d = load(spark, sf_dir, "documents").withColumn("raw", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("summary: a "), "text", F.lit(" DETAIL : "), "text")).otherwise(F.coalesce("text", F.lit(""))))
    d = d.select("doc_id", T.split_summary("raw").alias("v"), T.ocr_summary("raw", "source").alias("o"))
    return d.select("doc_id", F.sha2(F.col("v.summary"), 256).alias("summary"), F.sha2(F.col("v.detail"), 256).alias("detail"), F.sha2(F.col("o.summary"), 256).alias("ocr_summary"), F.sha2(F.col("o.detail"), 256).alias("ocr_detail"))


def table_like_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.is_table_like("text").alias("table_like"), T.is_pipe_table("text").alias("pipe_table"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_html("html"), 256).alias("sha256"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.length(T.clean_text("text")).cast("bigint").alias("n"), F.length(S.one_space("text")).cast("bigint").alias("n_flat"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("t", T.tokens("text"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.size(F.array_distinct(F.filter("t", lambda t: F.length(t) >= 4))).cast("bigint").alias("n_key"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, FILES, FILE_SCHEMA)
    return rows.select("id", S.title_from_filename("name").alias("title"), S.safe_filename("name").alias("safe"), S.roman_to_int("bab").cast("bigint").alias("chapter"), S.comma_decimal("value").alias("value"))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal order: chapter as a number, then article, then clause, then id."""
    order = Window.orderBy(S.roman_to_int(F.regexp_extract("bab", r"BAB\s+([IVXLC]+)", 1)), F.coalesce(F.regexp_extract("pasal", "([0-9]+)", 1).try_cast("int"), F.lit(0)), F.coalesce(S.safe_int(F.col("ayat")), F.lit(0)), "id")
    return _chunks(spark).select("id", F.row_number().over(order).cast("bigint").alias("place"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, fx.ANSWERS, fx.ANSWER_SCHEMA)
    ids = T.citation_ids("answer")
    return rows.select("id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("cited"), T.sanitize_citations("answer", "sources").alias("clean"), T.strip_emphasis(F.concat(F.lit("**a** __b  "), "answer")).alias("plain"))


def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", S.display_score(F.col("value") / 100, F.col("event_id") % 5).alias("shown"))


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered classification of converter messages."""
    rows = fx.frame(spark, ERRORS, ERROR_SCHEMA)
    m = F.lower(F.coalesce("message", F.lit("")))
    kind = F.when(m.rlike("out of memory|oom"), "memory").when(m.rlike("encrypt|password"), "encrypted").when(m.rlike("timeout|timed out"), "timeout").when(m.rlike("no such file|not found"), "missing").when(m.rlike("corrupt|invalid pdf"), "corrupt").otherwise("unknown")
    return rows.select("id", kind.alias("kind"))


def figure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by caption words, else by shape; of identical images the first."""
    rows = fx.frame(spark, FIGURES, FIGURE_SCHEMA)
    first = rows.groupBy("hash").agg(F.min_by(F.struct("id", "caption", "w", "h"), "id").alias("f")).select("hash", "f.*")
    return first.select("id", T.figure_kind("caption", "w", "h").alias("kind"), F.regexp_extract(F.lower(F.coalesce("caption", F.lit(""))), r"gambar\s+([0-9]+)", 1).alias("number"))


def caption_after_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First caption after an image, before the next image, within 500 characters."""
    rows = fx.frame(spark, CAPTIONS, CAPTION_SCHEMA).withColumnRenamed("place", "offset")
    order = Window.partitionBy("page").orderBy("offset")
    images = rows.where("kind = 'image'").withColumn("stop", F.lead("offset").over(order))
    caps = rows.where("kind = 'caption'").select("page", F.col("offset").alias("at"), F.col("name").alias("caption"))
    near = (F.col("at") > F.col("offset")) & (F.col("at") <= F.col("offset") + 500) & (F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    met = images.alias("i").join(caps.alias("c"), (F.col("i.page") == F.col("c.page")) & near, "left")
    return met.groupBy("i.page", "name").agg(F.min_by("caption", "at").alias("caption"))


def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an event log, JSON parsed, malformed ones skipped."""
    log = 'event: retrieval\ndata: {"n": 3}\n\nevent: token\ndata: {"n": 4, "t": "a"}\n\nevent: token\ndata: {bad\n\nevent: complete\ndata: {"n": 7}\n\n'
    frames = formats.sse_frames(fx.frame(spark, [(1, log)], "id bigint, log string"), "log", "id")
    return frames.select("id", "place", "event", F.from_json("data", "n int", {"mode": "PERMISSIVE"})["n"].alias("n")).where("n is not null")


def linear_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, [(1, "| Nama | Nilai |\n|---|---|\n| A | 3 |\n| B | - |\n| C | 5 | x |")], "id bigint, block string")
    return rows.select("id", structure.linearize_table(F.col("block")).alias("text"))


QUERIES = {f.__name__: f for f in (
    classify_queries, query_kinds, expand_queries, focus_terms, benchmark_focus_terms, table_labels, doc_types, titles, cover_titles, figure_texts, table_like_docs, html_clean, clean_documents, token_counts,
    file_names, natural_order, citations, display_scores, error_kinds, figure_kinds, caption_after_image, sse_events, linear_tables,
)}

KIND = r"CASE WHEN regexp_matches({q}, '\btabel\b|\btable\b') THEN 'table' WHEN regexp_matches({q}, '\bindikator\b|\bid[-\s]*[0-9]+') THEN 'indikator' WHEN regexp_matches({q}, '\bpasal\b|\bayat\b|\bperpres\b|\bpermenpan\b|\bpp\s*[0-9]+\b|\bse\s+menteri\b') THEN 'pasal' ELSE 'general' END"
LIKE = r"((contains(text, '|') AND contains(lower(text), 'tabel')) OR (len({l}) >= 3 AND len({p}) >= 2) OR (len({l}) >= 3 AND contains(lower(text), 'tabel') AND len({p}) >= 1))".replace("{p}", "list_filter({l}, lambda x: contains(x, ':') AND contains(x, ';'))").replace("{l}", "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')")
PIPES = "len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2"
FOCUS = "array_to_string((WITH f AS (SELECT t, min(i) AS i FROM (SELECT unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS w)) WHERE t NOT IN ({stop}) AND (regexp_matches(t, '^[0-9]+$') OR length(t) >= 3) GROUP BY t) SELECT list(t ORDER BY i)[1:8] FROM f), ' ')"
NAMED = "WITH named AS (SELECT doc_id, ([" + ", ".join(f"'{x}'" for x in FILE_KINDS) + f"])[doc_id % {len(FILE_KINDS)} + 1] || '_' || source || '.pdf' AS name, text FROM documents)"
TITLE = r"regexp_replace(regexp_replace(replace(regexp_replace(trim(coalesce({x}, '')), '(?i)\.pdf$', ''), '_', ' '), '\s+', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g')"
REGULATION = r"CASE WHEN regexp_matches({x}, 'peraturan presiden|\bperpres\b') THEN 'perpres' WHEN regexp_matches({x}, 'peraturan menteri|permenpan|\bpermen\b') THEN 'permen' WHEN regexp_matches({x}, 'peraturan pemerintah|\bpp\b') THEN 'pp' WHEN contains({x}, 'pedoman') THEN 'pedoman' WHEN contains({x}, 'laporan') THEN 'laporan' ELSE '' END"
SUSPICIOUS = r"({x} = '' OR regexp_matches({x}, '\btentang\s+[0-9]+\s+tahun\s+[0-9]{{4}}\b') OR (len(regexp_extract_all({x}, 'tahun')) >= 2 AND regexp_matches({x}, '\bnomor\s+[0-9]+.*\btahun\s+[0-9]{{4}}.*\btahun\s+[0-9]{{4}}\b')))"
ROMAN = "(SELECT coalesce(sum(CASE WHEN v < nxt THEN -v ELSE v END), 0) FROM (SELECT v, lead(v, 1, 0) OVER (ORDER BY i) AS nxt FROM (SELECT generate_subscripts(c, 1) AS i, CASE unnest(c) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END AS v FROM (SELECT string_split(regexp_replace(upper({x}), '[^IVXLCDM]', '', 'g'), '') AS c))))"
CHAPTER = r"regexp_extract(bab, 'BAB\s+([IVXLC]+)', 1)"
FULL = "sistem pemerintahan berbasis elektronik"
ORACLES = {
    "classify_queries": f"SELECT query_id, {KIND.format(q='lower(text)')} AS kind FROM {QUESTIONS}",
    "query_kinds": f"SELECT role, {KIND.format(q='lower(text)')} AS kind, count(*) AS n FROM conversations GROUP BY 1, 2",
    "expand_queries": rf"""
WITH n AS (SELECT query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM {QUESTIONS} WHERE trim(text) <> ''),
p AS (SELECT *, lower(q) AS l, regexp_extract(lower(q), 'nomor\s+([0-9]+)', 1) AS num, regexp_extract(lower(q), 'tahun\s+([0-9]{{4}})', 1) AS yr, regexp_extract(lower(q), 'pasal\s+([0-9]+)', 1) AS pas,
  regexp_extract(lower(q), '\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS tab FROM n),
a AS (SELECT *, regexp_matches(l, 'definisi|pengertian') AND (contains(l, 'spbe') OR contains(l, '{FULL}')) AS asks FROM p),
v AS (
  SELECT query_id, 0 AS o, q AS variant FROM a UNION ALL SELECT query_id, 1, q || ' {FULL}' FROM a WHERE regexp_matches(l, '\bspbe\b')
  UNION ALL SELECT query_id, 2, q || ' teknologi informasi dan komunikasi' FROM a WHERE regexp_matches(l, '\btik\b')
  UNION ALL SELECT query_id, 3, q || ' badan siber dan sandi negara' FROM a WHERE regexp_matches(l, '\bbssn\b')
  UNION ALL SELECT query_id, 4, q || ' instansi pusat dan pemerintah daerah' FROM a WHERE regexp_matches(l, '\bippd\b')
  UNION ALL SELECT query_id, 5, q || ' pasal ' || pas FROM a WHERE pas <> '' UNION ALL SELECT query_id, 6, q || ' tabel ' || tab FROM a WHERE tab <> ''
  UNION ALL SELECT query_id, 7, q || ' lampiran tabel ' || tab FROM a WHERE tab <> ''
  UNION ALL SELECT query_id, 8, q || ' tabel ' || tab || ' nomor ' || num || ' tahun ' || yr FROM a WHERE tab <> '' AND num <> '' AND yr <> ''
  UNION ALL SELECT query_id, 9, q || CASE WHEN num <> '' AND yr <> '' THEN ' pasal 1 perpres nomor ' || num || ' tahun ' || yr || ' ' WHEN contains(l, 'perpres') THEN ' pasal 1 perpres ' ELSE ' pasal 1 ' END || 'yang dimaksud dengan {FULL}' FROM a WHERE asks
), u AS (SELECT query_id, lower(variant) AS k, min(o) AS o, arg_min(variant, o) AS variant FROM v GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS place, variant FROM u QUALIFY place < 6""",
    "focus_terms": f"SELECT query_id, coalesce({FOCUS.format(stop=STOP)}, '') AS terms FROM {QUESTIONS}",
    "benchmark_focus_terms": f"SELECT item_id, coalesce({FOCUS.format(stop=', '.join(repr(w) for w in T.GUARDRAIL_STOPWORDS))}, '') AS terms FROM benchmark",
    "table_labels": rf"SELECT id, {LIKE} AS table_like, CASE WHEN n = '' THEN '' ELSE 'Tabel ' || n END AS label, {PIPES} AS pipe_table FROM (SELECT *, regexp_extract(lower(text), '\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS n FROM {CHUNKS})",
    "doc_types": NAMED + r"""
SELECT doc_id,
  CASE WHEN regexp_matches(n, 'perpres|pp_|permen|peraturan|se_') OR regexp_matches(t, 'peraturan presiden|peraturan pemerintah|peraturan menteri') THEN 'peraturan' WHEN regexp_matches(n, 'audit|laporan') THEN 'audit' ELSE 'other' END AS stored,
  CASE WHEN contains(n, 'pedoman') AND contains(n, 'aparatur') AND contains(n, 'reformasi') THEN 'pedoman_spbe' WHEN regexp_matches(n, 'evaluasi[ _]spbe') THEN 'laporan_spbe'
    WHEN regexp_matches(n, 'perpres|permen|peraturan|bssn|uu_|pp_') OR (regexp_matches(t, 'pasal\s+[0-9]+') AND regexp_matches(t, 'bab\s+[ivxlcdm]+')) THEN 'peraturan'
    WHEN regexp_matches(n, 'laporan|evaluasi|audit|hasil') THEN 'laporan' WHEN len(regexp_extract_all(t, 'pasal\s+[0-9]+')) >= 3 THEN 'peraturan' ELSE 'laporan' END AS structure,
  CASE WHEN contains(n, 'audit') THEN 'audit' WHEN regexp_matches(n, 'pp|perpres|permen|peraturan') THEN 'peraturan' ELSE 'other' END AS upload
FROM (SELECT doc_id, lower(name) AS n, lower(substr(text, 1, 2000)) AS t FROM named)""",
    "titles": NAMED + rf"""
, c AS (SELECT doc_id, {TITLE.format(x='name')} AS n, lower(name) AS raw, {TITLE.format(x="array_to_string(string_split(text, ' ')[1:4], ' ')")} AS t FROM named),
k AS (SELECT *, {REGULATION.format(x='lower(t)')} AS kt, {REGULATION.format(x='lower(n)')} AS kn FROM c)
SELECT doc_id, n AS clean, {REGULATION.format(x='raw')} AS regulation, {SUSPICIOUS.format(x='raw')} AS suspicious,
  CASE WHEN t = '' THEN CASE WHEN n = '' THEN 'Dokumen' ELSE n END WHEN n <> '' AND ((kt <> '' AND kn <> '' AND kt <> kn) OR {SUSPICIOUS.format(x='lower(t)')} OR (length(t) < 12 AND length(n) > length(t))) THEN n ELSE t END AS title
FROM k""",
    "figure_texts": r"""
WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'summary: a ' || text || ' DETAIL : ' || text ELSE coalesce(text, '') END AS raw FROM documents),
p AS (SELECT *, trim(regexp_extract(raw, '(?is)SUMMARY\s*:\s*(.+?)(?:DETAIL\s*:|$)', 1), ' ') AS a, trim(regexp_extract(raw, '(?is)DETAIL\s*:\s*(.+)$', 1), ' ') AS b,
  list_filter(list_transform(string_split(raw, chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts, trim(raw, ' ') AS t FROM r)
SELECT doc_id, sha256(CASE WHEN a <> '' AND b <> '' THEN a ELSE coalesce(parts[1], '') END) AS summary,
  sha256(CASE WHEN a <> '' AND b <> '' THEN b WHEN len(parts) >= 2 THEN array_to_string(parts[2:], chr(10) || chr(10)) ELSE coalesce(parts[1], '') END) AS detail,
  sha256(CASE WHEN t = '' THEN source || ': (kosong)' ELSE source || ': ' || replace(substr(t, 1, 200), chr(10), ' ') END) AS ocr_summary,
  sha256(CASE WHEN t = '' THEN source ELSE source || chr(10) || chr(10) || t END) AS ocr_detail
FROM p""",
    "table_like_docs": f"SELECT doc_id, {LIKE} AS table_like, {PIPES} AS pipe_table FROM documents",
    "html_clean": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS sha256 FROM pages",
    "clean_documents": r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '</?span[^>]*>', '', 'g'), '\*\*\s*-?\s*[0-9]+\s*-?\s*\*\*', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'))) AS n, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_flat FROM documents",
    "token_counts": r"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, len(list_distinct(list_filter(t, lambda x: length(x) >= 4))) AS n_key FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)",
    "file_names": rf"SELECT id, trim(translate(regexp_replace(regexp_replace(name, '^.*/', ''), '\.[^.]*$', ''), '_-', '  ')) AS title, regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g') AS safe, CAST({ROMAN.format(x='bab')} AS BIGINT) AS chapter, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS value FROM {FILE_VALUES}",
    "natural_order": rf"SELECT id, row_number() OVER (ORDER BY chapter, coalesce(TRY_CAST(regexp_extract(pasal, '([0-9]+)', 1) AS INTEGER), 0), coalesce(TRY_CAST(ayat AS INTEGER), 0), id) AS place FROM (SELECT *, {ROMAN.format(x=CHAPTER)} AS chapter FROM {CHUNKS})",
    "citations": r"""
WITH a AS (SELECT id, sources, answer, regexp_extract_all(answer, '\[[0-9]+\]') AS t, regexp_split_to_array(answer, '\[[0-9]+\]') AS p FROM {ANSWERS}),
b AS (SELECT *, list_transform(t, lambda x: CAST(x[2:-2] AS BIGINT)) AS n FROM a),
c AS (SELECT id, list_filter(n, lambda x, i: list_position(n, x) = i) AS cited, array_to_string(list_concat([p[1]], list_transform(n, lambda x, i: CASE WHEN x BETWEEN 1 AND sources THEN t[i] ELSE '' END || p[i + 1])), '') AS clean, answer FROM b)
SELECT id, coalesce(array_to_string(cited, ','), '') AS cited, trim(regexp_replace(regexp_replace(regexp_replace(clean, '  +', ' ', 'g'), ' +\.', '.', 'g'), ' +,', ',', 'g')) AS clean,
  regexp_replace(replace(replace('**a** __b  ' || answer, '**', ''), '__', ''), '  +', ' ', 'g') AS plain FROM c""".replace("{ANSWERS}", ANSWERS),
    "error_kinds": "SELECT id, CASE WHEN regexp_matches(m, 'out of memory|oom') THEN 'memory' WHEN regexp_matches(m, 'encrypt|password') THEN 'encrypted' WHEN regexp_matches(m, 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(m, 'no such file|not found') THEN 'missing' WHEN regexp_matches(m, 'corrupt|invalid pdf') THEN 'corrupt' ELSE 'unknown' END AS kind FROM (SELECT id, lower(coalesce(message, '')) AS m FROM " + fx.values(ERRORS, ERROR_SCHEMA) + ")",
    "figure_kinds": r"SELECT id, CASE WHEN regexp_matches(c, '\b(pie|lingkaran)\b') THEN 'pie_chart' WHEN regexp_matches(c, '\b(bar|batang)\b') THEN 'bar_chart' WHEN regexp_matches(c, '\b(line|garis|tren|capaian.*tahun|indeks.*[0-9]{4})\b') THEN 'line_chart' WHEN regexp_matches(c, '\b(grafik|chart)\b') THEN 'bar_chart' WHEN regexp_matches(c, '\b(lini masa|timeline|kronologi)\b') THEN 'timeline_image' WHEN regexp_matches(c, '\b(diagram|struktur|alur|hierarki|kriteria|peta|tingkat)\b') THEN 'diagram' WHEN regexp_matches(c, '\b(foto|presiden)\b|tim pelaksanaan') THEN 'photo' WHEN regexp_matches(c, '\btabel\b') THEN 'table_image' WHEN h > 0 AND w / h > 2.5 THEN 'timeline_image' ELSE 'diagram' END AS kind, regexp_extract(c, 'gambar\s+([0-9]+)', 1) AS number FROM (SELECT *, lower(coalesce(caption, '')) AS c FROM " + fx.values(FIGURES, FIGURE_SCHEMA) + ") QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1",
    "caption_after_image": "WITH r AS (SELECT * FROM " + fx.values(CAPTIONS, CAPTION_SCHEMA) + "), i AS (SELECT *, lead(place) OVER (PARTITION BY page ORDER BY place) AS stop FROM r WHERE kind = 'image') SELECT i.page, i.name, arg_min(c.name, c.place) AS caption FROM i LEFT JOIN r c ON c.kind = 'caption' AND c.page = i.page AND c.place > i.place AND c.place <= i.place + 500 AND (stop IS NULL OR c.place < stop) GROUP BY i.page, i.name",
    "display_scores": "SELECT event_id, CAST(round(CAST(greatest(0.0, (CASE WHEN v < 0.1 THEN least(75.0, 65.0 + v * 300) ELSE least(99.9, 75.0 + v * 8.5) END) - r * 0.14) AS DECIMAL(20, 9)), 2) AS DOUBLE) AS shown FROM (SELECT event_id, value / 100 AS v, event_id % 5 AS r FROM events)",
}
