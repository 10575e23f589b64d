"""Structure and chunk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import structure as X
from ..sources.tables import load
from . import fixtures as fx


REGULATIONS = [(1, fx.REGULATION), (2, fx.REGULATION + "\nBAB III\nPENUTUP\nPasal 4\nCukup jelas.")]
SCORES = "Nama: Kabupaten A; Indeks: 3,25; Predikat: Baik\nNama: Kementerian B; Indeks: 4,10; Predikat: Sangat Baik\nNama: Kota C; Indeks: -; Predikat: Kurang"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lines(_docs(spark, sf_dir)).select("doc_id", F.col("n").cast("bigint").alias("n"), F.length("line").cast("bigint").alias("size"))


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines are headings of the lines after them."""
    rows = X.sections(X.lines(_docs(spark, sf_dir)), F.length("line") < 30)
    return rows.select("doc_id", "section", "title", "n_lines", F.col("n_chars").cast("bigint").alias("n_chars"))


def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed greedily into chunks of at most 900 characters."""
    return X.packed(_docs(spark, sf_dir), 900).select("doc_id", "chunk_index", F.length("text").alias("size"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.chunk_documents(_docs(spark, sf_dir), *X.SIZES["peraturan"])
    return rows.select("doc_id", "chunk_index", "chunk_parts", F.length("text").alias("size"), F.xxhash64("text").alias("hash"))


def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.with_context(X.chunk_documents(_docs(spark, sf_dir), *X.SIZES["laporan"]))
    return rows.select("doc_id", "chunk_index", F.length("before").alias("n_before"), F.length("after").alias("n_after"))


def chosen_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse chunks, or fine ones for documents with fewer than 20 coarse and more fine ones."""
    docs = _docs(spark, sf_dir)
    rows = X.choose_by_count(X.chunk_documents(docs, *X.SIZES["laporan"]), X.chunk_documents(docs, *X.SIZES["umum"]))
    return rows.groupBy("doc_id").agg(F.max("way").alias("way"), F.count("*").alias("n"))


def _nodes(spark: SparkSession) -> DataFrame:
    return X.regulation_nodes(X.lines(fx.frame(spark, REGULATIONS, "doc_id bigint, text string")))


def regulation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark)


def regulation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.article_chunks(_nodes(spark))


def parent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause chunks with the whole text of their article, on the first clause of each article only."""
    nodes = _nodes(spark).where("kind = 'text' and pasal is not null")
    parents = nodes.groupBy("doc_id", "pasal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("parent"))
    first = F.row_number().over(Window.partitionBy("doc_id", "pasal").orderBy("n"))
    return nodes.where("ayat is not null").withColumn("k", first).join(parents, ["doc_id", "pasal"]).select("doc_id", "pasal", "ayat", F.when(F.col("k") == 1, F.col("parent")).alias("parent"))


def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of a source against those of its chunks: ok, partial or missing."""
    rows = fx.frame(spark, [(1, fx.REGULATION)], "doc_id bigint, text string")
    have = F.regexp_count("text", F.lit(r"(?m)^Pasal\s+[0-9]+$"))
    kept = X.article_chunks(_nodes(spark)).groupBy("doc_id").agg(F.count_distinct(F.regexp_extract("hierarchy", r"Pasal ([0-9]+)", 1)).alias("kept"))
    met = rows.select("doc_id", have.cast("bigint").alias("have")).join(kept, "doc_id")
    return met.select("doc_id", "have", "kept", F.when(F.col("kept") >= F.col("have"), "ok").when(F.col("kept") > 0, "partial").otherwise("missing").alias("status"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institution rows of a linearised report: name, index and predicate."""
    rows = X.lines(fx.frame(spark, [(1, SCORES)], "doc_id bigint, text string"))
    get = lambda k: F.regexp_extract("line", rf"{k}:\s*([^;]*)", 1)
    kind = F.when(get("Nama").startswith("Kabupaten"), "Kabupaten").when(get("Nama").startswith("Kota"), "Kota").when(get("Nama").startswith("Kementerian"), "Kementerian").otherwise("Lainnya")
    return rows.select("doc_id", get("Nama").alias("name"), kind.alias("kind"), F.replace(get("Indeks"), F.lit(","), F.lit(".")).try_cast("double").alias("score"), F.trim(get("Predikat")).alias("grade"))


QUERIES = {f.__name__: f for f in (
    document_lines, line_sections, packed_lines, chunk_documents, chunk_context, chosen_chunks, regulation_nodes, regulation_chunks, parent_texts, alignment_report, score_rows,
)}
LINES = "lines AS (SELECT doc_id, n, trim(line) AS line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> '')"


def _text(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


NODES = rf"""
l AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS INT) AS n, trim(line) AS line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM (VALUES {', '.join(f'({i}, {_text(t)})' for i, t in REGULATIONS)}) r(doc_id, text))) WHERE trim(line) <> ''),
h AS (SELECT *, nullif(regexp_extract(line, '^BAB\s+([IVXLC]+)\b', 1), '') AS hb, nullif(regexp_extract(line, '^Pasal\s+([0-9]+)$', 1), '') AS hp, nullif(regexp_extract(line, '^\(([0-9]+)\)', 1), '') AS ha FROM l),
b AS (SELECT *, last_value(hb IGNORE NULLS) OVER w AS bab, count(hb) OVER w AS cb, lag(hb) OVER w IS NOT NULL AS after_bab FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
p AS (SELECT *, last_value(hp IGNORE NULLS) OVER w AS pasal, count(hp) OVER w AS cp FROM b WINDOW w AS (PARTITION BY doc_id, cb ORDER BY n)),
a AS (SELECT *, last_value(ha IGNORE NULLS) OVER (PARTITION BY doc_id, cb, cp ORDER BY n) AS ayat FROM p),
nodes AS (SELECT doc_id, n, bab, pasal, ayat, CASE WHEN after_bab THEN 'title' ELSE 'text' END AS kind, trim(regexp_replace(line, '^\([0-9]+\)\s*', '')) AS text FROM a WHERE hb IS NULL AND hp IS NULL),
body AS (SELECT * FROM nodes WHERE kind = 'text' AND pasal IS NOT NULL),
parts AS (SELECT doc_id, bab, pasal, ayat, min(n) AS n, string_agg(text, ' ' ORDER BY n) AS text FROM body GROUP BY ALL),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, concat_ws(' > ', 'BAB ' || bab, 'Pasal ' || pasal, 'ayat (' || ayat || ')') AS hierarchy, ayat IS NULL AS is_parent, text FROM parts)
"""
ORACLES = {
    "packed_lines": """
WITH RECURSIVE l AS (SELECT doc_id, length(line) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''),
r AS (SELECT doc_id, i, 0 AS chunk_index, size FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.size + 1 + l.size <= 900 THEN chunk_index ELSE chunk_index + 1 END, CASE WHEN r.size + 1 + l.size <= 900 THEN r.size + 1 + l.size ELSE l.size END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
SELECT doc_id, chunk_index, CAST(max(size) AS INT) AS size FROM r GROUP BY 1, 2""",
    "regulation_nodes": f"WITH {NODES} SELECT * FROM nodes",
    "regulation_chunks": f"WITH {NODES} SELECT * FROM chunks",
    "parent_texts": f"WITH {NODES} SELECT doc_id, pasal, ayat, CASE WHEN row_number() OVER (PARTITION BY doc_id, pasal ORDER BY n) = 1 THEN (SELECT string_agg(z.text, ' ' ORDER BY z.n) FROM body z WHERE z.doc_id = body.doc_id AND z.pasal = body.pasal) END AS parent FROM body WHERE ayat IS NOT NULL",
    "alignment_report": rf"WITH {NODES}, k AS (SELECT count(DISTINCT regexp_extract(hierarchy, 'Pasal ([0-9]+)', 1)) AS kept FROM chunks WHERE doc_id = 1), g AS (SELECT count(*) AS have FROM l WHERE doc_id = 1 AND regexp_matches(line, '^Pasal\s+[0-9]+$')) SELECT CAST(1 AS BIGINT) AS doc_id, have, kept, CASE WHEN kept >= have THEN 'ok' WHEN kept > 0 THEN 'partial' ELSE 'missing' END AS status FROM k, g",
    "score_rows": rf"WITH r AS (SELECT regexp_extract(line, 'Nama:\s*([^;]*)', 1) AS name, regexp_extract(line, 'Indeks:\s*([^;]*)', 1) AS score, regexp_extract(line, 'Predikat:\s*([^;]*)', 1) AS grade FROM (SELECT trim(unnest(string_split({_text(SCORES)}, chr(10)))) AS line)) SELECT CAST(1 AS BIGINT) AS doc_id, name, CASE WHEN regexp_matches(name, '^(Kabupaten|Kota|Kementerian)') THEN regexp_extract(name, '^(Kabupaten|Kota|Kementerian)', 1) ELSE 'Lainnya' END AS kind, TRY_CAST(replace(score, ',', '.') AS DOUBLE) AS score, trim(grade) AS grade FROM r",
    "document_lines": f"WITH {LINES} SELECT doc_id, n, length(line) AS size FROM lines",
    "line_sections": f"WITH {LINES}, s AS (SELECT *, length(line) < 30 AS h, CAST(sum(CASE WHEN length(line) < 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS section FROM lines) SELECT doc_id, section, max(CASE WHEN h THEN line END) AS title, count(*) FILTER (WHERE NOT h) AS n_lines, CAST(sum(CASE WHEN h THEN 0 ELSE length(line) END) AS BIGINT) AS n_chars FROM s GROUP BY 1, 2",
}
