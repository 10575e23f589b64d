"""Paragraph chunks over documents made from the lines of ``documents``: headings and tables between them by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paragraphs import LABEL, paragraph_chunks
from .regulations import PIECES, _id, _pieces, _s


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every ten lines one stands under a heading and one is a table under its name; each is a paragraph of its own."""

    def one(x, i):  # noqa: ANN001, ANN202
        table = F.array(_s("**Tabel ", i, ". Nilai urusan**"), _s("| a | b |\n| ", i, " | ", x, " |"))
        return F.when(i % 10 == 0, F.array(_s("## Urusan ", i), x)).when(i % 10 == 3, table).otherwise(F.array(x))

    return _pieces(spark, sf_dir).select("doc_id", _s("Dokumen ", _id()).alias("title"), F.array_join(F.flatten(F.transform("p", one)), "\n\n").alias("text"))


def table_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraph_chunks(_documents(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_type", "context_header", "table_label", "is_parent", F.md5("table_context").alias("beside"), F.md5("text").alias("text"))


QUERIES = {"table_paragraphs": table_paragraphs}


def _label(c: str) -> str:
    return "CASE WHEN regexp_extract({c}, '{p}', 1) <> '' THEN concat_ws('. ', 'Tabel ' || regexp_extract({c}, '{p}', 1), nullif(trim(rtrim(trim(regexp_extract({c}, '{p}', 2)), '*')), '')) END".replace("{c}", c).replace("{p}", LABEL)


ORACLES = {
    "table_paragraphs": f"""
WITH RECURSIVE {PIECES},
k AS (
  SELECT doc_id, i, 0 AS j, CASE WHEN i % 10 = 0 THEN concat('## Urusan ', i) ELSE concat('**Tabel ', i, '. Nilai urusan**') END AS t,
    CASE WHEN i % 10 = 0 THEN concat('Urusan ', i) ELSE concat('Tabel ', i, '. Nilai urusan') END AS h FROM pc WHERE i % 10 IN (0, 3)
  UNION ALL SELECT doc_id, i, 1, CASE WHEN i % 10 = 3 THEN concat('| a | b |', chr(10), '| ', i, ' | ', x, ' |') ELSE x END, NULL FROM pc),
p AS (SELECT doc_id, i % 10 = 3 AND j = 1 AS tab, t, h, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM k),
a AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS above FROM p),
r AS (
  SELECT doc_id, n, 0::BIGINT AS chunk_index, length(t) AS size FROM a WHERE n = 1
  UNION ALL SELECT a.doc_id, a.n, CASE WHEN r.size + length(t) > 900 THEN chunk_index + 1 ELSE chunk_index END, CASE WHEN r.size + length(t) > 900 THEN length(t) ELSE r.size + length(t) END
  FROM r JOIN a ON a.doc_id = r.doc_id AND a.n = r.n + 1),
c AS (SELECT doc_id, chunk_index, string_agg(t, chr(10) || chr(10) ORDER BY n) AS raw, coalesce((list(above ORDER BY n))[1], '') AS above, bool_or(tab) AS tab FROM a JOIN r USING (doc_id, n) GROUP BY ALL),
m AS (SELECT *, lag(raw) OVER w AS before, lead(raw) OVER w AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
z AS (SELECT *, CASE WHEN tab THEN coalesce({_label('raw')}, {_label('before')}, '') ELSE '' END AS label FROM m),
g AS (SELECT *, concat('Dokumen ', doc_id, CASE WHEN tab AND above <> '' THEN ' > ' || above ELSE '' END, CASE WHEN label <> '' AND NOT contains(above, label) THEN ' > ' || label ELSE '' END) AS header FROM z)
SELECT doc_id, chunk_index, CASE WHEN tab THEN 'table' ELSE 'text' END AS chunk_type, header AS context_header, label AS table_label, NOT tab OR before IS NULL AS is_parent,
  md5(CASE WHEN tab THEN concat_ws(chr(10) || chr(10), right(before, 500), left(after, 500)) ELSE '' END) AS beside, md5(concat(header, ': ', CASE WHEN label <> '' THEN label || chr(10) ELSE '' END, raw)) AS text
FROM g"""
}
