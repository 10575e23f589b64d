"""Retrieval queries: lexical, vector and literal search, fusion, stitching, boosts, cited context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INDICATOR_NUMBER, TABLE_NUMBER
from ..operators import fusion, lexical, vectors
from ..sources.tables import load
from . import fixtures as fx

K = 5
QUESTIONS, CHUNKS = fx.values(fx.QUESTIONS, fx.QUESTION_SCHEMA), fx.values(fx.CHUNKS, fx.CHUNK_SCHEMA)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), K)


BM25_CTES = """
d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS toks FROM documents),
q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS toks FROM benchmark),
corpus AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM d) GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, corpus),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(toks) AS term FROM q) GROUP BY ALL),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
bm AS (
  SELECT query_id, id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term), corpus GROUP BY query_id, id
),
bm_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= {k}),
ov AS (
  SELECT query_id, id, CAST(count(*) AS DOUBLE) AS score
  FROM (SELECT query_id, unnest(list_distinct(toks)) AS term FROM q) JOIN (SELECT id, unnest(list_distinct(toks)) AS term FROM d) USING (term) GROUP BY query_id, id
),
ov_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ov) WHERE rank <= {k}),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM bm_top UNION ALL SELECT query_id, id, rank FROM ov_top) GROUP BY query_id, id),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 25)
"""


def _ctes(k: int) -> str:
    return BM25_CTES.replace("{k}", str(k))


def lexical_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.overlap(_docs(spark, sf_dir), _asked(spark, sf_dir), K)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    data = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return data, data.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, asked = _vectors(spark, sf_dir)
    return vectors.top_cosine(data, asked, K)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, asked = _vectors(spark, sf_dir)
    return vectors.top_cosine(data, asked, K, same="label")


def _vector_sql(same: str) -> str:
    return f"""
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 {same}
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5
"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion([lexical.best(_docs(spark, sf_dir), _asked(spark, sf_dir), 20)])  # both kinds of list


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical lists, fusion, rerank and citation records for every benchmark question."""
    docs = load(spark, sf_dir, "documents")
    best = fusion.rerank(_fused(spark, sf_dir).select("query_id", "id", F.col("score").alias("base"), F.lit(0.0).alias("boost")), K)
    text = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"), F.col("lang").alias("context_header"), F.lit("").alias("pasal"), F.lit("").alias("bab"))
    return fusion.sources(best.join(text, "id"))


HYBRID_SQL = f"""
WITH {_ctes(20)},
best AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rrf) WHERE rank <= 5)
SELECT query_id, rank, CAST(id AS VARCHAR) AS doc_id, source AS title, lang AS section,
  CAST(round(CAST(greatest(0.0, (CASE WHEN score < 0.1 THEN least(75.0, 65.0 + score * 300) ELSE least(99.9, 75.0 + score * 8.5) END) - rank * 0.14) AS DECIMAL(20, 9)), 2) AS DOUBLE) AS shown,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet
FROM best JOIN documents ON doc_id = id
"""


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = hybrid_retrieval(spark, sf_dir)
    return fusion.context_blocks(cited).select("query_id", F.col("n_sources").cast("bigint").alias("n_sources"), F.sha2("context", 256).alias("context_sha256"))


CONTEXT_SQL = f"""
SELECT query_id, count(*) AS n_sources, sha256(string_agg('[' || rank || '] ' || title || chr(10) || snippet, chr(10) || chr(10) ORDER BY rank)) AS context_sha256
FROM ({HYBRID_SQL}) GROUP BY query_id
"""


def neighbor_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the turns next to it, merged in order."""
    talk = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "role", "text")
    return fusion.stitch(talk.where("role = 'user'").select("doc_id", "chunk_index"), talk).select(
        "doc_id", "chunk_index", F.array_join(F.transform("stitched_indices", lambda x: x.cast("string")), ",").alias("indices"), F.length("text").cast("bigint").alias("n_chars")
    )


def neighbor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "role", "text")
    hits = talk.where("role = 'user'").select("doc_id", "chunk_index")
    return fusion.neighbours(hits, talk).select("doc_id", "hit", "chunk_index", F.length("text").cast("bigint").alias("n_chars"))


NEIGHBOR_SQL = """
WITH h AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
SELECT h.conv_id AS doc_id, h.turn AS hit, c.turn AS chunk_index, length(c.text) AS n_chars
FROM h JOIN conversations c ON c.conv_id = h.conv_id AND abs(c.turn - h.turn) = 1
WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.conv_id = c.conv_id AND x.turn = c.turn)
"""


def _scored_fixture(spark: SparkSession) -> DataFrame:
    q = fx.frame(spark, fx.QUESTIONS, fx.QUESTION_SCHEMA).withColumnRenamed("text", "question")
    c = fx.frame(spark, fx.CHUNKS, fx.CHUNK_SCHEMA)
    fields = {k: F.col(k) for k in ("document_title", "doc_type", "hierarchy", "context_header", "bab", "pasal", "ayat", "is_table", "table_label", "text")}
    # both sides are short rule fixtures, met on a constant key
    met = q.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one")
    return met.select("query_id", "id", fusion.metadata_boost(F.col("question"), fields).alias("boost"))


def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_fixture(spark)


def rerank_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(_scored_fixture(spark).withColumn("base", F.round(1.0 / (60 + F.col("id")), 6)), 3).select("query_id", "id", "score", "rank")


PAIRS = f"(SELECT * FROM {QUESTIONS}) q, (SELECT * FROM {CHUNKS}) c"
BOOST_SQL = rf"""
WITH m AS (
  SELECT query_id, id, lower(q.text) AS q, lower(pasal) AS article, lower(bab) AS chapter, lower(hierarchy) AS path, is_table, lower(table_label) AS label,
    lower(document_title) || ' ' || lower(hierarchy) || ' ' || lower(context_header) || ' ' || lower(doc_type) || ' ' || lower(pasal) || ' ' || lower(ayat) || ' ' || lower(substr(c.text, 1, 2500)) AS blob
  FROM {PAIRS}
), n AS (
  SELECT *, regexp_extract(q, 'nomor\s+([0-9]+)', 1) AS num, regexp_extract(q, 'tahun\s+([0-9]{{4}})', 1) AS yr, regexp_extract(q, 'pasal\s+([0-9]+)', 1) AS pas,
    regexp_extract(q, '\b(?:indikator|id)[-\s]*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS ind, regexp_extract(q, '\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS tab,
    regexp_matches(q, 'definisi|pengertian') AS asks
  FROM m
)
SELECT query_id, id, round(
  CASE WHEN contains(q, 'perpres') AND regexp_matches(blob, 'peraturan presiden|perpres') THEN 0.25 ELSE 0 END
  + CASE WHEN contains(q, 'permen') AND regexp_matches(blob, 'peraturan menteri|permen') THEN 0.25 ELSE 0 END
  + CASE WHEN contains(q, 'pp ') AND (contains(blob, 'peraturan pemerintah') OR contains(' ' || blob || ' ', ' pp ')) THEN 0.25 ELSE 0 END
  + CASE WHEN num <> '' AND regexp_matches(blob, '\b' || num || '\b') THEN 0.20 ELSE 0 END
  + CASE WHEN yr <> '' AND regexp_matches(blob, '\b' || yr || '\b') THEN 0.20 ELSE 0 END
  + CASE WHEN pas <> '' AND regexp_matches(article, '\bpasal\s+' || pas || '\b') THEN 0.55 WHEN pas <> '' AND regexp_matches(blob, '\bpasal\s+' || pas || '\b') THEN 0.20 ELSE 0 END
  + CASE WHEN ind <> '' AND regexp_matches(path, '\bindikator\s+' || ind || '\b') THEN 2.0
         WHEN ind <> '' AND (regexp_matches(blob, '\bindikator\s*' || ind || '\b') OR regexp_matches(blob, '\bid[- \t]*' || ind || '\b')) THEN 0.85 ELSE 0 END
  + CASE WHEN ind <> '' AND contains(blob, 'spbe') THEN 0.15 ELSE 0 END
  + CASE WHEN tab <> '' AND regexp_matches(blob, '\btabel\s*(?:ke[-\s]*)?' || tab || '\b') THEN 1.35 WHEN tab <> '' AND contains(blob, 'tabel') THEN 0.20 ELSE 0 END
  + CASE WHEN tab <> '' AND is_table THEN 0.40 ELSE 0 END
  + CASE WHEN tab <> '' AND label <> '' AND contains(label, 'tabel ' || tab) THEN 0.25 ELSE 0 END
  + CASE WHEN asks AND regexp_matches(article, '\bpasal\s+1\b') THEN 0.55 ELSE 0 END
  + CASE WHEN asks AND regexp_matches(article, '\bpasal\s+1\b') AND (contains(chapter, 'bab i') OR contains(blob, 'ketentuan umum')) THEN 1.10 ELSE 0 END
  + CASE WHEN asks AND contains(blob, 'yang dimaksud dengan') THEN 0.90 ELSE 0 END
  + CASE WHEN asks AND contains(blob, 'selanjutnya disingkat spbe adalah') THEN 1.00 ELSE 0 END, 2)::DOUBLE AS boost
FROM n
"""


def table_literals(asked: DataFrame, chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks labelled with the table number that a question names: an equi-join on the number, at most 5 each.

    ``keep`` names columns of both that must agree (a document scope).
    """
    q = asked.select("query_id", *keep, F.regexp_extract(F.lower("text"), TABLE_NUMBER, 1).alias("n")).where("n <> ''")
    c = chunks.select("id", *keep, F.regexp_extract(F.lower("table_label"), TABLE_NUMBER, 1).alias("n")).where("n <> ''")
    return lexical.top(q.join(c, ["n", *keep]).select("query_id", "id", F.lit(2.0).alias("score")), 5)


def indicator_literals(asked: DataFrame, chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks whose path, else header, names the indicator that a question asks for; each once, at most 5 a question, score 2.5."""
    q = asked.select("query_id", *keep, F.regexp_extract(F.lower("text"), INDICATOR_NUMBER, 1).alias("n")).where("n <> ''")
    places = F.array(*[F.struct(F.lit(i).alias("probe"), F.regexp_extract_all(F.lower(c), F.lit(r"indikator\s+([0-9]{1,3})\b"), F.lit(1)).alias("ns")) for i, c in enumerate(("hierarchy", "context_header"))])
    c = chunks.select("id", *keep, F.explode(places).alias("p")).select("id", *keep, "p.probe", F.explode("p.ns").alias("n"))
    first = q.join(c, ["n", *keep]).groupBy("query_id", "id").agg(F.min("probe").alias("probe"))
    ranked = lexical.top(first.withColumn("score", -F.col("probe").cast("double")), 5)
    return ranked.select("query_id", "id", F.lit(2.5).alias("score"), "rank")


def literal_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_literals(fx.frame(spark, fx.QUESTIONS, fx.QUESTION_SCHEMA), fx.frame(spark, fx.CHUNKS, fx.CHUNK_SCHEMA))


def literal_indicator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicator_literals(fx.frame(spark, fx.QUESTIONS, fx.QUESTION_SCHEMA), fx.frame(spark, fx.CHUNKS, fx.CHUNK_SCHEMA))


LITERAL_TABLE_SQL = rf"""
WITH q AS (SELECT query_id, regexp_extract(lower(text), '\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS n FROM {QUESTIONS}),
c AS (SELECT id, regexp_extract(lower(table_label), '\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS n FROM {CHUNKS})
SELECT query_id, id, CAST(2.0 AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM q JOIN c USING (n) WHERE n <> '' QUALIFY rank <= 5
"""
LITERAL_INDICATOR_SQL = rf"""
WITH q AS (SELECT query_id, regexp_extract(lower(text), '\b(?:indikator|id)[-\s]*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS n FROM {QUESTIONS}),
c AS (SELECT id, 0 AS probe, unnest(regexp_extract_all(lower(hierarchy), 'indikator\s+([0-9]{{1,3}})\b', 1)) AS n FROM {CHUNKS}
  UNION ALL SELECT id, 1, unnest(regexp_extract_all(lower(context_header), 'indikator\s+([0-9]{{1,3}})\b', 1)) FROM {CHUNKS}),
f AS (SELECT query_id, id, min(probe) AS probe FROM q JOIN c USING (n) WHERE n <> '' GROUP BY query_id, id)
SELECT query_id, id, CAST(2.5 AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY probe, id) AS rank FROM f QUALIFY rank <= 5
"""


def ngram_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two- to four-word phrases of the benchmark texts by how many texts hold them; 20 most frequent."""
    words = load(spark, sf_dir, "benchmark").select("item_id", F.expr("regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}_]+)', 1)").alias("w"))
    sizes = F.flatten(
        F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>")))
    )
    counts = words.select(F.explode(F.array_distinct(sizes)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("hits"))
    return counts.where("hits >= 2").orderBy(F.desc("hits"), "phrase").limit(20)


NGRAM_SQL = r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM w, range(2, 5) r(n), (SELECT unnest(range(1, 1 + (SELECT max(len(w)) FROM w))) AS i) s WHERE i + n - 1 <= len(w))
SELECT phrase, count(*) AS hits FROM p GROUP BY phrase HAVING count(*) >= 2 ORDER BY hits DESC, phrase LIMIT 20
"""

QUERIES = {
    "bm25_topk": bm25_topk,
    "lexical_overlap_topk": lexical_overlap_topk,
    "vector_topk": vector_topk,
    "vector_topk_filtered": vector_topk_filtered,
    "rrf_hybrid": rrf_hybrid,
    "hybrid_retrieval": hybrid_retrieval,
    "context_assembly": context_assembly,
    "neighbor_lookup": neighbor_lookup,
    "neighbor_stitch": neighbor_stitch,
    "metadata_boost": metadata_boost,
    "rerank_boosted": rerank_boosted,
    "literal_table_search": literal_table_search,
    "literal_indicator_search": literal_indicator_search,
    "ngram_anchors": ngram_anchors,
}
STITCH_SQL = """
WITH RECURSIVE h AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
p AS (SELECT h.conv_id, h.turn AS hit, c.turn AS t, c.text FROM h JOIN conversations c ON c.conv_id = h.conv_id AND abs(c.turn - h.turn) <= 1
  WHERE c.turn = h.turn OR NOT EXISTS (SELECT 1 FROM h x WHERE x.conv_id = c.conv_id AND x.turn = c.turn)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, hit ORDER BY t) AS i FROM p),
m AS (
  SELECT conv_id, hit, 1::BIGINT AS i, CAST(t AS VARCHAR) AS indices, text AS done FROM n WHERE i = 1
  UNION ALL
  SELECT conv_id, hit, i, indices, CASE WHEN done = '' THEN text WHEN contains(done, text) THEN done WHEN same > 0 THEN done || substr(text, same + 1) ELSE done || chr(10) || text END
  FROM (SELECT m.conv_id, m.hit, n.i, m.indices || ',' || n.t AS indices, m.done, n.text,
      coalesce(list_max(list_filter(range(24, least(length(m.done), length(n.text), 220) + 1), lambda s: right(m.done, s) = left(n.text, s))), 0) AS same
    FROM m JOIN n ON n.conv_id = m.conv_id AND n.hit = m.hit AND n.i = m.i + 1)
)
SELECT conv_id AS doc_id, hit AS chunk_index, arg_max(indices, i) AS indices, length(arg_max(done, i)) AS n_chars FROM m GROUP BY conv_id, hit
"""

ORACLES = {
    "neighbor_stitch": STITCH_SQL,
    "bm25_topk": f"WITH {_ctes(5)} SELECT * FROM bm_top",
    "lexical_overlap_topk": f"WITH {_ctes(5)} SELECT * FROM ov_top",
    "vector_topk": _vector_sql(""),
    "vector_topk_filtered": _vector_sql("AND a.label = b.label"),
    "rrf_hybrid": f"WITH {_ctes(20)} SELECT * FROM rrf",
    "hybrid_retrieval": HYBRID_SQL,
    "context_assembly": CONTEXT_SQL,
    "neighbor_lookup": NEIGHBOR_SQL,
    "metadata_boost": BOOST_SQL,
    "rerank_boosted": f"SELECT * FROM (SELECT query_id, id, round(round(1.0 / (60 + id), 6) + boost, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(round(1.0 / (60 + id), 6) + boost, 6) DESC, id) AS rank FROM ({BOOST_SQL})) WHERE rank <= 3",
    "literal_table_search": LITERAL_TABLE_SQL,
    "literal_indicator_search": LITERAL_INDICATOR_SQL,
    "ngram_anchors": NGRAM_SQL,
}
