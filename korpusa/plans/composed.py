"""The whole retrieval flow over a table of chunks: variants, four ranked lists, fusion, stitching, boosts, sources, trace.

Chunks are windows of WORDS words of every document, and the rule fixtures' chunks as documents with
negative ids; questions are the benchmark's texts, and the rule fixtures' questions with negative ids.
Embedding is model inference, so its results are taken as data: the vector of document d's first chunk is
row d of ``embeddings``, that of variant v of question q row |q| + v.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display_score, snippet
from ..functions.text import classify_query, expand_query
from ..operators import fusion, lexical, vectors
from ..sources.formats import written
from ..sources.tables import load
from . import fixtures as fx
from . import retrieval as R

WORDS = 64
#: A chunk's id is its document's times PLACES plus its index.
PLACES = 1 << 20
#: Results a question: questions on tables and indicators need more context.
K, K_TECHNICAL = 5, 8
#: Most rows wanted around all candidates that are shipped to the chunks; more are joined by a shuffle.
MOST_SHIPPED = 1_000_000
FIELDS = ("document_title", "doc_type", "hierarchy", "context_header", "bab", "pasal", "ayat", "is_table", "table_label")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, doc_id, chunk_index, text, *FIELDS)``; documents without a word have no chunk."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+"), lambda w: w != "")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", words.alias("w")).where("size(w) > 0")
    windows = F.transform(F.expr(f"sequence(0, cast((size(w) - 1) div {WORDS} as int))"), lambda i: F.array_join(F.slice("w", i * WORDS + 1, WORDS), " "))
    blank = F.lit("")
    cut = docs.select("doc_id", F.posexplode(windows).alias("chunk_index", "text"), "source", "lang").select(
        "doc_id", "chunk_index", "text", F.coalesce("source", blank).alias("document_title"), F.lit("document").alias("doc_type"),
        F.concat_ws(" > ", "source", "lang").alias("hierarchy"), blank.alias("context_header"), blank.alias("bab"), blank.alias("pasal"), blank.alias("ayat"),
        F.lit(False).alias("is_table"), blank.alias("table_label"),
    )
    rules = fx.frame(spark, fx.CHUNKS, fx.CHUNK_SCHEMA).drop("id").withColumn("doc_id", -F.col("doc_id"))
    return cut.unionByName(rules).withColumn("id", F.col("doc_id") * PLACES + F.col("chunk_index"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, text, kind, k)``."""
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rules = fx.frame(spark, fx.QUESTIONS, fx.QUESTION_SCHEMA).select((-F.col("query_id")).alias("query_id"), "text").where("trim(text) <> ''")
    kinds = asked.unionByName(rules).withColumn("kind", classify_query("text"))
    return kinds.withColumn("k", F.when(F.col("kind").isin("table", "indikator"), K_TECHNICAL).otherwise(K))


def searched() -> Column:
    """Joined tokens of a chunk's paths, headers and text."""
    return lexical.joined_tokens(lexical.search_text(*[F.col(c) for c in ("hierarchy", "context_header", "bab", "pasal", "ayat", "text")]))


def ranked_lists(chunks: DataFrame, asked: DataFrame, chunk_vectors: DataFrame, asked_vectors: DataFrame, same: str | None = None) -> dict[str, DataFrame]:
    """The ranked lists ``(query_id, id, rank)`` of every question by name.

    vector: k of ``chunk_vectors(id, vec)`` for each variant of ``asked_vectors(query_id, variant, vec)``, one variant
    after the other; bm25: 2 k over paths, headers and text; table and indicator: literal numbers.
    ``same`` names a column of questions and chunks (and of both vector tables) that must agree before ranking.
    ``chunks`` may hold their searched() tokens as ``toks``.
    """
    keep = (same,) if same else ()
    ks = F.broadcast(asked.select("query_id", "k"))  # two numbers a question
    toks = F.col("toks") if "toks" in chunks.columns else searched()
    words = lexical.bm25(chunks.select("id", toks.alias("toks"), *keep), asked.select("query_id", "text", *keep), 2 * K_TECHNICAL, same)
    # a question has at most six variants: both numbers travel as one key
    keyed = asked_vectors.select((F.col("query_id") * 8 + F.col("variant")).alias("query_id"), "vec", *keep)
    near = vectors.top_cosine(chunk_vectors, keyed, K_TECHNICAL, same)
    near = near.select(F.shiftright("query_id", 3).alias("query_id"), F.col("query_id").bitwiseAND(7).alias("variant"), "id", "rank")
    near = near.join(ks, "query_id").where("rank <= k").selectExpr("query_id", "id", "row_number() over (partition by query_id order by variant, rank, id) as rank")
    return {
        "vector": near,
        "bm25": words.join(ks, "query_id").where("rank <= 2 * k").select("query_id", "id", "rank"),
        "table": R.table_literals(asked, chunks, keep),
        "indicator": R.indicator_literals(asked, chunks, keep),
    }


def answer_sources(chunks: DataFrame, asked: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Fused candidates, at most 25 a question, stitched with their neighbours, boosted by metadata, k best of each.

    What meets the chunks is a few places a candidate, so the chunks themselves are not shuffled. Candidates and
    the chunks around them, a bounded number a question, are written once: every later step reads them.
    """
    most = asked.count() * fusion.MOST_CANDIDATES
    small = F.broadcast if 3 * most <= MOST_SHIPPED else (lambda df: df)
    fused = fusion.reciprocal_rank_fusion(list(lists.values()))
    hits = fused.selectExpr("query_id", "id", "score AS base", f"(id - pmod(id, {PLACES}L)) div {PLACES} AS doc_id", f"cast(pmod(id, {PLACES}L) AS int) AS chunk_index")
    hits = written(hits, "candidates")
    spots = hits.select("doc_id", F.explode(F.expr("sequence(chunk_index - 1, chunk_index + 1)")).alias("chunk_index")).distinct()
    nearby = written(chunks.join(small(spots), ["doc_id", "chunk_index"], "left_semi"), "nearby")
    whole = fusion.stitch(hits, nearby, per=("query_id",)).withColumn("id", F.col("doc_id") * PLACES + F.col("chunk_index"))
    rows = whole.join(hits.select("query_id", "id", "base"), ["query_id", "id"]).join(nearby.select("id", *FIELDS), "id")
    rows = rows.join(asked.select("query_id", F.col("text").alias("question"), "kind", "k"), "query_id")
    boosted = rows.withColumn("boost", fusion.metadata_boost(F.col("question"), {k: F.col(k) for k in (*FIELDS, "text")}))
    return fusion.rerank(boosted, K_TECHNICAL).where("rank <= k")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # five passes read the chunks and two their tokens: both are made once
    chunks, asked = written(chunk_table(spark, sf_dir).withColumn("toks", searched()), "chunks"), questions(spark, sf_dir)
    given = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    variants = asked.select("query_id", F.posexplode(expand_query("text")).alias("variant", "v"))
    wanted = variants.select("query_id", "variant", (F.abs("query_id") + F.col("variant")).alias("vec_id"))
    firsts = load(spark, sf_dir, "documents").where(r"text rlike '[^ \\t\\n\\r]'").select("doc_id")
    of_chunks = given.join(firsts, F.col("vec_id") == F.col("doc_id"), "left_semi").select((F.col("vec_id") * PLACES).alias("id"), "vec")
    return chunks, asked, of_chunks, given.join(wanted, "vec_id").select("query_id", "variant", "vec")


def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, of_chunks, of_asked = _inputs(spark, sf_dir)
    best = answer_sources(chunks, asked, ranked_lists(chunks, asked, of_chunks, of_asked))
    indices = F.array_join(F.transform("stitched_indices", lambda x: x.cast("string")), ",")
    return best.select("query_id", "kind", "rank", "doc_id", indices.alias("indices"), "boost", "score", display_score(F.col("score"), F.col("rank")).alias("shown"), F.length("text").cast("bigint").alias("n_chars"), snippet("text").alias("snippet"))


def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage found for every question: number of candidates and the first of them."""
    chunks, asked, of_chunks, of_asked = _inputs(spark, sf_dir)
    lists = {name: written(x, name) for name, x in ranked_lists(chunks, asked, of_chunks, of_asked).items()}
    stages = [x.select("query_id", "id", "rank", F.lit(name).alias("stage")) for name, x in lists.items()]
    stages.append(fusion.reciprocal_rank_fusion(list(lists.values())).select("query_id", "id", "rank", F.lit("fused").alias("stage")))
    every = reduce(DataFrame.unionByName, stages)
    return every.groupBy("query_id", "stage").agg(F.count("*").alias("n"), F.min_by("id", "rank").alias("first_id"))


QUERIES = {"hybrid_full": hybrid_full, "retrieval_trace": retrieval_trace}

from .rules import KIND, ORACLES as RULES  # noqa: E402

_BM25 = R.BM25_CTES[R.BM25_CTES.index("corpus AS") : R.BM25_CTES.index("ov AS (")].replace("{k}", "(SELECT 2 * k FROM hq z WHERE z.query_id = y.query_id)").replace("FROM bm WHERE score > 0)", "FROM bm WHERE score > 0) y")
_ASKED = r"(SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -query_id, text FROM " + R.QUESTIONS + " WHERE trim(text) <> '')"
_VARIANTS = RULES["expand_queries"].replace(f"{R.QUESTIONS} WHERE trim(text) <> ''", f"{_ASKED} WHERE trim(text) <> ''")
_NUMBER = r"regexp_extract(lower({}), '\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1)"
_LISTS = rf"""
hq AS (SELECT *, CASE WHEN kind IN ('table', 'indikator') THEN {K_TECHNICAL} ELSE {K} END AS k FROM (SELECT query_id, text, {KIND.format(q='lower(text)')} AS kind FROM {_ASKED})),
hw AS (SELECT doc_id, source, lang, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
hc AS (
  SELECT doc_id, i::INT AS chunk_index, array_to_string(w[i * {WORDS} + 1:i * {WORDS} + {WORDS}], ' ') AS text, coalesce(source, '') AS document_title, 'document' AS doc_type,
    concat_ws(' > ', source, lang) AS hierarchy, '' AS context_header, '' AS bab, '' AS pasal, '' AS ayat, false AS is_table, '' AS table_label
  FROM (SELECT *, unnest(range(0, (len(w) + {WORDS - 1}) // {WORDS})) AS i FROM hw)
  UNION ALL SELECT -doc_id, chunk_index, text, document_title, doc_type, hierarchy, context_header, bab, pasal, ayat, is_table, table_label FROM {R.CHUNKS}
),
c AS (SELECT *, doc_id * {PLACES} + chunk_index AS id FROM hc),
d AS (SELECT id, regexp_extract_all(lower(array_to_string(list_filter([trim(hierarchy), trim(context_header), trim(bab), trim(pasal), trim(ayat), trim(text)], lambda x: x <> ''), ' ')), '[\p{{L}}\p{{N}}_]+') AS toks FROM c),
q AS (SELECT query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS toks FROM hq),
{_BM25}
av AS (SELECT v.query_id, v.place, CAST(e.embedding AS DOUBLE[]) AS vec FROM ({_VARIANTS}) v JOIN embeddings e ON e.vec_id = abs(v.query_id) + v.place),
cv AS (SELECT id, CAST(embedding AS DOUBLE[]) AS vec FROM c JOIN embeddings ON vec_id = doc_id AND chunk_index = 0),
vs AS (SELECT query_id, place, id, row_number() OVER (PARTITION BY query_id, place ORDER BY round(list_cosine_similarity(av.vec, cv.vec), 6) DESC, id) AS r FROM av, cv),
vl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, r) AS rank FROM vs JOIN hq USING (query_id) WHERE r <= k),
tl AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank
  FROM (SELECT query_id, {_NUMBER.format('text')} AS n FROM hq) JOIN (SELECT id, {_NUMBER.format('table_label')} AS n FROM c) USING (n) WHERE n <> '' QUALIFY rank <= 5
),
ip AS (SELECT id, 0 AS probe, unnest(regexp_extract_all(lower(hierarchy), 'indikator\s+([0-9]{{1,3}})\b', 1)) AS n FROM c UNION ALL SELECT id, 1, unnest(regexp_extract_all(lower(context_header), 'indikator\s+([0-9]{{1,3}})\b', 1)) FROM c),
il AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY min(probe), id) AS rank
  FROM (SELECT query_id, regexp_extract(lower(text), '\b(?:indikator|id)[-\s]*(?:ke[-\s]*)?([0-9]{{1,3}})\b', 1) AS n FROM hq) JOIN ip USING (n) WHERE n <> '' GROUP BY query_id, id QUALIFY rank <= 5
),
lists AS (
  SELECT 'vector' AS stage, query_id, id, rank FROM vl UNION ALL SELECT 'bm25', query_id, id, rank FROM bm_top
  UNION ALL SELECT 'table', query_id, id, rank FROM tl UNION ALL SELECT 'indicator', query_id, id, rank FROM il
),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS base FROM lists GROUP BY query_id, id),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, id) AS rank FROM fused QUALIFY rank <= 25)
"""
_FLOW = f"""
h AS (SELECT query_id, doc_id, chunk_index FROM cand JOIN c USING (id)),
p AS (SELECT h.query_id, h.doc_id, h.chunk_index AS hit, c.chunk_index AS t, c.text FROM h JOIN c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) <= 1
  WHERE c.chunk_index = h.chunk_index OR NOT EXISTS (SELECT 1 FROM h x WHERE x.query_id = h.query_id AND x.doc_id = c.doc_id AND x.chunk_index = c.chunk_index)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, hit ORDER BY t) AS i FROM p),
m AS (
  SELECT query_id, doc_id, hit, 1::BIGINT AS i, CAST(t AS VARCHAR) AS indices, text AS done FROM o WHERE i = 1
  UNION ALL
  SELECT query_id, doc_id, hit, i, indices, CASE WHEN done = '' THEN text WHEN contains(done, text) THEN done WHEN same > 0 THEN done || substr(text, same + 1) ELSE done || chr(10) || text END
  FROM (SELECT m.query_id, m.doc_id, m.hit, o.i, m.indices || ',' || o.t AS indices, m.done, o.text,
      coalesce(list_max(list_filter(range(24, least(length(m.done), length(o.text), 220) + 1), lambda s: right(m.done, s) = left(o.text, s))), 0) AS same
    FROM m JOIN o ON o.query_id = m.query_id AND o.doc_id = m.doc_id AND o.hit = m.hit AND o.i = m.i + 1)
),
st AS (SELECT query_id, doc_id, hit, arg_max(indices, i) AS indices, arg_max(done, i) AS text FROM m GROUP BY ALL),
sc AS (SELECT st.query_id, c.* EXCLUDE (text), st.text, st.indices FROM st JOIN c ON c.doc_id = st.doc_id AND c.chunk_index = st.hit),
bo AS ({R.BOOST_SQL.replace(R.PAIRS, 'hq q JOIN sc c USING (query_id)')}),
al AS (SELECT query_id, id, boost, round(base + boost, 6) AS score FROM cand JOIN bo USING (query_id, id)),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM al)
SELECT query_id, kind, rank, doc_id, indices, boost, score,
  CAST(round(CAST(greatest(0.0, (CASE WHEN score < 0.1 THEN least(75.0, 65.0 + score * 300) ELSE least(99.9, 75.0 + score * 8.5) END) - rank * 0.14) AS DECIMAL(20, 9)), 2) AS DOUBLE) AS shown,
  length(sc.text) AS n_chars, CASE WHEN length(sc.text) > 200 THEN substr(sc.text, 1, 200) || '...' ELSE sc.text END AS snippet
FROM fi JOIN sc USING (query_id, id) JOIN hq USING (query_id) WHERE rank <= k
"""
ORACLES = {
    "hybrid_full": f"WITH RECURSIVE {_LISTS}, {_FLOW}",
    "retrieval_trace": f"WITH {_LISTS} SELECT query_id, stage, count(*) AS n, arg_min(id, rank) AS first_id FROM (SELECT * FROM lists UNION ALL SELECT 'fused', query_id, id, rank FROM cand) GROUP BY ALL",
}
