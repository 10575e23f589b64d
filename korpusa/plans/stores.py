"""Queries of state and keyed stores: revoked tokens, a table kept by batches, legal order, evaluation by ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import lexical
from ..operators.keyed_store import KeyedStore
from ..operators.numbering import numbered
from ..sources.formats import shared_path
from ..sources.tables import load
from ..streaming.tokens import run_judged
from .regulations import PIECES, ROMAN, regulations
from .retrieval import _asked, _ctes, _docs

HOURS = 12


def tokens_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' errors revoke their token for twelve hours; which of their other events are refused."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    revokes = F.col("event_type") == "error"
    folder = shared_path(spark, "token-rows")
    rows = e.select(F.col("user_id").alias("token"), "ts", F.when(~revokes, F.col("event_id")).alias("use"), F.when(revokes, F.col("ts") + F.expr(f"interval {HOURS} hours")).alias("until"))
    rows.write.parquet(folder)
    return run_judged(spark, folder).select(F.col("token").alias("user_id"), F.col("use").alias("event_id"), "refused")


def _store(spark: SparkSession, sf_dir: str) -> KeyedStore:
    """Customers in four batches, one of them applied twice: all of them, new balances, deletes, and a mix."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    store = KeyedStore(spark, shared_path(spark, "keyed"), "c_custkey", "c_custkey long, c_mktsegment string, c_acctbal double")
    no = {"order": F.lit(0), "gone": F.lit(False)}
    doubled = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") * 2).otherwise(F.col("c_acctbal")))
    store.apply(10, c.where("c_custkey % 5 <> 0").withColumns(no))
    store.apply(11, doubled.withColumns(no))
    store.apply(12, c.where("c_custkey % 7 = 0").withColumns(no | {"gone": F.lit(True)}))
    store.apply(11, c.withColumns(no | {"gone": F.lit(True)}))  # comes again, whatever it holds
    twice = c.where("c_custkey % 14 = 0")
    store.apply(13, twice.withColumns(no).unionByName(twice.withColumns(no | {"order": F.lit(1), "c_mktsegment": F.lit("AGAIN")})))
    return store


def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).rows()


def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [(x["batch"], *(x["counters"][s] for s in ("imported", "updated", "skipped", "deleted", "missing"))) for x in _store(spark, sf_dir).ledger()]
    return spark.createDataFrame(lines, "batch long, imported long, updated long, skipped long, deleted long, missing long")


def legal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of all made regulations numbered in legal order: chapter as a number, article, clause, place."""
    parts = D.regulation_parts(D.text_lines(regulations(spark, sf_dir)))
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    order = [F.col("doc_id"), F.coalesce(S.roman_to_int(F.coalesce("bab", F.lit(""))), F.lit(0)), number("pasal"), number("ayat"), F.col("n")]
    return numbered(parts, order).select("doc_id", "kind", "bab", "pasal", "ayat", "place")


def truth_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and reciprocal rank of BM25 lists against ids in a text, else against metadata pairs."""
    docs = load(spark, sf_dir, "documents")
    lists = lexical.best(_docs(spark, sf_dir), _asked(spark, sf_dir), 10)
    meta = docs.select(F.col("doc_id").alias("id"), F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("meta"))
    found = lists.where("kind = 'bm25'").join(meta, "id").select("query_id", F.col("id").alias("chunk"), "rank", "meta")
    named = lists.where("kind = 'overlap' and rank = 2 and query_id % 3 = 0").select(F.col("query_id").alias("q"), F.concat(F.lit("CHUNK "), "id", F.lit(", CHUNK "), F.col("id") + 1).alias("truth"))
    pairs = F.when(F.col("query_id") % 4 > 0, F.create_map(F.lit("source"), F.concat(F.lit("SRC"), F.col("query_id") % 10), F.lit("lang"), F.lit("x-EN-y"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    truths = _asked(spark, sf_dir).join(named, F.col("query_id") == F.col("q"), "left").select("query_id", E.truth_ids("truth").alias("ids"), pairs.alias("pairs"))
    return E.scores(E.matched(found, truths), (1, 3, 5, 10))


QUERIES = {"tokens_revoked": tokens_revoked, "store_rows": store_rows, "store_counters": store_counters, "legal_order": legal_order, "truth_evaluation": truth_evaluation}
_CASES = """
a AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0),
n1 AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 = 0),
b AS (SELECT * FROM a WHERE c_custkey % 3 <> 0 UNION ALL SELECT * FROM n1),
c AS (SELECT * FROM b WHERE c_custkey % 7 <> 0),
n3 AS (SELECT c_custkey, 'AGAIN' AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 14 = 0)
"""
ORACLES = {
    "tokens_revoked": f"SELECT user_id, event_id, EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND r.ts <= e.ts AND e.ts < r.ts + INTERVAL {HOURS} HOUR) AS refused FROM events e WHERE event_type <> 'error'",
    "store_rows": f"WITH {_CASES} SELECT * FROM c UNION ALL SELECT * FROM n3",
    "store_counters": f"""
WITH {_CASES}
SELECT 10::BIGINT AS batch, (SELECT count(*) FROM a) AS imported, 0::BIGINT AS updated, 0::BIGINT AS skipped, 0::BIGINT AS deleted, 0::BIGINT AS missing
UNION ALL SELECT 11, count(*) FILTER (WHERE a.c_custkey IS NULL), count(*) FILTER (WHERE a.c_acctbal <> n1.c_acctbal), count(*) FILTER (WHERE a.c_acctbal = n1.c_acctbal), 0, 0 FROM n1 LEFT JOIN a USING (c_custkey)
UNION ALL SELECT 12, 0, 0, 0, (SELECT count(*) FROM b WHERE c_custkey % 7 = 0), (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM b))
UNION ALL SELECT 13, (SELECT count(*) FROM n3), 0, 0, 0, 0""",
    "legal_order": f"""
WITH {PIECES},
t AS (
  SELECT DISTINCT doc_id, CASE WHEN i % 20 = 0 THEN 'intro' WHEN i % 4 = 1 THEN 'article' ELSE 'clause' END AS kind, CASE WHEN i % 4 = 0 AND i % 20 > 0 THEN i - 1 ELSE i END AS part FROM pc),
u AS (
  SELECT doc_id, kind, part // 20 % 10 + 1 AS b, CASE WHEN kind <> 'intro' THEN part - part % 4 + 1 END AS p, CASE WHEN kind = 'clause' THEN part % 4 - 1 END AS y, part FROM t
  UNION ALL SELECT doc_id, 'preamble', NULL, NULL, NULL, -1 FROM src UNION ALL SELECT doc_id, 'appendix', NULL, NULL, NULL, 1000000000 FROM src WHERE doc_id % 3 = 0)
SELECT doc_id, kind, ['{"', '".join(ROMAN)}'][b] AS bab, p::VARCHAR AS pasal, y::VARCHAR AS ayat,
  row_number() OVER (ORDER BY doc_id, coalesce(b, 0), coalesce(p, 0), coalesce(y, 0), part) AS place FROM u""",
    "truth_evaluation": f"""
WITH {_ctes(10)},
g AS (SELECT item_id AS query_id, o.id AS a, item_id % 4 > 0 AS p FROM benchmark LEFT JOIN ov_top o ON o.query_id = item_id AND o.rank = 2 AND item_id % 3 = 0),
s AS (SELECT b.query_id, b.rank, coalesce(b.id IN (g.a, g.a + 1), false)
    OR (g.p AND (contains(lower(coalesce(source, '')), 'src' || (b.query_id % 10)) OR contains('src' || (b.query_id % 10), lower(coalesce(source, '')))) AND (contains(lower(coalesce(lang, '')), 'x-en-y') OR contains('x-en-y', lower(coalesce(lang, ''))))) AS hit
  FROM bm_top b JOIN g USING (query_id) JOIN documents ON doc_id = b.id),
f AS (SELECT item_id AS query_id, min(CASE WHEN hit THEN rank END) AS spot FROM benchmark LEFT JOIN s ON s.query_id = item_id GROUP BY item_id)
SELECT k, count(*) AS questions, round(avg(CASE WHEN spot <= k THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN spot <= k THEN 1.0 / spot ELSE 0 END), 6) AS mrr FROM f, (VALUES (1::BIGINT), (3), (5), (10)) v(k) GROUP BY k""",
}
