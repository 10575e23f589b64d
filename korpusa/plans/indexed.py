"""Queries of the stored lexical index: built in batches, with documents replaced and deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical_index import LexicalIndex
from ..sources.formats import shared_path
from .retrieval import K, _asked, _ctes, _docs

#: Documents whose id this divides are deleted at the end.
GONE = 7


def _kept(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """All documents after four commits: three quarters of them, the rest with a wrong text for some, these again, a delete and what it deleted."""
    docs = _docs(spark, sf_dir)
    index = LexicalIndex.create(spark, shared_path(spark, "lexical-index")).add(docs.where("id % 4 <> 1"))
    wrong = docs.select("id", F.when(F.col("id") % 8 == 1, F.lit("text of an earlier version")).otherwise(F.col("text")).alias("text"))
    index = index.add(wrong.where("id % 4 = 1")).add(docs.where("id % 8 = 1"))
    return index.delete(docs.where("id % 16 = 3").select("id")).add(docs.where("id % 16 = 3"))


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of bm25_topk from the files of an index that was built, changed and loaded again."""
    return LexicalIndex.load(spark, _kept(spark, sf_dir).path).search(_asked(spark, sf_dir), K)


def bm25_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    index = LexicalIndex.create(spark, shared_path(spark, "lexical-index")).add(docs)
    return index.delete(docs.where(f"id % {GONE} = 0").select("id")).search(_asked(spark, sf_dir), K)


def bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks each question meets, and how many its search scores."""
    index = LexicalIndex.create(spark, shared_path(spark, "lexical-index")).add(_docs(spark, sf_dir))
    return index.blocks_read(_asked(spark, sf_dir), K)


QUERIES = {"bm25_indexed": bm25_indexed, "bm25_after_delete": bm25_after_delete, "bm25_blocks": bm25_blocks}
_REST = _ctes(K).replace("AS toks FROM documents)", f"AS toks FROM documents WHERE doc_id % {GONE} <> 0)", 1)
ORACLES = {"bm25_indexed": f"WITH {_ctes(K)} SELECT * FROM bm_top", "bm25_after_delete": f"WITH {_REST} SELECT * FROM bm_top"}
