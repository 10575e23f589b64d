"""Stored BM25 index: segments of block-wise postings, a checked manifest, deletes by tombstone, block-max search.

Files below the index's path:

* ``segments/<s>/forward``: a row a document, ``id, dl, terms, tfs`` and its place ``at``. Documents are laid out by
  their most frequent term, then by length, and cut into blocks, so a block's documents are alike in language and length.
* ``segments/<s>/postings/bucket=<b>``: a row a term and block, sorted by term: ``ids, tfs, dls`` as arrays, beside
  them ``most_tf`` and ``least_dl``. From these two any mean length gives an upper bound of the term's score in the
  block, so bounds stay right when later batches move the corpus statistics.
* ``changes/<v>``: ``term, df`` that a commit adds (or takes away, below zero), ``tombstones/<v>``: ids that it deletes
  from earlier segments.
* ``manifest/v=<v>``: one JSON line a commit, with its own digest and the row counts of every part. A commit is
  visible when its manifest is; what a failed one left behind is read by nobody.

A batch of added or deleted documents costs its own size and one pass over the vocabulary; postings that exist are
not touched. A term that all texts hold is a row a block, never one long list.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.formats import written
from .batches import sliced
from .lexical import FLOOR, K1, B, asked_terms
from .numbering import laid_out, placed

#: Documents of a block at least, as a power of two; a segment has at most about MOST_BLOCKS blocks.
BLOCK_BITS, MOST_BLOCKS = 6, 1 << 20
#: Tokens of a bucket of postings, on average; blocks that are scored first to get a threshold; asked terms that are broadcast at most.
BUCKET_TOKENS, SEEDS, MOST_SHIPPED = 1 << 22, 4, 1_000_000
#: Rounding of scores is to 6 places, so a bound this close below the threshold may still tie.
SLACK = 1e-5
FORWARD = "id long, dl long, terms array<string>, tfs array<int>"
PARTS = ("forward", "postings")


class DamagedIndex(ValueError):
    """The files are not those of a whole index."""


@dataclass(frozen=True)
class Segment:
    name: int
    documents: int
    postings: int
    buckets: int


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: tuple[Segment, ...]
    deletes: tuple[int, ...]
    changes: tuple[int, ...]
    documents: int
    tokens: int
    mean_idf: float

    def line(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"digest": hashlib.sha256(body.encode()).hexdigest(), "body": body})

    @classmethod
    def parse(cls, line: str) -> Manifest:
        try:
            outer = json.loads(line)
            if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["digest"]:
                raise DamagedIndex("the manifest's digest differs")
            raw = json.loads(outer["body"])
            return cls(**{**raw, "segments": tuple(Segment(**s) for s in raw["segments"]), "deletes": tuple(raw["deletes"]), "changes": tuple(raw["changes"])})
        except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
            raise DamagedIndex(f"the manifest can't be read: {e}") from e


EMPTY = Manifest(0, (), (), (), 0, 0, 0.0)


@dataclass(frozen=True)
class Rest:
    """What an index keeps when some documents go: tombstone versions, live documents and tokens, and the terms that go."""

    deletes: tuple[int, ...]
    documents: int
    tokens: int
    changes: DataFrame | None


def counted(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` as FORWARD: length in tokens, distinct terms and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 512):
            counts = [Counter(t.split(" ")) if t else Counter() for t in b.column("toks").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array([c.total() for c in counts], pa.int64()),
                    pa.array([list(c) for c in counts], pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
                ],
                ["id", "dl", "terms", "tfs"],
            )

    return docs.select(F.col("id").cast("long").alias("id"), F.array_join(tokens("text"), " ").alias("toks")).mapInArrow(run, FORWARD)


def inverted(forward: DataFrame) -> DataFrame:
    """Postings ``(term, block, most_tf, least_dl, ids, tfs, dls)`` of FORWARD rows with a ``block``, by term in each block.

    One task inverts a block at a time; its size is that of 2**BLOCK_BITS documents (more only where a segment has over MOST_BLOCKS blocks).
    """

    def run(own: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        lists = own["terms"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        doc = np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
        tf = own["tfs"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((doc, code := coded.indices.to_numpy()))
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        at = pa.array(np.append(starts, len(order)).astype(np.int32))
        dl, tf = own["dl"].to_numpy()[doc[order]], tf[order]
        cells = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (own["id"].to_numpy()[doc[order]], tf, dl)]
        bounds = [np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)] if len(starts) else [tf, dl]
        return pa.table([coded.dictionary.take(pa.array(code[order][starts])), np.full(len(starts), own["block"][0].as_py()), *map(pa.array, bounds), *cells], names=["term", "block", "most_tf", "least_dl", "ids", "tfs", "dls"])

    kind = "term string, block long, most_tf int, least_dl long, ids array<long>, tfs array<int>, dls array<long>"
    return forward.where("dl > 0").groupBy("block").applyInArrow(run, kind)


class LexicalIndex:
    """One index at ``path``; ``add`` and ``delete`` commit, ``search`` reads the files alone."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(spark, path, EMPTY)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        """The newest commit, after its digest and the row counts of all its parts are checked; else DamagedIndex."""
        try:
            lines = spark.read.text(f"{path.rstrip('/')}/manifest").select("v", "value").orderBy(F.desc(F.col("v").cast("long"))).limit(1).collect()
        except AnalysisException as e:
            raise DamagedIndex(f"no manifest below {path}") from e
        if not lines:
            raise DamagedIndex("the manifest is empty")
        found = cls(spark, path, Manifest.parse(lines[0].value))
        for s in found.manifest.segments:
            try:
                rows = [found._part(s, part).count() for part in PARTS]
            except AnalysisException as e:
                raise DamagedIndex(f"segment {s.name} lacks a part") from e
            if rows != [s.documents, s.postings]:
                raise DamagedIndex(f"segment {s.name} has {rows} rows, the manifest says {[s.documents, s.postings]}")
        return found

    def _part(self, s: Segment, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{s.name}/{part}")

    def _deleted(self) -> DataFrame | None:
        """``(id, before)``: ids that are gone from segments with a name below ``before``."""
        versions = self.manifest.deletes
        return self.spark.read.parquet(*[f"{self.path}/tombstones/{v}" for v in versions]) if versions else None

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without rows ``(segment, id)`` that a tombstone names."""
        gone = self._deleted()
        if gone is None:
            return rows
        gone = gone.groupBy("id").agg(F.max("before").alias("before")).withColumnRenamed("id", "gone")
        return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("segment") < F.col("before")), "left_anti")

    def forward(self) -> DataFrame | None:
        """``(segment, id, dl, terms, tfs)`` of the live documents."""
        parts = [self._part(s, "forward").select(F.lit(s.name).alias("segment"), "id", "dl", "terms", "tfs") for s in self.manifest.segments]
        return self._live(reduce(DataFrame.unionByName, parts)) if parts else None

    def _commit(self, segments: tuple[Segment, ...], deletes: tuple[int, ...], documents: int, n_tokens: int, changes: DataFrame) -> LexicalIndex:
        """Parts of a commit that failed before its manifest are overwritten; two writers of one version can't both make it."""
        version = self.manifest.version + 1
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/{version}")
        made = Manifest(version, segments, deletes, (*self.manifest.changes, version), documents, n_tokens, 0.0)
        found = LexicalIndex(self.spark, self.path, made)
        df, n = F.col("df"), F.lit(float(documents))
        mean = found._terms().agg(F.avg(F.log(n - df + 0.5) - F.log(df + 0.5))).first()[0]
        found.manifest = replace(made, mean_idf=mean or 0.0)
        self.spark.createDataFrame([(found.manifest.line(),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/v={version}")
        return found

    def _terms(self) -> DataFrame:
        """``(term, df)`` of the live documents: the sum of all commits' changes."""
        every = self.spark.read.parquet(*[f"{self.path}/changes/{v}" for v in self.manifest.changes])
        return every.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def add(self, docs: DataFrame) -> LexicalIndex:
        """Commits a segment of ``docs(id, text)``; ids that are indexed already are replaced. Rows without id are left out; ids are unique in a batch."""
        base = self._without(docs.select(F.col("id").cast("long").alias("id")))
        name = self.manifest.version + 1
        where = f"{self.path}/segments/{name}"
        rows = written(counted(docs.where("id is not null")), "counted")  # a range shuffle reads its input twice
        often = F.element_at("terms", F.array_position("tfs", F.array_max("tfs")).cast("int"))
        lead = F.when(F.size("terms") > 0, often)
        laid = laid_out(rows, [lead, F.col("dl"), F.col("id")], "at")
        laid.write.mode("overwrite").parquet(f"{where}/forward")
        forward = self.spark.read.parquet(f"{where}/forward")
        n = forward.count()
        bits = max(BLOCK_BITS, (n // MOST_BLOCKS).bit_length())
        total = forward.agg(F.sum("dl")).first()[0] or 0
        buckets = max(8, total // BUCKET_TOKENS)
        packed = inverted(placed(forward, "place", "at").withColumn("block", F.shiftright(F.col("place") - 1, bits)))
        packed = packed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{where}/postings")
        postings = self.spark.read.parquet(f"{where}/postings")
        segment = Segment(name, n, postings.count(), buckets)
        changes = postings.groupBy("term").agg(F.sum(F.size("ids")).cast("long").alias("df"))
        changes = changes if base.changes is None else changes.unionByName(base.changes)
        return self._commit((*self.manifest.segments, segment), base.deletes, base.documents + n, base.tokens + total, changes)

    def delete(self, ids: DataFrame) -> LexicalIndex:
        """Commits tombstones of ``ids(id)``; ids that are not indexed change nothing."""
        base = self._without(ids.select(F.col("id").cast("long").alias("id")))
        return self if base.changes is None else self._commit(self.manifest.segments, base.deletes, base.documents, base.tokens, base.changes)

    def _without(self, ids: DataFrame) -> Rest:
        """What stays of the index without some documents; their terms come from the forward rows of these documents only."""
        m, live = self.manifest, self.forward()
        nothing = Rest(m.deletes, m.documents, m.tokens, None)
        if live is None:
            return nothing
        gone = live.join(ids.where("id is not null").distinct(), "id", "left_semi")
        n, total = gone.agg(F.count("*"), F.sum("dl")).first()
        if not n:
            return nothing
        version = m.version + 1
        gone.select("id", F.lit(version).alias("before")).write.mode("overwrite").parquet(f"{self.path}/tombstones/{version}")
        changes = gone.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        return Rest((*m.deletes, version), m.documents - n, m.tokens - total, changes)

    # --- search -----------------------------------------------------------------------------------------

    def _weights(self, queries: DataFrame) -> DataFrame:
        """``(query_id, term, weight)`` of the terms that live documents hold."""
        asked = asked_terms(queries)
        idf = F.log(F.lit(float(self.manifest.documents)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(idf < 0, FLOOR * self.manifest.mean_idf).otherwise(idf)
        few = len(asked.limit(MOST_SHIPPED + 1).select("query_id").toArrow()) <= MOST_SHIPPED
        known = self._terms().join(F.broadcast(asked) if few else asked, "term")
        return known.select("query_id", "term", (F.col("qf") * idf).alias("weight"))

    def _buckets(self, weights: DataFrame) -> dict[int, list[int]]:
        """For each segment the buckets of the asked terms."""
        return {s.name: [r[0] for r in weights.select(F.pmod(F.xxhash64("term"), F.lit(s.buckets))).distinct().collect()] for s in self.manifest.segments}

    def _postings(self, used: dict[int, list[int]], *columns: str) -> DataFrame:
        """Postings of all segments; of their files only the buckets ``used`` are listed and read."""
        parts = [self._part(s, "postings").where(F.col("bucket").isin(used[s.name])).select(F.lit(s.name).alias("segment"), "term", "block", *columns) for s in self.manifest.segments]
        return reduce(DataFrame.unionByName, parts)

    def _part_score(self, tf: Column, dl: Column) -> Column:
        mean = self.manifest.tokens / self.manifest.documents or 1.0
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))

    def bounds(self, weights: DataFrame, used: dict[int, list[int]]) -> DataFrame:
        """``(query_id, segment, block, bound)`` of the blocks that hold a term of the question."""
        most = F.greatest(F.col("weight") * self._part_score(F.col("most_tf"), F.col("least_dl")), F.lit(0.0))
        met = self._postings(used, "most_tf", "least_dl").join(weights, "term")
        return met.groupBy("query_id", "segment", "block").agg(F.sum(most).alias("bound"))

    def _scored(self, weights: DataFrame, used: dict[int, list[int]], blocks: DataFrame) -> DataFrame:
        """``(query_id, id, score)`` of the live documents of ``blocks(query_id, segment, block)``."""
        cells = self._postings(used, "ids", "tfs", "dls").join(weights, "term").join(blocks, ["query_id", "segment", "block"], "left_semi")
        each = cells.select("query_id", "segment", "weight", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("x"))
        part = F.col("weight") * self._part_score(F.col("x.tfs"), F.col("x.dls"))
        sums = each.groupBy("query_id", "segment", F.col("x.ids").alias("id")).agg(F.round(F.sum(part), 6).alias("score"))
        return self._live(sums.where("score > 0")).select("query_id", "id", "score")

    def plan(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """``(scored, blocks)``: scores of all documents that may be among the k best, and blocks ``(query_id, segment, block, bound, place, more)``.

        The blocks with the highest bounds are scored first; of the rest those (``more``) whose bound reaches the k-th of these scores.
        """
        weights = written(self._weights(queries), "weights")
        few = weights.count() <= MOST_SHIPPED
        weights, used = F.broadcast(weights) if few else weights, self._buckets(weights)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
        blocks = written(self.bounds(weights, used).withColumn("place", place), "blocks")
        first = written(self._scored(weights, used, blocks.where(F.col("place") <= SEEDS)), "scored")
        threshold = _ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        reaches = (F.col("place") > SEEDS) & (F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        blocks = blocks.join(threshold, "query_id", "left").withColumn("more", reaches).drop("least")
        return first.unionByName(self._scored(weights, used, blocks.where("more"))), blocks

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, id, score, rank)``: the k best live documents of each of ``queries(query_id, text)``, ties to the smaller id.

        Scores are those of ``lexical.bm25`` over the same documents. No documents or no known terms give no rows.
        """
        if not self.manifest.documents:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank long")
        return _ranked(self.plan(queries, k)[0], k)

    def blocks_read(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, blocks, read)``: blocks with a term of the question, and how many of them a search scores."""
        return self.plan(queries, k)[1].groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if((F.col("place") <= SEEDS) | F.col("more")).alias("read"))

    def merged(self, path: str) -> LexicalIndex:
        """A new index at ``path`` of one segment with the live documents, from their forward rows: no text is read again."""
        live = self.forward()
        fresh = LexicalIndex.create(self.spark, path)
        if live is None:
            return fresh
        again = F.array_join(F.flatten(F.transform(F.arrays_zip("terms", "tfs"), lambda x: F.array_repeat(x["terms"], x["tfs"]))), " ")
        return fresh.add(live.select("id", again.alias("text")))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
