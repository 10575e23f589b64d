"""Importance resampling towards a target: hashed n-gram features, bucket gains, Gumbel-top-k.

Each task turns its texts, a block of words at a time, into numbers and sorts all places by their next N
words: a suffix array to depth N. Neighbours with an LCP of k or more form the runs of one repeated
k-gram; its bytes are hashed once a run (from the hash of the run's first k - 1 words on), and the bucket
is scattered back to every occurrence. So a document's features are stored as bucket ids, once; counts
over the corpus and scores of the documents read these, not the texts. A word that fills a third of all
texts is one run a block, and a bucket's counts are summed in the task first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import discard, give_back, sliced, stored, table

#: Words in a feature at most; buckets; words of a document that may be drawn; share drawn in percent; seed of the draw.
N, BUCKETS, LEAST, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Words sorted together (a longer text goes alone).
TOGETHER = 1 << 17
#: Bytes of a word as they are, A-Z lower-cased, all others a space.
LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


class Codes(dict):
    """Words to numbers from 1 in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self) + 1
        return code


def buckets_of(docs: list[list[bytes]], depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all runs of 1 to ``depth`` words of the documents, document by document, and their number in each."""
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    codes = Codes()
    ids = np.fromiter((codes[w] for d in docs for w in d), np.int64, total)
    vocabulary = [b"", *codes]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # words from a place to its document's end
    ahead = [ids]  # the words after a place, 0 beyond the document
    for k in range(1, depth):
        x = np.zeros(total, np.int64)
        x[: max(total - k, 0)] = ids[k:]
        ahead.append(np.where(left > k, x, 0))
    rank, most = ids, len(vocabulary)
    for x in ahead[1:]:
        if most > (1 << 62) // len(vocabulary):  # else the key would leave 64 bits
            kinds, rank = np.unique(rank, return_inverse=True)
            most = len(kinds)
        rank, most = rank * len(vocabulary) + x, most * len(vocabulary)
    sa = np.argsort(rank)
    out, state = np.zeros((total, depth), np.int64), np.zeros(total, np.int64)
    same = np.ones(max(total - 1, 0), bool)
    spaced = [b" " + w for w in vocabulary]
    for k, x in enumerate(ahead):
        same &= x[sa[1:]] == x[sa[:-1]]  # neighbours whose LCP is above k
        fresh = np.flatnonzero(np.concatenate([[True], ~same])) if total else np.zeros(0, np.int64)
        last, before = x[sa[fresh]].tolist(), state[fresh].tolist()
        named = spaced if k else vocabulary
        crc = np.array([zlib.crc32(named[w], c) for w, c in zip(last, before, strict=True)], np.int64)
        state = np.repeat(crc, np.diff(np.append(fresh, total)))
        out[sa, k] = state % buckets
    whole = left[:, None] > np.arange(depth)
    per_word = np.concatenate([[0], np.cumsum(whole.sum(1))])
    ends = per_word[np.cumsum(sizes)] if total else np.zeros(len(docs), np.int64)
    return out[whole], np.diff(np.concatenate([[0], ends]))


def features(docs: DataFrame, depth: int = N, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)``: bucket ids of each text's features, packed little-endian (16 bits, 32 beyond 65,536 buckets).

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased. Null and
    empty texts have none. Other columns are not read.
    """
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def block(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
        flat, counts = buckets_of(docs, depth, buckets)
        packed, at = flat.astype(width).tobytes(), np.concatenate([[0], np.cumsum(counts)]) * np.dtype(width).itemsize
        cells = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(d) for d in docs], pa.int64()), pa.array(counts), cells], ["doc_id", "n_words", "n_features", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, size = [], [], 0
        for b in sliced(batches, 128):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(t)
                if docs and size + len(words) > TOGETHER:
                    yield block(ids, docs)
                    ids, docs, size = [], [], 0
                ids.append(i)
                docs.append(words)
                size += len(words)
        if docs:
            yield block(ids, docs)
        give_back()

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def cells(b: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All bucket ids of a batch of ``features()`` and where each row's end."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    column = b.column("buckets")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(width)
    return flat, (at - at[0]) // np.dtype(width).itemsize


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: ``buckets`` numbers, whatever the corpus; summed in each task, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            if len(b):
                n += np.bincount(cells(b, buckets)[0], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    sums = feats.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the corpus, floored."""
    m, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean of the gains of a document's features; none: 0."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                flat, at = cells(b, buckets)
                sums = np.diff(np.concatenate([[0], np.cumsum(gain[flat])])[at])
                mean = sums // np.maximum(np.diff(at), 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    return feats.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable fixed by seed and id, floored; a missing id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least: int = LEAST) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs``; rank 1, 2, ... is set for those drawn.

    Of the documents with ``least`` words or more, ``percent`` in a hundred (rounded down) are drawn without
    replacement, in proportion to their importance: highest scores first, ties to the smaller id, rows
    without id last. Repeated rows have equal scores and are drawn each for itself. An empty target gives
    every bucket a count of 0; no documents give no rows.
    """
    feats = stored(features(docs))
    gain = gains(bucket_counts(feats), bucket_counts(features(target)))
    rows = stored(weights(feats, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    discard(feats)
    long_enough = F.col("n_words") >= least
    drawn = rows.where(long_enough).count() * percent // 100
    some = numbered(rows.where(long_enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    ranked = some.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    both = ranked.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    return both.select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.lit(None).cast("long").alias("doc_id"), "text"))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS MATERIALIZED (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS MATERIALIZED (
  SELECT side, id, f, count(*) AS n FROM (
    SELECT side, id, unnest(w) AS f FROM words
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words) GROUP BY ALL),
coded AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || hex(f)[2 * i - 1 : 2 * i])::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS b
  FROM (SELECT DISTINCT f FROM feats), crc),
counts AS (
  SELECT b, sum(CASE WHEN side = 's' THEN n ELSE 0 END)::BIGINT AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END)::BIGINT AS t FROM feats JOIN coded USING (f) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS g FROM counts),
means AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM feats JOIN coded USING (f) JOIN gain USING (b) WHERE side = 's' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN means USING (id) WHERE side = 's'),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * 25 // 100 FROM scored WHERE n_words >= 20) THEN r END AS rank FROM ranked
"""
