"""Exact duplicates against a minimal perfect hash over the distinct digests of earlier texts.

Texts are equal when they are identical after each run of white space becomes one space; the SHA-256 of
that form stands for a text, so only digests travel. The distinct digests of the history are dealt out
into shards by hash; each shard is one row with a minimal perfect hash (levels of bits: a key that meets
no other on a level owns its bit, the rest go to the next; a key's slot is the number of bits before its
own) and, by slot, the full digest, the locator of the text that stays and its number of copies. The
hash gives any key some slot, so a lookup compares all 32 bytes: equal means seen before, and what is
not in the history forms groups of its own.

Hot groups: copies are counted where they are read (one row a digest and task), and digests with more
than HEAVY rows or their share of all rows meet their group by broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, HEAVY_SHARE, stored, table

#: Digests of a shard at most, on average; bits of a level for each key.
SHARD, GAMMA = 1 << 16, 1.5
#: Runs of white space that are not one space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
GROUP = "digest binary, keep_id long, group_size long, seen boolean"
INDEX = "shard long, n long, levels array<long>, bits array<long>, digests binary, winners array<long>, copies array<long>"


def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place on a level of each digest, given as four words of 64 bits; all 256 bits take part."""
    h = np.full(len(words), (level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1), np.uint64)
    for column in words.T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def as_words(digests: pa.Array) -> np.ndarray:
    """Digests of 32 bytes as rows of four words."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


class PerfectHash:
    """Minimal perfect hash: ``slots`` gives members distinct numbers below their count, others any such number or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        """Of distinct digests; repeated ones would never come apart and are an error."""
        if len(np.unique(words, axis=0)) < len(words):
            raise ValueError("digests repeat")
        sizes, levels, left = [], [], words
        while len(left):
            size = -(-int(GAMMA * len(left)) // 64) * 64 or 64
            at = place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def slots(self, words: np.ndarray) -> np.ndarray:
        out, left, start = np.full(len(words), -1), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = place(words[left], level, size) + start
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + lower)[hit]
            left, start = left[~hit], start + size
        return out


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, copies)``: rows that repeat id and text are one row with their number."""
    same = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), RUNS, " ")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(same, 256)).alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def shards_for(spark: SparkSession, rows: int) -> int:
    """Enough that a shard stays small, and several for each partition of a shuffle."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD))


def dealt(grouped: DataFrame, shards: int) -> DataFrame:
    return grouped.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build(grouped: DataFrame, shards: int) -> DataFrame:
    """The index: a row a shard, of distinct digests (``digest, keep_id, group_size``). Store it to look things up later."""

    def run(own: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        words = as_words(own["digest"])
        hashed = PerfectHash.of(words)
        at = np.argsort(hashed.slots(words))
        return pa.table(
            {
                "shard": own["shard"].slice(0, 1),
                "n": [len(own)],
                "levels": [hashed.sizes],
                "bits": [hashed.bits.view(np.int64)],
                "digests": [words[at].tobytes()],
                "winners": [own["keep_id"].take(at).to_pylist()],
                "copies": [own["group_size"].take(at).to_pylist()],
            },
            schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("levels", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("digests", pa.binary()), ("winners", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64()))]),
        )

    return dealt(grouped, shards).groupBy("shard").applyInArrow(run, INDEX)


def look_up(grouped: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``(digest, keep_id, group_size, seen)`` of all texts of index and ``grouped``.

    A text of the index keeps its winner, whatever ids come later, and adds up its copies; any other
    keeps the winner of its own group. ``seen`` says that the index holds it. ``shards`` is that of the index.
    """
    kind = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("seen", pa.bool_())])

    def meet(new: pa.Table, old: pa.Table) -> pa.Table:
        new, known, outs = new.combine_chunks(), np.zeros(len(new), bool), []
        if len(old):
            row = {c: old[c][0] for c in ("levels", "bits", "digests", "winners", "copies")}
            hashed = PerfectHash(row["levels"].values.to_numpy(), row["bits"].values.to_numpy().view(np.uint64))
            slots_words = np.frombuffer(row["digests"].as_py(), "<u8").reshape(-1, 4)
            copies = row["copies"].values.to_numpy().copy()
            if len(new):
                words = as_words(new["digest"])
                at = hashed.slots(words)
                known = (at >= 0) & (slots_words[np.maximum(at, 0)] == words).all(1)
                copies[at[known]] += new["group_size"].to_numpy()[known]
            flat = pa.Array.from_buffers(pa.binary(32), len(slots_words), [None, pa.py_buffer(row["digests"].as_py())])
            outs.append(pa.table([flat.cast(pa.binary()), row["winners"].values, copies, np.ones(len(copies), bool)], schema=kind))
        rest = new.filter(pa.array(~known))
        outs.append(pa.table([rest["digest"], rest["keep_id"], rest["group_size"], np.zeros(len(rest), bool)], schema=kind))
        return pa.concat_tables(outs)

    return dealt(grouped, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(meet, GROUP)


def mark(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """A row for each of ``digests()`` rows and copy, with its group and whether it is the one that stays."""
    heavy = F.col("group_size") > max(HEAVY, total // HEAVY_SHARE)  # fewer than HEAVY_SHARE groups
    if total > HEAVY:
        hot = F.broadcast(found.where(heavy))
        both = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(found.where(~heavy), "digest"))
    else:
        both = rows.join(found, "digest")
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, before: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Rows with an id up to ``before`` are the history that is indexed (None: ids up to the middle one, so
    that winners have the smallest id of their text); the others are looked up.
    Null texts count as empty. Rows without id are looked up and stay only where no row with an id has
    their text (keep_id is then null). Of rows that repeat id and text one is kept. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs, key, text))
    total, middle = rows.agg(F.sum("copies"), F.percentile_approx("doc_id", 0.5)).first()
    shards, last = shards_for(spark, total or 0), middle if before is None else before
    old = F.col("doc_id") <= F.lit(last).cast("long")
    index = stored(build(groups(rows.where(old)), shards))
    found = stored(look_up(groups(rows.where(~F.coalesce(old, F.lit(False)))), index, shards))
    return mark(rows, found, total or 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
