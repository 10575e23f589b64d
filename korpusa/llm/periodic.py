"""Runs: maximal stretches of words that repeat with a period at least three times.

Texts are sequences of words. Where no WIDTH words occur twice in a document, its longest previous
factors are all shorter, and no run of the least length fits: such documents are told by a rolling hash
of all their windows (equal windows always meet, so none is lost) and need no more work. The others of
a batch are put one after the other, an own separator behind each, and go through

1. suffix array and ranks of all prefixes of length 2, 4, 8, ... by doubling; LCP of neighbours from the ranks;
2. the longest-previous-factor array by one stack pass over suffix array and LCP, and from it the LZ blocks;
3. boundary extensions: a run of three periods p or more either lies inside a block, clear of its ends,
   or shows at a block's start b in the pair (b, b + p) or at its end e in the pair (e - p, e), for a p
   up to that block's length. (Let the run be [s, t). Every place from s + p on has a longer factor
   reaching t, so of the two blocks that can cover [s + p, t) one covers p of its places.) So all pairs
   number twice the words; a pair is extended in both directions by ranks, vectorised;
4. runs clear of a block's ends are copies of runs in the block's earlier occurrence: blocks in order,
   runs bucketed by their start.

Work and memory grow as n log n of a batch's words or of the longest document's.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, sliced, table

#: Least length of a run in words and least number of periods in it; the boundary step needs three.
LEAST, PERIODS = 24, 3
#: A run's longest previous factor has at least so many words.
WIDTH = LEAST - LEAST // PERIODS
#: Words that go through the suffix array together (a longer document goes alone).
TOGETHER = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and for k = 0, 1, ... the ranks of all suffixes by their first 2**k symbols.

    Two different places share a rank only if both have all 2**k symbols and these are equal.
    """
    n = len(s)
    ranks = [np.unique(s, return_inverse=True)[1].astype(np.int64)]
    while True:
        r, step = ranks[-1], 1 << (len(ranks) - 1)
        if n == 0 or int(r.max()) == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = r[step:] + 1
        ranks.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
    return np.argsort(ranks[-1]), ranks


def forward(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal symbols from places i and j on (different places of a pair)."""
    n, i, j = len(ranks[0]), i.copy(), j.copy()
    out = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((i < n) & (j < n))
        same = inside[ranks[k][i[inside]] == ranks[k][j[inside]]]
        for x in (i, j, out):
            x[same] += 1 << k
    return out


def backward(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal symbols that end just before places i and j."""
    i, j = i.copy(), j.copy()
    out = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        inside = np.flatnonzero((i >= step) & (j >= step))
        same = inside[ranks[k][i[inside] - step] == ranks[k][j[inside] - step]]
        i[same] -= step
        j[same] -= step
        out[same] += step
    return out


def previous_factors(sa: np.ndarray, ranks: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor that also starts earlier, and where it starts (-1: nowhere).

    A place leaves the stack when the array reaches an earlier place: then its nearest earlier places on
    both sides are known, with the LCP towards each.
    """
    n = len(sa)
    longest, source = [0] * n, [-1] * n
    lcp = [0, *forward(ranks, sa[:-1], sa[1:]).tolist(), 0] if n else [0]
    stack: list[tuple[int, int]] = []
    for at, shared in zip([*sa.tolist(), -1], lcp, strict=True):
        while stack and stack[-1][0] > at:
            top, left = stack.pop()
            if max(left, shared):
                longest[top], source[top] = (left, stack[-1][0]) if left >= shared else (shared, at)
            shared = min(shared, left)
        stack.append((at, shared))
    return longest, source


def blocks_of(longest: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """LZ blocks as ``(start, length, start of the earlier occurrence or -1)``."""
    out, at = [], 0
    while at < len(longest):
        size = max(1, longest[at])
        out.append((at, size, source[at]))
        at += size
    return out


def at_boundaries(ranks: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], int]:
    """Smallest period of every run ``(start, end)`` that touches a block's start or end."""
    n = len(ranks[0])
    first, ends = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    place = np.arange(n)
    i, j = np.concatenate([first, place]), np.concatenate([place + 1, ends])
    # of the extensions, together two thirds of a run, one covers a third
    k = min(len(ranks) - 1, (LEAST // PERIODS).bit_length() - 1)
    step = 1 << k
    ahead = (i < n) & (j < n)
    ahead[ahead] = ranks[k][i[ahead]] == ranks[k][j[ahead]]
    behind = (i >= step) & (j >= step)
    behind[behind] = ranks[k][i[behind] - step] == ranks[k][j[behind] - step]
    some = np.flatnonzero(ahead | behind)
    i, j = i[some], j[some]
    p = j - i
    s, t = i - backward(ranks, i, j), j + forward(ranks, i, j)
    ok = t - s >= np.maximum(LEAST, PERIODS * p)
    found: dict[tuple[int, int], int] = {}
    for x, y, q in zip(s[ok].tolist(), t[ok].tolist(), p[ok].tolist(), strict=True):
        found[x, y] = min(q, found.get((x, y), q))
    return found


def runs_of(s: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, end, period)`` of a sequence of numbers, by start."""
    sa, ranks = suffix_array(s)
    blocks = blocks_of(*previous_factors(sa, ranks))
    starts, sizes = (np.array([b[x] for b in blocks], np.int64) for x in (0, 1))
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (x, y), q in at_boundaries(ranks, starts, sizes).items():
        by_start.setdefault(x, []).append((y, q))
    order = sorted(by_start)
    for b, size, before in blocks:
        if size < LEAST + 2:
            continue
        at, shift = bisect_right(order, before), b - before
        while at < len(order) and order[at] < before + size:
            for y, q in list(by_start[order[at]]):
                if y < before + size:
                    if order[at] + shift not in by_start:
                        insort(order, order[at] + shift)
                    by_start.setdefault(order[at] + shift, []).append((y + shift, q))
            at += 1
    return [(x, y, q) for x in order for y, q in sorted(by_start[x], key=lambda r: r[1])]


def may_repeat(docs: list[list[bytes]]) -> np.ndarray:
    """Which documents may hold WIDTH words twice; those that do are always among them."""
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(len(docs), bool)
    total = int(sizes.sum())
    if total < LEAST:
        return out
    h = np.fromiter((hash(w) for d in docs for w in d), np.int64, total).view(np.uint64)
    span, factor = 1, 0x9E3779B97F4A7C15
    power = factor
    while span < WIDTH:
        more = min(span, WIDTH - span)
        h = h[: len(h) - more] * np.uint64(pow(factor, more, 2**64)) + h[more:] if more < span else h[:-span] * np.uint64(power) + h[span:]
        span, power = span + more, power * power % 2**64
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(docs)), sizes)[: len(h)]
    inside = np.arange(len(h)) + WIDTH <= ends[doc]
    doc, h = doc[inside], h[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(h)
    twice = h[order[1:]] == h[order[:-1]]
    out[doc[order[1:][twice]]] = True
    return out & (sizes >= LEAST)


class Codes(dict):
    """Words to numbers in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def runs_of_texts(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, end, period)`` of each document, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    some, waiting, size = np.flatnonzero(may_repeat(docs)).tolist(), [], 0
    for x in [*some, None]:
        if waiting and (x is None or size + len(docs[x]) > TOGETHER):
            codes, parts, starts = Codes(), [], []
            for y in waiting:
                starts.append(sum(map(len, parts)))
                parts += [list(map(codes.__getitem__, docs[y])), [-1 - y]]
            at = 0
            for s, t, p in runs_of(np.concatenate([np.array(q, np.int64) for q in parts])):
                while at + 1 < len(starts) and starts[at + 1] <= s:
                    at += 1
                out[waiting[at]].append((s - starts[at], t - starts[at], p))
            waiting, size = [], 0
        if x is not None:
            waiting.append(x)
            size += len(docs[x])
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, t, p in runs:
        drop[s + p] += 1
        drop[t] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: the runs of each text as structs ``(start, length, period)`` by start and period.

    ``collapsed`` is the text with each run cut to its first period. Null, empty and short texts have no
    runs; repeated rows each give a row; rows without id keep a null id. Other columns are not read.
    One narrow stage, no shuffle: a text is never split, and holds the task's memory n log n of its words.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 128):
            docs = [(t or b"").split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            runs = runs_of_texts(docs)
            flat = np.array([r for d in runs for r in d], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, runs)]).astype(np.int32), structs)
            rest = pa.array([collapsed(d, r) for d, r in zip(docs, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(d) for d in docs], pa.int64()), lists, rest], ["doc_id", "n_words", "runs", "collapsed"])
        give_back()

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The query's own texts: in a tenth of the documents, by id, all words from some word on repeat with one period.

    Documents without id stay as they are.
    """
    h = F.crc32(F.col(key).cast("long").cast("string"))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    with_places = rows.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))

    def word(i: Column) -> Column:
        return F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return with_places.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of most periods and hashes of ``find_runs()`` rows."""

    def more(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", F.aggregate("runs", nothing, more))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(planted(table(spark, sf_dir, "documents"))))
