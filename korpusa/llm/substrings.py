"""Exact duplicate-substring removal with a run-length index.

Every byte covered by a LENGTH-byte string that also starts elsewhere, in any document or twice in one,
is removed; strings are judged on the input.

A whole-corpus suffix array cannot be built at scale, so the corpus is first cut so that equal strings
meet. Each LENGTH-byte window belongs to its minimizer, the leftmost least hash among its KMER-byte
pieces; equal windows have equal minimizers at equal offsets. The windows of one minimizer occurrence
form one short context. Contexts whose minimizer occurs once in the corpus cannot match and go no
further; the others meet by minimizer, equal contexts merged beforehand, and each bucket gets its own
index:

* suffixes that start a window are sorted by prefix doubling;
* the Burrows-Wheeler transform is kept as runs, with the suffixes at both ends of every run sampled;
* only there are common prefixes compared. Elsewhere a suffix's neighbour has the same preceding byte,
  so its match is one shorter than that of the position before: matching statistics stream along the
  text from run end to run end, and a window is marked where they reach LENGTH.

A minimizer with more than HOT occurrences is not put into one bucket: content-defined pieces of its
distinct contexts, and the windows of pieces that occur once, are counted by 128-bit hash instead,
spread over all tasks (the exact way for such keys).

Defined results: null text counts as empty; repeated rows are duplicates of each other and each keeps
its own output row; texts shorter than LENGTH keep all bytes; very long ones are cut into contexts whole;
doc_id may be null (rows are told apart by doc_id and a 64-bit hash of the text); of two equal least hashes
in a window (a tie) the leftmost counts; equal contexts and windows are recognised by 128 bits of hash (64 of the
minimizer, 64 of the context; or one of 128) and not compared byte by byte; an empty table gives an empty result; of
the input only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, split_join, stored, table

LENGTH, KMER = 200, 32
#: Occurrences of a minimizer that one bucket takes; bytes of contexts indexed at once.
HOT, TEXT = 4096, 1 << 19
CHUNK, PLACE = 1 << 20, (1 << 24) - 1
MOST_SEEN = 200_000
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def piece_hashes(a: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes from each place."""
    h, size = a.astype(np.uint64) + np.uint64(1), 1
    for m in MULTIPLIERS:  # doubles the length each time: KMER = 2 ** len(MULTIPLIERS)
        h = h[:-size] * m + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    return h


def contexts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer hash of each context of a text, in order."""
    n = len(text) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, parts = np.frombuffer(text, np.uint8), []
    width = LENGTH - KMER + 1
    for at in range(0, n, CHUNK):
        count = min(CHUNK, n - at)
        h = piece_hashes(a[at : at + count + LENGTH - 1])
        low = (h & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :]) if width > size else low
        chosen = (low & np.uint64(PLACE)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(chosen)) + 1)
        parts.append((at + first, np.diff(np.append(first, count)), h[chosen[first]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- the run-length index of one bucket --------------------------------------------------------------


class RunLengthIndex:
    """Run-compressed BWT over the windows of a bucket's contexts, with sampled run ends."""

    def __init__(self, texts: list[bytes]):
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        n = len(self.text)
        stop = np.cumsum(sizes)
        self.end = np.repeat(stop, sizes)  # end of the context that a place is in
        windows = sizes - LENGTH + 1
        self.starts = np.repeat(stop - sizes, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.first = np.zeros(n, bool)
        self.first[stop - sizes] = True
        # ranks of the 4, 8, 16, ... bytes from each place, cut at the context's end
        key = np.zeros(n, np.uint64)
        for k in range(4):
            at = np.arange(n) + k
            inside = at < self.end
            key[inside] |= self.text[at[inside]].astype(np.uint64) << np.uint64(8 * (3 - k))
        self.levels: list[tuple[int, np.ndarray]] = [(4, self._rank(key, 32))]
        longest, size = int(sizes.max()), 4
        bits = int(n).bit_length()
        while size * 2 < longest:
            rank = self.levels[-1][1]
            self.levels.append((size * 2, self._rank(rank.astype(np.uint64) << np.uint64(bits) | self._ahead(rank, np.arange(n), size), 2 * bits)))
            size *= 2
        rank = self.levels[-1][1]
        pair = rank[self.starts].astype(np.uint64) << np.uint64(bits) | self._ahead(rank, self.starts, size)
        self.order = self.starts[np.argsort(pair, kind="stable")]  # ties: equal to the end, by place
        before = np.where(self.first[self.order], -1 - np.arange(len(self.order)), self.text[self.order - 1])
        self.heads = np.append(0, np.flatnonzero(np.diff(before)) + 1)  # first suffix of every run
        self.symbols = before[self.heads]

    @staticmethod
    def _rank(key: np.ndarray, bits: int) -> np.ndarray:
        """Dense rank (from 1) of every key."""
        n = len(key)
        low = int(n).bit_length()
        if bits + low <= 64:  # a plain sort of key and place is much faster than an argsort
            both = np.sort(key << np.uint64(low) | np.arange(n, dtype=np.uint64))
            order, key = (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
        return out

    def _ahead(self, rank: np.ndarray, places: np.ndarray, by: int) -> np.ndarray:
        at = places + by
        inside = at < self.end[places]
        return np.where(inside, rank[np.minimum(at, len(rank) - 1)], 0).astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, within their contexts."""
        out = np.zeros(len(a), np.int64)
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        for size, rank in reversed(self.levels):
            for _ in range(1 if size > 4 else 2):
                x, y = a + out, b + out
                fits = out + size <= room
                x, y = np.where(fits, x, 0), np.where(fits, y, 0)
                out += size * (fits & (rank[x] == rank[y]))
        for _ in range(4):
            fits = out < room
            x, y = np.where(fits, a + out, 0), np.where(fits, b + out, 0)
            out += fits & (self.text[x] == self.text[y])
        return out

    def statistics(self) -> np.ndarray:
        """For each place: a match length to another suffix, exact wherever it reaches LENGTH."""
        best = np.zeros(len(self.text), np.int64)
        if len(self.order) < 2:
            return best
        tails = np.append(self.heads[1:] - 1, len(self.order) - 1)
        for ends, other in ((self.heads, -1), (tails, 1)):
            ends = ends[(ends + other >= 0) & (ends + other < len(self.order))]
            sampled = np.zeros(len(self.text), bool)
            value = np.zeros(len(self.text), np.int64)
            here = self.order[ends]
            sampled[here] = True
            value[here] = self.common(here, self.order[ends + other])
            sampled |= self.first
            at = np.arange(len(self.text))
            last = np.maximum.accumulate(np.where(sampled, at, 0))
            best = np.maximum(best, value[last] - (at - last))
        return best


def marked(texts: list[bytes], repeated: np.ndarray) -> list[list[int]]:
    """Flat [start, end, start, end, ...] byte spans to remove of each context of a bucket."""
    index = RunLengthIndex(texts)
    found = index.statistics() >= LENGTH
    sizes = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(sizes)
    out = []
    for lo, hi, again in zip((stop - sizes).tolist(), stop.tolist(), repeated.tolist(), strict=True):
        hit = np.ones(hi - lo - LENGTH + 1, bool) if again else found[lo : hi - LENGTH + 1]
        out.append(spans(hit))
    return out


def spans(hit: np.ndarray) -> list[int]:
    """Merged byte spans that marked windows cover."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + LENGTH
    if not len(first):
        return []
    gap = first[1:] > last[:-1]
    return np.stack([first[np.append(True, gap)], last[np.append(gap, True)]], axis=1).reshape(-1).tolist()


# --- plans ---------------------------------------------------------------------------------------------


def text_hash() -> F.Column:
    return F.xxhash64("text")


def occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, at, n, kh)``: every context of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                b = whole.slice(lo, 1024)
                got = [contexts(t.as_py()) for t in b.column("text").cast(pa.binary())]
                rep = pa.array(np.repeat(np.arange(len(b)), [len(g[0]) for g in got]))
                at, n, kh = (np.concatenate([g[i] for g in got]) for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rep), b.column("th").take(rep), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(kh.view(np.int64))],
                    ["doc_id", "th", "at", "n", "kh"],
                )

    return docs.where(F.octet_length("text") >= LENGTH).mapInArrow(run, "doc_id long, th long, at int, n int, kh long")


def packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, z)``: texts compressed one by one, before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for b in batches:
            texts = [z.compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(texts, pa.binary())], ["doc_id", "th", "z"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, z binary")


def cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contexts of ``wanted(doc_id, th, at, n, kh, hot)`` as ``(kh, ch, doc_id, th, at, hot, ctx, again)``.

    In each task the first occurrence of a context carries its bytes and the second says so (again);
    further ones are only listed.
    """
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "n", "kh", "hot")).alias("list"))
    same = packed(docs).alias("d").join(lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.th") == F.col("l.th")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], bool] = {}
        digest, plain = xxhash.xxh64_intdigest, zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.slice(lo, 256)
                rows: list[tuple] = []
                for doc, th, z, items in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("z").to_pylist(), b.column("list"), strict=True):
                    text = plain(z)
                    flat = items.values
                    cols = (flat.field(k).to_pylist() for k in ("at", "n", "kh", "hot"))
                    for at, n, kh, hot in zip(*cols, strict=True):
                        ctx = text[at : at + n + LENGTH - 1]
                        ch = digest(ctx)
                        ch -= (ch >> 63) << 64
                        state = seen.get((kh, ch))
                        if state is None:
                            if len(seen) >= MOST_SEEN:
                                seen.clear()
                            seen[kh, ch] = False
                            rows.append((kh, ch, doc, th, at, hot, ctx, False))
                        else:
                            seen[kh, ch] = True
                            rows.append((kh, ch, doc, th, at, hot, None, not state))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_())
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kh", "ch", "doc_id", "th", "at", "hot", "ctx", "again"])

    schema = "kh long, ch long, doc_id long, th long, at int, hot boolean, ctx binary, again boolean"
    return same.select("d.doc_id", "d.th", "z", "list").mapInArrow(run, schema)


MARKS = "kh long, ch long, spans array<int>"


def indexed(shipped: DataFrame) -> DataFrame:
    """``(kh, ch, spans)`` of contexts with something to remove, by the run-length index of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = marked([v[0] for v in held.values()], np.array([v[1] > 1 for v in held.values()]))
            some = [(k, s) for k, s in zip(held, found, strict=True) if s]
            cols = [[k[0] for k, _ in some], [k[1] for k, _ in some], [s for _, s in some]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["kh", "ch", "spans"])

        for b in batches:
            for kh, ch, ctx in zip(b.column("kh").to_pylist(), b.column("ch").to_pylist(), b.column("ctx").to_pylist(), strict=True):
                if kh != last and size >= TEXT:
                    yield flush()
                    held, size = {}, 0
                last = kh
                entry = held.setdefault((kh, ch), [None, 0])
                entry[1] += 1
                if entry[0] is None and ctx is not None:
                    entry[0] = ctx
                    size += len(ctx)
        if held:
            yield flush()

    rows = shipped.where("not hot").select("kh", "ch", "ctx").repartition("kh")
    return rows.sortWithinPartitions("kh").mapInArrow(run, MARKS)


#: Distances from a window to the next cut that share one key; further windows are always looked up.
NEAR = np.array([8, 16, 32, 64, 128])
FAR = len(NEAR)


def pieces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and next cut (from the first window; -1: none in reach) of each piece of a context.

    A window starts a piece when a hash of its first 8 bytes says so. The text decides, so pieces inside
    a passage are equal wherever the passage stands.
    """
    n = len(text) - LENGTH + 1
    head = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        h = h * MULTIPLIERS[0] + head[k : k + len(h)] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= MULTIPLIERS[1]
    cut = np.flatnonzero((h >> np.uint64(60)) < 3)  # about three windows in sixteen
    first = np.unique(np.append(0, cut[cut < n]))
    end = np.append(first[1:], n)
    at = np.append(cut, len(text))[np.searchsorted(cut, end)]
    return first, end, np.where(at <= end + LENGTH - 9, at - first, -1)


def distances(ahead: int, n: int) -> np.ndarray:
    """Place in NEAR (or FAR) of the distance from each of a piece's n windows to the next cut."""
    return np.searchsorted(NEAR, ahead - np.arange(n)) if ahead >= 0 else np.full(n, FAR)


def counted(shipped: DataFrame) -> DataFrame:
    """The same for minimizers with too many occurrences for one bucket, by 128-bit hashes.

    Contexts are cut into content-defined pieces. A piece that occurs twice is removed as a whole, one
    row for all its windows; only the windows of pieces that occur once, those at the ends of passages,
    are looked up among those of all distinct pieces.

    Equal windows have the next cut at the same distance d, and what follows it is equal up to the
    window's end. So a piece first gives one key for each step of NEAR that its distances fall in: the
    LENGTH - step bytes from the cut, which all its windows up to that step hold. Windows are listed one
    by one only where another piece has the same key, or where no cut is near: nothing is lost.
    """
    whole = shipped.where("hot").groupBy("kh", "ch").agg(F.max("ctx").alias("ctx"), (F.count("*") > 1).alias("twice"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole_batch in batches:
            for lo in range(0, len(whole_batch), 256):
                b = whole_batch.slice(lo, 256)
                rows = []
                for kh, ch, ctx, twice in zip(*(b.column(c).to_pylist() for c in ("kh", "ch", "ctx", "twice")), strict=True):
                    for x, y, ahead in zip(*(v.tolist() for v in pieces(ctx)), strict=True):
                        text = ctx[x : y + LENGTH - 1]
                        rows.append((kh, ch, x, ahead, digest(text), text, twice))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kh", "ch", "a", "ahead", "s", "text", "twice"])

    parts = stored(whole.mapInArrow(cut_up, "kh long, ch long, a int, ahead int, s binary, text binary, twice boolean"))
    kinds = stored(parts.groupBy("s").agg(F.max("text").alias("text"), F.max("ahead").alias("ahead"), ((F.count("*") > 1) | F.max("twice")).alias("again")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows = []
            for s, again, ahead, text in zip(*(b.column(c).to_pylist() for c in ("s", "again", "ahead", "text")), strict=True):
                for step in np.unique(distances(ahead, len(text) - LENGTH + 1)).tolist():
                    key = None if step == FAR else bytes([step]) + digest(text[ahead : ahead + LENGTH - int(NEAR[step])])
                    rows.append((s, again, step, key))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], ["s", "again", "step", "k"])

    keys = stored(kinds.mapInArrow(keyed, "s binary, again boolean, step int, k binary"))
    met = keys.where("k is not null").groupBy("k").agg((F.count("*") > 1).alias("c"), F.bool_and("again").alias("whole")).where("c and not whole").select("k")
    near = split_join(keys.where("k is not null"), met, ["k"]).select("s", "step")
    steps = near.unionByName(keys.where("k is null").select("s", "step")).groupBy("s").agg(F.collect_set("step").alias("steps"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole_batch in batches:
            for lo in range(0, len(whole_batch), 128):
                b = whole_batch.slice(lo, 128)
                texts, places = b.column("text").to_pylist(), []
                for t, ahead, wanted in zip(texts, b.column("ahead").to_pylist(), b.column("steps").to_pylist(), strict=True):
                    places.append(np.flatnonzero(np.isin(distances(ahead, len(t) - LENGTH + 1), wanted)).astype(np.int32))
                rep = pa.array(np.repeat(np.arange(len(b)), [len(p) for p in places]))
                w = pa.array([digest(t[i : i + LENGTH]) for t, p in zip(texts, places, strict=True) for i in p.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("s").take(rep), b.column("again").take(rep), pa.array(np.concatenate(places)), w], ["s", "again", "place", "w"])

    looked_up = kinds.join(steps, "s").select("s", "again", "text", "ahead", "steps")
    singles = stored(looked_up.mapInArrow(windows, "s binary, again boolean, place int, w binary"))
    shared = singles.groupBy("w").agg((F.count("*") > 1).alias("c")).where("c").select("w")
    alone = singles.where("not again").join(shared, "w").groupBy("s").agg(F.array_sort(F.collect_set("place")).alias("places"))
    all_of = F.sequence(F.lit(0), F.length("text") - LENGTH)
    hit = kinds.where("again").select("s", all_of.alias("places")).unionByName(alone)
    found = parts.select("kh", "ch", "a", "s").join(hit, "s").groupBy("kh", "ch").agg(F.collect_list(F.struct("a", "places")).alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found in b.column("found").to_pylist():
                at = np.concatenate([np.array(f["places"], np.int64) + f["a"] for f in found])
                marks = np.zeros(int(at.max()) + 1, bool)
                marks[at] = True
                out.append(spans(marks))
            yield pa.RecordBatch.from_arrays([b.column("kh"), b.column("ch"), pa.array(out, pa.list_(pa.int32()))], ["kh", "ch", "spans"])

    return found.mapInArrow(merge, MARKS)


def removed(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every row; kept is what remains, as bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", text_hash())
    every = stored(occurrences(docs))
    often = every.groupBy("kh").agg(F.count("*").alias("c")).where("c > 1").select("kh", (F.col("c") > HOT).alias("hot"))
    listed = stored(cut(docs, split_join(every, often, ["kh"])))
    discard(every)
    release(docs.sparkSession)
    shipped = listed.where("ctx is not null or again")
    marks = stored(indexed(shipped).unionByName(counted(shipped)))
    release(docs.sparkSession)
    places = split_join(listed.select("kh", "ch", "doc_id", "th", "at"), marks, ["kh", "ch"])
    per_doc = places.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "spans")).alias("found"))
    both = packed(docs).alias("d").join(per_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.th") == F.col("p.th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for lo in range(0, len(whole), 512):
                b = whole.slice(lo, 512)
                rows = []
                for z, found in zip(b.column("z").to_pylist(), b.column("found"), strict=True):
                    text = plain(z)
                    cover = merged(found.values) if found.is_valid else []
                    kept, at = [], 0
                    for x, y in cover:
                        kept.append(text[at:x])
                        at = y
                    kept.append(text[at:])
                    rows.append((len(text), sum(y - x for x, y in cover), len(cover), b"".join(kept)))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.select("d.doc_id", "z", "found").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(found: pa.StructArray) -> list[tuple[int, int]]:
    """Maximal removed runs from the spans of a document's contexts."""
    at = found.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = found.field("spans")
    per = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(at, per)
    pair = flat.reshape(-1, 2)
    pair = pair[np.argsort(pair[:, 0], kind="stable")]
    high = np.maximum.accumulate(pair[:, 1])
    new = np.append(True, pair[1:, 0] > high[:-1])
    first = np.flatnonzero(new)
    return list(zip(pair[first, 0].tolist(), high[np.append(first[1:] - 1, len(pair) - 1)].tolist(), strict=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM b),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM m),
s AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS sid FROM g),
sp AS (SELECT r, sid, min(i) AS a, max(i) + 200 AS z FROM s GROUP BY r, sid),
p AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS prev FROM sp),
k AS (
  SELECT r, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept, sum(z - a) AS removed, count(*) AS spans, max(z) AS stop
  FROM p JOIN n USING (r) GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * stop + 1), h))) AS kept_sha256
FROM n LEFT JOIN k USING (r)
"""
