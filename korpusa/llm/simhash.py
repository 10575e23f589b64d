"""SimHash near-duplicate detection with a generalised pigeonhole join.

Fingerprints: 64-bit SimHash over word shingles (XXH64, seed 42; a bit is set when more than half
of the shingle hashes set it). Two fingerprints link at ``max_distance`` or fewer differing bits.

Search, over distinct fingerprints only:

1. bit co-occurrence over all fingerprints groups correlated bits into ``PARTS`` partitions, so that
   skew is concentrated and the other partitions stay selective;
2. a histogram of every partition's values (at most 2^16 cells each) estimates how many candidates a
   fingerprint meets when partition i is searched within distance t;
3. every fingerprint picks its own thresholds t_1..t_m with sum t_i = max_distance - m + 1 (t_i = -1
   skips a partition) that minimise the estimate, by dynamic programming. The general pigeonhole
   principle makes any such choice complete: a pair within max_distance meets in some partition i
   within t_i bits;
4. each fingerprint is stored once a partition and probes with its variants; equal keys meet in a
   shuffle, and pairs are verified by XOR and bit count. A key with many fingerprints is cut into
   blocks, its probes visit every block. Dense blocks yield spanning links, never all pairs;
5. connected components by alternating stars, then one join back to the documents.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like
any other; very long texts are hashed whole, in pieces of bounded memory; ties of a bit (as many hashes with it
as without) leave it 0; repeated rows each keep their own output row; null doc_id rows are kept and never become a
component's id while another id exists; an empty table gives an empty result; columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, durable, free_name, packed_rows, sliced, split_join, stored, table

BITS, PARTS, WIDTH = 64, 4, 16
#: Most fingerprints of one key that one task holds; a larger key is cut into blocks of about this size.
BLOCK = 4096
#: Cost of shuffling one probe, in verified candidates.
PROBE_COST = 40.0


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every word shingle of a lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of the hashes; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py() or b"", shingle)) for t in texts), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# --- the generalised pigeonhole join ---------------------------------------------------------------


def bit_groups(pairs: dict[tuple[int, int], int], n: int) -> list[list[int]]:
    """PARTS groups of WIDTH bits; a group grows by the bit most correlated with what it has."""
    joint = np.zeros((BITS, BITS))
    for (i, j), c in pairs.items():
        joint[i, j] = joint[j, i] = c / max(n, 1)
    p = np.diag(joint)
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(np.divide(joint - np.outer(p, p), scale, out=np.zeros_like(joint), where=scale > 0))
    free, groups = set(range(BITS)), []
    for _ in range(PARTS):
        first = max(sorted(free), key=lambda i: (abs(p[i] - 0.5), corr[i, sorted(free)].sum()))
        group = [first]
        free.discard(first)
        while len(group) < WIDTH:
            best = max(sorted(free), key=lambda i: corr[i, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def flips(t: int) -> np.ndarray:
    """All WIDTH-bit masks with exactly t bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), t)], np.int64)


def candidate_tables(counts: np.ndarray, most: int) -> np.ndarray:
    """tables[i, t + 1, v]: stored fingerprints within distance t of value v in partition i, plus probe cost."""
    every, cells = np.arange(1 << WIDTH), counts.shape[1]
    tables = np.zeros((PARTS, most + 2, cells))
    for i in range(PARTS):
        found, probes = np.zeros(cells), 0
        for t in range(most + 1):
            masks = flips(t)
            for m in masks:
                found += counts[i][every ^ m]
            probes += len(masks)
            tables[i, t + 1] = found + PROBE_COST * probes
    return tables


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds, one row a fingerprint, that sum to ``total`` at the least estimated cost.

    costs[n, i, t + 1] is the cost of searching partition i within t (t = -1 skips it). Dynamic
    programming over partitions; the state is the sum so far, all fingerprints at once.
    """
    n, parts, levels = costs.shape
    most = levels - 2
    best = {0: np.zeros(n)}
    back: list[dict[int, np.ndarray]] = []
    for i in range(parts):
        nxt: dict[int, np.ndarray] = {}
        step: dict[int, np.ndarray] = {}
        for s, cost in best.items():
            for t in range(-1, most + 1):
                to, c = s + t, cost + costs[:, i, t + 1]
                left = total - to
                if left > (parts - 1 - i) * most or left < -(parts - 1 - i):
                    continue
                if to not in nxt:
                    nxt[to], step[to] = c, np.full(n, t, np.int8)
                else:
                    better = c < nxt[to]
                    nxt[to] = np.where(better, c, nxt[to])
                    step[to] = np.where(better, np.int8(t), step[to])
        best, back = nxt, [*back, step]
    out, state = np.zeros((n, parts), np.int8), np.full(n, total)
    for i in reversed(range(parts)):
        for s in np.unique(state):
            at = state == s
            out[at, i] = back[i][int(s)][at]
        state = state - out[:, i]
    return out


def spanning_links(stored: np.ndarray, probes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs within ``most`` bits connect; few when the block is dense."""
    hit = np.bitwise_count(stored[None, :] ^ probes[:, None]) <= most
    total = int(np.count_nonzero(hit))
    if total <= 4 * (len(stored) + len(probes)):
        p, s = np.nonzero(hit)
        keep = probes[p] != stored[s]
        return probes[p][keep], stored[s][keep]
    none = len(stored)
    label = np.arange(none)
    while True:  # smallest label reachable, spread over the dense block
        low = np.where(hit, label[None, :], none).min(axis=1)
        new = np.minimum(label, np.where(hit, low[:, None], none).min(axis=0))
        if (new == label).all():
            break
        label = new
    seen = low < none
    a = np.concatenate([probes[seen], stored])
    b = np.concatenate([stored[low[seen]], stored[label]])
    keep = a != b
    return a[keep], b[keep]


def near_links(distinct: DataFrame, max_distance: int = 4) -> DataFrame:
    """``(a, b)`` links whose components are those of all pairs of ``distinct.fp`` within the distance."""
    spark = distinct.sparkSession
    total, most = max_distance - PARTS + 1, min(3, max(0, max_distance))
    if total > PARTS * most:
        raise ValueError("max_distance is too large for this partitioning")

    def unsigned(b: pa.RecordBatch) -> np.ndarray:
        return b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(unsigned(b).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            joint += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(BITS)
        if n:
            i, j, c = np.append(i, -1), np.append(j, -1), np.append(joint[i, j], n)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(c.astype(np.int64))], ["i", "j", "c"])

    # 2,081 sums, whatever the size of the table
    sums = distinct.select("fp").mapInArrow(cooccurrence, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    pairs = {(r.i, r.j): r.c for r in sums}
    n = pairs.pop((-1, -1), 0)
    groups = bit_groups(pairs, n)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            for i, bits in enumerate(groups):
                counts[i] += np.bincount(project(unsigned(b), bits), minlength=1 << WIDTH)
        i, v = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(v, pa.int32()), pa.array(counts[i, v])], ["i", "v", "c"])

    # at most PARTS x 2^16 sums, whatever the size of the table
    cells = distinct.select("fp").mapInArrow(histogram, "i int, v int, c long").groupBy("i", "v").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros((PARTS, 1 << WIDTH), np.int64)
    counts[cells.i.to_numpy(), cells.v.to_numpy()] = cells.c.to_numpy()
    shared = spark.sparkContext.broadcast((counts.astype(np.int32), candidate_tables(counts, most).astype(np.float32)))
    variants = [np.concatenate([flips(k) for k in range(t + 1)]) for t in range(most + 1)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, tables = shared.value
        blocks = np.maximum(1, -(-stored // BLOCK))
        for whole in batches:
            for at in range(0, len(whole), 4096):
                fps = unsigned(whole.slice(at, 4096))
                values = np.stack([project(fps, bits) for bits in groups], axis=1)
                limits = allocate(np.stack([tables[i][:, values[:, i]].T for i in range(PARTS)], axis=1), total)
                key, blk, kind, fp = [], [], [], []
                for i in range(PARTS):
                    v = values[:, i]
                    k = blocks[i][v]
                    key.append((i << WIDTH) | v)
                    blk.append((fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k)
                    kind.append(np.zeros(len(v), np.int8))
                    fp.append(fps)
                    for t in range(most + 1):
                        rows = np.flatnonzero(limits[:, i] == t)
                        if not len(rows):
                            continue
                        probe = v[rows][:, None] ^ variants[t][None, :]
                        r, c = np.nonzero(stored[i][probe])  # values that nothing has need no probe
                        probe, who = probe[r, c], rows[r]
                        alone = (probe == v[who]) & (stored[i][probe] == 1)  # it would meet itself only
                        probe, who = probe[~alone], who[~alone]
                        times = blocks[i][probe]
                        first = np.repeat(np.cumsum(times) - times, times)
                        key.append((i << WIDTH) | np.repeat(probe, times))
                        blk.append(np.arange(len(first)) - first)
                        kind.append(np.ones(len(first), np.int8))
                        fp.append(fps[np.repeat(who, times)])
                cols = [np.concatenate(x) for x in (key, blk, kind, fp)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int8()), pa.array(cols[3].view(np.int64))],
                    ["key", "blk", "kind", "fp"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by (key, blk, kind): what is stored first, then its probes."""
        at, held, stored = None, [], None
        out_a, out_b, size = [], [], 0
        for b in batches:
            key = b.column("key").to_numpy().astype(np.int64) << 32 | b.column("blk").to_numpy()
            kind, fps = b.column("kind").to_numpy(), unsigned(b)
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, len(key)).tolist(), strict=True):
                if lo == hi:
                    continue
                if key[lo] != at:
                    at, held, stored = key[lo], [], None
                if kind[lo] == 0:
                    held.append(fps[lo:hi])
                    stored = None
                    continue
                if stored is None:
                    stored = np.concatenate(held) if held else fps[:0]
                if not len(stored):
                    continue
                step = max(1, (1 << 21) // len(stored))
                for p in range(lo, hi, step):
                    x, y = spanning_links(stored, fps[p : min(hi, p + step)], max_distance)
                    if len(x):
                        out_a.append(x)
                        out_b.append(y)
                        size += len(x)
            if size > 50_000:
                yield links(out_a, out_b)
                out_a, out_b, size = [], [], 0
        if size:
            yield links(out_a, out_b)

    def links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    met = distinct.select("fp").mapInArrow(keys, "key int, blk int, kind tinyint, fp long").repartition("key", "blk")
    return met.sortWithinPartitions("key", "blk", "kind").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    fps = durable(fingerprints(docs, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(near_links(distinct, max_distance))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = split_join(named, lowest, ["root"]).select("fp", "component_id")
    return split_join(fps, labels, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- similar texts ----------------------------------------------------------------------------------

#: Views of a text, shingles a view samples, and views in which a pair must agree to be found for certain.
VIEWS, SAMPLED, AGREE = 12, 3, 2
#: Most bytes of shingle sets in a block; a larger bucket is cut into blocks and every pair of blocks is visited.
BLOCK_BYTES = 4 << 20
MIX = [np.uint64(x | 1) for x in np.random.default_rng(7).integers(1, 2**63, VIEWS).tolist()]


def views_of(hashes: np.ndarray) -> np.ndarray:
    """One SimHash a view, over the SAMPLED least shingles in that view's order."""
    out = np.zeros(VIEWS, np.uint64)
    for v in range(VIEWS):
        order = hashes * MIX[v]
        order ^= order >> np.uint64(31)
        order *= MIX[v - 1]
        least = order if len(order) <= SAMPLED else np.partition(order, SAMPLED - 1)[:SAMPLED]
        out[v] = fingerprint(np.sort(least))
    return out


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted shingle sets are that similar (Jaccard); two empty ones are."""
    small, large = sorted((len(x), len(y)))
    if small < similarity * large - 1e-6:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True)) if small else 0
    union = small + large - common
    return common / union >= similarity if union else True


def connecting(sets: list[np.ndarray], side: np.ndarray, sure: np.ndarray, probe: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all pairs of sets at least ``similarity`` alike; the sure ones are connected already.

    A pair counts only if one of the two probes for it.
    Sets are 64-bit hashes, compared whole. With two sides only pairs across them are compared. Those that
    hold what is most common come first, so that the base of many copies connects them at once.
    """
    size = np.array([len(x) for x in sets], np.int64)
    _, token, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(-np.bincount(owner, times[token], len(sets)) / np.maximum(size, 1), kind="stable")
    starts = np.cumsum(size) - size
    parts = [token[starts[i] : starts[i] + size[i]] for i in order.tolist()]
    parts = [x[times[x] > 1] for x in parts]  # what one set alone holds is common to no pair
    size, side, sure, probe = size[order], side[order], sure[order], probe[order]
    flat, ends = np.concatenate([*parts, np.zeros(0, np.int64)]), np.cumsum([len(x) for x in parts])
    label = np.where(sure, len(sets), np.arange(len(sets)))
    mark, across, out = np.zeros(len(times), bool), len(np.unique(side)) > 1, []
    for x in range(len(sets) - 1):
        after = slice(x + 1, None)
        small, large = np.minimum(size[x], size[after]), np.maximum(size[x], size[after])
        new = (label[after] != label[x]) & (probe[after] | probe[x]) & (small >= similarity * large - 1e-6)
        if across:
            new &= side[after] != side[x]
        if not new.any():
            continue
        mark[parts[x]] = True
        if 4 * np.count_nonzero(new) < len(new):
            common = np.zeros(len(new), np.int64)
            for y in np.flatnonzero(new).tolist():
                common[y] = np.count_nonzero(mark[parts[x + 1 + y]])
        else:
            sums = np.append(0, np.cumsum(mark[flat[ends[x] :]]))
            common = np.diff(sums[ends[x:] - ends[x]])
        mark[parts[x]] = False
        union = size[x] + size[after] - common
        hit = x + 1 + np.flatnonzero(new & (np.where(union > 0, common / np.maximum(union, 1), 1.0) >= similarity))
        if len(hit):
            labels, first = np.unique(label[hit], return_index=True)
            out += [(int(order[x]), int(order[y])) for y in hit[first].tolist()]
            label[np.isin(label, labels)] = label[x]
    return out


def sketched(keyed: DataFrame, shingle: int) -> DataFrame:
    """``(th, views, n)`` of every distinct text of ``keyed(th, text)``; n is the size of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of one task need one sketch; forgetting some costs time only
        for b in sliced(batches, 1024):
            rows = []
            for th, text in zip(b.column("th").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                if th in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(th)
                h = np.unique(shingle_hashes(text.as_py(), shingle))
                rows.append((th, views_of(h).view(np.int64).tolist(), len(h)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["th", "views", "n"])

    sketches = keyed.select("th", "text").mapInArrow(run, "th long, views array<long>, n long")
    return sketches.groupBy("th").agg(F.first("views").alias("views"), F.first("n").alias("n"))


MEMBER = "th long, v int, fp long, lead long, total long, probe boolean"


def probing(met: DataFrame) -> DataFrame:
    """MEMBER rows: each text's buckets, and whether it probes there.

    By the generalised pigeonhole principle a pair that agrees in AGREE views or more meets in any
    VIEWS - AGREE + 1 of them, so a text leaves out AGREE - 1: thresholds of 0 (probe) or -1 (skip)
    that sum to 1 - AGREE, at the least number of candidates, by the same dynamic programming.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            flat, per = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(b)), per)
            v, c = flat.field("v").to_numpy(zero_copy_only=False), flat.field("c").to_numpy(zero_copy_only=False)
            costs = np.zeros((len(b), VIEWS, 2))
            costs[row, v, 1] = c
            chosen = allocate(costs, 1 - AGREE)[row, v] == 0
            cols = [b.column("th").take(pa.array(row)), *(flat.field(x) for x in ("v", "fp", "lead", "total")), pa.array(chosen)]
            yield pa.RecordBatch.from_arrays(cols, ["th", "v", "fp", "lead", "total", "probe"])

    lists = met.groupBy("th").agg(F.collect_list(F.struct("v", "fp", "lead", "total", "c")).alias("buckets"))  # at most VIEWS
    return lists.mapInArrow(run, MEMBER)


def text_groups(keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(th, group)`` of every distinct text of ``keyed(th, text)`` that is linked to another.

    A similarity of 0.8 leaves two 64-bit fingerprints about 10 bits apart, where a pigeonhole search
    would probe a large part of the table. So the fingerprint is made longer instead, from VIEWS
    SimHashes of SAMPLED shingles each: bits of one view change together, so each view is one partition
    of correlated bits; a text searches all but the AGREE - 1 costliest (see probing). A pair at 0.8
    agrees in each view with probability 0.51, so in AGREE or more with 0.997.

    Everything is decided on whole shingle sets. Texts are first compared with one member of each of
    their buckets; a bucket that this does not connect is compared whole: every pair that is not
    connected yet and that one of the two probes for, in blocks of about BLOCK_BYTES and all pairs of blocks.
    """
    sketches = stored(sketched(keyed, shingle))
    seen = sketches.select("th", "n", F.posexplode("views").alias("v", "fp"))
    buckets = seen.groupBy("v", "fp").agg(F.min("th").alias("lead"), F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1")
    members = stored(probing(split_join(seen.drop("n"), buckets, ["v", "fp"])))
    live = members.groupBy("v", "fp").agg(F.max("probe").alias("any")).where("any").select("v", "fp")
    members = stored(split_join(members, live, ["v", "fp"]))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            made = [np.unique(shingle_hashes(t.as_py(), shingle)).astype("<u8").tobytes() for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(made, pa.binary())], ["th", "hashes"])

    first = keyed.select("th", F.col("row__")).groupBy("th").agg(F.min("row__").alias("row__"))  # one row of each text
    wanted = members.select("th").distinct().join(first, "th").select("row__")
    texts = keyed.join(wanted, "row__", "left_semi").select("th", "text")
    if not keyed.groupBy("row__").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["th"])  # rows that repeat both id and text
    sets = stored(texts.mapInArrow(whole_sets, "th long, hashes binary"))

    led = stored(leader_links(members, sketches.select("th", "n"), sets, similarity))
    marked = members.join(led.withColumn("led", F.lit(True)), ["th", "lead"], "left")
    marked = marked.withColumn("sure", F.coalesce("led", F.col("th") == F.col("lead"))).drop("led")
    loose = marked.groupBy("v", "fp").agg(F.count_if(~F.col("sure")).alias("left")).where("left > 0").select("v", "fp")
    loose = split_join(marked, loose, ["v", "fp"]).select("th", "v", "fp", "sure", "probe", F.ceil(F.col("total") * 8 / BLOCK_BYTES).alias("blocks"))
    side, last = F.pmod(F.xxhash64("th", "v"), F.col("blocks")), F.col("blocks") - 1
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)))).alias("other")
    placed = loose.withColumn("side", F.coalesce(side, F.lit(0).cast("long"))).select("*", meets)
    placed = placed.select("th", "v", "fp", "sure", "probe", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    blocks = placed.join(sets, "th").repartition("v", "fp", "i", "j").sortWithinPartitions("v", "fp", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by bucket and pair of blocks."""
        at, held = None, []
        for b in sliced(batches, 1024):
            cols = [b.column(c).to_pylist() for c in ("v", "fp", "i", "j")]
            rest = [b.column(c).to_pylist() for c in ("th", "side", "sure", "probe")]
            for key, hashes, *row in zip(zip(*cols, strict=True), packed_rows(b.column("hashes"), "<u8"), *rest, strict=True):
                if key != at:
                    yield from links(held)
                    at, held = key, []
                held.append((hashes.copy(), *row))
        yield from links(held)

    def links(held: list[list]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            hashes, th, side, sure, probe = zip(*held, strict=True)
            found = connecting(list(hashes), np.array(side), np.array(sure), np.array(probe), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([th[x] for x, _ in found], pa.int64()), pa.array([th[y] for _, y in found], pa.int64())], ["a", "b"])

    linked = blocks.mapInArrow(compare, "a long, b long").unionByName(led.select(F.col("th").alias("a"), F.col("lead").alias("b")))
    return connected_components(linked).select(F.col("node").alias("th"), F.col("root").alias("group"))


def leader_links(members: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(th, lead)`` of the texts that are similar to a leader of theirs, on whole sets.

    A leader of many is sent to as many tasks as its followers fill blocks.
    """
    pairs = members.where("th <> lead").select("th", "lead").distinct()
    parts = pairs.join(sizes, "th").groupBy("lead").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("long").alias("parts"))
    parts = stored(parts)
    follow = split_join(pairs, parts, ["lead"]).select("lead", F.pmod(F.xxhash64("th"), F.col("parts")).alias("part"), "th", F.lit(1).alias("rank"))
    ahead = parts.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("lead").alias("th"), F.lit(0).alias("rank"))
    met = follow.unionByName(ahead).join(sets, "th").repartition("lead", "part").sortWithinPartitions("lead", "part", "rank")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for b in sliced(batches, 1024):
            keep = []
            for rank, own in zip(b.column("rank").to_pylist(), packed_rows(b.column("hashes"), "<u8"), strict=True):
                if rank == 0:
                    lead = own.copy()
                keep.append(rank == 1 and alike(own, lead, similarity))
            yield b.select(["th", "lead"]).filter(pa.array(keep, pa.bool_()))

    return met.select("lead", "rank", "th", "hashes").mapInArrow(verify, "th long, lead long")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``(row__, doc_id, text, th)``; th is 64 bits of the text, so equal texts are merged by it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("th", F.xxhash64("text")).withColumn("row__", F.xxhash64("th", "doc_id"))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, th, group)`` of every row; a group's rows are connected by texts at least that similar (see text_groups)."""
    keyed = keyed_texts(docs)
    roots = stored(text_groups(keyed, shingle, similarity))
    rows = keyed.select("doc_id", "th")
    alone = rows.join(roots, "th", "left_anti").withColumn("group", F.col("th"))
    return split_join(rows, roots, ["th"]).select("doc_id", "th", "group").unionByName(alone)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the smallest doc_id.

    Of rows that repeat both id and text one is kept, whichever it is where their other columns differ.
    """
    keyed = keyed_texts(docs)
    roots = text_groups(keyed, shingle, similarity)
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    lowest = keyed.groupBy("th").agg(F.min(named).alias("m")).join(roots, "th", "left")
    best = lowest.groupBy(F.coalesce("group", "th")).agg(F.min("m").alias("m")).select("m.doc_id", "m.th")
    th = free_name(docs, "th__")
    told = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    best = best.select(F.col("doc_id").alias("best__"), F.col("th").alias("least__"))
    same = (F.col(f"d.{th}") == F.col("b.least__")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.best__"))
    kept = told.alias("d").join(best.alias("b"), same, "left_semi")
    return kept.dropDuplicates(["doc_id", th]).drop(th)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
