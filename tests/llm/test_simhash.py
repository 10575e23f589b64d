import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from korpusa.llm import common
from korpusa.llm import simhash as S


def slow_fingerprint(text, k=4):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((-1 if d is None else d, f"{f:016x}", low.get(root(i), -1)) for i, (d, f) in enumerate(fps))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, "\t \n"), (4, "Ab"), (5, "aB"), (6, "Ä x ä"), (7, "same text here again and more"), (7, "same text here again and more"), (None, "aB")]
    base = [rng.choice(words) for _ in range(400)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(400)] = rng.choice(words)
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    assert got(S.near_duplicates(df)) == brute(rows)


def test_hot_key_in_blocks_keeps_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 300:
        fps.add(base ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    monkeypatch.setattr(S, "BLOCK", 16)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = {(r.a, r.b) for r in S.near_links(df, 4).collect()}
    fps = sorted(fps)
    groups = {f: f for f in fps}

    def root(x, g):
        while g[x] != x:
            x = g[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                groups[root(a, groups)] = root(b, groups)
    mine = {f: f for f in fps}
    for a, b in links:
        a, b = int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))
        assert (a ^ b).bit_count() <= 8 or root(a, groups) == root(b, groups)
        mine[root(a, mine)] = root(b, mine)
    want, have = {}, {}
    for f in fps:
        want.setdefault(root(f, groups), set()).add(f)
        have.setdefault(root(f, mine), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("total", [1])
def test_thresholds_sum(total):
    counts = np.random.default_rng(0).integers(0, 50, (S.PARTS, 1 << S.WIDTH))
    tables = S.candidate_tables(counts, 3)
    values = np.random.default_rng(1).integers(0, 1 << S.WIDTH, (50, S.PARTS))
    costs = np.stack([tables[i][:, values[:, i]].T for i in range(S.PARTS)], axis=1)
    assert (S.allocate(costs, total).sum(axis=1) == total).all()


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(2)
    for parts, most, total in ((4, 2, 1), (5, 0, -2), (3, 1, 0)):
        costs = rng.integers(0, 99, (20, parts, most + 2)).astype(float)
        every = [t for t in itertools.product(range(-1, most + 1), repeat=parts) if sum(t) == total]
        least = np.min([sum(costs[:, i, t + 1] for i, t in enumerate(x)) for x in every], axis=0)
        got = S.allocate(costs, total)
        assert (got.sum(axis=1) == total).all()
        assert (sum(costs[np.arange(20), i, got[:, i] + 1] for i in range(parts)) == least).all()


def test_texts_skip_their_costliest_views(spark):
    rows = [(1, v, 10 + v, 1, 5, 100 if v in (3, 7) else 2) for v in range(S.VIEWS)]
    met = spark.createDataFrame(rows, "th long, v int, fp long, lead long, total long, c long")
    skipped = {r.v for r in S.probing(met).collect() if not r.probe}
    assert len(skipped) == S.AGREE - 1 and skipped <= {3, 7}


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", 7, "p"), (1, "a b c d e f", 7, "p"), (2, "a b c d e f", 8, "q"), (3, "other words stand here now", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th__ long, `group` string")
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 5)
    monkeypatch.setattr(common, "HEAVY_SHARE", 4)
    rows = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(40)], "k long, x long")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, name string")
    assert {r.k for r in common.heavy_keys(rows, ["k"]).collect()} == {0}
    want = sorted(map(tuple, rows.join(names, ["k"]).collect()))
    assert sorted(map(tuple, common.split_join(rows, names, ["k"]).collect())) == want
    counts = rows.groupBy("k").agg(F.count("*").alias("c__"))
    assert sorted(map(tuple, common.split_join(rows, names, ["k"], counts=counts).collect())) == want


def test_hot_keys_of_both_sides_are_dealt_over_shares(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 5)
    monkeypatch.setattr(common, "HEAVY_SHARE", 4)
    rows = spark.createDataFrame([(k % 3 if k % 2 else 0, k // 2) for k in range(40)], "k long, x long")
    many = spark.createDataFrame([(0, f"a{i}") for i in range(20)] + [(1, "b"), (1, "b"), (9, "c")], "k long, name string")
    want = sorted(map(tuple, rows.join(many, ["k"]).collect()))
    got = common.salted_join(rows, many, ["k"], ["x"])
    assert got.columns == ["k", "x", "name"] and sorted(map(tuple, got.collect())) == want


def test_components_with_a_hub_of_largest_id(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 5)
    edges = [(1000, i) for i in range(0, 60, 2)] + [(i, i + 1) for i in range(0, 60, 2)] + [(2000, 2001)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in (*range(60), 1000)}, 2000: 2000, 2001: 2000}


def test_very_long_and_empty_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id for r in S.one_of_each(df).collect()} == {1, 3}
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def star(copies, size=120, seed=3):
    """A base text and copies about 0.84 like it, but about 0.71 like one another."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    rows = [(0, " ".join(base))]
    for c in range(1, copies + 1):
        words, at = list(base), rng.randrange(5, size // 2 - 5)
        words[at], words[at + size // 2] = f"x{c}", f"y{c}"
        rows.append((c, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [8 << 20, 1 << 18])
def test_copies_of_one_base_are_all_linked(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    df = spark.createDataFrame(star(2000), "doc_id long, text string")
    left = [r.doc_id for r in S.one_of_each(df).collect()]
    assert 0 in left and len(left) <= 2  # recall of the 2,000 links 0.999 or more


def test_connecting_equals_all_pairs():
    rng = random.Random(4)
    for n in (0, 1, 60):
        sets = []
        for _ in range(n):
            x = set(rng.choice(sets).tolist()) if sets and rng.random() < 0.6 else {rng.randrange(1 << 60) for _ in range(rng.randrange(40))}
            x = {y for y in x if rng.random() < 0.95} | {rng.randrange(1 << 60) for _ in range(rng.randrange(3))}
            sets.append(np.array(sorted(x), np.uint64))
        for side in (np.zeros(n, int), np.arange(n) % 2):
            parent = list(range(n))

            def root(i, parent=parent):
                while parent[i] != i:
                    i = parent[i]
                return i

            found = S.connecting(sets, side, np.zeros(n, bool), np.ones(n, bool), 0.8)
            for a, b in found:
                assert root(a) != root(b)
                parent[root(a)] = root(b)
            assert not found or n > 1
            for i in range(n):
                for j in range(i):
                    u = len(np.union1d(sets[i], sets[j]))
                    like = u == 0 or len(np.intersect1d(sets[i], sets[j])) / u >= 0.8
                    if like and (side[i] != side[j] or not side.any()):
                        assert root(i) == root(j)


def test_pairs_near_the_threshold_are_decided_on_whole_sets(spark):
    rng, rows, want = random.Random(5), [], set()
    for g in range(300):
        base = [f"g{g}w{i}" for i in range(400)]
        words = list(base)
        for at in rng.sample(range(5, 395, 6), rng.choice([6, 7, 8, 9, 10, 11])):  # similarity 0.86 to 0.76
            words[at] = f"g{g}x{at}"
        a, b = ({tuple(w[i : i + 5]) for i in range(396)} for w in (base, words))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(words))]
        want |= {2 * g} if len(a & b) / len(a | b) >= 0.8 else {2 * g, 2 * g + 1}
    assert 320 < len(want) < 580
    left = {r.doc_id for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == want
