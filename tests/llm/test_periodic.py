import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from korpusa.llm import periodic


def plain_runs(w, least=24, periods=3):
    """Every maximal stretch of each period, the smallest period of a stretch only."""
    n, best = len(w), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, t, q) for (s, t), q in best.items())


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(s, t - s, q) for s, t, q in plain_runs(w)]
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lead = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *lead, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept)))


def sequences(rng):
    """Sequences with nested, touching, overlapping and copied repetitions."""
    for _ in range(1500):
        kinds = rng.choice([1, 2, 2, 3, 50])
        out = []
        for _ in range(rng.randrange(1, 7)):
            what, base = rng.random(), [rng.randrange(kinds) for _ in range(rng.randrange(1, 14))]
            if what < 0.4:
                out += (base * rng.randrange(1, 40))[: rng.randrange(1, 90)]
            elif what < 0.6 and out:
                at = rng.randrange(len(out))
                out += out[at : at + rng.randrange(1, 120)]
            elif what < 0.75:
                inner = base * rng.randrange(2, 12) + [99]
                out += inner * rng.randrange(1, 5)
            else:
                out += base
        yield out[:400]


def test_runs_against_plain():
    for s in sequences(random.Random(3)):
        assert periodic.runs_of(np.array(s, np.int64)) == plain_runs(s), s


def test_previous_factors_against_plain():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(0, 40))]
        sa, ranks = periodic.suffix_array(np.array(s, np.int64))
        assert sorted(range(len(s)), key=lambda i: s[i:]) == sa.tolist()
        longest, source = periodic.previous_factors(sa, ranks)
        for i in range(len(s)):
            want = max((next((k for k in range(len(s) - i) if s[j + k] != s[i + k]), len(s) - i) for j in range(i)), default=0)
            assert longest[i] == want and (s[source[i] : source[i] + want] == s[i : i + want] if want else source[i] == -1)
            assert want == 0 or 0 <= source[i] < i


@pytest.mark.parametrize("together", [1, 300, 1 << 16])
def test_batches_of_texts(monkeypatch, together):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    rng = random.Random(5)
    docs = [[f"{x}".encode() for x in s] for s, _ in zip(sequences(rng), range(120), strict=False)] + [[], [b"x"]]
    assert periodic.runs_of_texts(docs) == [plain_runs(d) for d in docs]


def test_query_rows(spark):
    rng = random.Random(6)
    ids = [i for i in range(-50, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:60] + list(range(9000, 9060))
    rows = [(i, " ".join(f"w{rng.randrange(rng.choice([3, 300]))}" for _ in range(rng.randrange(0, 200)))) for i in ids]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 30), (5, "x\x1cy " * 24), (5, "x\x1cy " * 24), (6, "a b c d e f g h " * 3), (7, "a b c d e f g h i " * 2), (8, "é " * 23), (9, "é " * 24)]
    rows += [(10, "a b\n" * 30 + "z " + "a b\n" * 30)]
    df = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, runs int, w string")
    got = periodic.digests(periodic.find_runs(periodic.planted(df))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert periodic.digests(periodic.find_runs(periodic.planted(df.limit(0)))).collect() == []


def test_null_id_and_long_texts(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    rows = [(None, "a " * 30), (0, " ".join(base + base + base[:5000])), (1, " ".join(["q"] * 300_000))]
    found = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in found}
    assert [tuple(x) for x in by[None].runs] == [(0, 30, 1)] and by[None].collapsed == "a"
    assert by[0].runs == [] and by[0].n_words == 85_000
    assert [tuple(x) for x in by[1].runs] == [(0, 300_000, 1)] and by[1].collapsed == "q"


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    few = [r for r in docs if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in periodic.query(spark, sf).collect()}
    assert len(got) == len(docs) and all(got[r.doc_id] == plain_row(r.doc_id, r.text) for r in few)
    assert sum(r[1] > 0 for r in got.values()) > 5
