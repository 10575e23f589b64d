import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from korpusa.llm import substrings as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(d, gone) if not g)
        runs = int(((~gone[:-1]) & gone[1:]).sum() + gone[0]) if len(d) else 0
        out.append((len(d), int(gone[: len(d)].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made(rng):
    letters = "abcdefghij é\n"
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [fresh(n) for n in (199, 200, 201, 260, 900)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 700, "ab" * 400, fresh(200), "\0" * 250]
    for _ in range(60):
        t = fresh(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            t += rng.choice(shared) + fresh(rng.randrange(250))
        texts.append(t)
    base = fresh(1500)
    for _ in range(12):
        b = list(base)
        for _ in range(4):
            b[rng.randrange(len(b))] = "#"
        texts.append("".join(b))
    return texts + [texts[20], base, base]


@pytest.mark.parametrize("hot, text, seen", [(4096, 1 << 19, 200_000), (4096, 2000, 10), (3, 2000, 200_000), (1, 1 << 19, 200_000)])
def test_equals_brute_force(spark, monkeypatch, hot, text, seen):
    for k, v in (("HOT", hot), ("TEXT", text), ("MOST_SEEN", seen), ("CHUNK", 700)):
        monkeypatch.setattr(S, k, v)
    texts = made(random.Random(11))
    df = spark.createDataFrame([(i if i != 30 else None, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, kh string, at int")
    df = df.unionByName(df.where("doc_id = 40"))  # a repeated row
    want = brute([*texts, texts[40]], S.LENGTH)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in S.removed(df).collect()), key=str)
    assert got == sorted([((i if i != 30 else None), *w) for i, w in enumerate(want[:-1])] + [(40, *want[-1])], key=str)


def test_windows_each_belong_to_one_context():
    t = made(random.Random(2))[-1].encode() * 2
    first, n, _ = S.contexts(t)
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(t) - S.LENGTH + 1


def test_run_sampling_gives_the_statistics():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(320))
    texts = list({bytes(base[:i] + bytes([rng.choice(b"abc")]) + base[i + 1 :])[: rng.randrange(201, 320)] for i in range(0, 320, 9)})
    index = S.RunLengthIndex(texts)
    stats, at = index.statistics(), 0
    every = [(t, i) for t in texts for i in range(len(t) - S.LENGTH + 1)]
    count = Counter(t[i : i + S.LENGTH] for t, i in every)
    for t in texts:
        for i in range(len(t) - S.LENGTH + 1):
            assert (stats[at + i] >= S.LENGTH) == (count[t[i : i + S.LENGTH]] > 1)
        at += len(t)
    assert len(index.heads) < len(index.order)


def test_empty_table(spark):
    assert S.removed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
