import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from korpusa.llm import importance


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(w, depth=2, buckets=10000):
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, depth + 1) if i + k <= len(w)]


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(plain_buckets(words(x)))
    for x in target:
        t.update(plain_buckets(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, x in docs:
        f = plain_buckets(words(x))
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    some = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(some[: len(some) * 25 // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("depth,buckets", [(1, 7), (2, 10000), (3, 100000), (5, 50)])
def test_buckets_against_plain(depth, buckets):
    rng = random.Random(depth)
    docs = [[rng.choice(["a", "b", "é", "w7", f"x{rng.randrange(99)}"]) for _ in range(rng.randrange(0, 60))] for _ in range(60)]
    docs += [[], ["solo"], ["a"] * 500]
    flat, counts = importance.buckets_of([[w.encode() for w in d] for d in docs], depth, buckets)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    for d, part in zip(docs, parts, strict=True):
        assert part.tolist() == plain_buckets(d, depth, buckets)
    assert importance.buckets_of([], depth, buckets)[1].tolist() == []


def test_key_beyond_64_bits():
    docs = [[f"w{i * 7 % 9000}".encode() for i in range(9000)] for _ in range(2)]
    flat, _ = importance.buckets_of(docs, 6, 1000)
    assert flat.tolist() == [b for d in docs for b in plain_buckets([w.decode() for w in d], 6, 1000)]


@pytest.mark.parametrize("together", [3, 200, 1 << 17])
def test_resample_against_plain(spark, monkeypatch, together):
    monkeypatch.setattr(importance, "TOGETHER", together)
    rng = random.Random(9)
    docs = [(i - 20, " ".join(rng.choice(["The", "of", "ÄÖ", "a1-b2", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "?!"), (903, "word " * 100_000), (None, "some words of text " * 9)]
    target = ["the w1 w2 w3 of of", None, "", "ÄÖ a1 b2 The of"]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, score int, rank string")
    got = importance.resample(df, spark.createDataFrame([(None, t) for t in target], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(docs, target), key=str)


def test_repeated_rows_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    df = spark.createDataFrame([(i // 2, "a b c d e " * 5) for i in range(40)], "doc_id long, text string")
    got = importance.resample(df, none).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11)) and len(got) == 40
    assert len({r.score for r in got}) <= 20
