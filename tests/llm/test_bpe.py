import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from korpusa.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
BITS = ["a", "b", "e", "th", "  ", " ", "\n", "\t", "\x1c", "\xa0", "　", "é", "ß", "1", "²", "٣", "'s", "'ll", "!!", "…", "中", "😀", "é", "ing", "tion", "A", "\x85", "\r\n", "_", "​", "ⅷ", "aaaaaaa", "====", "     "]


@pytest.fixture(scope="module")
def pair():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.encoder(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(pair):
    mine, theirs = pair
    rng = random.Random(5)
    texts = ["", "a" * 5000, " " * 300 + "x", "ab" * 4000, *("".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(4000))]
    for t in texts:
        packed = mine.encode(t)
        assert list(memoryview(packed).cast("I")) == theirs.encode_ordinary(t), repr(t)
        assert mine.decode(packed) == t.encode()


def test_bounded_tables(pair, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 2)
    mine, theirs = pair
    t = "one two three, four-five sixes sevens unhappily retokenised words"
    assert list(memoryview(mine.encode(t)).cast("I")) == theirs.encode_ordinary(t)


def test_digests(spark, pair):
    rows = [(1, "Hello  world\n", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "é" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = pair[1].encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), PATH).collect() == []


def test_one_worker_encodes_and_decodes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = bpe.decode(bpe.encode(docs, PATH), PATH)
    coded = bpe.coded(docs, PATH)
    assert coded.schema == both.schema and sorted(map(tuple, coded.collect())) == sorted(map(tuple, both.collect()))
    # two Python steps in a task are two workers, each of which may come to hold the vocabulary
    for df in (bpe.digests(docs, PATH), corpus_pipeline.tokens(spark, docs, sf)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
