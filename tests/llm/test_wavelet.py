import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from korpusa.llm import wavelet as W

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 3000])
def test_matrix_answers(n):
    ids = np.random.default_rng(n).integers(0, 300, n)
    m = W.WaveletMatrix.build(ids)
    assert (m.tokens() == ids).all()
    for i in range(0, n, 97):
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[0]), i) == (ids[:i] == ids[0]).sum()
    t = int(ids[-1])
    assert m.count(t) == (ids == t).sum() and m.locate(t) == np.flatnonzero(ids == t).tolist()
    assert m.count(5000) == 0 and m.locate(299 + 1) == []
    with pytest.raises(IndexError):
        m.select(t, m.count(t))


def test_wide_ids_and_shard_round_trip():
    ids = np.array([70000, 1, 99999, 0, 1])
    docs, lengths, m = W.open_shard(W.pack_shard([None, 4], [2, 3], ids))
    assert docs == [None, 4] and lengths.tolist() == [2, 3] and m.tokens().tolist() == ids.tolist()


def test_pieces_equal_the_library():
    t = W.tokenizer(PATH)
    rng = random.Random(2)
    bits = ["The", "it's", "  ", "\n", "\x1c", "É", "é", "12", "!!", "<|endoftext|>", "ſ", "İ", "Σ", "中文", "\xa0", " ", "\x85", "don't", "a" * 60, "​"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1500)]
    for x, packed in zip(texts, t.encode(texts)):
        assert np.frombuffer(packed, t.kind).tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_different_words_meet_the_library_once():
    t, asked = W.PieceTokenizer(PATH), []

    class Counted:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **how):
            asked.extend(w for x in texts for w in x.split())
            return self.of.encode_batch_fast(texts, **how)

    whole, t.tokenizer, t.small = t.tokenizer, Counted(t.tokenizer), Counted(t.small)
    texts = ["Word word, WORD! (word) J\u030c j\u030c. \u0130a, don't DON'T x1 x1. \u03a3\u03a3 <|ENDOFTEXT|> <|endoftext|>", "", "word, " * 50]
    want = [whole.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, t.kind).tolist() for x in t.encode(texts)] == want
    assert asked.count("word") == 1 and asked.count(",") == 1 and "Word" not in asked
    asked.clear()
    assert [np.frombuffer(x, t.kind).tolist() for x in t.encode(texts)] == want and not asked


def test_long_texts_come_in_portions(monkeypatch):
    monkeypatch.setattr(W, "TEXT_AT_ONCE", 10)
    b = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 30, "", "abcd", "abcdefgh"])], ["text"])
    got = [x.column("text").to_pylist() for x in W.portions(b)]
    assert [y for x in got for y in x] == b.column("text").to_pylist() and len(got) == 2
    assert sum(map(len, W.portions(b.slice(0, 0)))) == 0
    t = W.PieceTokenizer(PATH)
    column = pa.array(["skipped", "A b.", "", " c\x1cd "]).slice(1)
    assert t.encode(column) == [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, t.kind).tobytes() for x in column.to_pylist()]
    assert t.encode([]) == []


def test_files_and_offsets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SHARD_TOKENS", 20)
    rows = [(i, " ".join(["word"] * (i % 7)) if i % 5 else None) for i in range(60)] + [(3, "again"), (3, "again"), (None, "x y"), (200, "long " * 100)]
    df = spark.createDataFrame([(t, d, 0) for d, t in rows], "text string, doc_id long, payload int")
    got = W.read_documents(spark, W.write_shards(df, PATH, str(tmp_path))).collect()
    t = W.tokenizer(PATH).tokenizer
    full = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(d), full(x)) for d, x in rows)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in got[1:]] == sorted(d for d, _ in rows if d is not None) and got[0].doc_id is None
    assert W.read_documents(spark, W.write_shards(df.limit(0), PATH, str(tmp_path))).collect() == []


def test_query_checksums(spark, sf):
    r = W.query(spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    ids = [*W.tokenizer(PATH).tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.start == 0


def test_lookups_unpack_few_pieces():
    ids = np.random.default_rng(5).integers(0, 50_000, 700_000)
    ids[::1000] = 49_999
    data = W.pack_shard([1], [len(ids)], ids)
    m = W.open_shard(data)[2]
    each = sum(len(p.at) - 1 for p in m.planes)
    unpacked = lambda: sum(len(p.pieces) for p in m.planes)
    assert unpacked() == 0 and each >= 96
    assert m.access(123_456) == ids[123_456] and unpacked() <= len(m.planes)
    assert m.count(49_999) == (ids == 49_999).sum() and unpacked() <= 3 * len(m.planes)
    assert m.select(49_999, 5) == np.flatnonzero(ids == 49_999)[5] and unpacked() <= 4 * len(m.planes)
    assert (W.open_shard(data)[2].tokens() == ids).all()


def test_occurrences_come_from_the_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    where = W.write_shards(docs, PATH, str(tmp_path))
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in W.read_documents(spark, where).collect()}
    word = int(next(x for x in ids.values() if len(x) > 3)[2])
    want = sorted((t, d, int(i)) for t in (word, 1, 48_000) for d, x in ids.items() for i in np.flatnonzero(x == t))
    assert sorted(map(tuple, W.find_tokens(spark, where, [word, 1, 48_000]).collect())) == want
