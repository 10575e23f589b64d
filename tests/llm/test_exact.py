import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from korpusa.llm import exact


def plain(rows):
    """One row a document: (doc_id, keep_id, group_size, number kept of its copies, digest), by comparing normalised texts."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for text, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        stays = ids.index(keep)
        out += [(d, keep, len(ids), i == stays, hashlib.sha256(text.encode()).hexdigest()) for i, d in enumerate(ids)]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    words = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(2 * n)), "<u8").reshape(-1, 4)
    hashed = exact.PerfectHash.of(words[:n])
    assert sorted(hashed.slots(words[:n])) == list(range(n))
    other = hashed.slots(words[n:])
    assert ((other >= -1) & (other < max(n, 1))).all()
    if n:
        with pytest.raises(ValueError):
            exact.PerfectHash.of(np.concatenate([words[:n], words[:1]]))


ROWS = [(5, "a  b"), (3, "a\t\x0bb"), (9, "a b "), (9, "a b "), (4, None), (8, ""), (7, " "), (6, "\n\n"), (2, "é x"), (11, "é x"), (None, "a b"), (None, "only"), (None, "only"), (12, "w " * 60000), (1, "w\n" * 60000), (-4, "neg"), (13, "neg")]


@pytest.mark.parametrize("before", [None, -10, 0, 3, 100])
def test_against_plain(spark, before):
    df = spark.createDataFrame([(*r, "x", None) for r in ROWS], "doc_id long, text string, digest string, copies int")
    got = exact.dedup(df, before).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert key(map(tuple, got.collect())) == key(plain(ROWS))


def test_history_wins_and_grows(spark):
    first = exact.groups(exact.digests(spark.createDataFrame([(10, "x"), (11, "x"), (12, "y")], "doc_id long, text string")))
    index = exact.build(first, 3)
    later = exact.groups(exact.digests(spark.createDataFrame([(1, "x"), (2, "z"), (3, "z")], "doc_id long, text string")))
    found = exact.look_up(later, index, 3)
    assert {(r.keep_id, r.group_size, r.seen) for r in found.collect()} == {(10, 3, True), (12, 1, True), (2, 2, False)}
    again = exact.look_up(later, exact.build(found.drop("seen"), 3), 3)
    assert {(r.keep_id, r.group_size, r.seen) for r in again.collect()} == {(10, 4, True), (12, 1, True), (2, 4, True)}


def test_slots_hold_full_digests(spark):
    rows = exact.groups(exact.digests(spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")))
    for r in exact.build(rows, 4).collect():
        words = np.frombuffer(bytes(r.digests), "<u8").reshape(-1, 4)
        hashed = exact.PerfectHash(np.array(r.levels), np.array(r.bits, np.int64).view(np.uint64))
        assert list(hashed.slots(words)) == list(range(r.n)) and len(r.winners) == r.n
        assert [hashlib.sha256(f"t{w}".encode()).digest() for w in r.winners] == [bytes(r.digests)[i : i + 32] for i in range(0, 32 * r.n, 32)]


def test_heavy_groups_are_the_same(spark, monkeypatch):
    df = spark.range(400).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 150)) as text")
    want = key(map(tuple, exact.dedup(df).collect()))
    monkeypatch.setattr(exact, "HEAVY", 20)
    monkeypatch.setattr(exact, "HEAVY_SHARE", 40)
    assert key(map(tuple, exact.dedup(df).collect())) == want == key(plain([(r.doc_id, r.text) for r in df.collect()]))


def test_empty(spark):
    assert exact.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
