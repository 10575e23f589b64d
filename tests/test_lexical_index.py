import json
import math
import random
import shutil
from collections import Counter
from pathlib import Path

import pytest

from korpusa.operators import lexical_index as li
from korpusa.operators.lexical_index import DamagedIndex, LexicalIndex


def plain(docs, questions, k):
    toks = {d: t.split() for d, t in docs.items()}
    n = len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean_idf = sum(raw.values()) / max(1, len(raw))
    idf = {w: 0.25 * mean_idf if x < 0 else x for w, x in raw.items()}
    mean = sum(map(len, toks.values())) / n or 1.0
    rows = set()
    for q, text in questions.items():
        scored = []
        for d, t in toks.items():
            tf = Counter(t)
            s = round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split() if w in tf), 6)
            if s > 0:
                scored.append((-s, d))
        rows |= {(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return rows


def made(rng, n):
    return {i: " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randrange(0, 30))) for i in range(n)}


def frame(spark, docs, kind="id long, text string"):
    return spark.createDataFrame(list(docs.items()), kind)


def found(index, spark, questions, k=4):
    return {tuple(r) for r in index.search(frame(spark, questions, "query_id long, text string"), k).select("query_id", "id", "score", "rank").collect()}


def test_batches_replaced_deleted_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(li, "BLOCK_BITS", 2)
    monkeypatch.setattr(li, "SEEDS", 1)
    rng = random.Random(1)
    docs, questions = made(rng, 90), {i: " ".join(f"w{rng.randrange(70)}" for _ in range(5)) for i in range(8)}
    questions[8] = "w1 w1 w2"
    index = LexicalIndex.create(spark, str(tmp_path / "a")).add(frame(spark, {i: t for i, t in docs.items() if i < 60}))
    assert found(index, spark, questions) == plain({i: t for i, t in docs.items() if i < 60}, questions, 4)
    later = {i: docs.get(i, "") + " w5 w6" for i in range(50, 90)}
    index = index.add(frame(spark, later))
    now = {**{i: t for i, t in docs.items() if i < 60}, **later}
    assert found(index, spark, questions) == plain(now, questions, 4)
    index = index.delete(frame(spark, {i: "" for i in (0, 3, 55, 89, 1000)}).select("id"))
    now = {i: t for i, t in now.items() if i not in (0, 3, 55, 89)}
    again = LexicalIndex.load(spark, str(tmp_path / "a"))
    assert again.manifest == index.manifest and again.manifest.version == 3
    assert found(again, spark, questions) == plain(now, questions, 4)
    merged = again.merged(str(tmp_path / "b"))
    assert len(merged.manifest.segments) == 1 and merged.manifest.documents == len(now)
    assert found(merged, spark, questions) == plain(now, questions, 4)
    read = merged.blocks_read(frame(spark, {1: now[7], 2: now[20], 3: now[41]}, "query_id long, text string"), 1).collect()
    assert all(0 < r.read <= r.blocks for r in read) and sum(r.read for r in read) < sum(r.blocks for r in read)


def test_nothing_asked_or_held(spark, tmp_path):
    index = LexicalIndex.create(spark, str(tmp_path / "a"))
    assert found(index, spark, {1: "x"}) == set() and index.delete(frame(spark, {1: "x"}).select("id")) is index
    index = index.add(spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "a")], "id long, text string"))
    assert index.manifest.documents == 3
    assert found(index, spark, {1: "zzz", 2: ""}) == set()
    index = index.delete(frame(spark, {1: "", 2: "", 3: ""}).select("id"))
    assert index.manifest.documents == 0 and found(index, spark, {1: "a"}) == set()
    assert LexicalIndex.load(spark, str(tmp_path / "a")).add(frame(spark, {7: "a c", 8: "b", 9: "d"})).manifest.documents == 3


@pytest.fixture
def whole(spark, tmp_path):
    LexicalIndex.create(spark, str(tmp_path / "w")).add(frame(spark, {1: "a b", 2: "b c c", 3: "d"}))
    return tmp_path / "w"


def spoil_digest(path):
    f = next((path / "manifest").rglob("part-*"))
    line = json.loads(f.read_text())
    f.write_text(json.dumps({**line, "body": line["body"].replace('"documents": 3', '"documents": 4')}) + "\n")
    (f.parent / f".{f.name}.crc").unlink()


def spoil_manifest(path):
    f = next((path / "manifest").rglob("part-*"))
    f.write_text('{"bm25": "not an index"}\n')
    (f.parent / f".{f.name}.crc").unlink()


@pytest.mark.parametrize(
    "spoil",
    [spoil_digest, spoil_manifest, lambda p: shutil.rmtree(p / "manifest"), lambda p: shutil.rmtree(p / "segments" / "1" / "forward"), lambda p: next((p / "segments" / "1" / "postings").rglob("*.parquet")).unlink()],
)
def test_damaged_files_are_refused(spark, whole: Path, spoil):
    assert LexicalIndex.load(spark, str(whole)).manifest.documents == 3
    spoil(whole)
    with pytest.raises(DamagedIndex):
        LexicalIndex.load(spark, str(whole))


def test_a_failed_commit_is_not_seen(spark, whole):
    shutil.copytree(whole / "changes" / "1", whole / "changes" / "2")
    index = LexicalIndex.load(spark, str(whole))
    assert index.manifest.version == 1 and index._terms().where("term = 'b'").first().df == 2
    assert index.add(frame(spark, {4: "b"})).manifest.version == 2
