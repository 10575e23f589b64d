import random
import re

import pytest

from korpusa.llm import common
from korpusa.llm import decontaminate as D


def canon(text):
    """Plain version: (token, kind) list."""
    out, before = [], None
    toks = [t for c in (text or "").split() for t in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[%$€£¥°]|[.!?:]", c)]
    for t in toks:
        if t in ".!?:":
            before = "stop"
            continue
        if t[0].isdigit():
            k = "n"
        elif t in D.SIGNS:
            k = "u"
        elif t.lower() in D.UNITS and before == "n":
            k = "u"
        elif t[0].isupper() and t.lower() not in D.UNITS and before not in ("stop", None):
            k = "c"
        else:
            k = "w"
        out.append((t.lower(), k))
        before = k if k == "n" else "x"
    return out


def brute(docs, bench):
    rows = []
    for doc, text in docs:
        d = canon(text)
        for item, btext in bench:
            b = canon(btext)
            size = min(D.WINDOW, len(b))
            if not size or (size < D.LEAST_WORDS and len(d) != size):
                continue
            n, hit = len(b) - size + 1, {}
            for at in range(n):
                for place in range(len(d) - size + 1):
                    x, y = b[at : at + size], d[place : place + size]
                    same = all(p[1] == q[1] and (p[1] != "w" or p[0] == q[0]) for p, q in zip(x, y))
                    few, fewer = (2 * sum(p[1] == "w" for p in z) < size for z in (x, y))
                    if few or fewer:
                        same = few and fewer and [p[0] for p in x] == [q[0] for q in y]
                    sx, sy = ([p for p in z if p[1] != "w"] for z in (x, y))
                    if same and len(sx) == len(sy):
                        hit.setdefault(place - at, []).append((at, list(zip(sx, sy))))
            ats, exact = set(), True
            for found in hit.values():
                pairs = {p for _, ps in found for p in ps}
                if len({p[0] for p in pairs}) == len(pairs):
                    ats |= {a for a, _ in found}
                    exact &= all(p == q for p, q in pairs)
            if ats and round(len(ats) / n, 4) >= D.MIN_COVER:
                rows.append((doc, item, n, len(ats), "exact" if exact else "reparameterised"))
    return sorted(rows, key=str)


@pytest.mark.parametrize("shipped, heavy", [(D.MOST_SHIPPED, common.HEAVY), (D.MOST_SHIPPED, 2), (-1, 2)])
def test_equals_brute_force(spark, monkeypatch, shipped, heavy):
    monkeypatch.setattr(D, "MOST_SHIPPED", shipped)
    monkeypatch.setattr(common, "HEAVY", heavy)
    rng = random.Random(9)
    words = ["apples", "trains", "leave", "the", "with", "and", "travel", "costs", "each", "shop", "then", "how", "many"]
    bench = [(i, "we say " + " ".join(rng.choice([*words, "12", "7.5", "kg", "near Alice", "$"]) for _ in range(rng.randrange(4, 40)))) for i in range(15)]
    bench += [(50, None), (51, ""), (52, "hello there 3 friends"), (53, "if 3 then 3 and then 4 of the trains with 3 leave each shop and 4 travel")]
    docs = []
    for i in range(60):
        item = rng.choice(bench)[1] or ""
        item = re.sub(r"\d+(\.\d+)?", lambda m: rng.choice([m[0], "99"]), item) if i % 2 else item
        docs.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(20))) + " " + item.replace("Alice", rng.choice(["Alice", "Bob"])) + " so"))
    docs += [(100, None), (101, ""), (102, "we if 5 then 5 and then 8 of the trains with 5 leave each shop and 8 travel"), (103, "we if 5 then 6 and then 8 of the trains with 7 leave each shop and 9 travel")]
    docs += [(104, "say hello there 3 friends"), (104, "say hello there 3 friends"), (None, "x hello there 8 friends")]
    a = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, line int, key string")
    b = spark.createDataFrame([(t, i, 0) for i, t in bench], "text string, item_id long, at int")
    got = sorted({(r.doc_id, r.item_id, r.n_windows, r.n_matched, r.kind) for r in D.matches(a, b).collect()}, key=str)
    want = sorted(set(brute(docs, bench)), key=str)
    assert got == want
    assert any(r[0] == 102 and r[4] == "reparameterised" for r in got) and not any(r[0] == 103 and r[1] == 53 for r in got)
    left = {r.doc_id for r in D.clean(a, b).collect()}
    assert left == {d for d, _ in docs} - {r[0] for r in got}
    assert D.clean(a, b).columns == a.columns


def test_number_rich_short_and_nameless_items(spark):
    table = "3 kg 4 m 5 km 6 Alice 7 Bob 8 kg 9 10 11 12 13 14 15"
    bench = spark.createDataFrame([(1, table), (2, "What is 12 + 15 kg?"), (3, "Paris"), (None, "seven words of an item without id"), (4, table)], "item_id long, text string")
    rows = [(1, f"see {table} end", 1), (2, "see 4 kg 5 m 6 km 7 Alice 8 Bob 9 kg 10 11 12 13 14 15 16", 1), (3, "so, What is 12 + 15 kg? it asks", 1), (4, "What is 12 + 16 kg?", 1)]
    rows += [(5, "we went to Paris once", 1), (6, "Paris", 1), (7, "here are seven words of an item without id again", 1), (8, "a clean text of words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key__ int")
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()}
    assert got == {(1, 1), (1, 4), (3, 2), (6, 3), (7, None)}
    left = D.clean(docs, bench)
    assert left.columns == docs.columns and {(r.doc_id, r.key__) for r in left.collect()} == {(i, 1) for i in (2, 4, 5, 8)}


def test_query_and_empty(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, "so " + text), (1, "so " + text), (2, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, text), (8, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.item_id, r.copy, r.cover) for r in D.query(spark, str(tmp_path)).collect())
    assert got == [(1, 7, 1, 1.0), (1, 7, 2, 1.0), (1, 8, 1, 1.0), (1, 8, 2, 1.0)]
    docs, bench = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert D.matches(docs, bench.limit(0)).collect() == [] and D.matches(docs.limit(0), bench).collect() == []
    assert D.clean(docs, bench.limit(0)).count() == 3
