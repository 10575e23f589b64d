"""Semantics of operators that SQL does not cover."""

import random

import pytest
from pyspark.sql import functions as F

from korpusa.functions import scalars, text
from korpusa.operators import fusion, lexical, quality, relational, structure, vectors
from korpusa.sources import formats


def plain_merge(parts):
    done = ""
    for p in parts:
        if not done:
            done = p
            continue
        if p in done:
            continue
        same = next((s for s in range(min(len(done), len(p), 220), 23, -1) if done[-s:] == p[:s]), 0)
        done = done + p[same:] if same else done + "\n" + p
    return done


def test_merge_texts(spark):
    rng = random.Random(1)
    cases = []
    for i in range(60):
        base = "".join(rng.choice("abc ") for _ in range(600))
        cuts = sorted(rng.randrange(600) for _ in range(4))
        cases.append((i, [base[: cuts[1]], base[max(0, cuts[1] - rng.randrange(260)) : cuts[2]], base[cuts[2] : cuts[3]], base[cuts[0] : cuts[1]]]))
    got = {r.i: r.m for r in spark.createDataFrame(cases, "i int, p array<string>").select("i", fusion.merge_texts(F.col("p")).alias("m")).collect()}
    for i, p in cases:
        assert got[i] == plain_merge([x for x in p if x] if p[0] else p), i


def test_stitching_radius_and_exclusion(spark):
    chunks = spark.createDataFrame([(1, i, f"part {i}") for i in range(6)], "doc_id bigint, chunk_index int, text string")
    hits = chunks.where("chunk_index in (1, 2)").select("doc_id", "chunk_index")
    got = {r.chunk_index: r.text for r in fusion.stitch(hits, chunks).collect()}
    assert got == {1: "part 0\npart 1", 2: "part 2\npart 3"}


@pytest.mark.parametrize("size, overlap", [(50, 10), (200, 40), (900, 150)])
def test_splitter_invariants(size, overlap):
    rng = random.Random(size)
    for _ in range(50):
        fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))  # no accidental repeats
        t = "".join(rng.choice([fresh(4), fresh(7), " ", " ", "\n", "\n\n", fresh(3) + ". ", fresh(70)]) for _ in range(rng.randrange(200)))
        parts = structure.split_recursively(t, size, overlap)
        assert all(0 < len(p) <= size for p in parts)
        at = 0
        for p in parts:  # in order, and nothing but white space between
            at = t.index(p, max(0, at - size))
        squeezed = "".join(t.split())
        covered, pos = "", 0
        for p in parts:
            s = "".join(p.split())
            k = max((k for k in range(min(len(s), len(covered)), -1, -1) if covered.endswith(s[:k]) and squeezed.startswith(covered + s[k:])), default=None)
            assert k is not None
            covered += s[k:]
        assert covered == squeezed


def test_packed_lines_keep_order_and_limit(spark):
    rng = random.Random(2)
    pieces = ["x" * rng.randrange(1, 60) for _ in range(80)] + ["y" * 300, "z"]
    docs = [(1, "\n".join(pieces)), (2, ""), (3, None), (4, " \n\n ")]
    got = structure.packed(spark.createDataFrame(docs, "doc_id long, text string"), 100).orderBy("doc_id", "chunk_index").collect()
    assert {r.doc_id for r in got} == {1} and [r.chunk_index for r in got] == list(range(len(got)))
    assert "\n".join(r.text for r in got) == "\n".join(pieces) and all(len(r.text) <= 100 or r.text == "y" * 300 for r in got)
    assert all(len(a.text) + 1 + len(b.text.split("\n")[0]) > 100 for a, b in zip(got, got[1:], strict=False))


def test_bm25_floor_and_scope(spark):
    docs = spark.createDataFrame([(1, "pasal satu"), (2, "pasal dua"), (3, "pasal tiga tiga")], "id bigint, text string")
    asked = spark.createDataFrame([(1, "pasal TIGA?")], "query_id bigint, text string")
    got = lexical.bm25(docs, asked, 5).collect()
    assert got[0].id == 3 and [r.rank for r in got] == list(range(1, len(got) + 1))
    assert lexical.bm25(docs.where("id < 0"), asked, 5).collect() == []


def test_shipped_and_joined_scores_are_equal(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the"] * 6 + [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), i % 3) for i in range(200)] + [(900, None, 1), (901, "", 2)], "id long, text string, part int")
    asked = spark.createDataFrame([(q, " ".join(rng.choice([*words, "unseen"]) for _ in range(6)), q % 3) for q in range(25)] + [(99, None, 0)], "query_id long, text string, part int")
    rows = lambda same: sorted((r.kind, r.query_id, r.rank, r.id, round(r.score, 5)) for r in lexical.best(docs, asked, 4, same).collect())
    for same in (None, "part"):
        monkeypatch.setattr(lexical, "MOST_SHIPPED", 1_000_000)
        monkeypatch.setattr(lexical, "QUESTIONS", 7)
        shipped = rows(same)
        monkeypatch.setattr(lexical, "MOST_SHIPPED", 1)
        assert shipped == rows(same) and len(shipped) > 100
    assert all(k[3] % 3 == k[1] % 3 for k in shipped)


def test_search_text_keeps_what_is_said(spark):
    df = spark.createDataFrame([("BAB I > Pasal 1", None, " ", "text")], "a string, b string, c string, d string")
    assert df.select(lexical.search_text(*map(F.col, "abcd")).alias("t")).first().t == "BAB I > Pasal 1 text"


def test_vector_search_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v[i].tolist(), int(i % 3)) for i in range(60)] + [(98, None, 0), (99, [0.0] * 5, 0)], "id bigint, vec array<double>, label int")
    want = {r[:2]: r[2] for r in [(q, i, round(float(v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])), 6)) for q in (0, 7) for i in range(60)]}
    monkeypatch.setattr(vectors, "ROWS", 9)
    monkeypatch.setattr(vectors, "QUERIES", 1)
    got = vectors.top_cosine(df, df.where("id in (0, 7)").withColumnRenamed("id", "query_id"), 4).collect()
    for q in (0, 7):
        best = sorted(((-s, i) for (a, i), s in want.items() if a == q))[:4]
        assert [(r.id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in best]


def test_quality_rules(spark):
    rows = [
        (1, "apa itu layanan", "layanan publik", "Informasi itu tidak tersedia.", 1),
        (2, "apa itu layanan", "layanan publik", "Tidak tersedia pada tabel, nilai 3,25 [1]", 1),
        (3, "sebutkan langkah", "", "1. satu\n2. dua [1]", 0),
    ]
    q = {r.id: r for r in quality.quality(spark.createDataFrame(rows, "id int, q string, c string, a string, n int"), "q", "c", "a", "n").collect()}
    assert q[1].has_unavailable and q[1].conflicting and not q[2].has_unavailable
    assert q[3].list_ok and q[3].citation_count == 1 and q[3].score == 0 + 10 + 4 + 3 - 8


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.roman_to_int(F.lit("XLIX")).alias("r"), scalars.first_non_blank(F.lit(" "), F.lit(None), F.lit("a")).alias("f"),
        scalars.safe_int(F.lit(" 7 ")).alias("i"), scalars.safe_int(F.lit("3.0")).alias("j"), scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"),
        F.array_join(text.expand_query(F.lit("tabel 2 nomor 5 tahun 2020")), "|").alias("e"),
    ).first()
    assert (row.r, row.f, row.i, row.j, row.c) == (49, "a", 7, None, 0.0)
    assert row.e.split("|")[1:] == ["tabel 2 nomor 5 tahun 2020 tabel 2", "tabel 2 nomor 5 tahun 2020 lampiran tabel 2", "tabel 2 nomor 5 tahun 2020 tabel 2 nomor 5 tahun 2020"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "a" / "y.txt").write_text("no")
    assert [r.length for r in formats.pdf_listing(spark, str(tmp_path)).collect()] == [6]
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]')
    bad.write_text("[{")
    assert formats.read_json_array(spark, str(good), "id int, q string").count() == 2
    assert formats.read_json_array(spark, str(bad), "id int, q string").count() == 0
    table = tmp_path / "gt.csv"
    table.write_text('no,question,meta\n1,"a, b","{""bab"": ""I""}"\n2,c,oops\n')
    rows = formats.read_ground_truth_csv(spark, str(table), "no int, question string, meta string", "meta", "bab string").orderBy("no").collect()
    assert rows[0].question == "a, b" and rows[0].meta.bab == "I" and (rows[1].meta is None or rows[1].meta.bab is None)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = str(tmp_path / "t")
    assert formats.rebuild_if_stale(df, spark, out) and not formats.rebuild_if_stale(df, spark, out) and formats.rebuild_if_stale(df, spark, out, force=True)
    formats.write_report(df, str(tmp_path / "r.json"))
    formats.write_report(df, str(tmp_path / "r.md"), "markdown")
    assert spark.read.json(str(tmp_path / "r.json")).count() == 2 and spark.read.text(str(tmp_path / "r.md")).count() == 2
    replaced = relational.replace_by_key(df, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, replaced.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert formats.add_missing_columns(df, spark.createDataFrame([(9, 1)], "k int, extra int")).columns == ["k", "v", "extra"]
