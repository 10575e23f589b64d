"""What a task holds doesn't grow with a partition's rows, and what several steps read is worked out once."""

import pyarrow as pa
import pytest

from korpusa.operators import chunkers as C
from korpusa.operators import documents as D
from korpusa.operators import lexical, lexical_index, structure, vectors
from korpusa.operators.batches import sliced
from korpusa.plans import composed

TEXT = "EVALUASI\nKesimpulan\nbaik\nTindak Lanjut dan Rekomendasi\n1. Urusan:\n● aksi\nBAB I\nPENDAHULUAN\nA. Latar\nisi"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_come_in_pieces_with_all_rows():
    given = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 1000), (1000, 1000), (1000, 1010))]
    got = list(sliced(iter(given), 256))
    assert max(map(len, got)) == 256 and [x for b in got for x in b.column("x").to_pylist()] == list(range(1010))


def test_terms_are_counted_in_pieces_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(lexical, "COUNTED", 2)
    rows = spark.createDataFrame([("a b a",), ("",), ("b",), ("a",), ("c",)], "toks string").coalesce(1)
    assert sorted(map(tuple, lexical.term_counts(rows).collect())) == [("a", 2, 3), ("b", 2, 2), ("c", 1, 1)]


def test_blocks_and_buckets_are_bounded():
    assert vectors.ASKED * vectors.ROWS * 8 <= 1 << 25 and lexical_index.BUCKET_TOKENS <= 1 << 22


@pytest.mark.parametrize("name", ["guide", "guideline", "paragraphs", "report"])
def test_a_run_is_read_by_its_steps_not_repeated(spark, name):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    lines = D.text_lines(docs)
    got = {"guide": lambda: D.guide_parts(lines), "guideline": lambda: D.guideline_parts(lines), "paragraphs": lambda: D.report_paragraphs(lines), "report": lambda: D.report_parts(docs)[0]}[name]()
    assert got.count() > 0 and "MapInArrow" not in plan(got)


def test_a_choice_by_count_makes_each_chunking_once(spark):
    docs = spark.createDataFrame([(i, "satu dua tiga empat. " * i) for i in range(1, 200)], "doc_id long, text string")
    got = structure.choose_by_count(structure.chunk_documents(docs, 400, 50), structure.chunk_documents(docs, 80, 10))
    assert plan(got).count("MapInArrow") - plan(got).count("ReusedExchange") <= 2 and "Join" not in plan(got)
    assert {r.doc_id: r.way for r in got.collect()}.keys() == set(range(1, 200))


def test_all_searches_in_small_blocks_give_the_same(spark, monkeypatch):
    data = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, vec array<double>")
    asked = data.withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, vectors.top_cosine(data, asked, 3).collect()))
    monkeypatch.setattr(vectors, "ASKED", 7)
    assert sorted(map(tuple, vectors.top_cosine(data, asked, 3).collect())) == want and len(want) == 120


def test_chunks_and_their_tokens_are_made_once(spark, sf):
    chunks, asked, of_chunks, of_asked = composed._inputs(spark, sf)
    assert "Generate" not in plan(chunks) and "regexp" not in plan(chunks)
    made = composed.chunk_table(spark, sf)
    assert sorted(map(tuple, chunks.drop("toks").collect())) == sorted(map(tuple, made.collect()))
    rows = lambda c: sorted(map(tuple, composed.ranked_lists(c, asked, of_chunks, of_asked)["bm25"].collect()))
    assert rows(chunks) == rows(made) != []


def test_ties_across_pieces_go_to_the_smaller_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "satu" if i % 3 else "satu dua") for i in range(60, 0, -1)] + [(i, "lain kata") for i in range(100, 300)], "id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "satu"), (2, "dua satu"), (3, "tiga")], "query_id long, text string")
    want = sorted(map(tuple, lexical.best(docs, asked, 4).collect()))
    assert [r[2] for r in want if r[:2] == ("overlap", 1)] == [1, 2, 3, 4] and {r[1] for r in want} == {1, 2}
    monkeypatch.setattr(lexical, "TEXTS", 2)
    assert sorted(map(tuple, lexical.best(docs, asked, 4).collect())) == want
