import re

from korpusa.operators import paragraphs as P

TABLE = "| a | b |\n|---|---|\n| 1 | 2 |"


def chunks(spark, *texts, title="T", most=60):
    docs = spark.createDataFrame([(i, title, t, "x") for i, t in enumerate(texts)], "doc_id int, title string, text string, n string")
    return sorted(P.paragraph_chunks(docs, most).collect(), key=lambda r: (r.doc_id, r.chunk_index))


def test_packing_keeps_every_paragraph(spark):
    texts = ["\n\n".join("w" * (1 + (i * 37 + d * 11) % 50) for i in range(30)) for d in range(4)]
    got = chunks(spark, *texts)
    for d, text in enumerate(texts):
        mine = [r for r in got if r.doc_id == d]
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        assert "\n\n".join(r.raw_text for r in mine) == text
        for one, after in zip(mine, mine[1:], strict=False):
            size = len(one.raw_text.replace("\n\n", ""))
            assert size <= 60 and size + len(after.raw_text.split("\n\n")[0]) > 60


def test_heading_at_most_four_paragraphs_above(spark):
    for gap, found in ((0, True), (3, True), (4, False)):
        text = "\n\n".join(["## Bagian Umum", *["isi " + "k" * 50] * gap, TABLE + " " * 3 + "z" * 30])
        last = chunks(spark, text)[-1]
        assert last.chunk_type == "table" and last.context_header == ("T > Bagian Umum" if found else "T")
    # a blank paragraph counts as one of the four
    text = "\n\n".join(["## Bagian Umum", *["isi " + "k" * 50] * 3, " ", TABLE + "z" * 30])
    assert chunks(spark, text)[-1].context_header == "T"


def test_labels_and_neighbours(spark):
    got = chunks(spark, "\n\n".join(["awal " + "a" * 50, "**Tabel 2. Bobot domain**", TABLE, "akhir " + "b" * 70]))
    table = next(r for r in got if r.chunk_type == "table")
    assert table.table_label == "Tabel 2. Bobot domain" and table.text.startswith("T > Tabel 2. Bobot domain: Tabel 2. Bobot domain\n")
    assert table.table_context == "awal " + "a" * 50 + "\n\nakhir " + "b" * 70 and table.parent_text == got[0].raw_text and not table.is_parent
    assert got[0].is_parent and got[0].text == "T: " + got[0].raw_text and got[0].table_context == "" and got[0].section == ""
    # the name stands in the chunk before, and is the heading as well: not said twice
    got = chunks(spark, "\n\n".join(["a" * 59, "**Tabel 7**", TABLE + "z" * 50]))
    assert got[-1].table_label == "Tabel 7" and got[-1].context_header == "T > Tabel 7"


def test_odd_documents(spark):
    assert chunks(spark, None, "", " \n\n ") == []
    long = "k" * 5000
    assert [r.raw_text for r in chunks(spark, f"a\n\n{long}\n\nb", title=None)] == ["a", long, "b"]
    rows = spark.createDataFrame([], "doc_id int, title string, text string")
    assert P.paragraph_chunks(rows).count() == 0


def test_label_pattern_reads_as_said():
    assert re.search(P.LABEL, "lihat tabel 12 . x|y").groups() == ("12", ". x")
