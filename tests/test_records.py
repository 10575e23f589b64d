"""Chunk records, source paths, figure chunks and expectations on single cases."""

from pyspark.sql import functions as F

from korpusa.operators import records as R


def record(spark, metadata, text="isi", index=3):
    df = spark.createDataFrame([(1, index, text, metadata)], "id long, i int, text string, metadata string")
    return df.select(R.chunk_record(F.col("id"), F.col("i"), F.col("text"), F.col("metadata")).alias("r")).first().r


def test_metadata_goes_over_columns(spark):
    r = record(spark, '{"id": 9, "text": "lain", "chunk_index": "5", "is_parent": "yes", "pasal": 12, "is_table": true, "table_label": "Tabel 1", "x": [1]}')
    assert (r.id, r.text, r.raw_text, r.chunk_index, r.is_parent, r.pasal, r.is_table, r.table_label, r.is_indexed) == (1, "lain", "isi", 5, True, "12", True, "Tabel 1", True)


def test_defaults_for_what_cannot_be_read(spark):
    for metadata in (None, "", "oops", "[1]", "3", "null", '{"bab": "x"', '{"bab": null, "chunk_part": "1.5", "chunk_index": "99999999999"}'):
        r = record(spark, metadata)
        assert (r.text, r.raw_text, r.chunk_index, r.bab, r.chunk_part, r.chunk_type, r.is_parent, r.is_indexed) == ("isi", "isi", 3, "", None, "text", False, True), metadata
    r = record(spark, None, None, None)
    assert (r.text, r.raw_text, r.chunk_index) == ("", "", 0)
    assert record(spark, '{"is_indexed": "False", "is_parent": 0}').is_indexed is False
    assert len(record(spark, '{"text": "' + "panjang " * 100_000 + '"}').text) == 800_000


def paths(spark, metadata):
    df = spark.createDataFrame([(metadata,)], "m string").select(R.chunk_record(F.lit(1), F.lit(0), F.lit("t"), F.col("m")).alias("r"))
    a, b = df.select(R.source_path(F.col("r")), R.legal_path(F.col("r"))).first()
    return tuple(a), tuple(b)


def test_paths_by_kind(spark):
    law = '{"doc_type": "peraturan", "document_title": "Aturan", "tentang": "Hal", "bab": "BAB III", "bagian": "Bagian Kedua", "pasal": "38", "ayat": "4", "hierarchy": "x"}'
    assert paths(spark, law) == (("Hal", "BAB III > Bagian Kedua > Pasal 38 > Ayat (4)"), ("Aturan", "BAB III > 38 > Ayat (4)"))
    audit = '{"doc_type": "audit", "filename": "Laporan_Audit.pdf", "section": "hasil UJI-coba 2a", "section_part": 2}'
    assert paths(spark, audit) == (("Laporan Audit", "Hasil Uji-Coba 2A > Bagian 2"), ("Laporan Audit", ""))
    assert paths(spark, '{"hierarchy": "", "context_header": "Umum"}') == (("Dokumen", "Umum"), ("Dokumen", ""))
    assert paths(spark, None) == (("Dokumen", ""), ("Dokumen", ""))


FIGURE = "doc_id long, figure_id string, page int, figure_number string, caption string, width int, height int, hash string, method string, detail string, kind int"


def test_figure_chunks(spark):
    rows = [
        (1, "b", 2, "Gambar 1", "Gambar 1. Alur", 10, 10, "h", "ocr", "rinci", 0),
        (1, "a", 2, "", "", 10, 10, "h", "ocr", " rinci ", 0),
        (1, "a", 2, "", "", 10, 10, "h", "ocr", " rinci ", 0),
        (1, "c", 9, None, "Foto rapat", 10, 10, "p", "ocr", "rinci", 0),
        (1, "d", 1, None, None, 10, 10, "q", "failed", "rinci", 0),
        (1, "e", 1, None, None, 10, 10, "r", None, "rinci", 0),
        (1, "f", 1, None, None, 10, 10, "s", "ocr", " \n", 0),
        (1, "g", 1, None, None, 10, 10, "t", "ocr", None, 0),
        (1, "h", 3, "", "", 10, 10, None, "ocr", "satu", 0),
        (1, "i", 3, "", "", 10, 10, None, "ocr", "dua", 0),
        (2, "a", 1, "Gambar 2", "Gambar 2. Grafik", 90, 10, "h", "vision", "naik\n", 0),
    ]
    df = spark.createDataFrame(rows, FIGURE)
    got = sorted(map(tuple, R.figure_chunks(df).collect()))
    assert got == [
        (1, "a", "diagram", "Figure: Figure", "", "diagram|a|page:2|ocr", " rinci "),
        (1, "h", "diagram", "Figure: Figure", "", "diagram|h|page:3|ocr", "satu"),
        (1, "i", "diagram", "Figure: Figure", "", "diagram|i|page:3|ocr", "dua"),
        (2, "a", "bar_chart", "Figure: Gambar 2", "Gambar 2. Grafik", "bar_chart|a|page:1|vision", "Gambar 2. Grafik\n\nnaik"),
    ]
    assert R.figure_chunks(df.limit(0)).collect() == []


def test_expectations(spark):
    fields = "answer string, ids array<string>, score long, claim boolean, words array<string>, allowed array<string>, least long, expected boolean"
    rows = [
        ("Isi BOBOT", ["1", " 2 ", None, ""], 5, False, ["bobot", "x"], ["1", "2"], 5, False),
        ("isi", ["3", "9", "3"], 4, True, ["bobot"], ["1"], 5, False),
        (None, [], None, None, [], [], 0, True),
        (None, None, None, None, None, None, None, None),
    ]
    got = spark.createDataFrame(rows, fields).select(R.unmet(*map(F.col, ("answer", "ids", "score", "claim", "words", "allowed", "least", "expected"))).alias("r")).collect()
    assert [r.r for r in got] == [[], ["keyword", "leakage:3|9", "score", "unavailable"], ["keyword", "score", "unavailable"], []]
