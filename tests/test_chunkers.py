import pytest

from korpusa.operators import chunkers as C
from korpusa.operators import documents as D
from korpusa.operators.structure import split_recursively
from korpusa.plans import regulations as R


def pack(items, lead, most, overlap, sep="\n", lead_once=False):
    """Greedy packing of one unit, written out: (label, text) pieces."""
    out, held, labels = [], lead if lead_once else "", []

    def flush():
        if held or (not lead_once and lead and not items):
            span = None if not labels or labels[0] is None else labels[0] if len(set(labels)) == 1 else f"{labels[0]}-{labels[-1]}"
            whole = held if lead_once or not lead else f"{lead}\n{held}" if held else lead
            out.extend((span, p) for p in split_recursively(whole, most, overlap))

    for label, text in items:
        if held and len(held) + len(text) + 1 > most:
            flush()
            held, labels = text, [label]
        else:
            held = held + sep + text if held else text
            labels.append(label)
    flush()
    return out


def rows(spark, units):
    given = []
    for u, (lead, items) in units.items():
        given += [(u, 0, True, None, lead)] if lead else []
        given += [(u, i + 1, False, label, text) for i, (label, text) in enumerate(items)]
    return spark.createDataFrame(given, "unit string, n long, lead boolean, label string, text string")


@pytest.mark.parametrize("lead_once", [False, True])
@pytest.mark.parametrize("sep", ["\n", "\n\n"])
def test_packing_against_plain(spark, sep, lead_once):
    import random

    rng = random.Random(2)
    units = {
        f"u{k}": (rng.choice(["", "Pasal 1\nisi", "kata " * 30]), [(f"({i})", f"ayat {i} " + "x y " * rng.choice([1, 5, 30, 90])) for i in range(rng.randrange(0, 9))])
        for k in range(60)
    }
    units = {u: x for u, x in units.items() if x[0] or x[1]}
    got = C.packed(rows(spark, units).repartition(7), 200, 30, sep, lead_once).collect()
    for u, (lead, items) in units.items():
        mine = [(r.label, r.text) for r in sorted((r for r in got if r.unit == u), key=lambda r: r.piece)]
        assert mine == pack(items, lead, 200, 30, sep, lead_once), u


def regulation(spark, text, size=(900, 150)):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return C.chunk_regulations(D.regulation_parts(D.text_lines(docs)), D.regulation_header(docs), size).orderBy("chunk_index").collect()


def test_two_clauses_of_350_share_a_chunk(spark):
    got = regulation(spark, "BAB I\nPasal 1\n(1) " + "A" * 350 + "\n(2) " + "B" * 350)
    assert len(got) == 1 and "A" * 350 in got[0].text and "B" * 350 in got[0].text and got[0].ayat == "Ayat (1)-(2)"
    assert got[0].hierarchy == "Peraturan  Tahun > BAB I > Pasal 1 > Ayat (1)-(2)"


def test_every_clause_chunk_names_its_article(spark):
    got = regulation(spark, "BAB I\nPasal 1\n(1) " + "A" * 60 + "\n(2) " + "B" * 60, (80, 0))
    assert [r.text for r in got] == ["Pasal 1\n(1) " + "A" * 60, "Pasal 1\n(2) " + "B" * 60] and [r.ayat for r in got] == ["Ayat (1)", "Ayat (2)"]


def test_an_article_of_a_name_only_gives_no_chunk(spark):
    assert [r.pasal for r in regulation(spark, "Pasal 100000\nPasal 2\nisi pasal dua")] == ["Pasal 2"]


def test_paragraphs_of_700_share_a_chunk(spark):
    docs = spark.createDataFrame([(1, "# Bab\n" + "X" * 700 + "\n\n" + "Y" * 700 + "\n\n" + "Z" * 700)], "doc_id long, text string")
    got = C.chunk_reports(D.report_paragraphs(D.text_lines(docs))).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["X" * 700 + "\n\n" + "Y" * 700, "Z" * 700] and got[0].hierarchy == "Bab"


def test_limit_and_part_numbers(spark):
    assert len(C.limited("W" * 1000, 1200, 100)) == 1 and len(C.limited("W" * 1000, 400, 40)) > 1 and C.limited(None, 10, 0) == []
    docs = spark.createDataFrame([(1, "BAB I Awal\n" + "kata " * 300)], "doc_id long, text string")
    got = C.chunk_guides(D.text_lines(docs)).orderBy("chunk_index").collect()
    assert len(got) > 1 and [r.hierarchy for r in got] == [f"BAB I - Awal [Bagian {i}/{len(got)}]" for i in range(1, len(got) + 1)]
    assert {(r.bab, r.chunk_parts) for r in got} == {("BAB I - Awal", len(got))} and [r.chunk_part for r in got] == list(range(1, len(got) + 1))


def test_tables_are_cut_between_rows():
    text = "Tabel 12 nilai\n" + "\n".join(f"Nama: instansi {i}; Nilai: {i}" for i in range(60))
    got = C.limited(text, 300, 60)
    assert len(got) > 3 and all(t and label == "Tabel 12" and len(p) <= 300 for p, t, label in got)
    assert {x for p, _, _ in got for x in p.split("\n")} == set(text.split("\n"))


def test_one_chunk_an_institution(spark):
    text = "Nama Instansi: Badan Kepegawaian Negara; D1: 4,4; D2: 4.0; D3: 3.55; D4: 4.19; Indeks: 4.06; Predikat: Sangat Baik"
    got = C.chunk_evaluations(spark.createDataFrame([(1, text, 2024)], "doc_id long, text string, year int"), "year").collect()
    assert len(got) == 1 and got[0].doc_type == "laporan_spbe"
    assert all(x in got[0].text for x in ("Badan Kepegawaian Negara", "4.06", "Sangat Baik", "Tahun 2024"))


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "pembuka laporan\n# BAB I Satu\n#### rinci **x**\nisi bagian satu\n## Dua\n| a | b |\n|---|---|\n| 1 | - |\nsesudah\n# Tiga\n## Empat\nisi bagian empat")], "doc_id long, text string")
    got = C.chunk_markdown(D.text_lines(docs), docs.selectExpr("doc_id", "'L' as title")).orderBy("chunk_index").collect()
    assert [(r.hierarchy, r.bab, r.text) for r in got] == [
        ("L", "", "pembuka laporan"), ("L > BAB I Satu", "BAB I", "rinci **x**\nisi bagian satu"), ("L > BAB I Satu > Dua", "BAB I", "a: 1; b: -\nsesudah"), ("L > Tiga > Empat", "", "isi bagian empat"),
    ]


def test_whole_table_of_regulations_against_plain(spark, sf):
    """Every chunk of an article, worked out from the made texts line by line."""
    got = R.clause_chunks(spark, sf)
    mine = {}
    for r in got.where("hierarchy like '%> Pasal %'").collect():
        mine.setdefault(r.doc_id, []).append((r.chunk_index, r.ayat, r.size))
    docs = R._pieces(spark, sf).collect()
    for d in docs:
        want, p = [], d.p
        for i in range(1, len(p), 4):
            clauses = [("(1)", f"(1) {p[i + 1]}")] if i + 1 < len(p) else []
            if i + 2 < len(p):
                more = f"\n{p[i + 3]}" if i + 3 < len(p) and (i + 3) % 20 else ""
                clauses.append(("(2)", f"(2) {p[i + 2]}{more}"))
            want += [(f"Ayat {a}" if a else "", len(t)) for a, t in pack(clauses, f"Pasal {i}\n{p[i]}", 900, 150) if len(t) >= 10]
        assert [(a, n) for _, a, n in sorted(mine.get(d.doc_id, []))] == want, d.doc_id


def test_linear_tables():
    assert C.linear_table("| a | b |\n|---|:--|\n| 1 | 2 | 3 |\n| x |") == "a: 1; b: 2\na: x"
    assert C.linear_table("| a |") == "| a |" and C.linear_tables("x\n| a |\n| 1 |\ny") == "x\na: 1\ny" and C.linear_tables("") == ""


def test_regulations_are_chunked_without_a_shuffle(spark, sf):
    """A text's lines stay in its row: dealt over partitions they took eight times the input's disk."""
    plan = R.clause_chunks(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_regulations_in_one_pass_against_lines(spark):
    """Chunks of whole texts are those of their lines dealt out, whatever the order of headings, blanks and odd white space."""
    import random

    rng = random.Random(5)
    some = ["BAB I Umum", "bab ii", "Bagian Kesatu. Hal", "Pasal 1", "**Pasal 2** isi pasal", "# Pasal 3", "Pasal 4 \r", "(1) ayat satu", "(2)  ayat dua " * 60, "(3) (4) dua", "(１) lain", "", " ", "\t isi", "isi \x85",
            "isi " * 300, "LAMPIRAN", "lampiran lain", "Lampir", "NOMOR 5 TAHUN 2020", "PERATURAN MENTERI", "a: 1; b: 2", "tabel 3 | x", " ", "isi panjang dan berakhir "]
    texts = ["", "\n", "LAMPIRAN", "x\nLAMPIRAN", "x\nLAMPIRAN a\n\nLAMPIRAN b\nisi lampiran", *("\n".join(rng.choices(some, k=rng.randrange(1, 60))) for _ in range(150)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = C.chunk_regulations(D.regulation_parts(D.text_lines(docs)), D.regulation_header(docs))
    got = C.chunk_regulation_texts(docs, held=7)
    assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    mine, theirs = ({(r.doc_id, r.chunk_index): tuple(r) for r in df.collect()} for df in (got, want))
    assert len(theirs) > 500 and mine == theirs and got.count() == len(mine)
