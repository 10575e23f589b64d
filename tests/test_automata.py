import random

import pytest
from pyspark.sql import functions as F

from korpusa.operators import documents as D
from korpusa.operators.automata import HERE, Machine, run

POOL = [
    "", "BAB I KETENTUAN UMUM", "## BAB II", "BAB III", "Bagian Kesatu. Umum", "Pasal 1", "**Pasal 2** langsung isi", "(1) satu", "(2) dua", "teks biasa", "Lampiran", "lampiran lain",
    "1. Latar Belakang", "2. Maksud dan Tujuan", "# **3. Ruang Lingkup**", "Yth. Para Menteri", "Kepala Badan", "SURAT EDARAN", "A. Sub satu", "B. Sub dua", "I.", "DOMAIN", "INDIKATOR 1", "ID-1",
    "Nama indikator", "Deskripsi Indikator: apa", "Level 1", "Kriteria Level satu", "Kriteria Bukti Dukung bukti", "Ketentuan Penilaian", "Kesimpulan", "Tindak Lanjut dan Rekomendasi", "1. Poin:", "● aksi", "Tabel 9. Hasil Evaluasi SPBE Kementerian",
    "3,25", "4", "2.5", "Baik", "12", "Kota C", "# Judul", "BAB IV X", "Nama Instansi: A; D1: 1; D2: 2; D3: 3; D4: 4; Indeks: 5,5; Predikat: Baik",
]
MACHINES = {"regulation": D.REGULATION, "guide": D.GUIDE, "letter": D.LETTER, "guideline": D.GUIDELINE, "report": D.REPORT, "paragraphs": D.PARAGRAPHS}


def plain(machine, texts):
    out = set()
    for k, lines in texts.items():
        state, held = 0, dict.fromkeys(machine.registers)
        for n, (line, flag) in enumerate(lines):
            state, sets, role = machine.step(state, line or "", flag)
            assert 0 <= state < machine.states
            held |= {r: str(n) if v == HERE else v for r, v in sets.items()}
            out.add((k, n, line or "", role, *(held[r] for r in machine.registers)))
    return out


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_segments_give_the_same_run(spark, name):
    machine, rng = MACHINES[name], random.Random(name)
    texts = {k: [(rng.choice(POOL), int(rng.random() < 0.05)) for _ in range(rng.randrange(1, 70))] for k in range(25)}
    texts[None] = [("BAB I", 0), (None, 0), ("isi", 0)] * 5
    rows = [(k, n, line, flag, "x") for k, ls in texts.items() for n, (line, flag) in enumerate(ls)]
    lines = spark.createDataFrame(rows, "doc_id long, n long, line string, flag int, role string")
    want = plain(machine, texts)
    for segment in (4, 1000):
        got = [tuple(r) for r in run(lines, machine, segment=segment).collect()]
        assert len(got) == len(rows) and set(got) == want
    assert run(lines.limit(0), machine).collect() == []


def test_string_keys_and_long_text(spark):
    parity = Machine(2, ("last",), lambda s, line, flag: (1 - s, {"last": line} if s else {}, "odd" if s else "even"))
    lines = spark.range(20_000).selectExpr("'doc' as name", "id as n", "string(id) as line")
    got = run(lines, parity, "name", segment=1000)
    assert got.where("role = 'odd'").count() == 10_000
    assert got.where("n = 15000").first().last == "14999" and got.where("n = 15001").first().last == "15001"


REGULATION = """PERATURAN MENTERI X
NOMOR 5 TAHUN 2020
TENTANG
TATA KELOLA
DATA
DENGAN RAHMAT TUHAN
BAB I
Umum isi bab
Bagian Kesatu. Awal
masih intro
Pasal 1 langsung
lanjutan
(1) ayat satu
tetap satu
(2) ayat dua
Bagian Kedua
Pasal 2
isi dua

BAB II PENUTUP
Pasal 3

Lampiran I
isi lampiran
(1) bukan ayat"""


def parts(df, *columns):
    return [tuple(r) for r in df.orderBy("n").select(*columns).collect()]


@pytest.mark.parametrize("segment", [None, 4])
def test_regulation(spark, segment):
    lines = D.text_lines(spark.createDataFrame([(1, REGULATION), (2, None), (3, "Pasal 7 saja\n(1) a")], "doc_id long, text string"))
    got = D.regulation_parts(lines, segment=segment)
    assert parts(got.where("doc_id = 1"), "kind", "bab", "bab_title", "bagian", "pasal", "ayat", "text") == [
        ("preamble", None, None, None, None, None, REGULATION.partition("\nBAB I\n")[0]),
        ("intro", "I", "", None, None, None, "Umum isi bab\nmasih intro"),
        ("article", "I", "", "Kesatu - Awal", "1", None, "langsung\nlanjutan"),
        ("clause", "I", "", "Kesatu - Awal", "1", "1", "ayat satu\ntetap satu"),
        ("clause", "I", "", "Kesatu - Awal", "1", "2", "ayat dua"),
        ("article", "I", "", "Kedua - ", "2", None, "isi dua"),
        ("article", "II", "PENUTUP", None, "3", None, ""),
        ("appendix", None, None, None, None, None, "Lampiran I\nisi lampiran\n(1) bukan ayat"),
    ]
    assert parts(got.where("doc_id = 3"), "kind", "bab", "pasal", "ayat", "text") == [("article", None, "7", None, "saja"), ("clause", None, "7", "1", "a")]
    assert got.where("doc_id = 2").count() == 0


def test_regulation_header(spark):
    df = spark.createDataFrame([(1, REGULATION), (2, None), (3, "TENTANG\n\nTENTANG\nA\nB\nC\nD\nE")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.regulation_header(df).collect()}
    assert got == {1: ("PERATURAN MENTERI X", "5", "2020", "TATA KELOLA DATA"), 2: ("Peraturan", "", "", ""), 3: ("Peraturan", "", "", "A B C D")}


def test_guide(spark):
    text = "pembuka\nBAB I PENDAHULUAN\nisi satu\n# **BAB II**\nab\n#### **Isi Pokok**\nisi dua"
    got = D.guide_parts(D.text_lines(spark.createDataFrame([(1, text), (2, "tanpa bab")], "doc_id long, text string")))
    assert parts(got, "doc_id", "bab", "title", "text") == [(1, "I", "PENDAHULUAN", "pembuka\nisi satu"), (1, "II", "Isi Pokok", "ab\nisi dua")]


def test_letter(spark):
    text = (
        "KEMENTERIAN\nYth.\nPara Menteri\n- 1 -\n| x |\nGubernur\n1. Latar Belakang\nkarena\n2. Maksud dan Tujuan\na. Maksud supaya jelas\nb. Tujuan agar rapi\n"
        "4. Dasar Hukum\n- Undang-Undang Nomor 1\nab\n5. Isi Edaran\nisi\n6. Penutup\nDemikian\n\nLAMPIRAN\nBAB I\nisi"
    )
    got = D.letter_parts(D.text_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert {r.part: r.text for r in got.collect()} == {
        "penerima": "Para Menteri\nGubernur", "latar_belakang": "karena", "maksud": "supaya jelas", "tujuan": "agar rapi", "dasar_hukum": "Undang-Undang Nomor 1",
        "isi_edaran": "isi", "penutup": "Demikian", "lampiran": "LAMPIRAN\nBAB I\nisi",
    }


def test_guideline(spark):
    text = (
        "BAB I\nPENDAHULUAN\nA. Latar\nisi a\n-3- jdih.menpan.go.id\nB. Tujuan\nisi b\nBAB II\nMETODE\numum saja\nI.\nDOMAIN\nINDIKATOR 1\nID-1\nArsitektur\nSPBE\nDeskripsi Indikator: apa\nini\nKetentuan Penilaian\nx\n"
        "Level 1\nlewat\nKriteria Level satu\nsatu lagi\nKriteria pemenuhan\nlewat\nKriteria Bukti Dukung surat\nLevel 2\nKriteria Level dua\nINDIKATOR 2\nID-2\nLayanan\nBAB III\nPENUTUP\nakhir\nINDIKATOR 3\nID-3\nTidak"
    )
    got = parts(D.guideline_parts(D.text_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))), "kind", "number", "title", "sub", "level", "text")
    assert got == [
        ("narrative", "I", "PENDAHULUAN", "A. Latar", None, "isi a"),
        ("narrative", "I", "PENDAHULUAN", "B. Tujuan", None, "isi b"),
        ("narrative", "II", "METODE", "Umum", None, "umum saja"),
        ("name", "1", None, None, None, "Arsitektur SPBE"),
        ("description", "1", None, None, None, "apa ini"),
        ("criteria", "1", None, None, "1", "satu satu lagi"),
        ("evidence", "1", None, None, "1", "surat"),
        ("criteria", "1", None, None, "2", "dua"),
        ("name", "2", None, None, None, "Layanan"),
        ("narrative", "III", "PENUTUP", "Umum", None, "akhir INDIKATOR 3 ID-3 Tidak"),
    ]


def test_report(spark):
    record = "3,5\n2\n1.5\n4\n3,25\nBaik\n7\n"
    text = (
        f"Kesimpulan\nhasil\nbaik\nTindak Lanjut dan Rekomendasi\n● hilang\n1. Perkuat:\n● satu\nlanjut\n- dua\n2. Kosong\nMendukung Arah Transformasi\n12 |\n{record}Kabupaten A\nBarat\n{record}Kota B\n3\n"
        "Tabel 9. Hasil Evaluasi SPBE Kementerian\nNama Instansi: Badan X; D1: 3,0; D2: 2; D3: 1; D4: 3; Indeks: 2,25; Predikat: Cukup\nNama Instansi: Salah; D1: 1.2.3; D2: 2; D3: 1; D4: 3; Indeks: 2,25; Predikat: Cukup"
    )
    told, scores = D.report_parts(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert parts(told, "kind", "number", "title", "text") == [
        ("conclusion", None, "Kesimpulan Evaluasi", "hasil baik"), ("recommendation", "1", "Perkuat", "satu lanjut"), ("recommendation", "1", "Perkuat", "dua"), ("recommendation", "2", "Kosong", ""),
    ]
    assert parts(scores, "name", "kind", "d1", "score", "grade") == [
        ("Kabupaten A Barat", "Pemerintah Kabupaten", 3.5, 3.25, "Baik"), ("Kota B", "Pemerintah Kota", 3.5, 3.25, "Baik"), ("Badan X", "Kementerian", 3.0, 2.25, "Cukup"),
    ]


def test_overlapping_records_leftmost_wins(spark):
    text = "\n".join(["1", "1", "1", "1", "1", "Baik", "5", "9"] * 1 + ["2", "2", "2", "2", "Cukup", "6", "Nama"])
    _, scores = D.report_parts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert parts(scores, "n", "name", "grade") == [(0, "9", "Baik")]


def test_paragraphs(spark):
    text = "hilang\n# Satu\na\nb\n\nc\nBAB II Dua\nd"
    got = D.report_paragraphs(D.text_lines(spark.createDataFrame([(1, text), (2, "x\n\ny")], "doc_id long, text string")))
    assert sorted(map(tuple, got.select("doc_id", "n", "heading", "level", "text").collect())) == [
        (1, 2, "Satu", 1, "a\nb"), (1, 5, "Satu", 1, "c"), (1, 7, "BAB II Dua", 1, "d"), (2, 0, "Dokumen", 1, "x"), (2, 2, "Dokumen", 1, "y"),
    ]


def test_kind(spark):
    rows = [("x", "Pedoman Aparatur Reformasi.pdf", "", "pedoman_spbe"), ("x", "evaluasi_spbe 2024", "peraturan", "laporan_spbe"), ("x", "a", "laporan", "laporan"), ("x", "perpres 95", "", "peraturan"), ("BAB II\nPasal 3", "a", "", "peraturan"), ("x", "hasil audit", "", "laporan"), ("pasal 1 pasal 2 pasal 3", "a", "", "peraturan"), ("x", "a", "", "laporan")]
    df = spark.createDataFrame(rows, "text string, name string, hint string, want string")
    assert df.where(D.document_kind(F.col("text"), F.col("name"), F.col("hint")) != F.col("want")).count() == 0


def test_made_regulations_choose_their_parser_by_the_first_piece(spark, tmp_path):
    from korpusa.plans.regulations import document_kinds

    rows = [(10 ** (size % 5), "a" * (size - 4) + "\nmore") for size in (1799, 1800, 1886)] + [(7, "one line"), (8, "  \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kind for r in document_kinds(spark, str(tmp_path)).where("made = 'regulations'").collect()}
    assert got == {10000: "peraturan", 1: "laporan", 10: "laporan", 7: "laporan", 8: "laporan"}
