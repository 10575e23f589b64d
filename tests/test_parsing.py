"""Parsers on small documents."""

from korpusa.operators import parsers
from korpusa.plans import parsing


def rows(spark, name):
    return parsing.QUERIES[name](spark, "").collect()


def test_indicator_blocks(spark):
    got = sorted((r.doc_id, r.indicator, r.domain, r.aspect, r.name, r.question, r.criteria) for r in rows(spark, "indicator_blocks") if r.doc_id == 1)
    assert got == [
        (1, 5, 1, 2, "Tim Koordinasi", "Apakah ada tim koordinasi?", "tingkat_1=Belum ada.|tingkat_2=Ada konsep."),
        (1, 6, 1, 2, "Layanan", "Bagaimana layanan?", "tingkat_1=Rintisan.|tingkat_5=Optimum."),
    ]


def test_markdown_sections(spark):
    got = [(r.path, r.text) for r in sorted(rows(spark, "markdown_sections"), key=lambda r: r.n) if r.doc_id == 1]
    assert got == [
        ("Laporan", "pengantar"), ("Laporan > Hasil", "baris a\nbaris b"), ("Laporan > Hasil > Rinci", "rinci satu"), ("Laporan > Saran", "saran satu"),
        ("Lampiran", "isi lampiran\nGambar 1. Alur\nakhir"),
    ]


def test_letter_sections(spark):
    got = {r.section: (r.title, r.recipients, r.text) for r in rows(spark, "letter_sections") if r.doc_id == 1}
    assert got["2"] == ("Maksud dan Tujuan", "Para Pimpinan Instansi", "Maksud satu. Tujuan dua.") and len(got) == 3


def test_figure_injection(spark):
    text = rows(spark, "figure_injection")[0].text
    assert "Gambar 1. Alur\n\n[Gambar 1] alur layanan\nakhir" in text and text.endswith("\n\n[Gambar 9] peta\n") and "Gambar 2]" not in text


def test_rules(spark):
    assert {(r.id, r.name) for r in rows(spark, "hierarchy_confusion")} == {(1, "tim koordinasi")}
    assert {r.id: r.roles for r in rows(spark, "role_lists")} == {1: '["admin","user"]', 2: "[]", 3: "[]", 4: "[]"}
    got = {(r.query_id, r.id): r.score for r in rows(spark, "scored_table_literals")}
    assert got[1, 4] == 3.35 and got[2, 3] == 3.85
    cover = {r.id: (r.must_cover, r.as_list) for r in rows(spark, "grounding_guardrails")}
    assert cover[2] == ("langkah, evaluasi, mandiri", True) and cover[4] == ("", False)


def test_split_rows_limits():
    text = "\n".join(f"baris {i}: nilai {i * 7}; ket" for i in range(60)) + "\n" + "y" * 500
    parts = parsers.split_rows(text, 120, 40)
    assert all(len(p) <= 120 for p in parts)
    for a, b in zip(parts, parts[1:]):
        if "y" not in b:
            assert b.split("\n")[0] in a
