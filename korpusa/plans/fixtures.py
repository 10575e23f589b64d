"""Small inline inputs for rules whose words the driver's synthetic texts do not contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTIONS = [
    (1, "apa isi tabel 13?"),
    (2, "isi dari tabel ke-2 permen nomor 59 tahun 2020"),
    (3, "apa isi pasal 5 perpres nomor 95 tahun 2018?"),
    (4, "jelaskan definisi SPBE menurut perpres"),
    (5, "berapa bobot indikator 30?"),
    (6, "tabel di pasal 5 berisi apa"),
    (7, "jelaskan domain evaluasi TIK dan BSSN"),
    (8, "  pengertian   SPBE  nomor 95 tahun 2018 "),
    (9, ""),
]
QUESTION_SCHEMA = "query_id bigint, text string"

CHUNKS = [
    (1, 1, 0, "Peraturan Presiden Nomor 95 Tahun 2018", "peraturan", "BAB I > Pasal 1", "Ketentuan Umum", "BAB I", "Pasal 1", "", False, "", "Dalam Peraturan Presiden ini yang dimaksud dengan Sistem Pemerintahan Berbasis Elektronik yang selanjutnya disingkat SPBE adalah penyelenggaraan pemerintahan."),
    (2, 1, 1, "Peraturan Presiden Nomor 95 Tahun 2018", "peraturan", "BAB II > Pasal 5", "Tata Kelola", "BAB II", "Pasal 5", "1", False, "", "Pasal 5 ayat 1 mengatur rencana induk SPBE nasional."),
    (3, 2, 0, "Peraturan Menteri Nomor 59 Tahun 2020", "peraturan", "Lampiran > Tabel 2", "Lampiran", "", "", "", True, "Tabel 2", "Tabel 2 memuat bobot domain; Domain 1: 13; Domain 2: 25"),
    (4, 2, 1, "Peraturan Menteri Nomor 59 Tahun 2020", "peraturan", "Lampiran > Tabel 13", "Lampiran", "", "", "", True, "Tabel 13", "Tabel 13 memuat kriteria indikator 30"),
    (5, 3, 0, "Pedoman Evaluasi SPBE", "pedoman", "Domain 4 > Indikator 30", "Indikator 30", "", "", "", False, "", "Indikator 30 menilai tingkat kematangan layanan."),
    (6, 3, 1, "Pedoman Evaluasi SPBE", "pedoman", "Domain 4 > Indikator 31", "", "", "", "", False, "", "Indikator 31 melengkapi indikator 30 pada layanan pengaduan."),
    (7, 4, 0, "Laporan Hasil Evaluasi", "laporan", "Kesimpulan", "", "", "", "", False, "", "Hasil evaluasi menunjukkan predikat baik."),
]
CHUNK_SCHEMA = (
    "id bigint, doc_id bigint, chunk_index int, document_title string, doc_type string, hierarchy string, context_header string, bab string, "
    "pasal string, ayat string, is_table boolean, table_label string, text string"
)

ANSWERS = [
    (1, "apa isi tabel 2", "Tabel 2 memuat bobot domain", "Bobot domain tabel 2:\n1. Domain 1 sebesar 13 [1]\n2. Domain 2 sebesar 25 [1]", 2),
    (2, "sebutkan langkah evaluasi mandiri", "langkah evaluasi mandiri meliputi tahap persiapan", "Informasi itu tidak ditemukan dalam dokumen.", 1),
    (3, "siapa penanggung jawab layanan", "penanggung jawab layanan adalah pimpinan instansi", "Penanggung jawab layanan adalah pimpinan instansi pusat [1], lihat juga [7] .", 3),
    (4, "apa itu audit", "", "", 0),
]
ANSWER_SCHEMA = "id bigint, question string, context string, answer string, sources int"

REGULATION = (
    "PERATURAN CONTOH\nBAB I\nKETENTUAN UMUM\nPasal 1\nDalam peraturan ini yang dimaksud dengan contoh adalah naskah uji.\n"
    "BAB II\nPENYELENGGARAAN\nPasal 2\n(1) Setiap instansi menyusun rencana.\n(2) Rencana ditinjau tiap tahun.\nPasal 3\nKetentuan ini berlaku sejak ditetapkan."
)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], schema: str) -> str:
    """The same rows as a SQL table expression."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    cols = [c.strip().split() for c in schema.split(",")]
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    body = ", ".join("(" + ", ".join(f"CAST({one(x)} AS {kinds[t]})" for x, (_, t) in zip(r, cols, strict=True)) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(c for c, _ in cols)})"
