from pyspark.sql import functions as F

from korpusa.operators import audit

SOURCE = "array<struct<id:int,section:string,context_header:string,pasal:string,ayat:string>>"


def test_audit(spark):
    sources = [(1, "Pasal 5", "Ayat (2)", None, None), (2, None, "", "Pasal 7", "3"), (None, "Pasal 9", "", "", "")]
    rows = [
        ("Menurut Pasal 5 ayat (2)\n\n dikutip [1]", sources, (1, 2, 0, 0, True)),
        ("pasal 6 Ayat 2 dan Pasal 7 [1][2]", sources, (1, 3, 1, 0, False)),
        ("Pasal 7 ayat (3) [2]\nPasal 1", sources, (2, 3, 1, 0, False)),
        ("Pasal 5\na\nb [1]", sources, (0, 0, 0, 0, True)),
        ("Pasal 5 [3]", sources, (0, 0, 0, 0, True)),
        ("Pasal 5 Ayat (1) [4]", [(4, "", "", "", "")], (1, 2, 0, 2, True)),
        (None, sources, (0, 0, 0, 0, True)),
        ("Pasal 5 [1]", None, (0, 0, 0, 0, True)),
    ]
    df = audit.audited(spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(rows)], f"i int, answer string, sources {SOURCE}"))
    got = {r.i: tuple(r)[1:] for r in df.select("i", *audit.totals(F.col("audit"))).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows)}
    one = df.where("i = 1").selectExpr("audit[0] as x").first().x
    assert one.missing_pasals == ["6"] and one.cited == ["1", "2"] and one.line.startswith("pasal 6")


def test_scrub(spark):
    df = spark.createDataFrame([("Pasal 1 Ayat (2) isi  ayat (3)", True), ("Pasal 1 ayat (2)", False)], "a string, u boolean")
    assert [r[0] for r in df.select(audit.scrubbed(F.col("a"), F.col("u"))).collect()] == ["Pasal 1 isi", "Pasal 1 ayat (2)"]
