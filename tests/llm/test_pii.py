import hashlib
import random
import re

from korpusa.llm import pii


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x, d: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x, d: 13 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x, d: 9 <= len(d) <= 15),
}


def brute(text):
    out = {}
    for k, (p, ok) in RULES.items():
        out[k] = [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return out


def check(spark, texts, tmp_path):
    rows = [(i, t, "extra", 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, found_email string, all__ int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = brute(t), got[i]
        for k in pii.BASE:
            assert r[f"n_{k}"] == len(want[k]), (t, k, r.spans)
        base = ",".join(x for k in pii.BASE for x in want[k])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (t, r.spans, base)
        assert r.spans.startswith(base)
    return got


def test_base_spans_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "x@y.zz", "_", "%", "-", "+", " ", ".", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "é", "😀", "\n", "(", ")", "+1 (743) 555-3824", "0", "00", "5500005555555559"]
    texts = [None, "", "😀 a@b.c_x@d.e 1.2.3.4.5.6.7.8", *("".join(rng.choice(bits) for _ in range(rng.randrange(18))) for _ in range(1500))]
    texts += ["a@b.cc " * 700 + "10.0.0.1 " * 600, "1 " * 30000, "9" * 50000, "a" * 60000, "a." * 30000 + "@", "+1" * 5000, "1." * 40000, "(" * 1000 + "+1" + "(" * 20000]
    check(spark, texts, tmp_path)


def test_added_kinds_and_scores(spark, tmp_path):
    texts = [
        "IBAN GB82 WEST 1234 5698 7654 32 please",
        "IBAN GB82 WEST 1234 5698 7654 33 please",
        "my ssn is 123-45-6789",
        "order 123-45-6789",
        "call me: 555-123-4567 or +1 (555) 123-4567",
    ]
    got = check(spark, texts, tmp_path)
    assert got[0].spans == "iban:5:32" and got[1].spans == ""
    assert got[2].spans == "ssn:10:21" and got[3].spans == ""
    assert got[4].spans == "phone:25:42,local_phone:9:21"


def test_mask_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "é mail a@b.cc, 10.0.0.1!", "s", 3), (2, None, None, None), (2, None, None, None), (3, "clean", "x", 1)], "doc_id long, text string, source string, found_ip int")
    got = sorted(map(tuple, pii.mask(df).collect()), key=str)
    assert pii.mask(df).columns == df.columns
    assert got == sorted([(1, "é mail [EMAIL], [IP]!", "s", 3), (2, None, None, None), (2, None, None, None), (3, "clean", "x", 1)], key=str)
    assert pii.mask(df.limit(0)).collect() == []


def test_plan_is_native(spark, sf):
    plan = pii.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_words_nearby_move_the_scores(spark, tmp_path):
    rows = [(1, "write an e-mail to a@b.cc"), (2, "sample a@b.cc"), (3, "x a@b.cc y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.scores for r in pii.query(spark, str(tmp_path)).collect()} == {1: "0.9", 2: "0.5", 3: "0.7"}


def test_long_text_full_of_matches(spark):
    """A megabyte of addresses: places of all, scores by the words beside each, in time linear in the text."""
    unit, n = "mail a@b.cc order call 0 xx ", 36_000
    row = pii.find(spark.createDataFrame([(1, unit * n)], "doc_id long, text string")).select("found_email").first()[0]
    assert [s.start for s in row] == [len(unit) * i + 5 for i in range(n)]
    assert {s.score for s in row} == {0.7}  # a word for and a word against each
