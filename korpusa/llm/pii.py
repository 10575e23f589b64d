"""Personal data in texts, with DataFrame expressions only.

Regular expressions propose spans; validators confirm them (octet range, Luhn, digit counts, mod-97);
words near a span raise or lower its score. The four base kinds (email, ip, card, phone) are kept
whenever their validator holds; the kinds the method adds (iban, ssn, local_phone) are kept when
their score reaches ``KEEP`` and they touch no base span.

Places come from the text itself: splitting at a pattern and extracting its matches give alternating
pieces, and running sums of their lengths (in blocks, so that the work stays near linear even for a
text full of matches) are code-point offsets. The words near a match come from the pieces beside it. Patterns use possessive groups and look-behinds: same
leftmost matches, but linear on long runs and without recursion.

Defined results: null text counts as empty (no spans); very long texts are searched whole; of overlapping
added spans of different kinds (ties) all are listed, and ``mask`` replaces that of the earlier kind; every row keeps its own output row; spans of
one kind never overlap; of the input only doc_id and text are read by ``find``; ``mask`` keeps all
other columns as they are, and leaves null text null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
KINDS = BASE + ADDED
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOCAL = "[A-Za-z0-9._%+-]"

#: kind -> (cheap test that a text can have any, pattern)
PATTERNS = {
    "email": ("contains({t}, '@')", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("{t} rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("{t} rlike '[0-9](?:[ -]?[0-9]){{12}}'", r"[0-9](?:[ -]?[0-9])++"),
    "phone": ("contains({t}, '+')", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": ("{t} rlike '[A-Z][A-Z][0-9][0-9] ?[A-Z0-9]'", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": ("{t} rlike '[0-9]-[0-9][0-9]-[0-9]'", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
    "local_phone": ("{t} rlike '[0-9][) .-]+[0-9]{{3}}[ .-]'", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: kind -> (score of a confirmed span, words nearby that speak for it)
SCORES = {
    "email": (0.7, "e-?mail|contact|mail|write"),
    "ip": (0.5, "ip|address|host|server"),
    "card": (0.8, "card|visa|credit|debit|amex|master"),
    "phone": (0.7, "phone|tel|call|fax|mobile|cell"),
    "iban": (0.8, "iban|bank|account|konto|transfer"),
    "ssn": (0.3, "ssn|social|security|tax"),
    "local_phone": (0.3, "phone|tel|call|fax|mobile|cell"),
}
AGAINST = "version|example|sample|order|invoice|isbn|serial"
WORD_BONUS, WORD_MALUS, KEEP, NEAR = 0.2, 0.2, 0.5, 40
RUN = 256
#: Matches beside a match that hold NEAR characters at least: each has two and more.
PIECES = NEAR // 2


def confirmed(kind: str, x: Column) -> Column:
    """Whether a match of its pattern is one."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(x, F.lit(" "), F.lit(""))
        moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
        mod = F.aggregate(
            F.split(moved, ""),
            F.lit(0),
            lambda a, c: F.when(c == "", a)
            .when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97)
            .otherwise((a * 100 + F.ascii(c) - 55) % 97)
            .cast("int"),
        )
        return F.length(plain).between(15, 34) & (mod == 1)
    return F.lit(True)


def found(df: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds ``found_<kind>``: confirmed spans as array<struct<start, end, score>>."""
    gate, pattern = PATTERNS[kind]
    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    test = F.expr(gate.format(t=f"`{text}`"))
    df = df.withColumn(
        f"m_{kind}", F.when(test, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    )
    df = df.withColumn(f"p_{kind}", F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(
        f"s_{kind}", F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
    )
    s = F.col(f"s_{kind}")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    runs = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(
        f"r_{kind}",
        F.aggregate(
            runs,
            F.array(F.lit(0).cast("long")),
            lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(s, k * RUN + 1, RUN)))),
        ),
    )
    r = F.col(f"r_{kind}")
    numbered = F.filter(F.transform(m, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: confirmed(kind, y["x"]))

    def placed(y: Column) -> Column:
        run = F.floor(y["i"] / RUN).cast("int")
        start = F.get(r, run) + total(F.slice(s, run * RUN + 1, y["i"] % RUN)) + F.length(F.get(p, y["i"]))
        return F.struct(start.cast("long").alias("start"), (start + F.length(y["x"])).cast("long").alias("end"), y["i"].alias("i"))

    base, words = SCORES[kind]

    # what stands beside a match, from the pieces beside it: no walk through the text for each match
    tails, heads = F.col(f"e_{kind}"), F.col(f"b_{kind}")
    glued = lambda a, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x, y)), "")

    def before(i: Column) -> Column:
        own, first = F.get(tails["p"], i), F.greatest(i - PIECES, F.lit(0))
        more = glued(F.slice(tails["p"], first + 1, i - first), F.slice(tails["m"], first + 1, i - first))
        return F.when(F.length(own) >= NEAR, own).otherwise(F.right(F.concat(more, own), F.lit(NEAR)))

    def after(i: Column) -> Column:
        own, n = F.get(heads["p"], i + 1), F.least(F.lit(PIECES), F.size(m) - i - 1)
        more = glued(F.slice(heads["m"], i + 2, n), F.slice(heads["p"], i + 3, n))
        return F.when(F.length(own) >= NEAR, own).otherwise(F.left(F.concat(own, more), F.lit(NEAR)))

    def scored(y: Column) -> Column:
        near = F.concat(before(y["i"]), F.lit(" | "), after(y["i"]))
        score = (
            F.lit(base)
            + F.when(near.rlike(rf"(?i)\b(?:{words})"), WORD_BONUS).otherwise(0.0)
            - F.when(near.rlike(rf"(?i)\b(?:{AGAINST})"), WORD_MALUS).otherwise(0.0)
        )
        return F.struct(y["start"].alias("start"), y["end"].alias("end"), F.round(score, 2).alias("score"))

    cut = lambda way: F.struct(F.transform(p, lambda x: way(x, F.lit(NEAR))).alias("p"), F.transform(m, lambda x: way(x, F.lit(NEAR))).alias("m"))
    df = df.withColumns({f"at_{kind}": F.transform(numbered, placed), f"e_{kind}": cut(F.right), f"b_{kind}": cut(F.left)})
    df = df.withColumn(f"found_{kind}", F.transform(F.col(f"at_{kind}"), scored))
    return df.drop(*[f"{x}_{kind}" for x in "mpsreb"], f"at_{kind}")


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``found_<kind>`` for every kind; added kinds are already settled against base spans and KEEP."""
    for kind in KINDS:
        df = found(df, text, kind)
    taken = F.concat(*[F.col(f"found_{k}") for k in BASE])
    for kind in ADDED:
        free = F.filter(
            F.col(f"found_{kind}"),
            lambda s: (s["score"] >= KEEP) & ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        df = df.withColumn(f"found_{kind}", free)
    return df


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed, then start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(f"found_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, found_<kind>...)``; each found column is array<struct<start, end, score>>."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_spans(df, "text")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; other columns unchanged."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row__"), F.coalesce("text", F.lit("")).alias("text__"))
    df, free = with_spans(inner, "text__"), F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def named(kind: str) -> Column:
        return F.transform(f"found_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def clear_of(spans: Column, taken: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    for kind in KINDS:  # earlier kinds win where spans of different kinds overlap
        df = df.withColumn("free__", F.concat(free, clear_of(named(kind), free)))
        free = F.col("free__")
    df = df.withColumn("all__", F.array_sort("free__"))
    spans, text = F.col("all__"), F.col("text__")

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, (before + 1).cast("int"), (s["start"] - before).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    tail = F.substring(text, (F.element_at(spans, -1)["end"] + 1).cast("int"), F.lit(2147483647))
    new = F.when(F.size(spans) == 0, F.col("row__.text")).otherwise(F.concat(F.array_join(F.transform(spans, piece), ""), tail))
    return df.select(*[new.alias("text") if c == "text" else F.col(f"row__.`{c}`").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        F.array_join(F.concat(*[F.transform(f"found_{k}", lambda s: s["score"].cast("string")) for k in KINDS]), ",").alias("scores"),
    )
