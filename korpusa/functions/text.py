"""Text rules for Indonesian regulations and reports: cleaning, labels, intent, expansion, focus terms.

Word boundaries are spelled with ASCII classes, so that plans and SQL agree on every input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import any_of, col, one_space

WORD = "[\\p{L}\\p{N}_]+"
TABLE_NUMBER = r"\b(?:tabel|table)\s*(?:ke[-\s]*)?([0-9]{1,3})\b"
INDICATOR_NUMBER = r"\b(?:indikator|id)[-\s]*(?:ke[-\s]*)?([0-9]{1,3})\b"
ARTICLE_NUMBER = r"\bpasal\s+([0-9]+)\b"
#: Abbreviations and what they stand for, fixed values.
FULL_FORMS = {
    "spbe": "sistem pemerintahan berbasis elektronik",
    "tik": "teknologi informasi dan komunikasi",
    "bssn": "badan siber dan sandi negara",
    "ippd": "instansi pusat dan pemerintah daerah",
}
#: Words that carry no topic in a question, fixed values.
STOPWORDS = (
    "yang dan atau dari pada untuk dalam dengan sebagai adalah agar maka karena apa siapa bagaimana kapan dimana berdasarkan menurut tolong jelaskan "
    "sebutkan isi tentang nomor tahun pasal ayat dokumen peraturan tersebut itu ini dapat jika mohon"
).split()
GUARDRAIL_STOPWORDS = (
    "yang dan atau dari pada untuk dalam dengan apa siapa bagaimana kapan dimana jelaskan sebutkan tolong berdasarkan peraturan tentang isi dokumen"
).split()


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def key_tokens(c: Column | str, least: int = 4) -> Column:
    """Distinct tokens of at least ``least`` characters."""
    return F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= least))


def clean_text(c: Column | str) -> Column:
    """Without image links, span tags and page marks; at most three newlines in a row; trimmed."""
    out = F.regexp_replace(col(c), r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"</?span[^>]*>", "")
    out = F.regexp_replace(out, r"\*\*\s*-?\s*[0-9]+\s*-?\s*\*\*", "")
    return F.trim(F.regexp_replace(out, r"\n{4,}", "\n\n\n"))


def strip_html(c: Column | str) -> Column:
    """Visible words of a page: comments, scripts, styles and tags out, white space collapsed."""
    out = F.regexp_replace(col(c), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    return one_space(F.regexp_replace(out, r"<[^>]*>", " "))


def strip_emphasis(c: Column | str) -> Column:
    """Without any ``**`` and ``__``, runs of spaces as one."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\*\*|__", ""), "  +", " ")


def is_table_like(c: Column | str) -> Column:
    """A pipe plus the word tabel; or three lines of which two are ``key: value; ...``, or one where tabel is named."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: F.trim(x) != "")
    pairs = F.size(F.filter(lines, lambda x: x.contains(":") & x.contains(";")))
    named = F.lower(col(c)).contains("tabel")
    return (col(c).contains("|") & named) | ((F.size(lines) >= 3) & ((pairs >= 2) | (named & (pairs >= 1))))


def is_pipe_table(c: Column | str) -> Column:
    return F.size(F.filter(F.split(col(c), "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)) >= 2


def table_label(c: Column | str) -> Column:
    """``Tabel N`` for the first table mentioned, else empty."""
    n = F.regexp_extract(F.lower(col(c)), TABLE_NUMBER, 1)
    return F.when(n == "", "").otherwise(F.concat(F.lit("Tabel "), n))


def classify_query(c: Column | str) -> Column:
    q = F.lower(F.coalesce(col(c), F.lit("")))
    return (
        F.when(q.rlike(r"\btabel\b|\btable\b"), "table")
        .when(q.rlike(r"\bindikator\b|\bid[-\s]*[0-9]+"), "indikator")
        .when(q.rlike(r"\bpasal\b|\bayat\b|\bperpres\b|\bpermenpan\b|\bpp\s*[0-9]+\b|\bse\s+menteri\b"), "pasal")
        .otherwise("general")
    )


def _any(c: Column, words: list[str]) -> Column:
    return any_of(*[c.contains(w) for w in words])


#: Words in file names and texts that tell a document's type, fixed values.
REGULATION_FILES = ["perpres", "pp_", "permen", "peraturan", "se_"]
REGULATION_TEXTS = ["peraturan presiden", "peraturan pemerintah", "peraturan menteri"]
STRUCTURE_FILES = ["perpres", "permen", "peraturan", "bssn", "uu_", "pp_"]
REPORT_FILES = ["laporan", "evaluasi", "audit", "hasil"]
UPLOAD_FILES = ["pp", "perpres", "permen", "peraturan"]


def stored_type(name: Column | str, text: Column | str) -> Column:
    """peraturan, audit or other: of a stored document, by file name and the first 2,000 characters (part of the rule)."""
    n, t = F.lower(col(name)), F.lower(F.substring(col(text), 1, 2000))
    return F.when(_any(n, REGULATION_FILES) | _any(t, REGULATION_TEXTS), "peraturan").when(_any(n, ["audit", "laporan"]), "audit").otherwise("other")


def structure_type(name: Column | str, text: Column | str, hint: Column | str = "") -> Column:
    """The parser of a document, by file name, a folder's hint and the first 2,000 characters (part of the rule)."""
    n, t = F.lower(col(name)), F.lower(F.substring(col(text), 1, 2000))
    hinted = F.lit(hint) if isinstance(hint, str) else hint
    articles = F.regexp_count(t, F.lit(r"pasal\s+[0-9]+"))
    return (
        F.when(n.contains("pedoman") & n.contains("aparatur") & n.contains("reformasi"), "pedoman_spbe")
        .when(n.rlike("evaluasi[ _]spbe"), "laporan_spbe")
        .when(hinted != "", hinted)
        .when(_any(n, STRUCTURE_FILES) | ((articles > 0) & t.rlike(r"bab\s+[ivxlcdm]+")), "peraturan")
        .when(_any(n, REPORT_FILES), "laporan")
        .when(articles >= 3, "peraturan")
        .otherwise("laporan")
    )


def upload_type(name: Column | str) -> Column:
    n = F.lower(col(name))
    return F.when(n.contains("audit"), "audit").when(_any(n, UPLOAD_FILES), "peraturan").otherwise("other")


def clean_title(c: Column | str) -> Column:
    """Without ``.pdf`` and underscores, spaces and hyphens trimmed."""
    text = F.translate(F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"(?i)\.pdf$", ""), "_", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ -]+|[ -]+$", "")


def regulation_type(c: Column | str) -> Column:
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return (
        F.when(t.rlike(r"peraturan presiden|\bperpres\b"), "perpres")
        .when(t.rlike(r"peraturan menteri|permenpan|\bpermen\b"), "permen")
        .when(t.rlike(r"peraturan pemerintah|\bpp\b"), "pp")
        .when(t.contains("pedoman"), "pedoman")
        .when(t.contains("laporan"), "laporan")
        .otherwise("")
    )


def suspicious_title(c: Column | str) -> Column:
    """Empty, or with number and year where the subject should stand, or with two years."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    twice = (F.regexp_count(t, F.lit("tahun")) >= 2) & t.rlike(r"\bnomor\s+[0-9]+.*\btahun\s+[0-9]{4}.*\btahun\s+[0-9]{4}\b")
    return (t == "") | t.rlike(r"\btentang\s+[0-9]+\s+tahun\s+[0-9]{4}\b") | twice


def best_title(title: Column | str, name: Column | str) -> Column:
    """The title, or the file name where that is more to be trusted."""
    t, n = clean_title(title), clean_title(name)
    kinds = regulation_type(t), regulation_type(n)
    apart = (kinds[0] != "") & (kinds[1] != "") & (kinds[0] != kinds[1])
    doubtful = apart | suspicious_title(t) | ((F.length(t) < 12) & (F.length(n) > F.length(t)))
    return F.when(t == "", F.when(n == "", "Dokumen").otherwise(n)).when((n != "") & doubtful, n).otherwise(t)


def about_text(c: Column | str) -> Column:
    """Subject phrase without its leading word; all capitals become title case, known abbreviations stay."""
    text = F.trim(F.regexp_replace(clean_title(c), r"^(?i:tentang)\s+", ""))
    titled = F.initcap(text)
    for word in ("SPBE", "TIK", "BSSN"):
        titled = F.regexp_replace(titled, rf"\b{word.capitalize()}\b", word)
    titled = F.regexp_replace(titled, r"\bPan\s*Rb\b", "PAN RB")
    loud = (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) > 6)
    return F.regexp_replace(F.when(loud, titled).otherwise(text), r"^[ -]+|[ -]+$", "")


def cover_title(title: Column | str, name: Column | str, about: Column | str) -> Column:
    """Title with its subject, as on a document's cover."""
    base, subject = best_title(title, name), about_text(about)
    plain = (subject == "") | suspicious_title(subject) | F.lower(base).contains(F.lower(subject)) | F.lower(base).contains("tentang")
    return F.when(plain, base).when(base == "Dokumen", subject).otherwise(F.concat(base, F.lit(" tentang "), subject))


def ordered_unique(c: Column) -> Column:
    """First of each value, compared case-insensitively; nulls and blanks out."""
    some = F.filter(c, lambda x: x.isNotNull() & (x != ""))
    return F.filter(some, lambda x, i: F.array_position(F.transform(some, F.lower), F.lower(x)) == i + 1)


def expand_query(c: Column | str, most: int = 6) -> Column:
    """The question and up to five anchored variants, in order, without repeats."""
    q = one_space(F.coalesce(col(c), F.lit("")))
    low = F.lower(q)
    number, year = F.regexp_extract(low, r"nomor\s+([0-9]+)", 1), F.regexp_extract(low, r"tahun\s+([0-9]{4})", 1)
    article, table = F.regexp_extract(low, r"pasal\s+([0-9]+)", 1), F.regexp_extract(low, TABLE_NUMBER, 1)
    full = FULL_FORMS["spbe"]
    dated = (number != "") & (year != "")
    add = lambda test, *parts: F.when(test, F.concat_ws(" ", q, *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    variants = [q]
    variants += [add(low.rlike(rf"\b{short}\b"), long) for short, long in FULL_FORMS.items()]
    variants.append(add(article != "", "pasal", article))
    variants.append(add(table != "", "tabel", table))
    variants.append(add(table != "", "lampiran tabel", table))
    variants.append(add((table != "") & dated, "tabel", table, "nomor", number, "tahun", year))
    asks = low.rlike("definisi|pengertian") & (low.contains("spbe") | low.contains(full))
    phrase = f"yang dimaksud dengan {full}"
    variants.append(
        F.when(asks & dated, F.concat_ws(" ", q, F.lit("pasal 1 perpres nomor"), number, F.lit("tahun"), year, F.lit(phrase)))
        .when(asks & low.contains("perpres"), F.concat_ws(" ", q, F.lit(f"pasal 1 perpres {phrase}")))
        .when(asks, F.concat_ws(" ", q, F.lit(f"pasal 1 {phrase}")))
    )
    return F.slice(ordered_unique(F.array(*variants)), 1, most)


def focus_terms(c: Column | str, most: int = 8, stop: list[str] = STOPWORDS) -> Column:
    """Topic words of a question: three letters or two digits at least, unique, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]{2,})"), F.lit(1))
    kept = F.filter(found, lambda t: ~t.isin(stop) & (t.rlike("^[0-9]+$") | (F.length(t) >= 3)))
    return F.slice(F.array_distinct(kept), 1, most)


def citation_ids(c: Column | str) -> Column:
    """Distinct ``[n]`` numbers in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.try_cast("bigint")))


def sanitize_citations(c: Column | str, sources: Column | str) -> Column:
    """Text without ``[n]`` that exceed the number of sources, spaces tidied."""
    found = F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(\[[0-9]+\])"), F.lit(1)))
    number = lambda x: F.regexp_extract(x, "[0-9]+", 0).try_cast("bigint")
    bad = F.filter(found, lambda x: ~F.coalesce((number(x) >= 1) & (number(x) <= col(sources)), F.lit(False)))
    out = F.aggregate(bad, col(c), lambda t, x: F.replace(t, x, F.lit("")))
    for what, by in (("  +", " "), (r" +\.", "."), (" +,", ",")):
        out = F.regexp_replace(out, what, by)
    return F.trim(out)


#: Figure kinds and the caption words that tell them, in order of test; fixed values.
FIGURE_KINDS = [
    ("pie_chart", r"\b(pie|lingkaran)\b"),
    ("bar_chart", r"\b(bar|batang)\b"),
    ("line_chart", r"\b(line|garis|tren|capaian.*tahun|indeks.*[0-9]{4})\b"),
    ("bar_chart", r"\b(grafik|chart)\b"),
    ("timeline_image", r"\b(lini masa|timeline|kronologi)\b"),
    ("diagram", r"\b(diagram|struktur|alur|hierarki|kriteria|peta|tingkat)\b"),
    ("photo", r"\b(foto|presiden)\b|tim pelaksanaan"),
    ("table_image", r"\btabel\b"),
]


def figure_kind(caption: Column | str, w: Column | str, h: Column | str) -> Column:
    """Kind of a figure by its caption; without a telling word by its shape."""
    text = F.lower(F.coalesce(col(caption), F.lit("")))
    rest = F.when((col(h) > 0) & (col(w) / F.nullif(col(h), F.lit(0)) > 2.5), "timeline_image").otherwise("diagram")
    return F.coalesce(*[F.when(text.rlike(p), kind) for kind, p in FIGURE_KINDS], rest)


def split_summary(c: Column | str) -> Column:
    """``(summary, detail)`` of a figure description: its labelled parts, else its first paragraph and the others."""
    labelled = [F.trim(F.regexp_extract(col(c), p, 1)) for p in (r"(?is)SUMMARY\s*:\s*(.+?)(?:DETAIL\s*:|$)", r"(?is)DETAIL\s*:\s*(.+)$")]
    parts = F.filter(F.transform(F.split(col(c), "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    rest = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "\n\n")).otherwise(first)
    both = (labelled[0] != "") & (labelled[1] != "")
    return F.struct(F.when(both, labelled[0]).otherwise(first).alias("summary"), F.when(both, labelled[1]).otherwise(rest).alias("detail"))


def ocr_summary(raw: Column | str, caption: Column | str) -> Column:
    """``(summary, detail)`` of recognised text: caption with its first 200 characters, caption with all of it."""
    text = F.trim(col(raw))
    short = F.concat(col(caption), F.lit(": "), F.replace(F.substring(text, 1, 200), F.lit("\n"), F.lit(" ")))
    return F.struct(
        F.when(text == "", F.concat(col(caption), F.lit(": (kosong)"))).otherwise(short).alias("summary"),
        F.when(text == "", col(caption)).otherwise(F.concat(col(caption), F.lit("\n\n"), text)).alias("detail"),
    )
