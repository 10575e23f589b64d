"""Parsers of document kinds as line automata: regulations, guides, circular letters, guidelines, evaluation reports, reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.formats import written
from .automata import HERE, Machine, run

# Patterns of headings and labels: fixed values.
CHAPTER = re.compile(r"^(?:#+\s*)?BAB\s+([IVXLCDM]+)\b[.\s]*(.*)$", re.I)
PART = re.compile(r"^(?:#+\s*)?Bagian\s+(\w+)\b[.\s]*(.*)$", re.I)
ARTICLE = re.compile(r"^\s*(?:#+\s*)?(?:\*\*\s*)?Pasal\s+(\d+)\s*(?:\*\*)?\s*(.*?)\s*$", re.I)
CLAUSE = re.compile(r"^\s*\((\d+)\)\s+(.+)")
GUIDE_CHAPTER = re.compile(r"^(?:#+\s*)?(?:\*\*\s*)?BAB\s+([IVXLCDM]+)(?:\s+(.*?))?(?:\s*\*\*)?$", re.I)
BOLD_TITLE = re.compile(r"^(?:#+\s*)?(?:\*\*\s*)?(.*?)(?:\s*\*\*)?$")
SECTION = re.compile(r"^(?:#+\s*)?(?:\*\*\s*)?(\d+)\.\s+(?:\*\*\s*)?(.*?)(?:\s*\*\*)?$", re.I)
FIRST_SECTION = re.compile(r"^(?:#+\s*)?(?:\*\*\s*)?(?:1\.\s+|SURAT\s*EDARAN)", re.I)
RECIPIENTS = re.compile(r"Yth\.|Kepada", re.I)
SECTION_WORDS = ("LATAR", "MAKSUD", "TUJUAN", "RUANG", "DASAR", "ISI", "LSI", "PENUTUP")
SECTIONS = ("latar_belakang", "maksud_dan_tujuan", "ruang_lingkup", "dasar_hukum", "isi_edaran", "penutup")
FOOTER = re.compile(r"-\d+-\s+jdih\.menpan\.go\.id", re.I)
HEADING = re.compile(r"^(#{1,4})\s+(.+)$")
NAMED_HEADING = re.compile(r"^(?:BAB|Bab|BAGIAN|Bagian|LAMPIRAN|Lampiran)\s+.+$")
SCORE_TABLE = re.compile(r"^Tabel\s+\d+\.\s*Hasil Evaluasi SPBE\s+(.+)$", re.I)
SCORE_ROW = r"(?i)Nama Instansi:\s*([^;]+);.*?D1:\s*([\d,.]+);.*?D2:\s*([\d,.]+);.*?D3:\s*([\d,.]+);.*?D4:\s*([\d,.]+);.*?Indeks:\s*([\d,.]+);.*?Predikat:\s*([^;]+)"
GRADES = ("Sangat Baik", "Baik", "Cukup", "Kurang", "Sangat Kurang")


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n, line)``: all lines of each text, blank ones too; null texts have none."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def joined(lines: Column | str, sep: str = "\n") -> Column:
    """The lines of a group in order of ``n`` as one text, without white space around it."""
    cell = F.struct(F.col("n"), (F.col(lines) if isinstance(lines, str) else lines).alias("x"))
    return stripped(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["x"]), sep))


def appendix_starts(lines: DataFrame, key: str) -> DataFrame:
    """``(key, start)``: the first line that begins with "lampiran" below a blank line, else the first that does at all; never a text's first line."""
    heads = lines.where((F.col("n") > 0) & F.lower(F.substring("line", 1, 8)).eqNullSafe("lampiran")).select(key, "n")
    above = heads.select(F.col(key).alias("k"), (F.col("n") - 1).alias("m"))
    blank = lines.where("line = ''").join(above, F.col(key).eqNullSafe(F.col("k")) & (F.col("n") == F.col("m")), "left_semi").select(key, (F.col("n") + 1).alias("n"))
    both = heads.withColumn("b", F.lit(False)).unionByName(blank.withColumn("b", F.lit(True)))
    return both.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("b"), F.col("n"))), F.min("n")).alias("start"))


def _flagged(lines: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    starts = starts.withColumnRenamed(key, "k")
    met = lines.join(starts, F.col(key).eqNullSafe(F.col("k")), "left")
    return met.select(key, "n", "line", (F.col("n") == F.coalesce("start", F.lit(-1))).cast("int").alias("flag"))


# --- regulations --------------------------------------------------------------------------------------------


def _regulation(state: int, line: str, flag: int) -> tuple[int, dict[str, str | None], str]:
    """States: 0 above any chapter, 1 in a chapter outside articles, 2 in an article, 3 in one of its clauses, 4 appendix."""
    if state == 4 or flag:
        return 4, {}, "appendix"
    s = line.strip()
    none = {"pasal_at": None, "pasal": None, "ayat_at": None, "ayat": None}
    if m := CHAPTER.match(s):
        return 1, none | {"bab_at": HERE, "bab": m[1].upper(), "bab_title": m[2].strip(), "bagian": None}, "chapter"
    if m := PART.match(s):
        return min(state, 1), none | {"bagian": f"{m[1]} - {m[2].strip()}"}, "part"
    if m := ARTICLE.match(s):
        return 2, none | {"pasal_at": HERE, "pasal": m[1]}, "article"
    if state >= 2 and (m := CLAUSE.match(s)):
        return 3, {"ayat_at": HERE, "ayat": m[1]}, "clause"
    return state, {}, ("preamble", "intro", "body", "clause")[state]


REGULATION = Machine(5, ("bab_at", "bab", "bab_title", "bagian", "pasal_at", "pasal", "ayat_at", "ayat"), _regulation)


def regulation_parts(lines: DataFrame, key: str = "doc_id", segment: int | None = None) -> DataFrame:
    """``(key, n, kind, bab, bab_title, bagian, pasal, ayat, text)``: preamble, chapter intros, articles, clauses and appendix of regulations.

    An article's text is what stands beside its heading and above its first clause. ``n`` is the place of the part's first line.
    """
    read = run(_flagged(lines, appendix_starts(lines, key), key), REGULATION, key, **({"segment": segment} if segment else {}))
    kind = F.when(F.col("role").isin("article", "body"), "article").otherwise(F.col("role"))
    head = F.regexp_extract("line", r"(?i)^\s*(?:#+\s*)?(?:\*\*\s*)?Pasal\s+\d+\s*(?:\*\*)?\s*(.*?)\s*$", 1)
    body = read.where(~F.col("role").isin("chapter", "part")).withColumn("kind", kind).withColumn("line", F.when(F.col("role") == "article", head).otherwise(F.col("line")))
    at = [F.when(F.col("kind").isin(*kinds), F.col(c)).alias(c) for c, kinds in (("bab_at", ("intro", "article", "clause")), ("pasal_at", ("article", "clause")), ("ayat_at", ("clause",)))]
    names = [c for c in REGULATION.registers if not c.endswith("_at")]
    parts = body.select(key, "kind", "n", "line", *at, *names).groupBy(key, "kind", "bab_at", "pasal_at", "ayat_at").agg(
        F.min("n").alias("n"), joined("line").alias("text"), *[F.first(c).alias(c) for c in names]
    )
    text = F.when(F.col("kind") == "clause", stripped(F.regexp_replace("text", r"^\([0-9]+\)\s*", ""))).otherwise(F.col("text"))
    empty = (text == "") & (F.col("kind") != "article")
    scoped = [F.when(F.col("kind").isin(*kinds), F.col(c)).alias(c) for c, kinds in (("bab", ("intro", "article", "clause")), ("bab_title", ("intro", "article", "clause")), ("bagian", ("article", "clause")), ("pasal", ("article", "clause")), ("ayat", ("clause",)))]
    return parts.where(~empty).select(key, "n", "kind", *scoped, text.alias("text"))


#: Which register tells parts of a kind apart, and which names they have; a kind without has one part a text.
PLACES = {"intro": "bab_at", "article": "pasal_at", "clause": "ayat_at"}
NAMES = {"intro": ("bab", "bab_title"), "article": ("bab", "bab_title", "bagian", "pasal"), "clause": ("bab", "bab_title", "bagian", "pasal", "ayat")}
SPACE = " \t\n\x0b\f\r"


def _stripped(x: str) -> str:
    """What stripped() gives: a last line end that is no white space to it stays, less the white space before."""
    return (x[:-1].rstrip(SPACE) + x[-1]).lstrip(SPACE) if x.endswith(("\x85", "\u2028", "\u2029")) else x.strip(SPACE)


def parts_of_regulation(text: str) -> Iterator[dict]:
    """The rows of regulation_parts() for one text, in order, with ``pasal_at``: one pass, for texts that stand in one row."""
    lines = text.split("\n")
    heads = [n for n, x in enumerate(lines) if n and x[:8].lower() == "lampiran"]
    start = next((n for n in heads if lines[n - 1] == ""), heads[0] if heads else -1)
    state, held, parts = 0, dict.fromkeys(REGULATION.registers), {}
    for n, line in enumerate(lines):
        state, sets, role = _regulation(state, line, n == start)
        for r, v in sets.items():
            held[r] = n if v == HERE else v
        if role in ("chapter", "part"):
            continue
        kind = "article" if role == "body" else role
        key = kind, held.get(PLACES.get(kind))
        if key not in parts:
            names = dict.fromkeys(("bab", "bab_title", "bagian", "pasal", "ayat")) | {c: held[c] for c in NAMES.get(kind, ())}
            parts[key] = {"n": n, "kind": kind, "pasal_at": held["pasal_at"], **names, "lines": []}
        parts[key]["lines"].append(ARTICLE.match(line.strip())[2] if role == "article" else line)
    for part in parts.values():
        whole = _stripped("\n".join(part.pop("lines")))
        if part["kind"] == "clause":
            whole = _stripped(re.sub(r"^\([0-9]+\)[ \t\n\x0b\f\r]*", "", whole))
        if whole or part["kind"] == "article":
            yield part | {"text": whole}


def regulation_header(docs: DataFrame, key: str = "doc_id", text: str = "text", beside: tuple[str, ...] = ()) -> DataFrame:
    """``(key, jenis, nomor, tahun, tentang)`` from the lines of the first 1,500 characters, where a title page has them; other columns ``beside`` them."""
    lines = F.transform(F.split(F.substring(text, 1, 1500), "\n"), stripped)
    named = F.filter("l", lambda x: x.rlike(r"(?i)(?:PERATURAN|UNDANG|PERPRES|PERMEN|SURAT\s+EDARAN|NOMOR)") & x.rlike(r"(?i)NOMOR[:\s]+\d+[/\w.-]*\s+TAHUN\s+\d{4}"))
    kinds = F.filter("l", lambda x: x.rlike(r"(?i)^(?:PERATURAN|SURAT\s+EDARAN|KEPUTUSAN)") & (F.length(x) < 100))

    def about(i: Column) -> Column:
        ahead = F.slice("l", i + 2, 4)
        ends = F.array_position(F.transform(ahead, lambda x: (x == "") | x.rlike("(?i)DENGAN RAHMAT|PRESIDEN|MENTERI")), F.lit(True))
        return F.array_join(F.when(ends > 0, F.slice(ahead, 1, (ends - 1).cast("int"))).otherwise(ahead), " ")

    places = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get("l", i).rlike("(?i)TENTANG"))
    found = F.filter(F.transform(places, about), lambda x: stripped(x) != "")
    rows = docs.select(key, *beside, F.coalesce(lines, F.array(F.lit(""))).alias("l"))
    number = F.coalesce(F.get(named, F.lit(0)), F.lit(""))
    pattern = r"(?i)NOMOR[:\s]+(\d+[/\w.-]*)\s+TAHUN\s+(\d{4})"
    return rows.select(
        key,
        *beside,
        F.coalesce(F.element_at(F.when(F.size(kinds) > 0, kinds), -1), F.lit("Peraturan")).alias("jenis"),
        F.regexp_extract(number, pattern, 1).alias("nomor"),
        F.regexp_extract(number, pattern, 2).alias("tahun"),
        stripped(F.coalesce(F.get(found, F.lit(0)), F.lit(""))).alias("tentang"),
    )


# --- guides and circular letters ----------------------------------------------------------------------------


def _guide(state: int, line: str, flag: int) -> tuple[int, dict[str, str | None], str]:
    """States: 0 above any chapter, 1 a chapter whose title is still to come, 2 a chapter with title."""
    s = line.strip()
    if m := GUIDE_CHAPTER.match(s):
        title = (m[2] or "").strip()
        return 2 if title else 1, {"bab_at": HERE, "bab": m[1].upper(), "title": title or None}, "chapter"
    if state == 1 and s and len(m := BOLD_TITLE.match(s)[1]) > 3:
        return 2, {"title": m.strip()}, "title"
    return state, {}, "text"


GUIDE = Machine(3, ("bab_at", "bab", "title"), _guide)


def guide_parts(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n, bab, title, text)`` of a guide's chapters; what stands above the first belongs to it, and texts without chapters have none."""
    read = written(run(lines, GUIDE, key), "read")  # three steps read it
    heads = read.where("bab_at is not null").groupBy(key, "bab_at").agg(F.first("bab").alias("bab"), F.max("title").alias("title"))
    first = heads.groupBy(F.col(key).alias("k")).agg(F.min(F.col("bab_at").cast("long")).alias("first"))
    text = read.where("role = 'text'").join(first, F.col(key).eqNullSafe(F.col("k"))).select(F.col(key).alias("k"), F.coalesce(F.col("bab_at").cast("long"), "first").alias("at"), "n", "line")
    parts = text.groupBy("k", "at").agg(joined("line").alias("text"))
    met = heads.join(parts, F.col(key).eqNullSafe(F.col("k")) & (F.col("bab_at").cast("long") == F.col("at")), "left")
    return met.select(key, F.col("bab_at").cast("long").alias("n"), "bab", "title", F.coalesce("text", F.lit("")).alias("text"))


def _letter(state: int, line: str, flag: int) -> tuple[int, dict[str, str | None], str]:
    """State: recipients (0 to come, 1 here, 2 over) times 7, plus section (0: none yet). 21: appendix. Flag 2: a line that may open the recipients."""
    if state == 21 or flag & 1:
        return 21, {}, "appendix"
    here, section = divmod(state, 7)
    s, roles, sets = line.strip(), [], {}
    if here == 1:
        if FIRST_SECTION.match(s):
            here = 2
        elif len(s) > 3 and not re.match(r"^- \d+ -", s) and not s.startswith("|"):
            roles.append("recipient")
    elif here == 0 and flag & 2 and RECIPIENTS.search(line):
        here = 1
    m = SECTION.match(s)
    if m and m[1] in "123456" and len(m[1]) == 1 and (len(m[2]) < 100 or any(w in m[2].upper() for w in SECTION_WORDS)):
        section, sets = int(m[1]), {"section": m[1], "section_at": HERE}
    elif section:
        roles.append("content")
    return here * 7 + section, sets, "+".join(roles)


LETTER = Machine(22, ("section", "section_at"), _letter)


def letter_parts(lines: DataFrame, key: str = "doc_id", window: int = 100) -> DataFrame:
    """``(key, part, text)`` of circular letters: recipients, the six sections (purpose and objective apart), appendix.

    Recipients start in the first ``window`` lines. Of a section number that comes twice the last one with lines counts.
    """
    heads = lines.where((F.col("n") > 0) & F.col("line").rlike(r"(?i)^\s*(?:#+\s*)?(?:\*\*)?LAMPIRAN(?:\s+.*)?$"))
    flags = _flagged(lines, heads.groupBy(key).agg(F.min("n").alias("start")), key)
    read = written(run(flags.withColumn("flag", F.col("flag") + F.when(F.col("n") < window, 2).otherwise(0)), LETTER, key), "read")  # four steps read it
    people = read.where(F.col("role").contains("recipient")).groupBy(key).agg(joined(F.trim("line")).alias("text")).select(key, F.lit("penerima").alias("part"), "text")
    tail = read.where("role = 'appendix'").groupBy(key).agg(joined("line").alias("text")).select(key, F.lit("lampiran").alias("part"), "text")
    each = read.where(F.col("role").contains("content")).groupBy(key, "section", "section_at").agg(joined("line").alias("text"), F.max("n").alias("end"))
    last = each.groupBy(key, "section").agg(F.max_by("text", "end").alias("text"))
    name = F.get(F.array(*map(F.lit, SECTIONS)), F.col("section").cast("int") - 1)
    basis = F.array_join(F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: F.length(x) > 10), "\n")
    legal = F.regexp_replace(basis, r"(?m)^[- ]+", "")
    whole = last.where("section <> '2'").select(key, name.alias("part"), F.when(F.col("section") == "4", legal).otherwise(F.col("text")).alias("text"))
    aim = last.where("section = '2'")
    purpose = F.regexp_extract("text", r"(?is)(?:#\s+)?(?:[ab]\.\s+)?Maksud(.*?)(?=(?:#\s+)?(?:[ab]\.\s+)?Tujuan|\z)", 1)
    target = F.regexp_extract("text", r"(?is)(?:#\s+)?(?:[ab]\.\s+)?Tujuan(.*)", 1)
    parts = [people, whole, aim.select(key, F.lit("maksud").alias("part"), stripped(purpose).alias("text")), aim.select(key, F.lit("tujuan").alias("part"), stripped(target).alias("text")), tail]
    return reduce(DataFrame.unionByName, parts).where("text <> ''")


# --- guidelines with indicators -----------------------------------------------------------------------------

NARRATIVE, INDICATOR = 5, 9
BARE_CHAPTER = re.compile(r"^BAB\s+([IVXLCDM]+)\s*$", re.I)
LETTERED = re.compile(r"^([A-Z])\.\s+(.*)$")
LAST_CHAPTER = re.compile(r"^BAB III(?:\s|$)", re.I)
ASKED = re.compile(r"^INDIKATOR\s+\d+")
NAME_MARK = re.compile(r"ID-\d+\s*$", re.I)
LABELS = re.compile(r"^(?:(?P<about>Deskripsi Indikator.*?:)|(?P<rules>Ketentuan Penilaian)|Level (?P<level>[1-5])\b|Kriteria (?:(?P<criteria>Level)|(?P<evidence>Bukti Dukung)|(?P<met>pemenuhan)))", re.I)
LABELLED = {"about": (4, {}, "description"), "rules": (3, {}, ""), "criteria": (6, {}, "criteria"), "evidence": (7, {}, "evidence"), "met": (5, {}, "")}
DOMAIN = re.compile(r"^DOMAIN", re.I)


def _narrative(p: int, s: str) -> tuple[int, dict[str, str | None], str]:
    """0 outside, 1 a chapter's title is next, 2 in a chapter, 3 in a lettered section, 4 after a line "I." that may close the chapters."""
    if m := BARE_CHAPTER.match(s):
        return 1, {"bab_at": HERE, "bab": m[1].upper(), "bab_title": None, "sub_at": None, "sub": None, "sub_title": None}, ""
    if p == 0 or (p == 4 and DOMAIN.match(s)):
        return 0, {}, ""
    if p == 1:
        return (2, {"bab_title": s}, "") if s else (1, {}, "")
    if m := LETTERED.match(s):
        return 3, {"sub_at": HERE, "sub": m[1], "sub_title": m[2].strip()}, ""
    return (4, {}, "") if s == "I." else (max(p, 2) if p != 4 else 2, {}, "narrative")


def _indicator(q: int, s: str) -> tuple[int, dict[str, str | None], str]:
    """0 outside, 1 before the name's mark, 2 name, 3 between parts, 4 description, 5 level, 6 its criteria, 7 its evidence, 8 over."""
    if q == 8 or LAST_CHAPTER.match(s):
        return 8, {}, ""
    if ASKED.match(s):
        return 1, {"ind_at": HERE, "level": None}, "head"
    if q == 0:
        return 0, {}, ""
    if q == 1:
        return (2 if NAME_MARK.search(s) else 1), {}, "head"
    if m := LABELS.match(s):
        if m.lastgroup == "level":
            return 5, {"level": m["level"]}, ""
        if m.lastgroup in ("about", "rules") or q >= 5:
            return LABELLED[m.lastgroup]
    return q, {}, ("", "head", "name", "", "description", "", "criteria", "evidence")[q]


def _guideline(state: int, line: str, flag: int) -> tuple[int, dict[str, str | None], str]:
    s = (FOOTER.sub("", line) if "-" in line else line).strip()
    (p, a, x), (q, b, y) = _narrative(state // INDICATOR, s), _indicator(state % INDICATOR, s)
    return p * INDICATOR + q, a | b, f"{x}|{y}"


GUIDELINE = Machine(NARRATIVE * INDICATOR, ("bab_at", "bab", "bab_title", "sub_at", "sub", "sub_title", "ind_at", "level"), _guideline)


def guideline_parts(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n, kind, number, title, sub, level, text)``: narrative sections, and name, description, criteria and evidence of the indicators.

    Narrative (kind ``narrative``): number and title of the chapter, ``sub`` the lettered section ("A. title"; "Umum" for a chapter
    without any; text above the first letter is left out). Indicators stand above chapter III; ``number`` counts them in order.
    """
    read = run(lines, GUIDELINE, key).where("role <> '|' or sub_at is not null or ind_at is not null").withColumn("line", stripped(F.when(F.col("line").contains("-"), F.regexp_replace("line", r"(?i)-\d+-\s+jdih\.menpan\.go\.id", "")).otherwise(F.col("line"))))
    read = written(read, "read")  # five steps read it
    told = read.where(F.col("role").startswith("narrative|"))
    lettered = read.where("sub_at is not null").select(F.col(key).alias("k"), F.col("bab_at").alias("b")).distinct()
    general = told.where("sub_at is null").join(lettered, F.col(key).eqNullSafe(F.col("k")) & (F.col("bab_at") == F.col("b")), "left_anti")
    rows = told.where("sub_at is not null").unionByName(general)
    text = stripped(F.regexp_replace(joined("line"), r"\n+", " "))
    sub = F.when(F.first("sub").isNotNull(), F.concat(F.first("sub"), F.lit(". "), F.first("sub_title"))).otherwise("Umum")
    narrative = rows.groupBy(key, "bab_at", "sub_at").agg(F.min("n").alias("n"), F.first("bab").alias("number"), F.first("bab_title").alias("title"), sub.alias("sub"), text.alias("text"))
    kind = F.regexp_extract("role", r"\|(.*)", 1)
    labelled = F.regexp_replace("line", r"(?i)^(?:Deskripsi Indikator.*?:|Kriteria Level|Kriteria Bukti Dukung)", "")
    asked = read.withColumn("kind", kind).where(F.col("kind").isin("name", "description", "criteria", "evidence")).withColumn("line", labelled)
    facts = asked.groupBy(key, "ind_at", "kind", "level").agg(F.min("n").alias("n"), text.alias("text"))
    marks = read.where("ind_at is not null").select(F.col(key).alias("k"), F.col("ind_at").alias("i")).distinct()
    order = marks.groupBy("k").agg(F.array_sort(F.collect_list(F.col("i").cast("long"))).alias("places"))
    met = facts.join(order, F.col(key).eqNullSafe(F.col("k")))
    number = F.array_position("places", F.col("ind_at").cast("long")).cast("string")
    none = F.lit(None).cast("string")
    return narrative.select(key, "n", F.lit("narrative").alias("kind"), "number", "title", "sub", none.alias("level"), "text").unionByName(
        met.select(key, "n", "kind", number.alias("number"), none.alias("title"), none.alias("sub"), "level", "text")
    ).where("text <> ''")


# --- evaluation reports -------------------------------------------------------------------------------------

SKIP = 7
AFTER_CONCLUSION = re.compile(r"^(?:Tindak Lanjut|Tabel)", re.I)
BULLET = re.compile(r"^(?:\d+\.|●|-)")
AFTER_ADVICE = re.compile(r"^(?:Tabel \d+|Mendukung Arah Transformasi)", re.I)
POINT = re.compile(r"^(\d+)\.\s+(.*)")
CONCLUSIONS = re.compile(r"^Kesimpulan\s*$", re.I)
ADVICE = re.compile(r"^Tindak Lanjut dan Rekomendasi\s*$", re.I)
ROW = re.compile(SCORE_ROW)


def _report(state: int, line: str, flag: int) -> tuple[int, dict[str, str | None], str]:
    """States: 0 open, 1 conclusions, 2 recommendations above any point, 3 in a point, 4 in an action of a point, 5 in an action of none.

    5 + k: k more lines of a record that began above; so of overlapping candidates (flag) the leftmost wins.
    """
    if state > 5:
        return (0 if state == 6 else state - 1), {}, "record"
    s = line.strip()
    if state == 1:
        if not AFTER_CONCLUSION.match(s):
            return 1, {}, "conclusion"
    elif state >= 2:
        bullet = BULLET.match(s)
        if state >= 4 and not bullet:
            return state, {}, "action" if state == 4 else ""
        if state >= 4 or not AFTER_ADVICE.match(s):
            if m := POINT.match(s):
                return 3, {"point_at": HERE, "point": m[1], "point_title": re.sub(r":$", "", m[2]).strip(), "action_at": None}, "point"
            if s.startswith(("●", "-")):
                return (5, {}, "") if state in (2, 5) else (4, {"action_at": HERE}, "action")
            return (2 if state in (2, 5) else 3), {}, ""
    if CONCLUSIONS.match(s):
        return 1, {"conclusion_at": HERE}, ""
    if ADVICE.match(s):
        return 2, {"point_at": None, "action_at": None}, ""
    if m := SCORE_TABLE.match(s):
        return 0, {"table_kind": m[1].strip()}, ""
    if ":" in s and ROW.search(s):
        return 0, {}, "row"
    return (5 + SKIP, {}, "candidate") if flag else (0, {}, "")


REPORT = Machine(6 + SKIP, ("table_kind", "conclusion_at", "point_at", "point", "point_title", "action_at"), _report)


def report_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n, line, flag, ahead)``: trimmed lines without blank ones and page numbers; flag 1 where eight lines look like a record.

    A record is five numbers, a grade, a running number and a name, a line each. ``ahead`` holds the grade's line on to the name and the line after.
    """
    kept = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: (x != "") & ~x.rlike(r"^\d+\s*\|$"))
    number = lambda i: F.coalesce(F.get("l", i).rlike(r"^(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)$"), F.lit(False))
    at = lambda i: F.coalesce(F.get("l", i), F.lit(""))
    fits = lambda i: number(i) & number(i + 1) & number(i + 2) & number(i + 3) & number(i + 4) & at(i + 5).isin(*GRADES) & at(i + 6).rlike("^[0-9]+$") & (at(i + 7) != "")
    rows = docs.select(key, kept.alias("l")).where(F.size("l") > 0)
    each = F.transform("l", lambda x, i: F.struct(x.alias("line"), F.when(fits(i), 1).otherwise(0).alias("flag"), F.when(fits(i), F.slice("l", i + 1, 9)).alias("ahead")))
    return rows.select(key, F.posexplode(each).alias("n", "x")).select(key, "n", "x.*")


def _institution(name: Column, other: Column) -> Column:
    has = lambda *words: F.lit(False) if not words else reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    return F.when(has("Kab.", "Kabupaten"), "Pemerintah Kabupaten").when(has("Kota"), "Pemerintah Kota").when(has("Provinsi"), "Pemerintah Provinsi").otherwise(other)


def report_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts and scores of evaluation reports.

    Texts ``(key, n, kind, number, title, text)``: conclusions, and the actions of each recommendation (a point without any gives one
    row with an empty text). Scores ``(key, n, name, kind, d1, d2, d3, d4, score, grade)``: from linearised rows and eight-line records;
    of records that overlap the first one counts. A line after a record that is no number and no heading ends its name.
    """
    rows = report_lines(docs, key, text)
    read = written(run(rows, REPORT, key).where("role not in ('', 'record')"), "read")  # six steps read it
    ends = read.where("role = 'conclusion'").groupBy(key, "conclusion_at").agg(F.min("n").alias("n"), joined("line", " ").alias("text"))
    none = F.lit(None).cast("string")
    told = ends.select(key, "n", F.lit("conclusion").alias("kind"), none.alias("number"), F.lit("Kesimpulan Evaluasi").alias("title"), "text")
    action = F.when(F.col("role") == "action", F.regexp_replace("line", r"^[●\- ]+", ""))
    points = read.where("role in ('point', 'action')").groupBy(key, "point_at", "action_at").agg(F.min("n").alias("n"), F.first("point").alias("number"), F.first("point_title").alias("title"), joined(action, " ").alias("text"))
    with_actions = points.where("action_at is not null").select(F.col(key).alias("k"), F.col("point_at").alias("p")).distinct()
    bare = points.where("action_at is null").join(with_actions, F.col(key).eqNullSafe(F.col("k")) & (F.col("point_at") == F.col("p")), "left_anti")
    advice = points.where("action_at is not null").unionByName(bare).select(key, "n", F.lit("recommendation").alias("kind"), "number", "title", "text")
    num = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    got = lambda i: F.regexp_extract("line", SCORE_ROW, i)
    name = F.trim(got(1))
    flat = read.where("role = 'row'").select(key, "n", name.alias("name"), _institution(name, F.coalesce("table_kind", F.lit("Instansi"))).alias("kind"), *[num(got(i + 1)).alias(c) for i, c in enumerate(("d1", "d2", "d3", "d4", "score"), 1)], F.trim(got(7)).alias("grade"))
    won = read.where("role = 'candidate'").select(F.col(key).alias("k"), F.col("n").alias("m"))
    met = rows.where("flag = 1").join(won, F.col(key).eqNullSafe(F.col("k")) & (F.col("n") == F.col("m")), "left_semi")
    cell = lambda i: F.get("ahead", F.lit(i))
    more = F.when(cell(8).rlike(r"^(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)$") | cell(8).rlike("(?i)^(?:Kesimpulan|Tabel|Tindak Lanjut|No)"), None).otherwise(cell(8))
    long_name = F.concat_ws(" ", cell(7), more)
    piled = met.select(key, "n", long_name.alias("name"), _institution(cell(7), F.lit("Kementerian")).alias("kind"), *[num(cell(i)).alias(c) for i, c in enumerate(("d1", "d2", "d3", "d4", "score"))], cell(5).alias("grade"))
    scores = flat.unionByName(piled)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("d1", "d2", "d3", "d4", "score")])
    return told.unionByName(advice), scores.where(whole)


# --- other reports ------------------------------------------------------------------------------------------


def _sections(state: int, line: str, flag: int) -> tuple[int, dict[str, str | None], str]:
    """State: 1 below a heading, plus 2 inside a paragraph."""
    s = line.strip()
    m = HEADING.match(s)
    if m or NAMED_HEADING.match(s):
        return 1, {"head_at": HERE, "heading": (m[2] if m else s).strip(), "level": str(len(m[1]) if m else 1), "para_at": None}, "heading"
    if not s:
        return state & 1, {}, ""
    return state | 2, ({} if state & 2 else {"para_at": HERE}), "text"


PARAGRAPHS = Machine(4, ("head_at", "heading", "level", "para_at"), _sections)


def report_paragraphs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n, heading, level, text)``: paragraphs of reports under their headings.

    Paragraphs above the first heading are left out; a text without headings is one section, "Dokumen".
    """
    read = written(run(lines, PARAGRAPHS, key).where("role <> ''"), "read")  # three steps read it
    headed = read.where("role = 'heading'").select(F.col(key).alias("k")).distinct()
    paras = read.where("role = 'text'").groupBy(key, "head_at", "para_at").agg(F.min("n").alias("n"), F.first("heading").alias("heading"), F.first("level").cast("int").alias("level"), joined("line").alias("text"))
    loose = paras.where("head_at is null").join(headed, F.col(key).eqNullSafe(F.col("k")), "left_anti").withColumns({"heading": F.lit("Dokumen"), "level": F.lit(1)})
    return paras.where("head_at is not null").unionByName(loose).select(key, "n", "heading", "level", "text")


def document_kind(text: Column, name: Column, hint: Column) -> Column:
    """The parser for a document, from its file name, a folder's hint and its first 2,000 characters, in this order of rules."""
    low, file = F.lower(F.substring(text, 1, 2000)), F.lower(name)
    has = lambda *words: reduce(lambda a, b: a | b, [file.contains(w) for w in words])
    return (
        F.when(file.contains("pedoman") & file.contains("aparatur") & file.contains("reformasi"), "pedoman_spbe")
        .when(has("evaluasi spbe", "evaluasi_spbe"), "laporan_spbe")
        .when(hint != "", hint)
        .when(has("perpres", "permen", "peraturan", "bssn", "uu_", "pp_"), "peraturan")
        .when(low.rlike(r"pasal\s+\d+") & low.rlike(r"bab\s+[ivxlcdm]+"), "peraturan")
        .when(has("laporan", "evaluasi", "audit", "hasil"), "laporan")
        .when(F.regexp_count(low, F.lit(r"pasal\s+\d+")) >= 3, "peraturan")
        .otherwise("laporan")
    )
