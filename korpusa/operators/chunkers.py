"""Chunkers by document kind: clauses, paragraphs and actions packed under a limit across rows, with path and part numbers.

Packing is a table function over the rows of one unit (an article, a section, a recommendation), in order; units are
dealt out by key, so nothing gathers a whole document. Chunk numbers are given last, by place in the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.formats import written
from .automata import HERE, Machine, run
from .batches import sliced
from .documents import HEADING, guide_parts, guideline_parts, joined, parts_of_regulation, regulation_header, report_parts
from .parsers import split_rows
from .structure import SIZES, split_recursively

LEAST = 10
TABLE_LABEL = re.compile(r"\btabel\s*(?:ke[-\s]*)?(\d{1,3})\b", re.I)
COLUMNS = ("doc_id", "n", "piece", "hierarchy", "bab", "bagian", "pasal", "ayat", "chunk_part", "chunk_parts", "is_table", "table_label", "text")


def is_table(text: str) -> bool:
    """Linearised tables: a pipe and the word "tabel", two lines of three or more with ":" and ";", or one such and the word."""
    low = text.lower()
    if "|" in text and "tabel" in low:
        return True
    rows = [x for x in map(str.strip, text.splitlines()) if x]
    like = sum(":" in x and ";" in x for x in rows)
    return len(rows) >= 3 and (like >= 2 or (like >= 1 and "tabel" in low))


def table_label(text: str) -> str | None:
    m = TABLE_LABEL.search(text)
    return f"Tabel {m[1]}" if m else None


def linear_table(block: str) -> str:
    """A pipe table as ``header: value; ...`` lines; rows and header are paired as far as both go, cells of "-" stay. One line alone stays as it is."""
    lines = [x for x in map(str.strip, block.splitlines()) if x and not re.match(r"^\|?[\s:\-]+\|[\s|:\-]*$", x)]
    head, *body = [[c for c in map(str.strip, x.split("|")) if c] for x in lines] or [[]]
    rows = ["; ".join(f"{h}: {c}" for h, c in zip(head, cells, strict=False)) for cells in body]
    return "\n".join(filter(None, rows)) or block


def linear_tables(text: str) -> str:
    """A text whose stretches of lines between pipes are linearised."""
    return re.sub(r"(?:^[ \t]*\|[^\n]*\|[ \t]*$\n?)+", lambda m: linear_table(m[0]) + ("\n" if m[0].endswith("\n") else ""), text, flags=re.M)


def limited(text: str, most: int, overlap: int) -> list[tuple[str, bool, str | None]]:
    """Pieces of at most ``most`` characters with table mark and label; a table is cut between rows, its label is that of the whole."""
    whole = (text or "").strip()
    table = is_table(whole)
    pieces = (split_rows(whole, most, overlap) if table else []) or split_recursively(whole, most, overlap)
    label = table_label(whole) if table else None
    return [(p, t := table or is_table(p), (label or table_label(p)) if t else None) for p in pieces]


class Pack:
    """Packs a unit's ``item`` rows (``label``, ``text``) greedily; rows of kind ``lead`` stand above every buffer, or above the first with ``lead_once``."""

    def __init__(self) -> None:
        self.items: list[tuple[str | None, str]] = []
        self.leads: list[str] = []
        self.unit: Row | None = None

    def eval(self, row: Row, most: int, overlap: int, sep: str, lead_once: bool) -> None:
        self.unit = self.unit or row
        self.args = most, overlap, sep, lead_once
        if row["lead"]:
            self.leads.append(row["text"])
        else:
            self.items.append((row["label"], row["text"]))

    def buffers(self) -> Iterator[tuple[str, str | None, str | None]]:
        most, _, sep, lead_once = self.args
        head = "\n".join(x for x in self.leads if x)
        held, first, last = (head, None, None) if lead_once else ("", None, None)
        for label, text in self.items:
            if held and len(held) + len(text) + 1 > most:
                yield held, first, last
                held, first = text, label
            else:
                held, first = (held + sep + text if held else text), first or label
            last = label
        if held:
            yield held, first, last

    def terminate(self) -> Iterator[tuple]:
        if self.unit is None:
            return
        most, overlap, _, lead_once = self.args
        above = "" if lead_once else "\n".join(x for x in self.leads if x)
        got = list(self.buffers()) or ([("", None, None)] if above else [])
        at = 0
        for text, first, last in got:
            span = None if first is None else first if first == last else f"{first}-{last}"
            for piece in split_recursively("\n".join(x for x in (above, text) if x), most, overlap):
                yield self.unit["unit"], at, span, piece
                at += 1


def packed(rows: DataFrame, most: int, overlap: int, sep: str = "\n", lead_once: bool = False) -> DataFrame:
    """``(unit, piece, label, text)`` of ``rows(unit, n, lead, label, text)``: see Pack; each unit is packed for itself, by ``n``."""
    pack = F.udtf(Pack, returnType="unit string, piece int, label string, text string")
    given = rows.select("unit", F.col("n").cast("long").alias("n"), "lead", "label", "text")
    return pack(given.asTable().partitionBy("unit").orderBy("n"), F.lit(most), F.lit(overlap), F.lit(sep), F.lit(lead_once))


def cut(rows: DataFrame, most: int, overlap: int, tables: bool = False) -> DataFrame:
    """``rows`` with ``text`` cut by ``limited()``: adds ``piece``, ``pieces``, ``is_table`` and ``table_label``; with ``tables`` pipe tables are linearised first."""
    pieces = F.udf(lambda t: limited(linear_tables(t or "") if tables else t, most, overlap), "array<struct<text:string,is_table:boolean,table_label:string>>")
    each = rows.withColumn("p", pieces("text"))
    spread = each.withColumn("pieces", F.size("p")).select(*rows.drop("text").columns, "pieces", F.posexplode("p").alias("piece", "x"))
    return spread.select(*rows.drop("text").columns, "piece", "pieces", "x.is_table", "x.table_label", "x.text")


def _chunks(rows: DataFrame, **columns: Column) -> DataFrame:
    text, no = F.lit(None).cast("string"), F.lit(None).cast("int")
    given = {c: text for c in ("bab", "bagian", "pasal", "ayat", "table_label")} | {"chunk_part": no, "chunk_parts": no, "is_table": F.lit(False)} | columns
    return rows.select(*[given[c].alias(c) if c in given else F.col(c) for c in COLUMNS])


def _cut_chunks(rows: DataFrame, size: tuple[int, int], tables: bool = False, **columns: Column) -> DataFrame:
    """Chunks of rows with ``hierarchy`` and whole texts; several pieces of one are numbered in hierarchy and columns."""
    got, many = cut(rows, *size, tables), F.col("pieces") > 1
    part = F.when(many, F.col("piece") + 1)
    path = F.when(many, F.concat("hierarchy", F.lit(" [Bagian "), F.col("piece") + 1, F.lit("/"), "pieces", F.lit("]"))).otherwise(F.col("hierarchy"))
    return _chunks(got.withColumn("hierarchy", path), chunk_part=part, chunk_parts=F.when(many, F.col("pieces")), is_table=F.col("is_table"), table_label=F.col("table_label"), **columns)


def _numbered(chunks: list[DataFrame], kind: str) -> DataFrame:
    """Chunk numbers by place; texts under LEAST characters are left out, their numbers stay free."""
    order = Window.partitionBy("doc_id").orderBy("n", "piece", "hierarchy")
    rows = reduce(DataFrame.unionByName, chunks).withColumn("text", F.trim("text"))
    rows = rows.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int")).where(F.length("text") >= LEAST)
    return rows.select("doc_id", "chunk_index", F.lit(kind).alias("doc_type"), *[c for c in COLUMNS if c not in ("doc_id", "n", "piece")])


def _path(*parts: Column | str) -> Column:
    """Non-empty parts joined by " > "."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")), " > ")


def chunk_regulations(parts: DataFrame, headers: DataFrame, size: tuple[int, int] = SIZES["peraturan"]) -> DataFrame:
    """Chunks of ``regulation_parts()`` with ``regulation_header()``: clauses packed by article, each chunk under its article's name and text."""
    titles = headers.select(F.col("doc_id").alias("d"), F.trim(F.concat_ws(" ", "jenis", "nomor", F.lit("Tahun"), "tahun")).alias("title"))
    rows = written(parts, "parts").join(titles, F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
    bab = F.when(F.col("bab").isNotNull(), F.concat_ws(" - ", F.concat(F.lit("BAB "), "bab"), F.nullif("bab_title", F.lit(""))))
    pasal = F.concat(F.lit("Pasal "), "pasal")
    rows = rows.withColumns({"bab": F.coalesce(bab, F.lit("")), "pasal": F.coalesce(pasal, F.lit("")), "bagian": F.coalesce("bagian", F.lit(""))})
    start = F.max(F.when(F.col("kind").isin("article", "intro"), F.col("n"))).over(Window.partitionBy("doc_id", "bab", "bagian", "pasal", "kind_group").orderBy("n"))
    body = rows.where("kind in ('article', 'clause', 'intro')").withColumn("kind_group", F.when(F.col("kind") == "intro", "intro").otherwise("article")).withColumn("at", start)
    units = body.withColumn("unit", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("at").cast("string")))
    heads = units.where("kind <> 'clause'").select("unit", "doc_id", F.col("at").alias("n"), "title", "bab", "bagian", "pasal")
    lead = F.col("kind") != "clause"
    text = F.when(lead, F.when(F.col("pasal") != "", F.concat_ws("\n", "pasal", F.nullif("text", F.lit("")))).otherwise(F.col("text"))).otherwise(F.concat(F.lit("("), "ayat", F.lit(") "), "text"))
    # an article of a name only has nothing to say
    spoken = units.withColumn("some", F.max((~lead | (F.col("text") != "")).cast("int")).over(Window.partitionBy("unit"))).where("some = 1")
    given = spoken.select("unit", "n", lead.alias("lead"), F.concat(F.lit("("), "ayat", F.lit(")")).alias("label"), text.alias("text"))
    ayat = F.when(F.col("label").isNotNull(), F.concat(F.lit("Ayat "), "label")).otherwise("")
    articles = packed(given, *size).withColumn("ayat", ayat).join(heads, "unit").withColumn("hierarchy", _path("title", "bab", "bagian", "pasal", "ayat"))
    top = rows.where("kind = 'preamble'").withColumn("hierarchy", F.lit("Pembukaan"))
    tail = rows.where("kind = 'appendix'").withColumn("hierarchy", F.concat_ws(" > ", "title", F.lit("Lampiran")))
    same = {c: F.col(c) for c in ("bab", "bagian", "pasal", "ayat")}
    return _numbered([_chunks(articles, **same), _chunks(cut(top, *size)), _chunks(cut(tail, *size), bagian=F.lit("Lampiran"))], "peraturan")


def _regulation_chunks(text: str, title: str, size: tuple[int, int]) -> Iterator[tuple]:
    """``(hierarchy, bab, bagian, pasal, ayat, text)`` of one regulation's chunks by place, short ones too: what chunk_regulations() gives."""
    path = lambda *parts: " > ".join(filter(None, parts))
    units: dict[int, tuple[dict, Pack | None, bool]] = {}  # by place; whether an article has more than its name
    for part in parts_of_regulation(text):
        if part["kind"] in ("preamble", "appendix"):
            units[part["n"]] = part, None, True
            continue
        lead, at = part["kind"] != "clause", part["pasal_at"] if part["kind"] == "clause" else part["n"]
        _, pack, some = units.setdefault(at, (part, Pack(), False))
        pasal, label = f"Pasal {part['pasal']}" if part["pasal"] else "", None if lead else f"({part['ayat']})"
        told = "\n".join(filter(None, (pasal, part["text"]))) if lead else f"{label} {part['text']}"
        pack.eval({"unit": None, "lead": lead, "label": label, "text": told}, *size, "\n", False)
        units[at] = units[at][0], pack, some or not lead or part["text"] != ""
    for part, pack, some in units.values():
        if pack is None:
            tail = part["kind"] == "appendix"
            for piece, _, _ in limited(part["text"], *size):
                yield f"{title} > Lampiran" if tail else "Pembukaan", None, "Lampiran" if tail else None, None, None, piece
        elif some:  # an article of a name only has nothing to say
            bab = "" if part["bab"] is None else " - ".join(filter(None, (f"BAB {part['bab']}", part["bab_title"])))
            bagian, pasal = part["bagian"] or "", f"Pasal {part['pasal']}" if part["pasal"] else ""
            for _, _, label, piece in pack.terminate():
                ayat = f"Ayat {label}" if label else ""
                yield path(title, bab, bagian, pasal, ayat), bab, bagian, pasal, ayat, piece


def chunk_regulation_texts(docs: DataFrame, size: tuple[int, int] = SIZES["peraturan"], held: int = 2048) -> DataFrame:
    """The chunks that chunk_regulations() gives of the lines of ``docs(doc_id, text)``, each text in one pass where its row is: nothing is shuffled or written."""
    title = F.trim(F.concat_ws(" ", "jenis", "nomor", F.lit("Tahun"), "tahun")).alias("title")
    rows = regulation_header(docs.where("text is not null"), beside=("text",)).select("doc_id", "text", title)
    told = ("hierarchy", "bab", "bagian", "pasal", "ayat", "text")

    def batch(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        at, index, *columns = zip(*found, strict=True) if found else [()] * (2 + len(told))
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), *(pa.array(c, pa.string()) for c in columns)], ["doc_id", "chunk_index", *told])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = []
            for at in range(len(b)):
                for index, (*names, piece) in enumerate(_regulation_chunks(b.column("text")[at].as_py(), b.column("title")[at].as_py(), size)):
                    if len(piece := piece.strip(" ")) >= LEAST:
                        found.append((at, index, *names, piece))
                    if len(found) >= held:
                        yield batch(b, found)
                        found = []
            yield batch(b, found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(go, f"doc_id {kind}, chunk_index int, " + ", ".join(f"{c} string" for c in told))
    text, no = F.lit(None).cast("string"), F.lit(None).cast("int")
    given = {"doc_type": F.lit("peraturan"), "chunk_part": no, "chunk_parts": no, "is_table": F.lit(False), "table_label": text}
    return got.select("doc_id", "chunk_index", *[given[c].alias(c) if c in given else F.col(c) for c in ("doc_type", *COLUMNS) if c not in ("doc_id", "n", "piece")])


def chunk_reports(paragraphs: DataFrame, size: tuple[int, int] = SIZES["laporan"]) -> DataFrame:
    """Chunks of ``report_paragraphs()``: paragraphs of a section packed with an empty line between them."""
    at = F.min("n").over(Window.partitionBy("doc_id", "heading", "section"))
    change = F.coalesce(F.lag("heading").over(Window.partitionBy("doc_id").orderBy("n")) != F.col("heading"), F.lit(True))
    rows = written(paragraphs, "paragraphs").withColumn("section", F.sum(change.cast("int")).over(Window.partitionBy("doc_id").orderBy("n")))
    rows = rows.withColumn("at", at).withColumn("unit", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("at").cast("string")))
    heads = rows.groupBy("unit").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("n"), F.first("heading").alias("hierarchy"))
    given = rows.select("unit", "n", F.lit(False).alias("lead"), F.lit(None).cast("string").alias("label"), F.trim("text").alias("text"))
    return _numbered([_chunks(packed(given, *size, "\n\n").join(heads, "unit"), bagian=F.col("hierarchy"))], "laporan")


def chunk_evaluations(docs: DataFrame, year: Column | str, size: tuple[int, int] = SIZES["laporan"]) -> DataFrame:
    """Chunks of evaluation reports ``docs(doc_id, text, ...)``: conclusions, recommendations with their actions, one chunk an institution."""
    told, scores = report_parts(docs)
    told = written(told, "told")
    years = docs.select(F.col("doc_id").alias("d"), (F.col(year) if isinstance(year, str) else year).cast("string").alias("year"))
    titled = lambda df: df.join(years, F.col("doc_id").eqNullSafe(F.col("d"))).drop("d").withColumn("top", F.concat(F.lit("Laporan Evaluasi SPBE Tahun "), F.coalesce("year", F.lit(""))))
    rows = titled(told)
    ends = rows.where("kind = 'conclusion'").withColumn("hierarchy", F.concat_ws(" > ", "top", F.lit("Ringkasan Eksekutif"), "title")).withColumn("text", F.concat_ws(": ", "title", "text"))
    points = rows.where("kind = 'recommendation'")
    at = F.min("n").over(Window.partitionBy("doc_id", "number", "title"))
    points = points.withColumn("at", at).withColumn("unit", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("at").cast("string")))
    name = F.concat(F.lit("Rekomendasi "), "number", F.lit(" - "), "title", F.lit(":"))
    leads = points.groupBy("unit").agg((F.min("n") - 1).alias("n"), F.first(name).alias("text")).select("unit", "n", F.lit(True).alias("lead"), F.lit(None).cast("string").alias("label"), "text")
    actions = points.where("text <> ''").select("unit", "n", F.lit(False).alias("lead"), F.lit(None).cast("string").alias("label"), F.concat(F.lit("• "), "text").alias("text"))
    heads = points.groupBy("unit").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("n"), F.first(F.concat_ws(" > ", "top", F.lit("Rekomendasi Strategis"), F.concat_ws(". ", "number", "title"))).alias("hierarchy"))
    advice = packed(leads.unionByName(actions), *size, "\n", True).join(heads, "unit")
    facts = titled(scores)
    sentence = F.format_string(
        "Laporan Pelaksanaan Evaluasi SPBE Tahun %s. Instansi: %s (%s, Kategori Wilayah: Nasional). Indeks SPBE Akhir: %s (Predikat: %s). "
        "Rincian Nilai Domain: Kebijakan Internal (%s), Tata Kelola (%s), Manajemen SPBE (%s), Layanan SPBE (%s).",
        F.coalesce("year", F.lit("")), "name", "kind", *[F.col(c).cast("string") for c in ("score",)], "grade", *[F.col(c).cast("string") for c in ("d1", "d2", "d3", "d4")],
    )
    places = facts.withColumn("text", sentence).withColumn("hierarchy", F.concat_ws(" > ", "top", F.lit("Data Capaian Instansi")))
    return _numbered(
        [_chunks(cut(ends, *size), bagian=F.lit("Ringkasan Eksekutif")), _chunks(advice, bagian=F.lit("Rekomendasi Strategis")), _cut_chunks(places.select("doc_id", "n", "hierarchy", "text"), size, bagian=F.lit("Data Capaian Instansi"))], "laporan_spbe"
    )


def chunk_guidelines(lines: DataFrame, title: str = "Pedoman", size: tuple[int, int] = SIZES["pedoman"]) -> DataFrame:
    """Chunks of guidelines: narrative sections, and one text an indicator with description, criteria and evidence by level."""
    rows = written(guideline_parts(lines), "parts")
    label = F.concat_ws(" - ", F.concat(F.lit("BAB "), "number"), F.nullif("title", F.lit("")))
    told = rows.where("kind = 'narrative'").withColumns({"bab": label, "bagian": F.col("sub")}).withColumn("hierarchy", F.concat_ws(" > ", F.lit(title), "bab", "bagian"))
    own = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text")))
    level = F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", (F.col("kind") == "evidence").alias("late"), "text")))
    facts = rows.where("kind <> 'narrative'").groupBy("doc_id", "number").agg(F.min("n").alias("n"), own("name").alias("name"), own("description").alias("about"), F.array_sort(level).alias("levels"))
    line = lambda x, i: F.concat(
        F.when((i == 0) | (F.get("levels", i - 1)["level"] != x["level"]), F.concat(F.lit("Tingkat "), x["level"], F.lit(":\n"))).otherwise(""), F.when(x["late"], "- Bukti Dukung: ").otherwise("- Kriteria: "), x["text"]
    )
    head = F.concat(F.lit("Indikator "), "number", F.lit(": "), F.coalesce("name", F.lit("")))
    whole = F.concat_ws("\n", head, F.concat(F.lit("Deskripsi: "), "about"), F.nullif(F.array_join(F.transform("levels", line), "\n"), F.lit("")))
    asked = facts.withColumn("text", whole).withColumn("hierarchy", F.concat_ws(" > ", F.lit(title), F.lit("Lampiran Instrumen"), head))
    return _numbered([_chunks(cut(told, *size), bab=F.col("bab"), bagian=F.col("bagian")), _cut_chunks(asked.select("doc_id", "n", "hierarchy", "text"), size)], "pedoman_spbe")


def chunk_guides(lines: DataFrame, size: tuple[int, int] = SIZES["peraturan"]) -> DataFrame:
    """Chunks of a guide's chapters, numbered where a chapter takes several."""
    label = F.concat_ws(" - ", F.concat(F.lit("BAB "), "bab"), F.nullif("title", F.lit("")))
    rows = guide_parts(lines).withColumn("hierarchy", label).withColumn("text", F.concat_ws("\n", label, F.nullif("text", F.lit(""))))
    return _numbered([_cut_chunks(rows.select("doc_id", "n", "hierarchy", "text"), size, bab=F.regexp_replace("hierarchy", r" \[Bagian [0-9]+/[0-9]+\]$", ""))], "petunjuk_teknis")


def _markdown(state: int, line: str, flag: int) -> tuple[int, dict[str, str | None], str]:
    """One state; headings of levels 1 to 3 are carried, a fourth level's text stays in the body."""
    m = HEADING.match(line.strip())
    if not m:
        return 0, {}, "text"
    level, title = len(m[1]), re.sub(r"\*\*(.+?)\*\*", r"\1", m[2].strip())
    return 0, ({} if level == 4 else {"at": HERE, f"h{level}": title} | {f"h{x}": None for x in range(level + 1, 4)}), "text" if level == 4 else "heading"


MARKDOWN = Machine(1, ("at", "h1", "h2", "h3"), _markdown)


def chunk_markdown(lines: DataFrame, titles: DataFrame, size: tuple[int, int] = SIZES["laporan"]) -> DataFrame:
    """Chunks of ``lines`` by Markdown headings, the way out where structure gives few; ``titles(doc_id, title)``. Pipe tables become ``header: value`` lines."""
    read = run(lines, MARKDOWN).withColumn("line", F.regexp_replace("line", r"^\s*#{4}\s+", ""))
    parts = read.where("role = 'text'").groupBy("doc_id", "at").agg(F.min("n").alias("n"), *[F.first(c).alias(c) for c in ("h1", "h2", "h3")], joined("line").alias("text")).where("text <> ''")
    met = parts.join(titles.select(F.col("doc_id").alias("d"), "title"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
    path = _path("title", "h1", "h2", "h3")
    bab = F.upper(F.regexp_extract(F.concat_ws("\n", "h1", "h2"), r"(?i)\bBAB\s+([IVXLCDM]+)\b", 1))
    rows = met.withColumns({"hierarchy": F.when(path == "", "Dokumen").otherwise(path), "bab": F.when(bab == "", "").otherwise(F.concat(F.lit("BAB "), bab)), "bagian": F.coalesce("h2", "h1", "h3", "title")})
    return _numbered([_cut_chunks(rows.select("doc_id", "n", "hierarchy", "text", "bab", "bagian"), size, True, bab=F.col("bab"), bagian=F.col("bagian"))], "md_fallback")
