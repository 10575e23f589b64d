"""Stored chunks as records, display paths of sources, chunks of figures, expectations on answers; native expressions.

Defined results: metadata that is null, no JSON or no object counts as empty; a null value inside it counts as
missing; an integer field that holds no integer gets its default; a flag is false for ``false``, ``0`` and the
empty text, true for all else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import figure_kind

#: Text fields of a record; missing ones are empty.
TEXTS = (
    "context_header", "document_title", "hierarchy", "filename", "doc_type", "bab", "bagian", "pasal", "ayat", "parent_pasal_text", "section", "section_part",
    "tentang", "table_context", "table_label", "original_table",
)
#: Integer fields with their defaults, flags with theirs.
NUMBERS = {"chunk_part": None, "chunk_parts_total": None}
FLAGS = {"is_parent": False, "is_table": False, "is_indexed": True}
INTEGER = r"^[ ]*[+-]?[0-9]+[ ]*$"
#: Kinds of figures and outcomes of an extraction that give no chunk.
SKIPPED_KINDS, SKIPPED_METHODS = ("photo",), ("skipped", "failed")
EDGES = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"


def filled(*values: Column) -> Column:
    """First value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def chunk_record(chunk_id: Column, index: Column, text: Column, metadata: Column) -> Column:
    """A stored chunk as one struct: its JSON metadata over its columns, table fields included; the id stays the row's own."""
    given = F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,string>")
    of = lambda name: F.element_at(given, name)
    number = lambda name, rest: F.coalesce(F.when(of(name).rlike(INTEGER), F.trim(of(name)).try_cast("int")), rest).cast("int")
    flag = lambda name, rest: F.coalesce(~F.lower(of(name)).isin("false", "0", ""), F.lit(rest))
    return F.struct(
        chunk_id.alias("id"),
        number("chunk_index", F.coalesce(index, F.lit(0))).alias("chunk_index"),
        filled(of("text"), of("chunk_text"), text).alias("text"),
        filled(of("raw_text"), text, of("text")).alias("raw_text"),
        filled(of("chunk_type"), F.lit("text")).alias("chunk_type"),
        *[filled(of(n)).alias(n) for n in TEXTS],
        *[number(n, F.lit(d)).alias(n) for n, d in NUMBERS.items()],
        *[flag(n, d).alias(n) for n, d in FLAGS.items()],
    )


def capitalised(c: Column) -> Column:
    """Every run of letters with a capital first and small letters after it."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), "")


def named_file(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" "))


def put(label: str, value: Column, close: str = "") -> Column:
    """The value between label and close; null, which concat_ws leaves out, where it is empty."""
    return F.when(value != "", F.concat(F.lit(label), value, F.lit(close)))


def source_path(r: Column) -> Column:
    """``(document, section)`` of a record by its kind: places of a regulation, sections of an audit, else its stored path."""
    document = filled(r["tentang"], r["document_title"], named_file(r["filename"]), F.lit("Dokumen"))
    places = F.concat_ws(" > ", put("", r["bab"]), put("", r["bagian"]), put("Pasal ", r["pasal"]), put("Ayat (", r["ayat"], ")"))
    parts = F.concat_ws(" > ", put("", capitalised(r["section"])), put("Bagian ", r["section_part"]))
    section = F.when(r["doc_type"] == "peraturan", places).when(r["doc_type"] == "audit", parts).otherwise(filled(r["hierarchy"], r["context_header"]))
    return F.struct(document.alias("document"), section.alias("section"))


def legal_path(r: Column) -> Column:
    """``(document, section)`` of a record of any kind by chapter, article and clause alone."""
    document = filled(r["document_title"], named_file(r["filename"]), r["tentang"], F.lit("Dokumen"))
    return F.struct(document.alias("document"), F.concat_ws(" > ", put("", r["bab"]), put("", r["pasal"]), put("Ayat (", r["ayat"], ")")).alias("section"))


def figure_chunks(figures: DataFrame) -> DataFrame:
    """``(doc_id, figure_id, kind, context_header, section, table_context, text)``: one chunk a figure that was read.

    figures: (doc_id, figure_id, page, figure_number, caption, width, height, hash, method, detail). Of identical
    images of a document the first by page and id (then by its other fields) stays, by partial minima, so that an image
    on every page is no group of rows; an image without hash is one of its own. Photos, failed and skipped extractions and those without a detail give no chunk.
    """
    wanted = figures.withColumn("kind", figure_kind("caption", "width", "height")).where(
        ~F.col("kind").isin(*SKIPPED_KINDS) & ~F.coalesce("method", F.lit("failed")).isin(*SKIPPED_METHODS) & F.coalesce(F.col("detail").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    )
    image = F.coalesce("hash", F.concat(F.lit("figure "), "figure_id")).alias("image")
    kept = wanted.groupBy("doc_id", image).agg(F.min(F.struct("page", "figure_id", "kind", "figure_number", "caption", "method", "detail")).alias("f")).select("doc_id", "f.*")
    caption = F.coalesce("caption", F.lit(""))
    return kept.select(
        "doc_id", "figure_id", "kind", F.concat(F.lit("Figure: "), filled(F.col("figure_number"), F.lit("Figure"))).alias("context_header"), caption.alias("section"),
        F.concat("kind", F.lit("|"), "figure_id", F.lit("|page:"), F.col("page").cast("string"), F.lit("|"), "method").alias("table_context"),
        F.when(caption == "", F.col("detail")).otherwise(F.regexp_replace(F.concat(caption, F.lit("\n\n"), "detail"), EDGES, "")).alias("text"),
    )


def unmet(answer: Column, doc_ids: Column, score: Column, unavailable: Column, any_of: Column, allowed: Column, least: Column, claim: Column) -> Column:
    """What an answer fails of its expectations, in order; an expectation that is null asks nothing."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    leaks = F.array_sort(F.array_distinct(F.filter(F.transform(doc_ids, lambda d: F.trim(d)), lambda d: d.isNotNull() & (d != "") & ~F.array_contains(allowed, d))))
    return F.filter(
        F.array(
            F.when(~F.exists(any_of, lambda w: low.contains(F.lower(w))), "keyword"),
            F.when(F.size(leaks) > 0, F.concat(F.lit("leakage:"), F.array_join(leaks, "|"))),
            F.when(least.isNotNull() & (score.isNull() | (score < least)), "score"),
            F.when(claim != F.coalesce(unavailable, F.lit(False)), "unavailable"),
        ),
        lambda x: x.isNotNull(),
    )
