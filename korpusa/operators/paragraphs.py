"""Documents without articles in chunks of paragraphs; chunks with tables get their heading, label and what stands beside them.

Only chunk numbers come from Python, over the sizes of a document's paragraphs; headings are a bounded frame, neighbours a window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_pipe_table

#: Largest chunk, characters of each neighbour beside a table, paragraphs before a table in which its heading is sought.
MOST, BESIDE, ABOVE = 900, 500, 4
# Patterns of headings and labels: fixed values.
HEADING = r"^(?:#{1,4}\s+|\*\*\s*)(.{5,120})(?:\s*\*\*)?$"
TABLE_HEADING = r"(?i)^(?:\*\*\s*)?(?:Tabel|Table)\s+\d{1,3}\.?\s*.+"
LABEL = r"(?i)(?:\*\*\s*)?(?:Tabel|Table)\s+(\d{1,3})\.?\s*([^\n|*]{0,80})"


def chunk_numbers(sizes: pd.Series, most: pd.Series) -> pd.Series:
    """A chunk number for each size, in order: a chunk ends before the item that would take it beyond ``most``."""

    def one(given: list[int], limit: int) -> list[int]:
        out, at, held = [], 0, 0
        for i, size in enumerate(given):
            if i and held + size > limit:
                at, held = at + 1, 0
            held += size
            out.append(at)
        return out

    return pd.Series([one(g, m) for g, m in zip(sizes, most, strict=True)])


def heading(paragraph: Column) -> Column:
    """What a paragraph says as a heading, null if it is none: Markdown or bold of 5 to 120 characters, or a line that names a table."""
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"^\*+|\*+$", ""))
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_extract(paragraph, HEADING, 1)), r"\*+$", ""))
    return F.when(paragraph.rlike(HEADING), plain).when(paragraph.rlike(TABLE_HEADING), bare(paragraph))


def label(text: Column) -> Column:
    """``Tabel n. Title`` or ``Tabel n`` of the first table that a text names, null if it names none."""
    n, title = F.regexp_extract(text, LABEL, 1), F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, LABEL, 2)), r"\*+$", ""))
    return F.when(n != "", F.when(title == "", F.concat(F.lit("Tabel "), n)).otherwise(F.concat(F.lit("Tabel "), n, F.lit(". "), title)))


def paragraphs(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``(doc_id, title, n, chunk_index, text, above)``: non-blank paragraphs, trimmed, with chunk number and nearest heading.

    ``n`` counts blank ones too; ``above`` is the last heading of the ABOVE paragraphs before.
    """
    numbers = F.pandas_udf(chunk_numbers, "array<int>")
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), trimmed.alias("all"))
    placed = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("n"), x.alias("text"))), lambda x: x["text"] != "")
    rows = rows.withColumn("p", placed).withColumn("c", numbers(F.transform("p", lambda x: F.length(x["text"])), F.lit(most)))
    spread = rows.select("doc_id", "title", F.explode(F.arrays_zip("p", "c")).alias("x")).select("doc_id", "title", "x.p.n", F.col("x.c").alias("chunk_index"), "x.p.text")
    # by place, not by row: blank paragraphs count among the four
    before = Window.partitionBy("doc_id").orderBy("n").rangeBetween(-ABOVE, -1)
    return spread.withColumn("above", F.last(heading(F.col("text")), ignorenulls=True).over(before))


def paragraph_chunks(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Chunks of ``docs(doc_id, title, text)`` by paragraphs, each under the document's title; ``doc_id`` is unique.

    Columns: ``doc_id, chunk_index, chunk_type, context_header, section, table_label, table_context, parent_text, is_parent, raw_text, text``.
    A chunk with a pipe table is of type "table": its header is title, nearest heading before it and label (its own, else one that the
    chunk before names), its context the end of the chunk before and the start of the one after, its parent the chunk before.
    A paragraph over ``most`` is a chunk of its own. Null and blank texts give no chunk, a null title is empty.
    """
    rows = paragraphs(docs, most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    chunks = rows.groupBy("doc_id", "chunk_index").agg(F.first("title").alias("title"), F.min_by("above", "n").alias("above"), F.max(is_pipe_table("text")).alias("table"), F.array_join(parts, "\n\n").alias("raw_text"))
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    near = chunks.withColumns({"before": F.lag("raw_text").over(order), "after": F.lead("raw_text").over(order)})
    name = F.when(F.col("table"), F.coalesce(label(F.col("raw_text")), label(F.col("before")), F.lit(""))).otherwise("")
    near = near.withColumn("table_label", name).withColumn("above", F.coalesce("above", F.lit("")))
    extra = [F.when((F.col("above") != "") & (F.col("above") != F.col("title")), F.col("above")), F.when((F.col("table_label") != "") & ~F.col("above").contains(F.col("table_label")), F.col("table_label"))]
    near = near.withColumn("context_header", F.when(F.col("table"), F.concat_ws(" > ", "title", *extra)).otherwise(F.col("title")))
    ends = F.concat_ws("\n\n", F.expr(f"right(before, {BESIDE})"), F.expr(f"left(after, {BESIDE})"))
    beside = lambda c: F.when(F.col("table"), F.coalesce(c, F.lit(""))).otherwise("")
    lead = F.when(F.col("table_label") != "", F.concat("table_label", F.lit("\n"))).otherwise("")
    near = near.withColumn("parent_text", beside(F.col("before")))
    return near.select(
        "doc_id", "chunk_index", F.when(F.col("table"), "table").otherwise("text").alias("chunk_type"), "context_header", beside(F.col("context_header")).alias("section"), "table_label",
        beside(ends).alias("table_context"), "parent_text", (F.col("parent_text") == "").alias("is_parent"), "raw_text", F.concat("context_header", F.lit(": "), lead, "raw_text").alias("text"),
    )
