"""Parsers of the other document kinds, as line tables with carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .structure import split_recursively


def carried(rows: DataFrame, above: list[str], name: str, value: Column) -> DataFrame:
    """Adds the last non-null ``value`` so far as ``name`` and how many there were as ``c_<name>``, within ``above``."""
    order = Window.partitionBy(*above).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("v__", value)
    return rows.withColumn(name, F.last("v__", ignorenulls=True).over(order)).withColumn(f"c_{name}", F.count("v__").over(order)).drop("v__")


def found(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))


def indicator_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row an indicator of an evaluation appendix: domain, aspect, question and the criteria of its levels.

    Repeated lines of a level are kept once, in order; what follows ``Jawaban:`` is left out.
    """
    rows = carried(lines, [key], "domain", found(r"(?i)^Domain\s+([0-9]+)\s*[:.]"))
    rows = carried(rows, [key], "aspect", found(r"(?i)^Aspek\s+([0-9]+)\s*[:.]"))
    rows = carried(rows, [key], "indicator", found(r"(?i)^Indikator\s+([0-9]+)\s*[:.]"))
    rows = rows.withColumn("name", found(r"(?i)^Indikator\s+[0-9]+\s*[:.]\s*(.+)$"))
    rows = carried(rows, [key, "c_indicator"], "level", found(r"(?i)^(?:Tingkat\s*)?([1-5])$"))
    rows = carried(rows, [key, "c_indicator"], "answer", found(r"(?i)^(Jawaban)\s*:"))
    head = F.col("line").rlike(r"(?i)^(?:(?:Domain|Aspek|Indikator)\s+[0-9]+\s*[:.]|(?:Tingkat\s*)?[1-5]$)")
    body = rows.where(F.col("indicator").isNotNull())
    text = F.when(~head & (F.col("c_answer") == 0), F.struct("n", "line"))
    parts = body.groupBy(key, "c_indicator", "level").agg(
        F.first("domain").alias("domain"), F.first("aspect").alias("aspect"), F.first("indicator").alias("indicator"), F.max("name").alias("name"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["line"])), " ").alias("text"),
    )
    level = F.when(F.col("level").isNotNull(), F.struct(F.concat(F.lit("tingkat_"), "level").alias("k"), F.col("text").alias("v")))
    return parts.groupBy(key, "c_indicator").agg(
        F.max("domain").cast("int").alias("domain"), F.max("aspect").cast("int").alias("aspect"), F.max("indicator").cast("int").alias("indicator"), F.max("name").alias("name"),
        F.coalesce(F.max(F.when(F.col("level").isNull(), F.col("text"))), F.lit("")).alias("question"), F.array_sort(F.collect_list(level)).alias("criteria"),
    ).drop("c_indicator")


def markdown_sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Body lines under their ``#``, ``##`` and ``###`` headings; a heading forgets the lower ones."""
    above = [key]
    rows = lines
    for i in (1, 2, 3):
        rows = carried(rows, above, f"h{i}", found(rf"^#{{{i}}}\s+(.+)$"))
        above = [*above, f"c_h{i}"]
    body = rows.where(~F.col("line").startswith("#"))
    path = F.concat_ws(" > ", "h1", "h2", "h3")
    return body.groupBy(key, "c_h1", "c_h2", "c_h3", path.alias("path")).agg(
        F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text")
    ).select(key, "n", "path", "text")


def letter_sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbered sections of a circular letter, with the recipients above them."""
    rows = carried(lines, [key], "section", found(r"^([1-9])\.\s"))
    rows = rows.withColumn("title", found(r"^[1-9]\.\s+(.+)$"))
    rows = carried(rows, [key], "recipients", found(r"(?i)^Yth\.\s*(.+)$"))
    text = F.when(F.col("title").isNull() & F.col("section").isNotNull(), F.struct("n", "line"))
    return rows.where("section is not null").groupBy(key, "section").agg(
        F.max("title").alias("title"), F.max("recipients").alias("recipients"),
        F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["line"]), " ").alias("text"),
    )


def split_rows(text: str, size: int, overlap: int) -> list[str]:
    """Table-like text cut between lines; each chunk starts with the last lines of the one before that fit ``overlap``."""
    out: list[list[str]] = []
    held: list[str] = []
    width = lambda ls: sum(map(len, ls)) + max(0, len(ls) - 1)
    for line in (x.strip() for x in text.splitlines()):
        if not line:
            continue
        if len(line) > size:
            if held:
                out.append(held)
            out += [[p] for p in split_recursively(line, size, overlap)]
            held = []
        elif held and width([*held, line]) > size:
            out.append(held)
            keep: list[str] = []
            for before in reversed(held):
                if width([before, *keep]) > overlap:
                    break
                keep.insert(0, before)
            held = [*keep, line]
        else:
            held = [*held, line]
    if held:
        out.append(held)
    return ["\n".join(x) for x in out]


def inject_summaries(markdown: Column, figures: Column) -> Column:
    """Markdown with each figure's ``[number] summary`` after its caption line, else at the end; figures: array<struct<number, summary>>."""

    def step(text: Column, f: Column) -> Column:
        caption = F.concat(F.lit(r"(?m)^(\Q"), f["number"], F.lit(r"\E\.[^\n]*)$"))
        note = F.concat(F.lit("["), f["number"], F.lit("] "), F.trim(f["summary"]))
        at = F.regexp_instr(text, caption)
        inside = F.regexp_replace(text, caption, F.concat(F.lit("$1\n\n"), note))
        return F.when(f["summary"].isNull() | (F.trim(f["summary"]) == ""), text).when(at > 0, inside).otherwise(F.concat(text, F.lit("\n\n"), note, F.lit("\n")))

    return F.aggregate(figures, markdown, step)
