"""Document structure and chunks: lines, carried headings, articles and clauses, bounded packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import sliced

#: Largest chunk and overlap in characters by document type, fixed values.
SIZES = {"peraturan": (900, 150), "laporan": (1800, 200), "pedoman": (1800, 200), "umum": (600, 100)}
SEPARATORS = ("\n\n", "\n", ".", " ", "")
LEAST = 10


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n, line)``: numbered non-blank lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.trim("line") != "").withColumn("line", F.trim("line"))


def sections(rows: DataFrame, heading: Column, key: str = "doc_id") -> DataFrame:
    """Lines grouped under the heading before them: ``(key, section, title, n_lines, n_chars)``; section 0 comes before any heading."""
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("h", heading).withColumn("section", F.sum(F.col("h").cast("int")).over(order))
    body = F.when(~F.col("h"), F.length("line")).otherwise(0)
    return numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("h"), F.col("line"))).alias("title"), F.count_if(~F.col("h")).alias("n_lines"), F.sum(body).alias("n_chars")
    )


def regulation_nodes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a text line of a regulation, with the chapter, article and clause it stands in.

    Headings are carried forward; a lower level is forgotten when a higher one begins, by partitioning
    on the running count of the higher heads.
    """
    line = F.col("line")
    head = {"bab": F.regexp_extract(line, r"^BAB\s+([IVXLC]+)\b", 1), "pasal": F.regexp_extract(line, r"^Pasal\s+([0-9]+)$", 1), "ayat": F.regexp_extract(line, r"^\(([0-9]+)\)", 1)}
    rows = rows.withColumns({f"h_{k}": F.nullif(v, F.lit("")) for k, v in head.items()})
    above: list[str] = [key]
    for level in ("bab", "pasal", "ayat"):
        order = Window.partitionBy(*above).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(level, F.last(f"h_{level}", ignorenulls=True).over(order)).withColumn(f"c_{level}", F.count(f"h_{level}").over(order))
        above.append(f"c_{level}")
    order = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumn("after_bab", F.coalesce(F.lag("h_bab").over(order).isNotNull(), F.lit(False)))
    body = rows.where(F.col("h_bab").isNull() & F.col("h_pasal").isNull())
    text = F.trim(F.regexp_replace("line", r"^\([0-9]+\)\s*", ""))
    return body.select(key, "n", "bab", "pasal", "ayat", F.when(F.col("after_bab"), "title").otherwise("text").alias("kind"), text.alias("text"))


def article_chunks(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """One chunk a clause (or article without clauses) with its path, position and parent flag."""
    body = nodes.where("kind = 'text' and pasal is not null")
    parts = body.groupBy(key, "bab", "pasal", "ayat").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))
    path = F.concat_ws(" > ", F.concat(F.lit("BAB "), "bab"), F.concat(F.lit("Pasal "), "pasal"), F.concat(F.lit("ayat ("), "ayat", F.lit(")")))
    order = Window.partitionBy(key).orderBy("n")
    return parts.select(key, (F.row_number().over(order) - 1).cast("bigint").alias("chunk_index"), path.alias("hierarchy"), F.col("ayat").isNull().alias("is_parent"), "text")


def packed(docs: DataFrame, most: int) -> DataFrame:
    """``(doc_id, chunk_index, text)``: non-blank lines packed greedily into chunks of at most ``most`` characters, a longer line alone.

    One pass over each text, in time linear in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for doc, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                held, size, at = [], 0, 0
                for line in (x for x in (text or "").split("\n") if x.strip(" ")):
                    if held and size + 1 + len(line) > most:
                        rows.append((doc, at, "\n".join(held)))
                        held, size, at = [], 0, at + 1
                    size += len(line) + (1 if held else 0)
                    held.append(line)
                if held:
                    rows.append((doc, at, "\n".join(held)))
            yield _batch(rows, [pa.int64(), pa.int32(), pa.string()], ["doc_id", "chunk_index", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk_index int, text string")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs; each repeats up to ``overlap`` characters of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    raw = list(text) if sep == "" else text.split(sep)
    units = raw if sep == "" else [raw[0], *(sep + r for r in raw[1:])]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def emit() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for u in units:
        if len(u) > size:
            emit()
            held, length = [], 0
            out += split_recursively(u, size, overlap, finer)
            continue
        if length + len(u) > size:
            emit()
            while held and (length > overlap or length + len(u) > size):
                length -= len(held.pop(0))
        held.append(u)
        length += len(u)
    emit()
    return out


def chunk_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """``(doc_id, chunk_index, chunk_parts, text)`` with dense indexes; chunks under ten characters are dropped first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for doc, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                kept = [c for c in split_recursively(text or "", size, overlap) if len(c) >= LEAST]
                rows += [(doc, i, len(kept), c) for i, c in enumerate(kept)]
            yield _batch(rows, [pa.int64(), pa.int32(), pa.int32(), pa.string()], ["doc_id", "chunk_index", "chunk_parts", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk_index int, chunk_parts int, text string")


def with_context(chunks: DataFrame, width: int = 500) -> DataFrame:
    """Each chunk with the end of the one before and the start of the one after."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumns({"before": F.right(F.lag("text").over(order), F.lit(width)), "after": F.left(F.lead("text").over(order), F.lit(width))})


def choose_by_count(first: DataFrame, second: DataFrame, least: int = 20, key: str = "doc_id") -> DataFrame:
    """Per document the first chunking, unless it has fewer than ``least`` chunks and the second has more."""
    both = first.withColumn("way", F.lit(1)).unionByName(second.withColumn("way", F.lit(2)))
    own = Window.partitionBy(key)
    n1, n2 = (F.count_if(F.col("way") == way).over(own) for way in (1, 2))
    counted = both.withColumns({"n1": n1, "n2": n2})  # one pass over the chunks, which a join with their counts would make twice
    return counted.where(F.col("way") == F.when((F.col("n1") < least) & (F.col("n2") > F.col("n1")), 2).otherwise(1)).drop("n1", "n2")


def linearize_table(block: Column) -> Column:
    """Pipe-table lines as ``header: value; ...`` lines; separator rows and ``-`` cells are skipped, extra cells get ``Kolom{i}``."""
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = F.filter(F.transform(F.split(block, "\n"), cells), lambda r: ~F.array_join(r, "").rlike(r"^[-: ]*$"))
    head, body = F.get(rows, F.lit(0)), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    pair = lambda v, i: F.concat(F.coalesce(F.get(head, i), F.concat(F.lit("Kolom"), (i + 1).cast("string"))), F.lit(": "), v)
    line = lambda r: F.array_join(F.filter(F.transform(r, lambda v, i: F.when((v != "-") & (v != ""), pair(v, i))), lambda x: x.isNotNull()), "; ")
    return F.array_join(F.transform(body, line), "\n")
