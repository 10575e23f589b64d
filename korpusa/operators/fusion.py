"""From candidate lists to cited context: rank fusion, stitching, boosts, reranking, assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import display_score, first_non_blank, snippet
from ..functions.text import INDICATOR_NUMBER, TABLE_NUMBER

RRF_K, MOST_CANDIDATES = 60, 25
#: Bounds of an overlap between neighbouring texts, in characters.
OVERLAP = (24, 220)


def reciprocal_rank_fusion(lists: list[DataFrame], most: int = MOST_CANDIDATES) -> DataFrame:
    """``(query_id, id, score, rank)`` from lists of (query_id, id, rank): sum of 1 / (60 + rank)."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1, per: tuple[str, ...] = ()) -> DataFrame:
    """Chunks within ``radius`` of a hit that are no hits themselves: ``(doc_id, hit, chunk_index, text)``.

    The range becomes an equi-join: each hit lists the places it wants. ``per`` names columns of the hits,
    such as a question, within which they count as hits; they are returned too.
    """
    around = F.filter(F.sequence(F.lit(-radius), F.lit(radius)), lambda o: o != 0)
    wanted = hits.select(*per, "doc_id", F.col("chunk_index").alias("hit"), F.explode(F.transform(around, lambda o: F.col("chunk_index") + o)).alias("chunk_index"))
    wanted = wanted.join(hits.select(*per, "doc_id", "chunk_index"), [*per, "doc_id", "chunk_index"], "left_anti")
    return wanted.join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])


def longest_overlap(left: Column, right: Column) -> Column:
    """Length of the longest suffix of left that is a prefix of right, within OVERLAP, else 0."""
    low, high = OVERLAP
    most = F.least(F.length(left), F.length(right), F.lit(high))
    fits = F.filter(F.sequence(most, F.lit(low), F.lit(-1)), lambda s: F.right(left, s) == F.left(right, s))
    return F.when(most >= low, F.coalesce(F.get(fits, F.lit(0)), F.lit(0))).otherwise(0)


def merge_texts(parts: Column) -> Column:
    """Texts in order as one: contained parts skipped, overlaps written once, else joined by a newline."""

    def step(done: Column, part: Column) -> Column:
        same = longest_overlap(done, part)
        return (
            F.when(done == "", part)
            .when(done.contains(part), done)
            .when(same > 0, F.concat(done, F.expr("''"), F.substr(part, same + 1)))
            .otherwise(F.concat(done, F.lit("\n"), part))
        )

    return F.aggregate(parts, F.lit(""), step)


def stitch(hits: DataFrame, chunks: DataFrame, radius: int = 1, per: tuple[str, ...] = ()) -> DataFrame:
    """Each hit with its neighbours merged in order: ``(*per, doc_id, chunk_index, stitched_indices, text)``."""
    near = neighbours(hits, chunks, radius, per).select(*per, "doc_id", "hit", "chunk_index", "text")
    own = hits.select(*per, "doc_id", "chunk_index").join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    own = own.select(*per, "doc_id", F.col("chunk_index").alias("hit"), "chunk_index", "text")
    parts = near.unionByName(own).groupBy(*per, "doc_id", "hit").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    return parts.select(
        *per,
        "doc_id",
        F.col("hit").alias("chunk_index"),
        F.transform("parts", lambda p: p["chunk_index"]).alias("stitched_indices"),
        merge_texts(F.transform("parts", lambda p: p["text"])).alias("text"),
    )


def metadata_boost(question: Column, chunk: dict[str, Column]) -> Column:
    """Sum of the rules that a question and a chunk's fields satisfy."""
    q = F.lower(F.coalesce(question, F.lit("")))
    get = {k: F.lower(F.coalesce(v.cast("string"), F.lit(""))) for k, v in chunk.items()}
    article, chapter, path = get["pasal"], get["bab"], get["hierarchy"]
    blob = F.concat_ws(" ", get["document_title"], path, get["context_header"], get["doc_type"], article, get["ayat"], F.substring(get["text"], 1, 2500))
    num = lambda pattern: F.regexp_extract(q, pattern, 1)
    has = lambda where, *parts: F.regexp_like(where, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    number, year, pasal = num(r"nomor\s+([0-9]+)"), num(r"tahun\s+([0-9]{4})"), num(r"pasal\s+([0-9]+)")
    indicator, table = num(INDICATOR_NUMBER), num(TABLE_NUMBER)
    asks = q.rlike("definisi|pengertian")
    first = asks & article.rlike(r"\bpasal\s+1\b")
    label = get["table_label"]
    rules = [
        (q.contains("perpres") & blob.rlike("peraturan presiden|perpres"), 0.25),
        (q.contains("permen") & blob.rlike("peraturan menteri|permen"), 0.25),
        (q.contains("pp ") & (blob.contains("peraturan pemerintah") | F.concat(F.lit(" "), blob, F.lit(" ")).contains(" pp ")), 0.25),
        ((number != "") & has(blob, r"\b", number, r"\b"), 0.20),
        ((year != "") & has(blob, r"\b", year, r"\b"), 0.20),
    ]
    either = [
        F.when((pasal != "") & has(article, r"\bpasal\s+", pasal, r"\b"), 0.55).when((pasal != "") & has(blob, r"\bpasal\s+", pasal, r"\b"), 0.20),
        F.when((indicator != "") & has(path, r"\bindikator\s+", indicator, r"\b"), 2.0).when(
            (indicator != "") & (has(blob, r"\bindikator\s*", indicator, r"\b") | has(blob, r"\bid[- \t]*", indicator, r"\b")), 0.85
        ),
        F.when((table != "") & has(blob, r"\btabel\s*(?:ke[-\s]*)?", table, r"\b"), 1.35).when((table != "") & blob.contains("tabel"), 0.20),
    ]
    rules += [
        ((indicator != "") & blob.contains("spbe"), 0.15),
        ((table != "") & chunk["is_table"], 0.40),
        ((table != "") & (label != "") & label.contains(F.concat(F.lit("tabel "), table)), 0.25),
        (first, 0.55),
        (first & (chapter.contains("bab i") | blob.contains("ketentuan umum")), 1.10),
        (asks & blob.contains("yang dimaksud dengan"), 0.90),
        (asks & blob.contains("selanjutnya disingkat spbe adalah"), 1.00),
    ]
    parts = [F.when(test, w).otherwise(0.0) for test, w in rules] + [F.coalesce(e, F.lit(0.0)) for e in either]
    return F.round(reduce(lambda a, b: a + b, parts), 2)


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """Top k by base score + boost: input (query_id, id, base, boost)."""
    total = scored.withColumn("score", F.round(F.col("base") + F.col("boost"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return total.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def sources(ranked: DataFrame) -> DataFrame:
    """Citation records: input (query_id, id, rank, score, text, title, context_header, pasal, bab)."""
    return ranked.select(
        "query_id",
        "rank",
        F.col("id").cast("string").alias("doc_id"),
        "title",
        F.coalesce(first_non_blank("context_header", "pasal", "bab"), F.lit("")).alias("section"),
        display_score(F.col("score"), F.col("rank")).alias("shown"),
        snippet("text").alias("snippet"),
    )


def context_blocks(cited: DataFrame) -> DataFrame:
    """One prompt context a question: numbered blocks in rank order. Input (query_id, rank, title, snippet)."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("snippet"))
    lists = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))).alias("b"))
    return lists.select("query_id", F.size("b").alias("n_sources"), F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("context"))
