"""Benchmark decontamination by template canonicalisation.

Texts become tokens: numbers, names (capitalised words inside a sentence) and units (after a number,
or a currency or percent sign) turn into typed placeholders, other words are lower-cased, punctuation
only ends sentences. Every window of WINDOW tokens is hashed: as a template (placeholders by type) where
at least half of its tokens are literal, else with the values of its slots, so that text rich in numbers
or names is found as a copy but not by its shape alone. Document windows are hash-joined to benchmark
windows.

Matches of one document and item are grouped by alignment (document place minus item place); an
alignment counts only if its slots are consistent: every benchmark value of a slot type is always
answered by one value in the document. So a re-parameterised question is caught, and chance matches
with scrambled values are not. An item is found in a document when the consistent alignments cover
at least MIN_COVER of the item's windows.

An item shorter than WINDOW tokens is one window of its own length. One shorter than LEAST_WORDS is too
common as a phrase to say anything, so it is found only in a text that is nothing else.

Before the join, a task drops windows whose hash no benchmark window has, while the benchmark has at
most MOST_SHIPPED windows (checked); a larger one is joined in full by shuffle.

Defined results: null text or item text has no windows and matches nothing; very long texts are read
whole, batch by batch; repeated document rows give a result row each; items with equal text (ties) are
each reported, those without an id too (item_id null); extra columns are ignored by ``matches`` and kept
by ``clean``, whatever their names; empty tables match nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, salted_join, sliced, stored, table

WINDOW, MIN_COVER, MOST_SHIPPED, LEAST_WORDS = 8, 0.5, 2_000_000, 4
LITERAL, NUMBER, CAPITAL, UNIT, SIGN, STOP = range(6)
#: Unit words, fixed values.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl l gal ms s sec min h hr hours hour minutes minute seconds second days day weeks week months "
    "month years year w kw mw v a hz khz mhz ghz b kb mb gb tb pa kpa j kj cal kcal c f k mph kmh kph usd eur gbp dollars dollar euros euro cents "
    "cent pounds pound meters meter metres metre kilometers kilometer grams gram kilograms kilogram liters liter litres litre miles mile percent".split()
)
SIGNS = frozenset("%$€£¥°")
TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[%$€£¥°]|[.!?:]")
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACEHOLDER = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>")) for k in (NUMBER, CAPITAL, UNIT)}
MOST_CHUNKS, LONG = 150_000, 48


class Lexicon(dict):
    """Packed token numbers of a chunk between white space; kinds and hashes of tokens by number."""

    def __init__(self) -> None:
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.numbers: dict[str, bytes] = {}
        self.texts: list[str] = []
        self.kinds, self.hashes = array("b"), array("Q")

    def number(self, token: str) -> bytes:
        low = token.lower()
        if token in SIGNS:
            kind = SIGN
        elif token in ".!?:":
            kind = STOP
        elif token[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if token[0].isupper() else LITERAL
        packed = self.numbers[token] = len(self.texts).to_bytes(4, "little")
        self.texts.append(token)
        self.kinds.append(kind)
        self.hashes.append(xxhash.xxh64_intdigest(low))
        return packed

    def __missing__(self, chunk: str) -> bytes:
        known = self.numbers
        packed = b"".join([known.get(t) or self.number(t) for t in TOKEN.findall(chunk)])
        if len(chunk) <= LONG:
            self[chunk] = packed
        return packed

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers, kinds after looking at neighbours, hashes of the canonical tokens and of the tokens themselves."""
        ids = np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")
        kind = np.frombuffer(self.kinds, np.int8)[ids] if len(ids) else np.zeros(0, np.int8)
        before = np.concatenate([[STOP], kind[:-1]])[: len(kind)]
        kind = np.where((kind == CAPITAL) & (before == STOP), LITERAL, kind)
        kind = np.where((kind == UNIT) & (before != NUMBER), LITERAL, np.where(kind == SIGN, UNIT, kind))
        keep = kind != STOP
        ids, kind = ids[keep], kind[keep]
        own = np.frombuffer(self.hashes, np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
        h = own
        for k, value in PLACEHOLDER.items():
            h = np.where(kind == k, value, h)
        return ids, kind, h, own


def windows(kind: np.ndarray, h: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` tokens: of its template where half of it is literal, else of its own words."""
    n = max(0, len(h) - size + 1)
    literal = np.zeros(n, np.int64)
    for k in range(size):
        literal += kind[k : k + n] == LITERAL
    out = mixed(h, n, size, 0)
    rich = np.flatnonzero(2 * literal < size)
    if len(rich):
        if 8 * len(rich) < n:  # few of them: only these are hashed by value
            span = rich[:, None] + np.arange(size)
            out[rich] = mixed(own[span].T, len(rich), size, 1)
        else:
            out[rich] = mixed(own, n, size, 1)[rich]
    return out


def mixed(h: np.ndarray, n: int, size: int, seed: int) -> np.ndarray:
    """One hash a window; h is a row of tokens, or a matrix of one row a place in the window."""
    out = np.full(n, size + (seed << 32), np.uint64)
    for k in range(size):
        out = (out + (h[k : k + n] if h.ndim == 1 else h[k])) * BASE
        out ^= out >> np.uint64(29)
    return out


def slots(lex: Lexicon, ids: np.ndarray, kind: np.ndarray, at: int, size: int) -> list[str]:
    """``kind:value`` of each placeholder of a window, in order."""
    return [f"{kind[i]}:{lex.texts[ids[i]].lower()}" for i in range(at, at + size) if kind[i] != LITERAL]


ITEM = "item long, item_id long, n_windows int, at int, h long, slots array<string>"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row a window of each item; the first word also as it looks inside a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon()
        for b in batches:
            rows = []
            for key, item, text in zip(*(b.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                ids, kind, h, own = lex.tokens(text or "")
                size = min(WINDOW, len(h))
                if not size:
                    continue
                variants = [(kind, h, None)]
                if kind[0] == LITERAL and lex.kinds[ids[0]] == CAPITAL:
                    inside, hidden = kind.copy(), h.copy()
                    inside[0], hidden[0] = CAPITAL, PLACEHOLDER[CAPITAL]
                    variants.append((inside, hidden, 1))
                for k, x, most in variants:
                    found = windows(k, x, own, size)
                    for at in range(len(found[:most])):
                        rows.append((key, item, len(found), at, int(found[at : at + 1].view(np.int64)[0]), slots(lex, ids, k, at, size)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["item", "item_id", "n_windows", "at", "h", "slots"])

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.withColumn("item", F.xxhash64("item_id", "text")).distinct().mapInArrow(run, ITEM)


def row_key() -> F.Column:
    """Tells document rows apart by content, so that it can be recomputed anywhere."""
    return F.xxhash64("doc_id", "text")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(key, doc_id, item_id, n_windows, n_matched, cover, kind)`` of every item found in a document text."""
    spark = docs.sparkSession
    items = stored(benchmark_windows(benchmark))
    sizes = sorted(benchmark_sizes(benchmark))
    shipped = None
    if items.count() <= MOST_SHIPPED:
        hashes = items.select("h").distinct().toArrow()["h"].to_numpy().view(np.uint64)
        shipped = spark.sparkContext.broadcast(np.sort(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon()
        known = shipped.value if shipped is not None else None
        for b in sliced(batches, 1024):
            key, doc, at_, h_, slots_ = [], [], [], [], []
            for k, d, text in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(lex) > MOST_CHUNKS or len(lex.texts) > MOST_CHUNKS:
                    lex.renew()
                ids, kind, h, own = lex.tokens(text)
                for size in sizes:
                    if size < LEAST_WORDS and len(h) != size:
                        continue
                    found = windows(kind, h, own, size)
                    if known is None:
                        hits = np.arange(len(found))
                    elif len(known):
                        hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found)
                    else:
                        hits = np.zeros(0, np.int64)
                    key += [k] * len(hits)
                    doc += [d] * len(hits)
                    at_.append(hits)
                    h_.append(found[hits].view(np.int64))
                    slots_ += [slots(lex, ids, kind, i, size) for i in hits.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(np.concatenate([*at_, []]).astype(np.int32)), pa.array(np.concatenate([*h_, np.zeros(0, np.int64)])), pa.array(slots_, pa.list_(pa.string()))],
                ["key", "doc_id", "place", "h", "values"],
            )

    texts = docs.where("text is not null").select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(texts.mapInArrow(run, "key long, doc_id long, place int, h long, values array<string>"))
    met = salted_join(found, items, ["h"], ["key", "place"]).where(F.size("slots") == F.size("values")).withColumn("line", F.col("place") - F.col("at"))
    pairs = met.select(
        "key", "doc_id", "item", "item_id", "n_windows", "line", "at",
        F.zip_with("slots", "values", lambda x, y: F.struct(x.alias("b"), y.alias("d"))).alias("pair"),
    )
    # what an alignment binds: the distinct pairs, few whatever the number of matches
    lines = pairs.groupBy("key", "doc_id", "item", "item_id", "n_windows", "line").agg(
        F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("pair"))).alias("bound")
    )
    lines = lines.where(F.size(F.array_distinct(F.transform("bound", lambda p: p["b"]))) == F.size("bound"))
    each = lines.groupBy("key", "doc_id", "item", "item_id", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("n_matched"),
        F.min(F.forall("bound", lambda p: p["b"] == p["d"])).alias("exact"),
    )
    each = each.withColumn("cover", F.round(F.col("n_matched") / F.col("n_windows"), 4)).where(F.col("cover") >= MIN_COVER)
    return each.select("key", "doc_id", "item_id", "n_windows", "n_matched", "cover", F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("kind"))


def benchmark_sizes(benchmark: DataFrame) -> list[int]:
    """Window lengths in use: WINDOW, and the lengths of shorter items; at most WINDOW numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon()
        for b in batches:
            n = [min(WINDOW, len(lex.tokens(t)[0])) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(n)), pa.int32())], ["n"])

    rows = benchmark.where("text is not null").select("text").mapInArrow(run, "n int")
    return [r.n for r in rows.where("n > 0").distinct().collect()]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    key = free_name(docs, "key__")
    hit = matches(docs, benchmark).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(hit, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    copies = docs.select(row_key().alias("key")).groupBy("key").agg(F.count("*").alias("copies"))
    return found.join(copies, "key").select(
        "doc_id", "item_id", "n_windows", "n_matched", "cover", "kind", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    )
