"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Training counts every character ORDER-gram of every labelled training text, by language, as partial
counts in each task and one sum a (language, n-gram). Nothing is left out of a model: it holds all
n-grams of its corpus, and continuation counts of the lower orders come from all of them, so it grows
with the corpus' distinct text. P(c | h) is interpolated Kneser-Ney with an absolute discount for each
language and order (n1 / (n1 + 2 n2) of its counts), down to the uniform distribution; all n-grams of
one order and all languages live in one sorted array of 64-bit hashes with a row of probabilities and
back-off weights, found by binary search.

Where the n-grams are at most MOST_SHIPPED (counted first), tasks get the model as a broadcast. A larger
one stays a table: every distinct n-gram of the texts is scored once by joins with the orders' tables
(``scored_by_join``), and joined back to the texts' n-gram counts; same probabilities, nothing collected.

A text is lower-cased, everything but letters becomes one space, and its distinct n-grams are looked up
once a batch. The language with the lowest length-normalised cross-entropy wins; ``score`` is its
posterior against the others, tempered by length. A text is ``rejected`` when it has no letter, or when
its cross-entropy is above the language's calibrated limit (a high quantile over all training texts of the
language, from counts in steps of STEP nats, plus a margin that shrinks with length).

Defined results: null text or text without a letter is ``und`` with score 0; ties go to the first
language in sorted order; very long texts are scored whole, in batches of bounded size; without any
training text everything is ``und``; every row keeps its own output row; an empty table gives an empty
result; columns of ``docs`` that have the name of an added one keep it, and the added one is numbered
(score_1); lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, give_back, sliced, split_join, stored, table

ORDER, MOST_SHIPPED = 5, 4_000_000
#: Calibration: quantile, steps of the counted cross-entropies and margin, both in nats.
QUANTILE, STEP, MARGIN = 0.995, 1e-4, 0.5
#: Model tables of at most so many rows are broadcast where the model itself is too large for it.
SMALL = 100_000
#: Shortest text, in characters, that calibrates.
LEAST_SIZE = 100
BATCH_CHARS = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text with runs of anything but letters as one space, padded with spaces."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(letters()[cp], cp, np.uint32(32))
    cp = np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]]).astype(np.uint32)
    return cp[np.append(True, (cp[1:] != 32) | (cp[:-1] != 32))]


def hashes(cp: np.ndarray, order: int) -> np.ndarray:
    """Hash of the order-gram that starts at each place; of its prefixes and suffixes, hashes(.., less)."""
    h = np.zeros(max(0, len(cp) - order + 1), np.uint64)
    for k in range(order):
        h = (h + cp[k : k + len(h)].astype(np.uint64) + np.uint64(1)) * BASE
        h ^= h >> np.uint64(29)
    return h


def discount(n1: float, n2: float) -> float:
    """Absolute discount from how many n-grams occur once and twice; 0.75 where none does, 0.1 at least."""
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 and n2 else 0.75


class Model:
    """Sorted hash arrays of all orders; build() from the top-order counts of every language."""

    def __init__(self, languages: list[str], keys: list[np.ndarray], probs: list[np.ndarray], ctx_keys: list[np.ndarray], backs: list[np.ndarray], size: int):
        self.languages, self.keys, self.probs, self.ctx_keys, self.backs, self.size = languages, keys, probs, ctx_keys, backs, size
        self.limits = np.full(len(languages), np.inf)

    @classmethod
    def build(cls, languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
        """counted[l]: (grams as code points [n, order], counts [n])."""
        n_lang = len(languages)
        alphabet = np.unique(np.concatenate([g.reshape(-1) for g, _ in counted]))
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for grams, n in counted:
            levels[order].append((grams, n.astype(float)))
            for k in range(order - 1, 0, -1):  # continuation counts: distinct characters to the left
                grams, n = np.unique(grams[:, 1:], axis=0, return_counts=True)
                levels[k].append((grams, n.astype(float)))
        keys, probs, ctx_keys, backs = [np.zeros(0, np.uint64)], [np.zeros((0, n_lang))], [np.zeros(0, np.uint64)], [np.zeros((0, n_lang))]
        for k in range(1, order + 1):
            gram_h = [_row_hash(g) for g, _ in levels[k]]
            ctx_h = [_row_hash(g[:, :-1]) for g, _ in levels[k]]
            key, ctx = np.unique(np.concatenate(gram_h)), np.unique(np.concatenate(ctx_h))
            prob, back = np.zeros((len(key), n_lang)), np.ones((len(ctx), n_lang))
            for lang, (_, n) in enumerate(levels[k]):
                at = np.searchsorted(ctx, ctx_h[lang])
                total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
                seen, off = total > 0, discount(np.count_nonzero(n == 1), np.count_nonzero(n == 2))
                back[seen, lang] = off * kinds[seen] / total[seen]
                prob[np.searchsorted(key, gram_h[lang]), lang] = (n - off) / total[at]
            keys.append(key)
            probs.append(prob.astype(np.float32))
            ctx_keys.append(ctx)
            backs.append(back.astype(np.float32))
        return cls(languages, keys, probs, ctx_keys, backs, len(alphabet) + 1)

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """log P of the last character of each top-order gram, for every language."""
        order = len(self.keys) - 1
        p = np.full((len(grams), len(self.languages)), 1.0 / self.size)
        for k in range(1, order + 1):
            g = grams[:, order - k :]
            back, found = _find(self.ctx_keys[k], _row_hash(g[:, :-1]))
            p *= np.where(found[:, None], self.backs[k][back], 1.0)
            at, found = _find(self.keys[k], _row_hash(g))
            p += np.where(found[:, None], self.probs[k][at], 0.0)
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean cross-entropy in nats of each text by language, and characters scored (0: no letter)."""
        order = len(self.keys) - 1
        out, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            codes, owner, held = [], [], 0
            while at < len(texts) and (held == 0 or held < BATCH_CHARS):
                cp = symbols(texts[at])
                if len(cp) > 1:
                    cp = np.concatenate([np.full(order - 2, 32, np.uint32), cp])
                    codes.append(cp)
                    owner.append(at)
                    size[at] = len(cp) - order + 1
                    held += len(cp)
                at += 1
            if not codes:
                continue
            h = [hashes(c, order) for c in codes]
            distinct, first, back = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, order) for c in codes])
            logs = self.log_probs(windows[first])
            ends = np.cumsum([len(x) for x in h])
            for lang in range(len(self.languages)):
                out[owner, lang] = -np.add.reduceat(logs[back, lang], np.append(0, ends[:-1])) / size[owner]
        return out, size

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        return decided(self.languages, self.limits, *self.entropies([t or "" for t in texts]))

    def own_entropies(self, sample: DataFrame) -> DataFrame:
        """``(lang, e, size)`` of ``sample(lang, text)`` by each text's own language."""
        shared = sample.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                e, size = shared.value.entropies([t or "" for t in b.column("text").to_pylist()])
                own = np.array([shared.value.languages.index(x) for x in b.column("lang").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(e[np.arange(len(e)), own]), pa.array(size)], ["lang", "e", "size"])

        return sample.mapInArrow(run, "lang string, e double, size long")


def decided(languages: list[str], limits: np.ndarray, e: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The verdicts from cross-entropies [texts, languages] and numbers of characters scored."""
    best = e.argmin(axis=1)
    least = e[np.arange(len(e)), best]
    odds = np.exp(-np.minimum((e - least[:, None]) * np.sqrt(np.maximum(size, 1))[:, None], 700))
    none = size == 0
    score = np.where(none, 0.0, 1.0 / odds.sum(axis=1))
    reject = none | (least > limits[best] + MARGIN + 2.0 / np.sqrt(np.maximum(size, 1)))
    return [UNKNOWN if x else languages[b] for x, b in zip(none, best, strict=True)], score, np.where(none, 0.0, least), reject


def _row_hash(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = (h + grams[:, k].astype(np.uint64) + np.uint64(1)) * BASE
        h ^= h >> np.uint64(29)
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def gram_counts(labelled: DataFrame, order: int = ORDER, kind: str = "string") -> DataFrame:
    """``(lang, gram, n)`` over all texts of ``labelled(lang, text)``; gram is order code points as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        chars = 0
        for b in sliced(batches, 1024):
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                cp = symbols(text.as_py() or "")
                if len(cp) > 1:
                    held.setdefault(lang.as_py(), []).append(np.concatenate([np.full(order - 2, 32, np.uint32), cp]))
                    chars += len(cp)
                if chars >= BATCH_CHARS:
                    yield from counted(held)
                    held, chars = {}, 0
        yield from counted(held)
        held.clear()
        give_back()

    def counted(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, codes in held.items():
            _, first, n = np.unique(np.concatenate([hashes(c, order) for c in codes]), return_index=True, return_counts=True)
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, order) for c in codes])[first]
            grams = np.ascontiguousarray(windows).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            text = [grams[i * order : (i + 1) * order] for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.int64() if kind == "long" else pa.string()), pa.array(text), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return labelled.select("lang", "text").mapInArrow(run, f"lang {kind}, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Model | TableModel:
    """A calibrated model from all rows of ``labelled(lang, text)`` with a language."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    model = learned(labelled)
    if model.languages:
        calibrate(model, model.own_entropies(labelled))
    return model


def learned(labelled: DataFrame) -> Model | TableModel:
    """A model without limits from all rows of ``labelled(lang, text)``, none of them null."""
    grams = stored(gram_counts(labelled))
    n = grams.count()
    if not n:
        return Model([], [np.zeros(0, np.uint64)], [np.zeros((0, 0))], [np.zeros(0, np.uint64)], [np.zeros((0, 0))], 1)
    return shipped_model(grams) if n <= MOST_SHIPPED else TableModel(grams)


def calibrate(model: Model | TableModel, own: DataFrame) -> None:
    """Sets the limits from ``own(lang, e, size)`` of all training texts by their own language.

    Counts in steps give the quantile's rank exactly and are few, however many texts there are; the limit is the step's largest value.
    """
    steps = own.where(f"size >= {LEAST_SIZE}").groupBy("lang", F.ceil(F.col("e") / STEP).alias("step")).agg(F.count("*").alias("n"), F.max("e").alias("most"))
    order, every = Window.partitionBy("lang").orderBy("step"), Window.partitionBy("lang")
    ranked = steps.withColumns({"rank": F.sum("n").over(order), "all": F.sum("n").over(every)}).where(F.col("rank") >= F.ceil(F.col("all") * QUANTILE))
    for r in ranked.groupBy("lang").agg(F.min_by("most", "step").alias("q")).collect():  # one row a language
        model.limits[model.languages.index(r.lang)] = r.q


def shipped_model(grams: DataFrame) -> Model:
    """The model as arrays, from at most MOST_SHIPPED counted n-grams."""
    rows = grams.select("lang", F.encode("gram", "UTF-32").alias("gram"), "n").toArrow()
    languages, counted = sorted(set(rows["lang"].to_pylist())), []
    for lang in languages:
        own = rows.filter(pc.equal(rows["lang"], lang))
        cp = np.frombuffer(b"".join(own["gram"].to_pylist()), ">u4").astype(np.uint32).reshape(len(own), -1)
        order = np.lexsort(cp.T[::-1])
        counted.append((cp[order], own["n"].to_numpy()[order]))
    return Model.build(languages, counted)


class TableModel:
    """The same model as tables, for corpora whose n-grams are too many to ship."""

    def __init__(self, grams: DataFrame, order: int = ORDER):
        """grams: stored ``(lang, gram, n)`` of the top order."""
        self.order = order
        self.languages = sorted(r.lang for r in grams.select("lang").distinct().collect())  # one row a language
        self.limits = np.full(len(self.languages), np.inf)
        level, self.levels = grams, []
        for k in range(order, 0, -1):
            if k < order:  # continuation counts: distinct characters to the left
                level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
            level = stored(level) if k < order else level
            once = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
            off = F.create_map(*[F.lit(x) for r in once for x in (r.lang, discount(r.n1, r.n2))])
            named = level.withColumns({"d": off[F.col("lang")], "h": F.substring("gram", 1, k - 1)})
            contexts = named.groupBy("lang", "h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            probs = named.join(contexts, ["lang", "h"]).groupBy("gram").agg(self._row((F.col("n") - F.col("d")) / F.col("total")).alias("p"))
            backs = contexts.withColumn("d", off[F.col("lang")]).groupBy("h").agg(self._row(F.col("d") * F.col("kinds") / F.col("total")).alias("b"))
            self.levels.insert(0, (stored(probs), stored(backs)))
        self.small = [tuple(t.count() <= SMALL for t in pair) for pair in self.levels]
        self.size = level.select("gram").distinct().count() + 1

    def _row(self, value: Column) -> Column:
        """One value a language, null where it has none."""
        return F.array(*[F.max(F.when(F.col("lang") == x, value)) for x in self.languages])

    def log_probs(self, wanted: DataFrame) -> DataFrame:
        """``(gram, logs)`` of distinct top-order n-grams ``wanted(gram)``, by one join an order and table.

        Tables of at most SMALL rows, the low orders, whose few keys all n-grams share, are broadcast.
        """
        p = wanted.withColumn("p", F.array_repeat(F.lit(1.0 / self.size), len(self.languages)))
        for k, ((probs, backs), small) in enumerate(zip(self.levels, self.small, strict=True), 1):
            probs, backs = (F.broadcast(t) if few else t for t, few in zip((probs, backs), small, strict=True))
            at = self.order - k + 1
            p = p.withColumn("h", F.substring("gram", at, k - 1)).join(backs, "h", "left").withColumnRenamed("p", "q").withColumn("x", F.substring("gram", at, k))
            p = p.join(probs.select(F.col("gram").alias("x"), "p"), "x", "left")
            zero, one = F.array_repeat(F.lit(None).cast("double"), len(self.languages)), F.coalesce("b", F.array_repeat(F.lit(None).cast("double"), len(self.languages)))
            lower = F.zip_with("q", one, lambda q, b: q * F.coalesce(b, F.lit(1.0)))
            p = p.select("gram", F.zip_with(lower, F.coalesce("p", zero), lambda q, x: q + F.coalesce(x, F.lit(0.0))).alias("p"))
        return p.select("gram", F.transform("p", lambda x: F.log(x)).alias("logs"))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """``(rid, e array<double>, size)`` of ``texts(rid, text)`` with a letter."""
        counts = stored(gram_counts(texts.select(F.col("rid").alias("lang"), "text"), self.order, "long"))
        logs = stored(self.log_probs(counts.select("gram").distinct()))
        each = split_join(counts, logs, ["gram"])  # " the " is in every English text
        sums = [(-F.sum(F.col("n") * F.col("logs")[i]) / F.sum("n")) for i in range(len(self.languages))]
        return each.groupBy(F.col("lang").alias("rid")).agg(F.array(*sums).alias("e"), F.sum("n").alias("size"))

    def own_entropies(self, sample: DataFrame) -> DataFrame:
        rows = stored(sample.withColumn("rid", F.monotonically_increasing_id()))
        place = F.array_position(F.array(*map(F.lit, self.languages)), F.col("lang")).cast("int")
        return rows.join(self.entropies(rows), "rid").select("lang", F.get("e", place - 1).alias("e"), "size")


ADDED = ("lang_pred", "score", "entropy", "rejected")


def predict(docs: DataFrame, model: Model | TableModel) -> DataFrame:
    """``docs`` with ADDED appended."""
    names = list(docs.columns)
    for c in ADDED:
        names.append(free_name(docs, c))
    added = ", ".join(f"`{n}` {t}" for n, t in zip(names[-4:], ("string", "double", "double", "boolean"), strict=True))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if isinstance(model, TableModel):
        return scored_by_join(docs, model, names, f"{fields}, {added}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            lang, score, e, no = shared.value.decide(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score), pa.array(e), pa.array(no)], names)

    return docs.mapInArrow(run, f"{fields}, {added}")


def scored_by_join(docs: DataFrame, model: TableModel, names: list[str], schema: str) -> DataFrame:
    """predict() by joins with the model's tables."""
    e, size = (free_name(docs, c) for c in ("e__", "size__"))
    return verdicts(scored(docs, model, e, size), model, names, schema)


def scored(docs: DataFrame, model: Model | TableModel, e: str, size: str) -> DataFrame:
    """``docs`` with cross-entropies by language (null where a table model finds no letter) and characters scored as columns ``e`` and ``size``."""
    if isinstance(model, TableModel):
        rid = free_name(docs, "rid__")
        rows = stored(docs.withColumn(rid, F.monotonically_increasing_id()))
        found = model.entropies(rows.select(F.col(rid).alias("rid"), "text")).toDF(rid, e, size)
        return rows.join(found, rid, "left").select(*[F.col(f"`{c}`") for c in docs.columns], e, size)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            matrix, sizes = shared.value.entropies([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(matrix.tolist(), pa.list_(pa.float64())), pa.array(sizes)], [*b.schema.names, e, size])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{e}` array<double>, `{size}` long")


def verdicts(rows: DataFrame, model: Model | TableModel, names: list[str], schema: str) -> DataFrame:
    """``rows`` whose last two columns are those of scored(), with ADDED in place of these."""
    languages, limits, n = model.languages, model.limits, len(rows.columns) - 2
    e, size = rows.columns[n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(e).to_pylist()
            matrix = np.array([x if x is not None else [0.0] * len(languages) for x in given]).reshape(len(b), len(languages))
            sizes = np.array([x or 0 for x in b.column(size).to_pylist()], np.int64)
            lang, score, best, no = decided(languages, limits, matrix, sizes)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(lang), pa.array(score), pa.array(best), pa.array(no)], names)

    return rows.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model | TableModel) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    judged = predict(docs, model)
    return judged.where(~F.col(f"`{judged.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trains = ~held_out(F.col("doc_id")) & F.col("text").isNotNull()
    model = learned(docs.where(trains & F.col("lang").isNotNull()).select("lang", "text"))
    own = F.when(trains, F.col("lang")).alias("own")  # for the limits only, never an input of a prediction
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"), own)
    if not model.languages:
        return predict(inputs, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
    # every text is scored once: the training texts' own values give the limits, then all are judged
    rows = stored(scored(inputs, model, "e", "size").drop("text"))
    place = F.array_position(F.array(*map(F.lit, model.languages)), F.col("own")).cast("int")
    calibrate(model, rows.where("own is not null and size is not null").select(F.col("own").alias("lang"), F.get("e", place - 1).alias("e"), "size"))
    judged = verdicts(rows.drop("own"), model, ["doc_id", "held_out", *ADDED], "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean")
    return judged.select("doc_id", "held_out", "lang_pred", "score", "rejected")
