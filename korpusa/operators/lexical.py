"""BM25 (Okapi) and token overlap of a stated question set, as two passes over the texts.

The first pass counts terms by document (one shuffle of distinct terms, partial sums first); it gives
document frequencies, the number of tokens and the floor of negative weights, a share of the mean over
the vocabulary. What questions need of it, the weights of their own terms, is small and shipped after a
check of its size. The second pass scores every text where it is read, against all questions in blocks,
and each task keeps k a question; only these are shuffled. So words that all texts share cost no
shuffle. Questions with more than MOST_SHIPPED terms in all are joined with postings instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .batches import sliced

K1, B, FLOOR = 1.5, 0.75, 0.25
MOST_SHIPPED, QUESTIONS, TEXTS = 1_000_000, 512, 512
#: Texts whose tokens are counted at a time.
COUNTED = 1024


def search_text(*fields: Column) -> Column:
    """Text to index: the fields that are not blank, in order, joined by a space."""
    return F.array_join(F.filter(F.transform(F.array(*[f.cast("string") for f in fields]), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " ")


def joined_tokens(text: Column | str) -> Column:
    """A text's tokens as one string: they hold no spaces, and strings cross to Python faster than arrays."""
    return F.array_join(tokens(text), " ")


def split_tokens(column: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Number of tokens of each row of space-joined tokens, and all tokens in order."""
    lists = pc.split_pattern(column, " ")
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(column, "").to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.where(some, size, 0), flat if some.all() else flat.filter(pc.not_equal(flat, ""))


def term_counts(joined: DataFrame) -> DataFrame:
    """``(term, df, tokens)`` of ``joined(toks)``: texts that hold a term, and its occurrences; summed in COUNTED texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, COUNTED):
            size, flat = split_tokens(b.column("toks"))
            coded = flat.dictionary_encode()
            code, n = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
            kinds = np.unique(np.repeat(np.arange(len(b)), size) * n + code) % n
            counts = [pa.array(np.bincount(x, minlength=n)[: len(coded.dictionary)]) for x in (kinds, code)]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *counts], ["term", "df", "tokens"])

    return joined.select("toks").mapInArrow(run, "term string, df long, tokens long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def term_statistics(joined: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """``(term, idf, kinds, tokens)`` of each of ``wanted(term)`` that a text has, and of all other terms together (term null).

    One pass and one shuffle give the weights and the sums behind the vocabulary's mean and the texts' mean length.
    """
    raw = term_counts(joined).withColumn("idf", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    marked = raw.join(wanted.withColumn("wanted", F.lit(True)), "term", "left")
    return marked.groupBy(F.when(F.col("wanted"), F.col("term")).alias("term")).agg(F.sum("idf").alias("idf"), F.count("*").alias("kinds"), F.sum("tokens").alias("tokens"))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def best(docs: DataFrame, queries: DataFrame, k: int, same: str | None = None, kinds: tuple[str, ...] = ("bm25", "overlap")) -> DataFrame:
    """``(kind, query_id, id, score, rank)``: k best of ``docs(id, text)`` for each of ``queries(query_id, text)``.

    ``docs`` may hold ``toks``, its texts' joined_tokens(), instead of texts. It is read up to three times: give a written table
    when its rows are costly to make.
    kind is one of ``kinds``: ``bm25`` (score above 0) or ``overlap`` (distinct tokens that text and question share). A term
    that a question repeats counts as often. Scores are rounded to 6 places; ties go to the smaller id.
    ``same`` names a column of both that must agree (a document scope, applied before ranking).
    """
    keep = [same] if same else []
    toks = docs.select("id", "toks" if "toks" in docs.columns else joined_tokens("text").alias("toks"), *keep)
    n, asked = docs.count(), asked_terms(queries)
    if not n:
        return _ranked(docs.sparkSession.createDataFrame([], "kind string, query_id long, id long, score double"), k)
    rows = asked.limit(MOST_SHIPPED + 1).toArrow()
    if len(rows) > MOST_SHIPPED:
        return _joined(toks, n, asked, queries, k, keep)
    scopes = dict(queries.select("query_id", same).collect()) if same else {}
    if "bm25" in kinds:
        stats = term_statistics(toks, n, F.broadcast(asked.select("term").distinct())).toArrow()  # a row a wanted term, and one
        average = float(np.sum(stats["idf"].to_numpy())) / max(1, int(np.sum(stats["kinds"].to_numpy())))
        mean = float(np.sum(stats["tokens"].to_numpy())) / n or 1.0
        stats = stats.filter(stats["term"].is_valid())
        idf, terms = stats["idf"].to_numpy().astype(float), stats["term"].combine_chunks()
        idf = np.where(idf < 0, FLOOR * average, idf)
    else:  # shared tokens need no weights, so no pass over the texts for them
        terms, mean = pc.unique(rows["term"].combine_chunks()), 1.0
        idf = np.zeros(len(terms))
    rows = rows.filter(pc.is_in(rows["term"], value_set=terms))
    place = pc.index_in(rows["term"], value_set=terms).to_numpy().astype(np.int64)
    query, row = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
    weight = rows["qf"].to_numpy() * idf[place]
    shared = docs.sparkSession.sparkContext.broadcast((terms, place, query, row, weight, mean, scopes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, place, query, row, weight, mean, scopes = shared.value
        kept = {kind: (np.full((len(query), k), -np.inf), np.full((len(query), k), np.iinfo(np.int64).max)) for kind in kinds}
        scope = np.array([scopes.get(int(q)) for q in query], object) if scopes else None
        blocks = []
        for lo in range(0, len(query), QUESTIONS):
            at = np.flatnonzero((row >= lo) & (row < lo + QUESTIONS))
            used, col = np.unique(place[at], return_inverse=True)
            w = np.zeros((len(used), min(QUESTIONS, len(query) - lo)))
            w[col, row[at] - lo] = weight[at]
            has = np.zeros_like(w)
            has[col, row[at] - lo] = 1.0
            blocks.append((lo, used, w, has))
        for b in sliced(batches, TEXTS):
            ids = b.column("id").to_numpy()
            size, flat = split_tokens(b.column("toks"))
            found = pc.index_in(flat, value_set=terms)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(b)), size)[known]
            key, tf = np.unique(doc * len(terms) + found.drop_null().to_numpy().astype(np.int64), return_counts=True)
            doc, term = np.divmod(key, max(len(terms), 1))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
            for lo, used, w, has in blocks:
                col = np.searchsorted(used, term)
                ok = (col < len(used)) & (used[np.minimum(col, len(used) - 1)] == term) if len(used) else np.zeros(len(term), bool)
                f, g = np.zeros((len(b), len(used))), np.zeros((len(b), len(used)))
                f[doc[ok], col[ok]], g[doc[ok], col[ok]] = part[ok], 1.0
                allowed = np.ones((w.shape[1], len(b)), bool)
                if scope is not None:
                    allowed = scope[lo : lo + w.shape[1], None] == np.array(b.column(keep[0]).to_pylist(), object)[None, :]
                for kind in kinds:
                    scores = np.round(f @ w, 6).T if kind == "bm25" else np.rint(g @ has).T
                    scores = np.where((scores > 0) & allowed, scores, -np.inf)
                    s0, i0 = kept[kind]
                    # a score below a question's k-th can't enter; most questions have none above it
                    reach = (scores > -np.inf) & (scores >= s0[lo : lo + len(scores), -1:])
                    for at in np.flatnonzero(reach.any(axis=1)).tolist():
                        s, i = np.append(s0[lo + at], scores[at, reach[at]]), np.append(i0[lo + at], ids[reach[at]])
                        order = np.lexsort((i, -s))[:k]
                        s0[lo + at], i0[lo + at] = s[order], i[order]
        for kind, (s, i) in kept.items():
            r, c = np.nonzero(s > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(r), pa.string()), pa.array(query[r], pa.int64()), pa.array(i[r, c]), pa.array(s[r, c])], ["kind", "query_id", "id", "score"])

    return _ranked(toks.mapInArrow(run, "kind string, query_id long, id long, score double"), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("kind", "query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _joined(toks: DataFrame, n: int, asked: DataFrame, queries: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """best() by an equi-join of weights and postings, for question sets too large to ship."""
    stats = term_statistics(toks, n, asked.select("term").distinct())
    average, mean = stats.agg(F.sum("idf") / F.sum("kinds"), F.sum("tokens") / n).first()
    idf = F.when(F.col("idf") < 0, FLOOR * (average or 0.0)).otherwise(F.col("idf"))
    weights = asked.join(stats.where("term is not null").select("term", idf.alias("idf")), "term")
    lists = toks.select("id", *keep, F.filter(F.split("toks", " "), lambda x: x != "").alias("toks"))
    postings = lists.select("id", *keep, F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("id", *keep, "dl", "term").agg(F.count("*").alias("tf"))
    wanted = weights.join(queries.select("query_id", *keep), "query_id") if keep else weights
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    met = wanted.join(postings, ["term", *keep])
    sums = met.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("bm25"), F.count("*").cast("double").alias("overlap"))
    scored = sums.select("query_id", "id", F.explode(F.create_map(F.lit("bm25"), "bm25", F.lit("overlap"), "overlap")).alias("kind", "score"))
    return _ranked(scored.where("score > 0").select("kind", "query_id", "id", "score"), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    return best(docs, queries, k, same, ("bm25",)).where("kind = 'bm25'").drop("kind")


def overlap(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return best(docs, queries, k, kinds=("overlap",)).where("kind = 'overlap'").drop("kind")


def top(scored: DataFrame, k: int, group: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """``rank`` 1..k within each group: score descending, ties by ``tie``."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
