"""URL filter: host and path rules, then a character language-model ratio; DataFrame expressions only.

Two smoothed variable-order Markov models over characters are trained, one on accepted and one on
rejected URLs: those that a rule decides, and those that hold a seed term. P(c | h) is Witten-Bell
interpolated from the longest context down to the uniform distribution. A URL's score is the mean over
its characters of log P_accepted - log P_rejected. Both are trained on and applied to the whole URL after
the ``://``, query and fragment included, lower-cased (a URL without ``://``: all of it); the threshold is calibrated on the training URLs,
halfway between the low tail of the accepted and the high tail of the rejected.

Every distinct n-gram is scored once, then joined to the distinct URLs' n-grams, so the work follows
distinct text, not rows. N-grams that a large share of all URLs hold ("www.") and URLs that a large share
of all rows hold (null ones) meet their one score by broadcast where they are (split_join), all others by
shuffle; their rows are counted where the n-grams and URLs are counted anyway.

Defined results: null url or one without ``://`` has empty host and path and no rule; null and empty URLs
score 0, others by their text; very long URLs are scored whole; a score at the threshold (a tie) is allowed; every row keeps its own output row; without training URLs of both
classes every score is 0 and the model allows; of the input only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, split_join, table

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that make an unruled URL a training example of the rejected kind.
SEEDS = ("casino", "cheap", "gambl", "pills", "porn", "spam", "viagra", "xxx")
ORDER = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, or all of a URL without one; empty for null."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.coalesce(url, F.lit("")))


def ruled(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # later, longer rules win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def grams(texts: DataFrame, *keep: str) -> DataFrame:
    """Every ORDER-gram that ends in a character of ``s`` or in its end mark."""
    padded = F.concat(F.lit("\u0001" * (ORDER - 1)), "s", F.lit("\u0002"))
    places = F.sequence(F.lit(1), F.length("s") + 1)
    return texts.select(*keep, F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("g"))


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(g, r)``: log P_accepted - log P_rejected of every wanted n-gram; counts is (g, a, b)."""
    size = F.lit(1.0) / (counts.select(F.countDistinct(F.right("g", F.lit(1)))).first()[0] + 1)  # one number
    out = wanted.withColumns({"pa": size, "pb": size})
    for k in range(1, ORDER + 1):
        gram, ctx = F.right("g", F.lit(k)), F.substring("g", ORDER - k + 1, k - 1)
        of = counts.groupBy(gram.alias("x")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        after = of.groupBy(F.substring("x", 1, k - 1).alias("h")).agg(
            F.sum("na").alias("ca"), F.sum("nb").alias("cb"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nb") > 0).alias("tb")
        )
        out = out.withColumns({"x": gram, "h": ctx}).join(of, "x", "left").join(after, "h", "left").drop("x", "h")
        step = {}
        for c in "ab":
            n, total, kinds = (F.coalesce(F.col(f"{x}{c}"), F.lit(0)) for x in ("n", "c", "t"))
            step[f"p{c}"] = F.when(total > 0, (n + kinds * F.col(f"p{c}")) / (total + kinds)).otherwise(F.col(f"p{c}"))
        out = out.withColumns(step).drop("na", "nb", "ca", "cb", "ta", "tb")
    return out.select("g", (F.log("pa") - F.log("pb")).alias("r"))


def scored(urls: DataFrame) -> DataFrame:
    """``(s, label, score)`` of distinct texts; input (s, label, n): label 1 accepted, -1 rejected, 0 unknown."""
    every = durable(grams(urls, "label", "n").groupBy("g").agg(
        F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") < 0, F.col("n")).otherwise(0)).alias("b"),
        F.count("*").alias("c__"),
    ))
    counts = every.where("a + b > 0").select("g", "a", "b")
    both = counts.agg(F.sum("a"), F.sum("b")).first()
    if not both[0] or not both[1]:
        return urls.select("s", "label", F.lit(0.0).alias("score"))
    ratios = log_ratios(counts, every.select("g"))
    sums = split_join(grams(urls, "s"), ratios, ["g"], counts=every.select("g", "c__")).groupBy("s").agg(F.avg("r").alias("score"))
    return urls.select("s", "label").join(sums, "s").select("s", "label", F.when(F.length("s") == 0, 0.0).otherwise(F.col("score")).alias("score"))


def threshold(scores: DataFrame) -> float:
    """Halfway between the accepted URLs' 2nd and the rejected URLs' 98th percentile; 0 without both."""
    low, high = scores.agg(
        F.percentile_approx(F.when(F.col("label") > 0, F.col("score")), 0.02), F.percentile_approx(F.when(F.col("label") < 0, F.col("score")), 0.98)
    ).first()
    return 0.0 if low is None or high is None else (low + high) / 2


def judge(pages: DataFrame, rules: tuple = RULES, seeds: tuple = SEEDS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.lower(after_scheme(F.col("url"))).alias("s"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    seeded = F.col("s").rlike("|".join(seeds)) if seeds else F.lit(False)
    label = F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", -1).when(seeded, -1).otherwise(0)
    urls = durable(rows.groupBy("s").agg(F.max(label).alias("label"), F.count("*").alias("n")))
    scores = durable(scored(urls))
    least = threshold(scores)
    return split_join(rows, scores.select("s", "score"), ["s"], counts=urls.select("s", F.col("n").alias("c__"))).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") < least, "block").otherwise("allow")).alias("verdict"),
        F.round("score", 6).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
