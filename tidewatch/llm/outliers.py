"""Quality rules with robust multivariate outliers (operator 3), in DataFrame functions only.

Base statistics come from array functions on each text. For every language and
source, a minimum-covariance-determinant estimate of four transformed statistics is
found by concentration steps: distances under the present mean and covariance, the
COVER share of nearest documents by a histogram of distances, and their mean and
covariance next. Two starts (medians with MADs, means with covariances) run side by
side, and the smaller determinant wins. Documents beyond a chi-square quantile of
the Mahalanobis distance are rejected.

A covariance of few documents says little. So a document of a language and source with fewer than
LEAST documents that pass the base rules is judged by the estimate of its whole language, and if that has
fewer too by the estimate of the whole table, found in the same way. Every document that passes the
base rules has a distance.

Only sums, histograms and one row of estimates a group move between tasks, so a hot group costs
no more than its rows.

Defined cases: null and empty texts have no words and fail the base rules; null languages and
sources are groups of their own; documents that fail the base rules have no distance; repeated rows are
documents of their own; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Least documents of an estimate of their own.
LEAST = 40
COVER = 0.75
STEPS = 6
#: Chance that a normally distributed document is rejected.
ALPHA = 1e-6
#: Least standard deviation of each statistic, so that a constant one can't reject for a trifle.
FLOORS = (0.08, 0.25, 0.15, 0.15)
SYMBOLS = "#*$%&|<>"
P = len(FLOORS)


def chi2_cdf(x: float, df: int) -> float:
    """For even df."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < q else (lo, mid)
    return hi


def _without(text: Column, chars: str, put: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def base_statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keep, t.alias("_t"))
    rows = rows.select(*keep, "_t", _without(F.col("_t"), "\t\n\x0b\x0c\r", " ").alias("_u"))
    rows = rows.select(
        *keep,
        F.array_remove(F.split("_u", " "), "").alias("_w"),
        F.char_length(F.replace("_u", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(_without(F.col("_t"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_l"),
    )
    rows = rows.select(
        *keep, "word_chars", "n_symbols", "_w", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    w = F.col("_w")
    hashed = F.when(F.size(w) < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    )
    rows = rows.withColumn("_h", F.sort_array(hashed))
    at = lambda v: v["i"]

    def same(a: Column, b: Column) -> Column:
        """Equal hashes first: words are compared for few neighbours only."""
        i, j = at(a), at(b)
        return (a["h"] == b["h"]) & (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

    h = F.col("_h")
    again = F.filter(h, lambda v, k: ((k > 0) & same(v, h[F.greatest(k - 1, F.lit(0))])) | ((k < F.size(h) - 1) & same(v, h[F.least(k + 1, F.size(h) - 1)])))
    rows = rows.withColumn("_again", F.sort_array(F.transform(again, at)))
    covered = F.aggregate(
        "_again", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n")), lambda s: s["n"]
    )
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics."""
    n, c = F.col("n_words") + 1, F.col("word_chars") + 1
    return [
        F.log(c / n), F.log1p(100 * F.col("n_symbols") / c), F.log1p(10 * F.col("n_dup_lines") / (F.col("n_lines") + 1)), F.log1p(10 * F.col("n_repeat_words") / n)
    ]


_X = [f"x{i}" for i in range(P)]
_M = [f"m{i}" for i in range(P)]
_S = [(i, j) for i in range(P) for j in range(i + 1)]


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, and the Cholesky factor and determinant of the covariance (floors added), by group."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(x).alias(m) for x, m in zip(_X, _M, strict=True)), *(F.avg(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i, j in _S))
    cov = [(F.greatest(F.col(f"s{i}{j}") - F.col(_M[i]) * F.col(_M[j]), F.lit(0.0)) + FLOORS[i] ** 2 if i == j else F.col(f"s{i}{j}") - F.col(_M[i]) * F.col(_M[j])).alias(f"c{i}{j}") for i, j in _S]
    return _cholesky(sums.select(*keys, "n", *_M, *cov), keys)


def _cholesky(cov: DataFrame, keys: list[str]) -> DataFrame:
    for i, j in _S:
        left = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        cov = cov.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return cov.select(*keys, "n", *_M, *(f"l{i}{j}" for i, j in _S), det.alias("log_det"))


def distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance under the joined estimate."""
    for i in range(P):
        rows = rows.withColumn(f"y{i}", (F.col(_X[i]) - F.col(_M[i]) - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0)))


def _concentrate(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step: estimates of the COVER share nearest to the present ones."""
    from pyspark.sql.window import Window

    near = distance(rows.join(now, ["g", "start"])).select("g", "start", *_X, F.floor(64 * F.log(F.col("d2") + 1e-9)).cast("int").alias("bin"))
    bins = near.groupBy("g", "start", "bin").agg(F.count("*").alias("k"))
    up = Window.partitionBy("g", "start").orderBy("bin")
    total = F.sum("k").over(Window.partitionBy("g", "start"))
    upto = bins.withColumn("upto", F.sum("k").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", total)
    cut = upto.filter(F.col("upto") >= COVER * F.col("all")).groupBy("g", "start").agg(F.min("bin").alias("cut"))
    return _estimates(near.join(cut, ["g", "start"]).filter("bin <= cut"), ["g", "start"])


def _levels(stats: DataFrame) -> DataFrame:
    """By group g: `judge`, the estimate that its documents are judged by, and `count`, those that they count in."""
    sizes = stats.groupBy("g").agg(F.first("l").alias("l"), F.count_if(~F.col("base_failed")).alias("n"))
    langs = sizes.groupBy("l").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    both = materialize(sizes.join(langs, "l"), "groups")
    some = both.agg(F.min("n_lang").alias("n")).first()
    small, apart = F.col("n") < LEAST, F.col("n_lang") < LEAST
    judge = F.when(~small, F.concat(F.lit("s"), "g")).when(~apart, F.concat(F.lit("l"), "l")).otherwise(F.lit("a"))
    counted = F.array(
        F.when(~small, F.concat(F.lit("s"), "g")), F.when(~apart & (F.col("least") < LEAST), F.concat(F.lit("l"), "l")),
        F.when(F.lit(some.n is not None and some.n < LEAST), F.lit("a")),
    )
    return both.select("g", judge.alias("judge"), F.array_compact(counted).alias("count"))


def estimates(passed: DataFrame) -> DataFrame:
    """MCD estimate by g over rows of g and the transformed statistics."""
    medians = passed.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile_approx(x, 0.5, 2000).alias(m) for x, m in zip(_X, _M, strict=True)))
    medians = materialize(medians, "medians")
    mads = passed.join(medians, "g").groupBy("g").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 2000).alias(f"a{i}") for i, (x, m) in enumerate(zip(_X, _M, strict=True))))
    diagonal = [(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _S]
    first = _cholesky(medians.join(mads, "g").select("g", F.lit(0).alias("start"), "n", *_M, *diagonal), ["g", "start"])
    second = _estimates(passed.withColumn("start", F.lit(1)), ["g", "start"])
    now = materialize(first.unionByName(second), "mcd")

    both = passed.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        now = materialize(_concentrate(both, now), "mcd")
    return now.groupBy("g").agg(F.min(F.struct("log_det", "start", *_M, *(f"l{i}{j}" for i, j in _S))).alias("e")).select("g", "e.*")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept."""
    l, g = F.to_json(F.struct(F.col(lang).alias("l"))), F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))
    named = docs.select(F.col(doc_id).alias("doc_id"), l.alias("l"), g.alias("g"), F.col(text).alias("_text"))
    stats = base_statistics(named, "doc_id", "l", "g", text="_text").withColumn("base_failed", base_failed())
    stats = materialize(stats.select("*", *(x.alias(n) for x, n in zip(vector(), _X, strict=True))), "stats")

    levels = materialize(_levels(stats), "levels")
    passed = stats.filter(~F.col("base_failed")).select("g", *_X).join(levels, "g").select(F.explode("count").alias("g"), *_X)
    best = estimates(passed).withColumnRenamed("g", "judge")
    # The nearest share's covariance is too small by a known factor for normal data.
    scale = COVER / chi2_cdf(chi2_quantile(COVER, P), P + 2)
    limit = scale * chi2_quantile(1 - ALPHA, P)
    out = distance(stats.join(levels.select("g", "judge"), "g").join(best, "judge", "left")).withColumn("d2", F.when(~F.col("base_failed"), F.col("d2") / scale))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", (~F.col("base_failed") & (F.col("d2") <= limit / scale)).alias("kept")
    )
