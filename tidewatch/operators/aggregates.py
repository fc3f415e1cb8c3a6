"""Distributions, coverage, risk and evaluation as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo, grid


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float = 0.25) -> DataFrame:
    """keys and one column a share: exact quantiles with linear interpolation between ranks, of non-null values.

    Values are counted first, then bins of `width` find where each rank lies; only those bins are sorted, each by itself, so no
    group's values come together in one task.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("_v") / width))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_k"))
    up, whole = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_k").over(up), F.lit(0))).withColumn("_all", F.sum("_k").over(whole))
    rank = {n: (F.col("_all") - 1) * q for n, q in shares.items()}
    held = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_k"))
    wanted = F.lit(False)
    for r in rank.values():
        wanted = wanted | held(F.floor(r)) | held(F.ceil(r))
    within = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    part = counted.join(bins.filter(wanted).select(*keys, "_bin", "_before", "_all"), [*keys, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    ends = part.groupBy(*keys).agg(F.first("_all").alias("_all"), *(at(F.floor(r)).alias(f"_lo_{n}") for n, r in rank.items()), *(at(F.ceil(r)).alias(f"_hi_{n}") for n, r in rank.items()))
    return ends.select(*keys, *((F.col(f"_lo_{n}") + (r - F.floor(r)) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, r in rank.items()))


def baseline(points: DataFrame, cell: str = "cell", value: str = "sog", key: str = "key", least: int = 100) -> DataFrame:
    """Distribution of a value by cell: percentiles, moments, keys, keys a day, course concentration; `insufficient` below `least` rows."""
    rows = points.filter(F.col(value).isNotNull())
    seen = rows.groupBy(cell, F.to_date("ts").alias("day"), key).agg(F.lit(1).alias("_1"))
    daily = seen.groupBy(cell, "day").agg(F.count("*").alias("k")).groupBy(cell).agg(F.round(F.avg("k"), 2).alias("keys_a_day"))
    c = F.radians("cog")
    stats = rows.groupBy(cell).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean"), F.round(F.stddev_pop(value), 3).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.round(F.sqrt(F.pow(F.avg(F.cos(c)), 2) + F.pow(F.avg(F.sin(c)), 2)), 3).alias("course_r"),
    )
    keys = rows.groupBy(cell).agg(F.count_distinct(key).alias("n_keys"))
    quantiles = exact_quantiles(rows, [cell], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return stats.join(daily, cell).join(keys, cell).join(quantiles, cell).select(
        cell, "n", "n_keys", *(F.round(n, 3).alias(n) for n in ("p50", "p95", "p99")), "mean", "std", "least", "most", "course_r", "keys_a_day",
        F.when(F.col("n") < least, "insufficient").otherwise("usable").alias("status"),
    )


def is_unusual(points: DataFrame, base: DataFrame, cell: str = "cell", value: str = "sog") -> DataFrame:
    """Adds unusual: value above the cell's 95th percentile; null (unknown) without a usable cell."""
    known = base.filter("status = 'usable'").select(cell, F.col("p95").alias("_p"))
    return points.join(known, cell, "left").withColumn("unusual", F.col(value) > F.col("_p")).drop("_p")


def density(events: DataFrame, res: int = 5) -> DataFrame:
    """Events by cell and kind: count and mean position."""
    return events.groupBy(grid.cell("lat", "lon", res).alias("cell"), "kind").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def noisy_or(rows: DataFrame, key: str, strength: str) -> DataFrame:
    """Each row with its key's noisy-OR score and its share of it (points add up to the score)."""
    w = Window.partitionBy(key)
    logs = F.log1p(-F.least(F.col(strength), F.lit(0.99)))
    total = F.sum("_l").over(w)
    return rows.withColumn("_l", logs).withColumn("score", 1 - F.exp(total)).withColumn("points", F.when(total == 0, 0.0).otherwise(F.col("score") * F.col("_l") / total)).drop("_l")


def merged_repeats(rows: DataFrame, keys: list[str], confidence: str, top: int = 3, cap: float = 0.99) -> DataFrame:
    """Occurrences of one factor as one: noisy-OR of the `top` most confident, capped."""
    w = Window.partitionBy(*keys).orderBy(F.desc(confidence))
    best = rows.withColumn("_i", F.row_number().over(w))
    return best.groupBy(*keys).agg(
        F.least(F.lit(cap), 1 - F.exp(F.sum(F.when(F.col("_i") <= top, F.log1p(-F.least(F.col(confidence), F.lit(0.999999))))))).alias("confidence"), F.count("*").alias("n")
    )


#: Weights of the four components of risk, and what an alert that nobody has judged counts (fixed values).
RISK_WEIGHTS = {"anomaly": 0.45, "sanctions": 0.30, "flag": 0.15, "ownership": 0.10}
UNJUDGED = 0.6


def anomaly_part(alerts: DataFrame, as_of, key: str = "subject", half_life_days: float = 30.0) -> DataFrame:
    """By subject: anomaly, what its alerts up to a time add up to, each halving with its age. alerts: subject, score, ts, disposition.

    Dismissed alerts are out, confirmed ones count fully.
    """
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400e6)
    live = alerts.filter((F.coalesce("disposition", F.lit("")) != "dismiss") & (age >= 0))
    weight = F.col("score") * F.when(F.col("disposition") == "confirm", 1.0).otherwise(UNJUDGED)
    return live.groupBy(key).agg((1 - F.exp(-F.sum(geo.decayed(weight, age, F.lit(half_life_days))))).alias("anomaly"), F.count("*").alias("n_alerts"))


def risk(parts: dict[str, DataFrame], key: str = "subject") -> DataFrame:
    """The weighted sum of the components, each a frame of key and a column of its name (0 to 1); a missing one is 0. Ranked, most risk first."""
    out = None
    for name, frame in parts.items():
        one = frame.select(key, F.col(name).cast("double").alias(name))
        out = one if out is None else out.join(one, key, "full")
    total = sum((w * (F.coalesce(F.col(n), F.lit(0.0)) if n in parts else F.lit(0.0)) for n, w in RISK_WEIGHTS.items()), F.lit(0.0))
    return out.fillna(0.0, list(parts)).withColumn("risk", total)


def best_threshold(labelled: DataFrame, kind: str = "anomaly_type", score: str = "score", label: str = "label", least: int = 6, recall: float = 0.5) -> DataFrame:
    """For each detector with enough labels, the threshold of best precision whose recall suffices; the lower of equals."""
    rows = labelled.filter(F.col(label).isin("confirm", "dismiss") & F.col(score).isNotNull())
    at = rows.groupBy(kind, score).agg(F.sum(F.when(F.col(label) == "confirm", 1).otherwise(0)).alias("tp"), F.count("*").alias("n"))
    down = Window.partitionBy(kind).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(kind)
    cut = at.select(kind, score, F.sum("tp").over(down).alias("tp"), F.sum("n").over(down).alias("n"), F.sum("tp").over(whole).alias("pos"), F.sum("n").over(whole).alias("all"))
    ok = cut.filter((F.col("all") >= least) & (F.col("pos") > 0) & (F.col("tp") / F.col("pos") >= recall)).withColumn("precision", F.col("tp") / F.col("n"))
    best = ok.groupBy(kind).agg(F.max(F.struct("precision", (-F.col(score)).alias("k"), (F.col("tp") / F.col("pos")).alias("recall"))).alias("b"))
    return best.select(kind, (-F.col("b.k")).alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def static_objects(contacts: DataFrame, res: int = 8, least_scenes: int = 3, least_days: float = 7.0, radius_m: float = 200.0) -> DataFrame:
    """Objects that stay: cells seen in several scenes over days, with contacts close around their median."""
    c = contacts.withColumn("cell", grid.cell("lat", "lon", res))
    mid = c.groupBy("cell").agg(
        F.count_distinct("scene_id").alias("n_scenes"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.percentile("lat", 0.5).alias("lat"), F.percentile("lon", 0.5).alias("lon"), F.percentile("length_m", 0.5).alias("length_m")
    ).filter((F.col("n_scenes") >= least_scenes) & (F.col("last_t") - F.col("first_t") >= least_days * 86_400))
    spread = c.select("cell", F.col("lat").alias("_a"), F.col("lon").alias("_o")).join(mid, "cell").groupBy("cell").agg(F.percentile(geo.haversine("_a", "_o", "lat", "lon"), 0.9).alias("spread_m"))
    return mid.join(spread.filter(F.col("spread_m") <= radius_m), "cell")


def votes(rows: DataFrame, key: str, choice: str, order: str) -> DataFrame:
    """Each key's most common choice (the first seen of equals) and its share of the key's rows."""
    total = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    each = rows.filter(F.col(choice).isNotNull()).groupBy(key, choice).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = each.groupBy(key).agg(F.max(F.struct("n", (-F.col("_first")).alias("k"), choice)).alias("b"))
    return total.join(best, key, "left").select(key, "n_rows", F.col(f"b.{choice}").alias(choice), (F.coalesce(F.col("b.n"), F.lit(0)) / F.col("n_rows")).alias("support"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows, nulls, least and most as text, distinct values."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        v = F.col(c).cast("string")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_0"), F.min(v).alias(f"{c}_1"), F.max(v).alias(f"{c}_2"), F.count_distinct(c).alias(f"{c}_3")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n"), F.col(f"{c}_0").alias("n_null"), F.col(f"{c}_1").alias("least"), F.col(f"{c}_2").alias("most"), F.col(f"{c}_3").alias("n_distinct")) for c in columns))).alias("r")).select("r.*")


def split_counts(df: DataFrame, *keys: str, flag: str = "is_synthetic") -> DataFrame:
    """Real and synthetic counts, never a total; a missing flag is real."""
    syn = F.coalesce(F.col(flag), F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(~syn).alias("real"), F.count_if(syn).alias("synthetic"))


def precision_recall(matched: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall and F1 of boolean columns; null where undefined."""
    n = lambda c: F.count_if(c).cast("double")
    p, a = F.col(predicted), F.col(actual)
    s = matched.agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"))
    div = lambda x, y: F.when(y > 0, x / y)
    s = s.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def coverage_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value in each column; an empty string is none, zero and false are values."""
    return df.agg(*(F.avg(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1.0).otherwise(0.0)).alias(c) for c in columns))


def when_chain(rules: list[tuple[Column, str]], default: str) -> Column:
    """The first rule that holds, in order; unknown (null) conditions do not hold."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out
