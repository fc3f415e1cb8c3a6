"""Ordered operators over one key's rows: deltas, islands, visits, resampling, as-of lookups.

All of them are window functions on the key. An unbounded key can be split first by
time (`bucket` columns in the partition keys), since every operator here looks only as far as
its own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewatch.functions import geo


def _by(keys, *order) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def numbered(points: DataFrame, key: str = "key", order: tuple = ("t", "point_id"), slice_s: float = 86_400.0) -> DataFrame:
    """points with `i`, the row's place in its key from 0, and `n`, the key's rows. A key is sorted by slices of time, never as a whole."""
    sliced = points.withColumn("_s", F.floor(F.col("t") / slice_s))
    whole, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sliced.groupBy(key, "_s").agg(F.count("*").alias("_k")).select(key, "_s", (F.sum("_k").over(upto) - F.col("_k")).alias("_before"), F.sum("_k").over(whole).alias("n"))
    own = F.row_number().over(_by([key, "_s"], *order)) - 1
    return sliced.withColumn("_i", own).join(sizes, [key, "_s"]).withColumn("i", F.col("_before") + F.col("_i")).drop("_s", "_i", "_before")


def parts(numbered_: DataFrame, back: int = 0, ahead: int = 0, size: int = 4096) -> DataFrame:
    """Numbered rows in parts of `size` of their key, each with `back` rows of the part before it and `ahead` of the one after (own = false).

    Windows over (key, part) then see what windows over the key would, and no task holds a whole key.
    """
    if max(back, ahead) > size:
        raise ValueError("a part is longer than what it borrows")
    at, last = F.floor(F.col("i") / size), F.floor((F.col("n") - 1) / size)
    lead = F.when((F.col("i") % size >= size - back) & (at < last), F.array(at + 1)).otherwise(F.array().cast("array<bigint>"))
    lag = F.when((F.col("i") % size < ahead) & (at > 0), F.array(at - 1)).otherwise(F.array().cast("array<bigint>"))
    spread = numbered_.withColumn("part", F.explode(F.concat(F.array(at), lead, lag)))
    return spread.withColumn("own", F.col("part") == at)


def neighbours(points: DataFrame, values: list[str], key: str = "key", order: tuple = ("t", "point_id"), slice_s: float = 86_400.0) -> DataFrame:
    """points with `i`, `n`, and `before` and `after`: structs of the values in the key's rows next to it, null at its ends."""
    row = F.struct(*values)
    w = _by([key, "part"], "i")
    cut = parts(numbered(points, key, order, slice_s), back=1, ahead=1)
    return cut.withColumn("before", F.lag(row).over(w)).withColumn("after", F.lead(row).over(w)).filter("own").drop("part", "own")


def deltas(points: DataFrame, key: str = "key", order: tuple = ("t", "point_id")) -> DataFrame:
    """Adds dt (s), turn (degrees) and leg (m) from the row before."""
    w = _by(key, *order)
    return points.select(
        "*", (F.col("t") - F.lag("t").over(w)).alias("dt"), geo.turn(F.lag("cog").over(w), F.col("cog")).alias("turn"),
        geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon").alias("leg"),
    )


def gaps(points: DataFrame, key: str = "key", least_s: float = 900.0, times_median: float = 3.0, carry: tuple = ()) -> DataFrame:
    """Silences longer than both `least_s` and `times_median` times the key's median interval; `carry`: columns to take from both ends."""
    w = _by(key, "t", "point_id")
    ahead = points.select(key, "point_id", "t", "lat", "lon", F.lead("t").over(w).alias("t_end"), F.lead("lat").over(w).alias("lat_end"), F.lead("lon").over(w).alias("lon_end"), *carry, *(F.lead(c).over(w).alias(f"{c}_end") for c in carry))
    ahead = ahead.filter(F.col("t_end").isNotNull()).withColumn("dt", F.col("t_end") - F.col("t"))
    cadence = ahead.groupBy(key).agg(F.percentile("dt", 0.5).alias("median_s"))
    limit = F.greatest(F.lit(least_s), times_median * F.greatest("median_s", F.lit(1.0)))
    return ahead.join(cadence, key).filter(F.col("dt") > limit)


def islands(rows: DataFrame, key: str, order: list, starts: Column) -> DataFrame:
    """Adds `island`: runs of rows, a new one beginning wherever `starts` is true (null starts one too)."""
    return rows.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn(
        "island", F.sum("_new").over(_by(key, *order).rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_new")


def state_runs(points: DataFrame, state: Column, key: str = "key", least_s: float = 0.0) -> DataFrame:
    """Runs of consecutive rows in which `state` holds: key, t_start, t_end, n, duration_s, mean position."""
    w = _by(key, "t", "point_id")
    flagged = points.withColumn("_on", F.coalesce(state, F.lit(False)))
    flagged = islands(flagged, key, ["t", "point_id"], F.lag("_on").over(w) != F.col("_on"))
    runs = flagged.filter("_on").groupBy(key, "island").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
    return runs.withColumn("duration_s", F.col("t_end") - F.col("t_start")).filter(F.col("duration_s") >= least_s).drop("island")


def sessions(points: DataFrame, key: str = "key", break_s: float = 1800.0) -> DataFrame:
    """Segments of a key's rows with no silence over `break_s`; lineage: the segment before."""
    w = _by(key, "t", "point_id")
    parts = islands(points, key, ["t", "point_id"], F.col("t") - F.lag("t").over(w) > break_s)
    seg = parts.groupBy(key, "island").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_points"))
    return seg.withColumn("fragmented_from", F.lag("island").over(_by(key, "island")))


def visits(points: DataFrame, zone: Column, key: str = "key", merge_s: float = 1800.0, dwell_s: float = 900.0) -> DataFrame:
    """Stays in zones: fixes of a zone less than merge_s apart are one stay; short ones go. Censored at the first or last fix."""
    w = _by(key, "t", "point_id")
    inside = points.withColumn("zone", zone).withColumn("_first", F.lag("t").over(w).isNull()).withColumn("_last", F.lead("t").over(w).isNull()).filter(F.col("zone").isNotNull())
    by_zone = Window.partitionBy(key, "zone").orderBy("t", "point_id")
    marked = inside.withColumn("_new", F.when(F.coalesce(F.col("t") - F.lag("t").over(by_zone) >= merge_s, F.lit(True)), 1).otherwise(0))
    marked = marked.withColumn("visit", F.sum("_new").over(by_zone.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(key, "zone", "visit").agg(
        F.min("t").alias("t_enter"), F.max("t").alias("t_last"), F.min("sog").alias("min_sog"), F.avg("sog").alias("mean_sog"),
        F.bool_or("_first").alias("entry_censored"), F.bool_or("_last").alias("open"),
    )
    out = out.withColumn("dwell_s", F.col("t_last") - F.col("t_enter")).withColumn("t_exit", F.when(~F.col("open"), F.col("t_last")))
    return out.filter(F.col("dwell_s") >= dwell_s).drop("visit", "t_last")


def call_sequence(points: DataFrame, place: Column, key: str = "key") -> DataFrame:
    """Places in the order of calls, repeats and nulls skipped: (key, calls array)."""
    seen = points.withColumn("_p", place).filter(F.col("_p").isNotNull())
    w = _by(key, "t", "point_id")
    changed = seen.filter(~F.col("_p").eqNullSafe(F.lit(None))).withColumn("_q", F.lag("_p").over(w)).filter(~F.col("_p").eqNullSafe(F.col("_q")))
    return changed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "point_id", "_p"))).alias("_c")).select(key, F.col("_c._p").alias("calls"))


def resample(points: DataFrame, key: str = "key", step_s: int = 300) -> DataFrame:
    """Positions on a grid of times by linear interpolation, where the bracketing interval is at most 2 * max(step, 3 * median)."""
    w = _by(key, "t", "point_id")
    pairs = points.select(key, "t", "lat", "lon", "sog", *(F.lead(c).over(w).alias(f"{c}2") for c in ("t", "lat", "lon", "sog"))).filter("t2 > t")
    cadence = pairs.groupBy(key).agg(F.percentile(F.col("t2") - F.col("t"), 0.5).alias("med"))
    pairs = pairs.join(cadence, key).filter(F.col("t2") - F.col("t") <= 2 * F.greatest(F.lit(float(step_s)), 3 * F.col("med")))
    first, last = F.ceil(F.col("t") / step_s), F.ceil(F.col("t2") / step_s) - 1
    out = pairs.filter(last >= first).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("g", F.col("_k") * step_s)
    f = (F.col("g") - F.col("t")) / (F.col("t2") - F.col("t"))
    return out.select(key, F.col("g").cast("long").alias("t"), *((F.col(c) + f * (F.col(f"{c}2") - F.col(c))).alias(c) for c in ("lat", "lon", "sog")))


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, values: list[str]) -> DataFrame:
    """left with the right side's last values at or before its time (`<value>_asof`) and first after (`<value>_next`).

    One union and one sort a key, instead of a range join.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(key, t, *values).select(key, t, *(F.col(v).alias(f"_v_{v}") for v in values)).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    held = F.struct(F.col(t).alias("t"), *(F.col(f"_v_{v}").alias(v) for v in values))
    both = both.withColumn("_r", F.when(F.col("_side") == 0, held))
    back = Window.partitionBy(key).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc(t), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_b", F.last("_r", ignorenulls=True).over(back)).withColumn("_n", F.last("_r", ignorenulls=True).over(ahead)).filter("_side = 1")
    return out.select(*left.columns, *(F.col(f"_b.{v}").alias(f"{v}_asof") for v in ["t", *values]), *(F.col(f"_n.{v}").alias(f"{v}_next") for v in ["t", *values]))


def decimate(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """At most about `most` rows a key: every ceil(n / most)-th, and the last."""
    w = _by(key, *order)
    n = F.count("*").over(Window.partitionBy(key))
    numbered = rows.withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    return numbered.filter(((F.col("_i") - 1) % F.ceil(F.col("_n") / most) == 0) | (F.col("_i") == F.col("_n"))).drop("_i", "_n")


def merge_intervals(rows: DataFrame, key: str, start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Overlapping intervals of a key as one: key, start, end, n_merged."""
    w = _by(key, start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(rows, key, [start, end], F.col(start) > reach).groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("island")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_i", F.row_number().over(_by(keys, *order))).filter("_i = 1").drop("_i")


def changes(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Rows whose value differs from the one before (first rows are no change): key, order, before, after."""
    w = _by(key, *order)
    return rows.withColumn("before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") > 1) & ~F.col("before").eqNullSafe(F.col(value))).select(key, *order, "before", F.col(value).alias("after"))


def superseded(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Adds `superseded`: some later row of the key has another value."""
    w = _by(key, *order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("superseded", F.coalesce((F.min(value).over(w) != F.col(value)) | (F.max(value).over(w) != F.col(value)), F.lit(False)))


def first_visits(visits_: DataFrame, key: str, zone: str, t: str, prior: int = 3) -> DataFrame:
    """First-ever visits of a zone by a key that has seen at least `prior` other zones before."""
    w = Window.partitionBy(key, zone).orderBy(t)
    firsts = visits_.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
    seen = firsts.withColumn("n_prior", (F.row_number().over(_by(key, t, zone)) - 1).cast("long"))
    return seen.filter(F.col("n_prior") >= prior)


def longest_run(rows: DataFrame, key: str, order: list, state: Column) -> DataFrame:
    """The longest run of consecutive rows in `state`, the earliest of equals: key, n, first position, is_tail, and its first and last order[0]."""
    w = _by(key, *order)
    flagged = rows.withColumn("_on", state).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    flagged = islands(flagged, key, order, F.lag("_on").over(w) != F.col("_on"))
    runs = flagged.filter("_on").groupBy(key, "island").agg(F.count("*").alias("n"), F.min("_i").alias("at"), F.max("_i").alias("upto"), F.first("_n").alias("all"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))
    best = runs.groupBy(key).agg(F.max(F.struct("n", (-F.col("at")).alias("k"), "upto", "all", "start", "end")).alias("b"))
    return best.select(key, F.col("b.n").alias("n"), (-F.col("b.k")).cast("long").alias("first_row"), (F.col("b.upto") == F.col("b.all")).alias("is_tail"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))
