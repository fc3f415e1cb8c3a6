"""Departures of a track from where its own dead reckoning put it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo
from tidewatch.operators import sequences

#: Turn up to which a leg is steady and fixes it must have been for; bounds of the lead, hours; slots of time for the look ahead (fixed values but the last).
STEADY_TURN, STEADY_FIXES, LEAST_LEAD_H, MOST_LEAD_H, SLICE_S = 20.0, 3, 1 / 3, 24.0, 86_400.0


def _steady(numbered: DataFrame, key: str) -> DataFrame:
    """numbered fixes with `steady`: none of the (two or three) turns leading to the fix is over STEADY_TURN."""
    cut = sequences.parts(numbered, back=STEADY_FIXES)
    w = Window.partitionBy(key, "part").orderBy("i")
    cut = cut.withColumn("_turn", geo.turn(F.lag("cog").over(w), F.col("cog")))
    back = F.max("_turn").over(w.rowsBetween(1 - STEADY_FIXES, 0))
    return cut.withColumn("steady", (F.col("i") >= 2) & F.coalesce(back <= STEADY_TURN, F.lit(False))).filter("own").drop("part", "own", "_turn")


def _first_at_or_after(asked: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """asked (key, target) with `found`, the first fix (t, lat, lon) at or after the target in its slot of time or the first of the next slot; else null."""
    fix = F.struct("t", "point_id", "lat", "lon")
    held = fixes.select(key, F.floor(F.col("t") / SLICE_S).alias("_s"), F.col("t").alias("_t"), fix.alias("_fix"))
    both = asked.withColumn("_s", F.floor(F.col("target") / SLICE_S)).withColumn("_t", F.col("target")).withColumn("_ask", F.lit(1))
    both = both.unionByName(held.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    ahead = Window.partitionBy(key, "_s").orderBy("_t", F.desc("_ask"), "_fix.point_id").rowsBetween(0, Window.unboundedFollowing)
    own = both.withColumn("_own", F.first("_fix", ignorenulls=True).over(ahead)).filter("_ask = 1")
    following = held.groupBy(key, (F.col("_s") - 1).alias("_s")).agg(F.min("_fix").alias("_next"))
    return own.join(following, [key, "_s"], "left").withColumn("found", F.coalesce("_own", "_next")).drop("_s", "_t", "_ask", "_fix", "_own", "_next")


def checks(fixes: DataFrame, key: str = "key", lead_h: float = 3.0, most: int = 200, sigma: str | None = None, growth_m: float = geo.NAUTICAL_MILE_M) -> DataFrame:
    """Each key's strided checks in order: key, check, t, lat, lon, seen_t, seen_lat, seen_lon, radius_m, radii, confidence.

    fixes: key, point_id, t, lat, lon, sog, cog. From every (n / most)-th fix the key is projected `lead_h` hours ahead and held against its first fix
    then. `radii` is null where no fix is near that time or the leg was not steady: nothing can be said then.
    """
    if not LEAST_LEAD_H <= lead_h <= MOST_LEAD_H:
        raise ValueError("a lead of twenty minutes to a day")
    lead = lead_h * 3600
    rows = _steady(sequences.numbered(fixes, key), key)
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    asked = rows.filter((F.col("i") % stride == 0) & (F.col("i") < F.col("n") - 1)).withColumn("check", F.floor(F.col("i") / stride)).withColumn("target", F.col("t") + lead)
    met = _first_at_or_after(asked, fixes, key)
    hours = (F.col("found.t") - F.col("t")) / 3600
    lat, lon = geo.destination("lat", "lon", "cog", F.col("sog") * geo.NAUTICAL_MILE_M * hours)
    known = F.col("steady") & (F.col("found.t") - F.col("target") <= lead / 2)
    grown = (F.col(sigma) if sigma else F.lit(0.0)) + growth_m * hours
    radius = F.greatest(F.lit(1.0), F.least(grown, geo.MAX_SPEED_KN * geo.NAUTICAL_MILE_M * hours))
    out = met.select(
        key, "check", "t", "lat", "lon", F.col("found.t").alias("seen_t"), F.col("found.lat").alias("seen_lat"), F.col("found.lon").alias("seen_lon"), radius.alias("radius_m"),
        geo.projection_confidence(hours).alias("_c"), F.when(known, geo.haversine(lat, lon, F.col("found.lat"), F.col("found.lon")) / radius).alias("radii"),
    )
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(0.95), (1 - 1 / F.col("radii")) * F.col("_c") * 1.6))).drop("_c")


def departures(checked: DataFrame, key: str = "key", margin: float = 1.0, least: int = 2) -> DataFrame:
    """The strongest check of each run of at least `least` consecutive checks outside their cones, with n_checks, the run's length.

    Within a run the first of equally strong ones stands. A key has some hundred checks at most, so its window is small.
    """
    w = Window.partitionBy(key).orderBy("check")
    out = F.coalesce(F.col("radii") > margin, F.lit(False))
    runs = sequences.islands(checked.withColumn("_out", out), key, ["check"], F.lag("_out").over(w) != F.col("_out")).filter("_out")
    each = Window.partitionBy(key, "island")
    best = runs.withColumn("n_checks", F.count("*").over(each)).withColumn("_i", F.row_number().over(each.orderBy(F.desc("radii"), "check")))
    return best.filter((F.col("n_checks") >= least) & (F.col("_i") == 1)).drop("_out", "_i", "island")
