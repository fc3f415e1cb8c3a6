"""Polygons as arrays of corners, and analyses of tracks against them.

A ring is an array of struct(lat, lon), closed. Distances are great-circle metres; the nearest point of an edge is
found in degrees, which is near enough to pick it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo
from tidewatch.operators import sequences

DEGREE_KM = geo.EARTH_ZONE_M / 1000 * math.pi / 180


def _edges(ring: Column) -> Column:
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def distance_m(lat, lon, ring: Column) -> Column:
    """Metres from a point to a ring; 0 inside and on it."""
    y, x = F.col(lat), F.col(lon)

    def nearest(e: Column) -> Column:
        dy, dx = e["b"]["lat"] - e["a"]["lat"], e["b"]["lon"] - e["a"]["lon"]
        length = dy * dy + dx * dx
        u = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((y - e["a"]["lat"]) * dy + (x - e["a"]["lon"]) * dx) / length))).otherwise(0.0)
        la, lo = e["a"]["lat"] + u * dy, e["a"]["lon"] + u * dx
        return F.struct(((y - la) * (y - la) + (x - lo) * (x - lo)).alias("d"), la.alias("lat"), lo.alias("lon"))

    best = F.array_min(F.transform(_edges(ring), nearest))
    return F.when(geo.ring_contains(lat, lon, ring), 0.0).otherwise(geo.haversine(y, x, best["lat"], best["lon"], geo.EARTH_ZONE_M))


def _cross(e: Column) -> Column:
    return e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]


def _total(ring: Column, of) -> Column:
    return F.aggregate(F.transform(_edges(ring), of), F.lit(0.0), lambda s, v: s + v)


def centroid(ring: Column) -> tuple[Column, Column]:
    """(lat, lon) of a ring's area."""
    twice = _total(ring, _cross)
    at = lambda c: _total(ring, lambda e: (e["a"][c] + e["b"][c]) * _cross(e)) / (3 * twice)
    return at("lat"), at("lon")


def area_km2(ring: Column) -> Column:
    """Square kilometres: square degrees, corrected for the centroid's latitude."""
    return F.abs(_total(ring, _cross)) / 2 * DEGREE_KM * DEGREE_KM * F.cos(F.radians(centroid(ring)[0]))


def circle(lat, lon, radius_m, steps: int = 64) -> Column:
    """A ring of true radius, by bearings."""
    corner = lambda i: F.struct(*(c.alias(n) for c, n in zip(geo.destination(lat, lon, i % steps * (360.0 / steps), radius_m), ("lat", "lon"), strict=True)))
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), corner)


def crossing(before: Column, after: Column, ring: Column, entering: Column, halvings: int = 12) -> Column:
    """struct(t, lat, lon): where a leg between two fixes (structs of t, lat, lon) crosses a ring, by halving."""
    at = lambda f, c: before[c] + (after[c] - before[c]) * f

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        beyond = geo.ring_contains(at(mid, "lat"), at(mid, "lon"), ring) == entering
        return F.struct(F.when(beyond, s["lo"]).otherwise(mid).alias("lo"), F.when(beyond, mid).otherwise(s["hi"]).alias("hi"))

    f = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve, lambda s: s["hi"])
    return F.struct(*(at(f, c).alias(c) for c in ("t", "lat", "lon")))


def wkt(ring: Column) -> Column:
    """POLYGON text with six decimals."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"])), ", "), F.lit("))"))


def ring_of(text) -> Column:
    """The outer ring of POLYGON text; null if it is none."""
    body = F.regexp_extract(F.col(text), r"^\s*POLYGON\s*\(\(([^()]*)\)", 1)
    pairs = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(1)).try_cast("double").alias("lat"), F.get(p, F.lit(0)).try_cast("double").alias("lon")))
    whole = ~F.exists(ring, lambda p: p["lat"].isNull() | p["lon"].isNull())
    return F.when((body != "") & whole & (F.size(ring) >= 4), ring)


def longest_sustained(points: DataFrame, condition: Column, least_s: float, value: Column, key: str = "key") -> DataFrame:
    """Each key's longest run of consecutive fixes under a condition, if it lasts least_s; the first of equals.

    key, t_start, duration_s, value (that of the run's last fix), n_run.
    """
    w = Window.partitionBy(key).orderBy("t", "point_id")
    rows = points.withColumn("_on", F.coalesce(condition, F.lit(False))).withColumn("_v", value)
    rows = sequences.islands(rows, key, ["t", "point_id"], F.lag("_on").over(w) != F.col("_on")).filter("_on")
    runs = rows.groupBy(key, "island").agg(F.min("t").alias("t_start"), (F.max("t") - F.min("t")).alias("duration_s"), F.max_by("_v", F.struct("t", "point_id")).alias("value"), F.count("*").alias("n_run"))
    best = runs.filter(F.col("duration_s") >= least_s).groupBy(key).agg(F.max(F.struct("duration_s", (-F.col("t_start")).alias("k"), "t_start", "value", "n_run")).alias("b"))
    return best.select(key, F.col("b.t_start").alias("t_start"), F.col("b.duration_s").alias("duration_s"), F.col("b.value").alias("value"), F.col("b.n_run").alias("n_run"))


def lane_deviation(points: DataFrame, lanes: list[Column], least_km: float = 60.0, least_min: float = 180.0, least_sog: float = 6.0, key: str = "key") -> DataFrame:
    """Keys under way, far from every lane, for long: rule, subject, t, score, distance_km, duration_min. lanes: rings, few."""
    km = F.least(*(distance_m("lat", "lon", r) for r in lanes), F.lit(float("inf"))) / 1000
    rows = points.withColumn("_km", F.explode(F.array(F.when(F.col("sog") >= least_sog, km))))  # once a row, and only under way
    run = longest_sustained(rows, (F.col("sog") >= least_sog) & (F.col("_km") >= least_km), least_min * 60, F.col("_km"), key)
    minutes = F.col("duration_s") / 60
    score = F.least(F.lit(1.0), 0.5 + 0.15 * F.least(F.col("value") / least_km, F.lit(2.0)) + 0.1 * F.least(minutes / (2 * least_min), F.lit(1.0)))
    return run.select(F.lit("lane_deviation").alias("rule"), F.col(key).cast("string").alias("subject"), F.col("t_start").alias("t"), score.alias("score"), F.col("value").alias("distance_km"), minutes.alias("duration_min"))


def anchored_outside(points: DataFrame, waters: list[Column], exempt: list[Column], nearest_km: Column, least_hours: float = 6.0, most_sog: float = 1.0, key: str = "key") -> DataFrame:
    """Keys that lie stopped in territorial waters outside every exempt area: rule, subject, t, score, hours, nearest_km."""
    inside = lambda rings: F.array_max(F.array(*(geo.ring_contains("lat", "lon", r) for r in rings), F.lit(False)))
    still = (F.col("sog") <= most_sog) & inside(waters) & ~inside(exempt)
    run = longest_sustained(points, still, least_hours * 3600, nearest_km, key)
    hours = F.col("duration_s") / 3600
    score = F.least(F.lit(1.0), 0.55 + 0.1 * F.least(hours / least_hours, F.lit(2.0)) + F.when(F.col("value") < 40, 0.1).otherwise(0.0))
    return run.select(F.lit("anchored_outside_limits").alias("rule"), F.col(key).cast("string").alias("subject"), F.col("t_start").alias("t"), score.alias("score"), hours.alias("hours"), F.col("value").alias("nearest_km"))


def transitions(points: DataFrame, ring: Column, key: str = "key") -> DataFrame:
    """Entries and exits of one area with the crossing between the fixes: key, point_id (of the later fix), entering, t, lat, lon, bearing."""
    w = Window.partitionBy(key).orderBy("t", "point_id")
    rows = points.withColumn("_in", geo.ring_contains("lat", "lon", ring)).withColumn("_at", F.struct("t", "lat", "lon"))
    rows = rows.withColumn("_was", F.lag("_in").over(w)).withColumn("_from", F.lag("_at").over(w)).filter(F.col("_was") != F.col("_in"))
    where = crossing(F.col("_from"), F.col("_at"), ring, F.col("_in"))
    out = rows.withColumn("_x", where).withColumn("bearing", geo.bearing(F.col("_from.lat"), F.col("_from.lon"), "lat", "lon"))
    return out.select(key, "point_id", F.col("_in").alias("entering"), F.col("_x.t").alias("t"), F.col("_x.lat").alias("lat"), F.col("_x.lon").alias("lon"), "bearing")
