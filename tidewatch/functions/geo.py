"""Geometry and kinematics as column expressions (degrees in, metres and knots out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_ZONE_M = 6_371_008.8
METRES_PER_DEGREE = 111_320.0
KNOT = 0.514444
NAUTICAL_MILE_M = 1852.0
MAX_SPEED_KN = 60.0
#: Sentinels of the position messages (fixed values).
SENTINELS = {"lat": 91.0, "lon": 181.0, "sog": 102.3, "cog": 360.0, "heading": 511.0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle distance; the argument of asin is clamped, so antipodes give half the circumference."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def rounded(x, places: int) -> Column:
    """A number of at least 0, rounded by arithmetic of doubles, as SQL engines do; F.round goes by way of decimals, row by row."""
    return F.floor(_c(x) * 10.0**places + 0.5) / 10.0**places


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(o2 - o1) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat, lon, course, metres) -> tuple[Column, Column]:
    """(lat, lon) after `metres` along a great circle."""
    a, o, b, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(course)), _c(metres) / EARTH_M
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lon2 = o + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 540.0, F.lit(360.0)) - 180.0


def turn(before, after) -> Column:
    """Smallest angle between two courses, 0 to 180."""
    return F.abs(F.pmod(_c(after) - _c(before) + 180.0, F.lit(360.0)) - 180.0)


def in_box(lat, lon, south=5.0, north=25.0, west=60.0, east=78.0) -> Column:
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def nulled(column, kind: str, tolerance: float = 1e-9) -> Column:
    """Null for the sentinel of its kind."""
    c = _c(column)
    return F.when(F.abs(c - SENTINELS[kind]) < tolerance, None).otherwise(c)


def to_local(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of an origin on an equirectangular frame."""
    return (_c(lon) - _c(lon0)) * METRES_PER_DEGREE * F.cos(F.radians(_c(lat0))), (_c(lat) - _c(lat0)) * METRES_PER_DEGREE


def uncertainty(sigma_m, hours) -> Column:
    """Radius of a dead-reckoned position: it grows by a nautical mile an hour, and no faster than any hull."""
    h = _c(hours)
    return F.greatest(F.lit(1.0), F.least(_c(sigma_m) + NAUTICAL_MILE_M * h, MAX_SPEED_KN * NAUTICAL_MILE_M * h))


def projection_confidence(hours) -> Column:
    return F.greatest(F.lit(0.05), 1 / (1 + _c(hours) / 3))


def radar_sigma(range_km, bearing_sigma_deg: float = 0.25, range_sigma_m: float = 25.0) -> Column:
    return F.sqrt(range_sigma_m * F.greatest(_c(range_km) * 1000 * math.radians(bearing_sigma_deg), F.lit(1.0)))


def rcs_from_length(length_m) -> Column:
    return 10 * F.log10(0.08 * F.pow(_c(length_m), 2.4))


def length_from_rcs(dbsm) -> Column:
    return F.pow(F.pow(F.lit(10.0), _c(dbsm) / 10) / 0.08, 1 / 2.4)


#: What the error models of gates leave out, metres (fixed value).
GATE_BUFFER_M = 500.0


def cone(r95, sog_kn, dt_s) -> Column:
    """A 95 % radius, no wider than what a hull of that speed covers since its last report."""
    return F.least(_c(r95), (2.5 * F.greatest(_c(sog_kn), F.lit(2.0)) + 5) * KNOT * F.greatest(_c(dt_s), F.lit(120.0)))


def gate_radius(r95, max_sog_kn, dt_s, sigma_m) -> Column:
    """How far from its predicted place a contact may lie."""
    return cone(r95, max_sog_kn, dt_s) + 3 * _c(sigma_m) + GATE_BUFFER_M


def association_score(d_m, sigma_m, length_rel=None, visited=None) -> Column:
    s = _c(sigma_m)
    score = -0.5 * F.pow(_c(d_m) / s, 2) - 2 * F.log(s / 200)
    if length_rel is not None:
        score = score - 0.5 * F.pow(F.coalesce(_c(length_rel), F.lit(0.0)), 2)
    if visited is not None:
        score = score + F.when(visited, 0.5).otherwise(0.0)
    return score


def dark_score(base, hearable, length_m, nearest_m) -> Column:
    size = F.least(F.lit(1.0), (_c(length_m) - 20) / 20 + 0.5)
    alone = F.least(F.lit(1.0), F.coalesce(_c(nearest_m), F.lit(5000.0)) / 5000 + 0.5)
    return _c(base) * _c(hearable) * size * alone


def decayed(base, age_days, half_life_days) -> Column:
    """Confidence that halves every half-life; without one it stays."""
    life = _c(half_life_days)
    return F.when(life.isNull(), _c(base)).otherwise(_c(base) * F.pow(F.lit(0.5), F.greatest(_c(age_days), F.lit(0.0)) / life))


def _held(y: Column, x: Column, edges: Column) -> Column:
    """Even-odd test against closed lines' edges; points on an edge count as inside."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["lat"] > y) != (b["lat"] > y)) & (x < (b["lon"] - a["lon"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["lon"] - a["lon"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lon"])
        return (F.abs(cross) < 1e-12) & y.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])) & x.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"]))

    return F.exists(edges, on) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def _ring_edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_contains(lat, lon, ring: Column) -> Column:
    """Even-odd test of a point in a ring (array of struct(lat, lon), closed); points on an edge count as inside."""
    return _held(_c(lat), _c(lon), _ring_edges(ring))


def rings_contain(lat, lon, rings: Column) -> Column:
    """The same over several rings at once: separate parts add, rings within a part are its holes."""
    return _held(_c(lat), _c(lon), F.flatten(F.transform(rings, _ring_edges)))
