"""Which silences a satellite image looked at: where a hull can have been at the pass, and how much of that the image covers.

Silences and scenes meet by day and coarse square; the geometry of each pair is a small function inside the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo

#: Assumed top speed, share that counts as the whole, corners of a disc, least radius (fixed values).
TOP_KN, WHOLE, CORNERS, LEAST_M = 20.0, 0.9999, 180, 1.0
SQUARE = 5.0
TIERS = ("confirmed", "partial", "unknown", "none")
#: Scenes by day and square that are broadcast, so that silences stay where they are; more are joined by a shuffle.
BROADCAST_SQUARES = 100_000


def disc(x: float, y: float, radius: float) -> np.ndarray:
    """Corners of a disc, anticlockwise."""
    a = np.arange(CORNERS) * (2 * math.pi / CORNERS)
    r = max(radius, LEAST_M)
    return np.stack([x + r * np.cos(a), y + r * np.sin(a)], axis=1)


def lens(a: tuple, ra: float, b: tuple, rb: float) -> np.ndarray:
    """Corners of what two discs share, anticlockwise; none if they do not meet."""
    ra, rb, d = max(ra, LEAST_M), max(rb, LEAST_M), math.dist(a, b)
    if d >= ra + rb:
        return np.zeros((0, 2))
    if d <= abs(ra - rb):
        return disc(*a, ra) if ra < rb else disc(*b, rb)
    arcs, towards = [], math.atan2(b[1] - a[1], b[0] - a[0])
    for (x, y), r, other, at in ((a, ra, rb, towards), (b, rb, ra, towards + math.pi)):
        half = math.acos(max(-1.0, min(1.0, (d * d + r * r - other * other) / (2 * d * r))))
        angle = at + np.linspace(-half, half, max(3, math.ceil(CORNERS * half / math.pi) + 1))[:-1]  # where one arc ends the other begins
        arcs.append(np.stack([x + r * np.cos(angle), y + r * np.sin(angle)], axis=1))
    return np.concatenate(arcs)


def convex(p: np.ndarray) -> bool:
    """Of an anticlockwise polygon."""
    to, on = np.roll(p, -1, axis=0) - p, np.roll(p, -2, axis=0) - np.roll(p, -1, axis=0)
    return bool((to[:, 0] * on[:, 1] - to[:, 1] * on[:, 0] >= 0).all())


def area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one whose corners run anticlockwise."""
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(subject):
            break
        side = (b[0] - a[0]) * (subject[:, 1] - a[1]) - (b[1] - a[1]) * (subject[:, 0] - a[0])
        inside = side >= 0
        if inside.all():
            continue
        after, side2, inside2 = np.roll(subject, -1, axis=0), np.roll(side, -1), np.roll(inside, -1)
        cuts = inside != inside2
        f = np.where(cuts, side / np.where(cuts, side - side2, 1.0), 0.0)
        met = subject + f[:, None] * (after - subject)
        # Each corner that is inside, then the crossing behind it.
        keep = np.stack([inside, cuts], axis=1).ravel()
        subject = np.stack([subject, met], axis=1).reshape(-1, 2)[keep]
    return subject


def assess(off: tuple | None, on: tuple | None, since_s: float, until_s: float, footprint: list[tuple]) -> tuple:
    """(tier, basis, covered share, area in km2, implied knots or None, whether it exceeds the assumed speed). Positions are (lat, lon) or None."""
    known = [p for p in (off, on) if p is not None]
    if not known:
        return "unknown", "no_position", None, None, None, False
    lat0, lon0 = (sum(p[k] for p in known) / len(known) for k in (0, 1))
    here = lambda p: (geo.EARTH_ZONE_M * math.radians(p[1] - lon0) * math.cos(math.radians(lat0)), geo.EARTH_ZONE_M * math.radians(p[0] - lat0))
    implied, speed = None, TOP_KN
    if len(known) == 2 and since_s + until_s > 0:
        (x0, y0), (x1, y1) = here(off), here(on)
        implied = math.hypot(x1 - x0, y1 - y0) / (since_s + until_s) / geo.KNOT
        speed = implied * 1.05 if implied > TOP_KN else TOP_KN
    exceeds, metres = implied is not None and implied > TOP_KN, speed * geo.KNOT
    ends = [(here(p), metres * s) for p, s in ((off, since_s), (on, until_s)) if p is not None]
    region = lens(*ends[0], *ends[1]) if len(ends) == 2 else disc(*ends[0][0], ends[0][1])
    basis = "lens" if len(ends) == 2 else "forward_cone" if off is not None else "backward_cone"
    whole = area(region)
    if whole <= 0:
        return "unknown", "unreachable", None, None, implied, exceeds
    if len(footprint) < 4 or max(p[1] for p in footprint) - min(p[1] for p in footprint) > 180:
        return "unknown", basis, None, whole / 1e6, implied, exceeds
    seen = np.array([here(p) for p in footprint[:-1]])
    seen = seen if area(seen) >= 0 else seen[::-1]
    share = min(1.0, abs(area(clip(region, seen) if convex(seen) else clip(seen, region))) / whole)
    tier = "confirmed" if share >= WHOLE else "partial" if share > 0 else "none"
    return tier, basis, share, whole / 1e6, implied, exceeds


def _squares(south: Column, west: Column, north: Column, east: Column) -> Column:
    rows = F.sequence(F.floor(south / SQUARE), F.floor(north / SQUARE))
    return F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.floor(west / SQUARE), F.floor(east / SQUARE)), lambda c: r * 1000 + c)))


def candidates(gaps: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pairs of silences and scenes taken within them whose boxes touch.

    gaps: gap_id, t_start, t_end, off_lat, off_lon, on_lat, on_lon (any may be null); scenes: scene_id, t_scene, ring.
    A silence without a position meets every scene of its time: it has a row, with tier unknown.
    """
    hours = (F.col("t_end") - F.col("t_start")) / 3600
    lat0, lon0 = F.coalesce("off_lat", "on_lat"), F.coalesce("off_lon", "on_lon")
    span = geo.haversine(F.coalesce("off_lat", lat0), F.coalesce("off_lon", lon0), F.coalesce("on_lat", lat0), F.coalesce("on_lon", lon0))
    reach = F.least(F.lit(180.0), F.greatest(TOP_KN * geo.NAUTICAL_MILE_M * hours, 1.05 * span) / 111_000 / F.cos(F.radians(F.least(F.abs(lat0), F.lit(80.0)))) + 1)
    boxed = gaps.withColumn("_box", F.when(lat0.isNotNull() & lon0.isNotNull(), _squares(F.greatest(lat0 - reach, F.lit(-90.0)), F.greatest(lon0 - reach, F.lit(-180.0)), F.least(lat0 + reach, F.lit(90.0)), F.least(lon0 + reach, F.lit(180.0)))))
    days = F.explode(F.sequence(F.floor(F.col("t_start") / 86_400), F.floor(F.col("t_end") / 86_400)))
    lats, lons = F.col("ring.lat"), F.col("ring.lon")
    looked = scenes.withColumn("_box2", _squares(F.array_min(lats), F.array_min(lons), F.array_max(lats), F.array_max(lons))).withColumn("_day", F.floor(F.col("t_scene") / 86_400))
    squares = looked.withColumn("_sq", F.explode("_box2"))
    few = squares.count() <= BROADCAST_SQUARES
    placed = boxed.filter("_box is not null").withColumn("_day", days).withColumn("_sq", F.explode("_box")).join(F.broadcast(squares) if few else squares, ["_day", "_sq"])
    # A pair that shares several squares is taken in the first.
    placed = placed.filter(F.col("_sq") == F.array_min(F.array_intersect("_box", "_box2")))
    lost = boxed.filter("_box is null").withColumn("_day", days).withColumn("_sq", F.lit(None).cast("long")).join(F.broadcast(looked) if few else looked, "_day")
    return placed.unionByName(lost).filter(F.col("t_scene").between(F.col("t_start"), F.col("t_end"))).drop("_day", "_sq", "_box", "_box2")


RESULT = "gap_id string, scene_id string, tier string, basis string, coverage double, reachable_km2 double, implied_kn double, exceeds boolean, hours_in double"


def opportunities(gaps: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every silence's assessed looks, tier `none` dropped; a silence with no look keeps one row of tier none with an empty scene id."""
    pairs = candidates(gaps, scenes)

    def run(batches):
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                place = lambda k: None if r[f"{k}_lat"] is None or r[f"{k}_lon"] is None else (r[f"{k}_lat"], r[f"{k}_lon"])  # noqa: B023,E731
                found = assess(place("off"), place("on"), r["t_scene"] - r["t_start"], r["t_end"] - r["t_scene"], [(p["lat"], p["lon"]) for p in r["ring"] or []])
                if found[0] != "none":
                    out.append((r["gap_id"], r["scene_id"], *found, (r["t_scene"] - r["t_start"]) / 3600))
            kinds = [pa.string()] * 4 + [pa.float64()] * 3 + [pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    picked = pairs.select(F.col("gap_id").cast("string").alias("gap_id"), F.col("scene_id").cast("string").alias("scene_id"), "t_start", "t_end", "t_scene", "off_lat", "off_lon", "on_lat", "on_lon", "ring")
    # By pair and in a fixed number of parts: a day or square with many silences is no single task's, and small rows with much work are not put together.
    parts = int(gaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = picked.repartition(parts, "gap_id", "scene_id").mapInArrow(run, RESULT)
    every = gaps.select(F.col("gap_id").cast("string").alias("gap_id"))
    return every.join(found, "gap_id", "left").fillna({"scene_id": "", "tier": "none", "basis": "evaluated"})


def ranked(found: DataFrame) -> DataFrame:
    """One row a silence: its looks in order of tier, then of the share covered."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)]), F.col("tier"))
    look = F.struct(order.alias("rank"), (-F.coalesce("coverage", F.lit(0.0))).alias("less"), "scene_id", "tier", "coverage")
    return found.groupBy("gap_id").agg(F.array_sort(F.collect_list(look)).alias("looks")).select("gap_id", F.transform("looks", lambda x: F.struct(x["scene_id"].alias("scene_id"), x["tier"].alias("tier"), x["coverage"].alias("coverage"))).alias("looks"))
