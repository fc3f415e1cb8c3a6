import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import areas, overpass


def ring(corners):
    return F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in corners))


def sampled(off, on, since, until, footprint, n=60_000):
    """Share of the reachable region under the footprint, by random points."""
    rng = np.random.default_rng(7)
    known = [p for p in (off, on) if p is not None]
    lat0, lon0 = np.mean([p[0] for p in known]), np.mean([p[1] for p in known])
    here = lambda p: np.array([geo.EARTH_ZONE_M * math.radians(p[1] - lon0) * math.cos(math.radians(lat0)), geo.EARTH_ZONE_M * math.radians(p[0] - lat0)])
    speed = overpass.TOP_KN
    if len(known) == 2:
        kn = np.linalg.norm(here(on) - here(off)) / (since + until) / geo.KNOT
        speed = kn * 1.05 if kn > speed else speed
    discs = [(here(p), speed * geo.KNOT * s) for p, s in ((off, since), (on, until)) if p is not None]
    c, r = min(discs, key=lambda d: d[1])
    x = c + rng.uniform(-r, r, (n, 2))
    x = x[np.all([np.linalg.norm(x - c, axis=1) <= r for c, r in discs], axis=0)]
    corners, inside = [here(p) for p in footprint], np.zeros(len(x), bool)
    for a, b in zip(corners[:-1], corners[1:], strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= ((a[1] > x[:, 1]) != (b[1] > x[:, 1])) & (x[:, 0] < (b[0] - a[0]) * (x[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
    return inside.mean()


def test_covered_share_against_random_points():
    rng = random.Random(5)
    shapes = [
        [(9, 64), (9, 67), (12, 67), (12, 64), (9, 64)],
        [(12, 64), (12, 67), (9, 67), (9, 64), (12, 64)],
        [(8, 63), (8, 68), (13, 68), (10.2, 65.5), (13, 63), (8, 63)],
    ]
    seen = set()
    for k in range(60):
        off = None if k % 6 == 1 else (rng.uniform(9, 11), rng.uniform(64.5, 66.5))
        on = None if k % 6 == 2 else (rng.uniform(9, 11), rng.uniform(64.5, 66.5))
        since, until = rng.uniform(600, 30_000), rng.uniform(600, 30_000)
        tier, basis, share, km2, _, _ = overpass.assess(off, on, since, until, shapes[k % 3])
        assert basis == ("lens" if off and on else "forward_cone" if off else "backward_cone") and km2 > 0
        want = sampled(off, on, since, until, shapes[k % 3])
        assert abs(share - want) < 0.02, (k, share, want)
        assert tier == ("confirmed" if share >= 0.9999 else "partial" if share > 0 else "none")
        seen.add(tier)
    assert {"confirmed", "partial"} <= seen


def test_tiers_that_cannot_be_told():
    box = [(9, 64), (9, 67), (12, 67), (12, 64), (9, 64)]
    assert overpass.assess(None, None, 60, 60, box)[:2] == ("unknown", "no_position")
    assert overpass.assess((10, 65), None, 60, 60, [])[0] == "unknown"
    tier, basis, share, _, kn, exceeds = overpass.assess((9.5, 64.5), (11.5, 66.5), 1800, 1800, box)
    assert exceeds and kn > 100 and basis == "lens" and share > 0.9


def test_every_silence_keeps_a_row_and_pairs_are_seen_once(spark):
    corner = lambda s, w, n, e: [(s, w), (s, e), (n, e), (n, w), (s, w)]
    gaps = spark.createDataFrame(
        [("a", 0.0, 90_000.0, 10.0, 65.0, 10.5, 65.5), ("b", 0.0, 3600.0, 10.0, 65.0, None, None), ("c", 0.0, 90_000.0, None, None, None, None), ("d", 200_000.0, 300_000.0, 0.0, 0.0, 0.1, 0.1)],
        "gap_id string, t_start double, t_end double, off_lat double, off_lon double, on_lat double, on_lon double",
    )
    scenes = spark.createDataFrame(
        [(n, t, [{"lat": float(a), "lon": float(o)} for a, o in c]) for n, t, c in (("wide", 50_000.0, corner(-20, 30, 40, 100)), ("far", 50_000.0, corner(-40, 100, -30, 110)), ("late", 95_000.0, corner(0, 60, 20, 70)))],
        "scene_id string, t_scene double, ring array<struct<lat double, lon double>>",
    )
    got = sorted((r.gap_id, r.scene_id, r.tier) for r in overpass.opportunities(gaps, scenes).collect())
    assert got == [("a", "wide", "confirmed"), ("b", "", "none"), ("c", "far", "unknown"), ("c", "wide", "unknown"), ("d", "", "none")]
    assert overpass.opportunities(gaps.limit(0), scenes).collect() == []


def test_distances_circles_and_texts(spark):
    rng = random.Random(3)
    points = [(rng.uniform(8, 14), rng.uniform(60, 70)) for _ in range(60)] + [(10.0, 64.0), (11.0, 65.0)]
    corners = [(10, 64), (10, 66), (12, 66), (11, 65), (12, 64), (10, 64)]

    def brute(lat, lon):
        best = None
        for (a1, o1), (a2, o2) in zip(corners[:-1], corners[1:], strict=True):
            for k in range(2001):
                la, lo = a1 + (a2 - a1) * k / 2000, o1 + (o2 - o1) * k / 2000
                d = (la - lat) ** 2 + (lo - lon) ** 2
                if best is None or d < best[0]:
                    best = (d, la, lo)
        p1, p2 = math.radians(lat), math.radians(best[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(best[2] - lon) / 2) ** 2
        return 2 * geo.EARTH_ZONE_M * math.asin(math.sqrt(h))

    df = spark.createDataFrame(points, "lat double, lon double")
    rows = df.select("lat", "lon", areas.distance_m("lat", "lon", ring(corners)).alias("d"), geo.ring_contains("lat", "lon", ring(corners)).alias("inside")).collect()
    for r in rows:
        assert r.d == 0 if r.inside else abs(r.d - brute(r.lat, r.lon)) < 60
    (c,) = spark.range(1).select(areas.circle(F.lit(12.0), F.lit(66.0), 20_000.0).alias("c")).select("c", areas.area_km2(F.col("c")).alias("km2"), areas.wkt(F.col("c")).alias("w")).collect()
    assert len(c.c) == 65 and c.c[0] == c.c[-1] and abs(c.km2 - math.pi * 400) < 0.01 * math.pi * 400
    texts = spark.createDataFrame([(c.w,), ("POLYGON ((1 2, x 3, 4 5, 1 2))",), ("POINT (1 2)",), (None,)], "w string")
    back = [r.r for r in texts.select(areas.ring_of("w").alias("r")).collect()]
    assert len(back[0]) == 65 and abs(back[0][3].lat - c.c[3].lat) < 1e-6 and back[1:] == [None] * 3


def test_lanes_are_measured_only_under_way(spark):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a, o in ((14.0, 66.0), (14.0, 70.0), (16.0, 70.0), (16.0, 66.0), (14.0, 66.0))))
    lane = F.when(F.col("sog") < 6, F.raise_error(F.lit("measured at rest")).cast("array<struct<lat double, lon double>>")).otherwise(ring)
    rows = [("a", i, 3600.0 * i, 20.0, 60.0, 1.0 if i == 3 else 8.0) for i in range(10)]
    p = spark.createDataFrame(rows, "key string, point_id long, t double, lat double, lon double, sog double")
    (r,) = areas.lane_deviation(p, [lane]).collect()
    assert (r.subject, r.t, r.duration_min) == ("a", 14_400.0, 300.0)
