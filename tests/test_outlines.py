"""Rings around cells, unions, zones with parts and holes, corridors."""

import json
import math
import random
from itertools import pairwise

from pyspark.sql import functions as F

from tidewatch.functions import grid
from tidewatch.operators import outlines, proximity
from tidewatch.sources import feeds

CELLS = "shape string, row long, col long"


def walked(cells):
    """Rings of cells by walking their edges, the inside to the left: sorted tuples of corners from the lowest one."""
    after = {}
    for r, c in cells:
        for p, q, beyond in (((r, c), (r, c + 1), (r - 1, c)), ((r, c + 1), (r + 1, c + 1), (r, c + 1)), ((r + 1, c + 1), (r + 1, c), (r + 1, c)), ((r + 1, c), (r, c), (r, c - 1))):
            if beyond not in cells:
                after.setdefault(p, []).append(q)
    out = []
    while after:
        at = min(after)
        ring, came = [at], None
        while True:
            choices = after[at]
            if len(choices) == 2 and came:
                d = (at[0] - came[0], at[1] - came[1])
                left = (at[0] + d[1], at[1] - d[0])
                to = left if left in choices else choices[0]
            else:
                to = choices[0]
            choices.remove(to)
            if not choices:
                del after[at]
            came, at = at, to
            if at == ring[0]:
                break
            ring.append(at)
        n = len(ring)
        corners = [p for i, p in enumerate(ring) if (ring[i - 1][0] == p[0]) != (p[0] == ring[(i + 1) % n][0])]
        k = corners.index(min(corners))
        out.append(tuple(corners[k:] + corners[:k]))
    return sorted(out)


def found(df):
    rings = {}
    for r in df.collect():
        rings.setdefault((r["shape"], r["ring"]), []).append((r["seq"], (r["y"], r["x"])))
    out = {}
    for (shape, _), run in rings.items():
        run.sort()
        assert [s for s, _ in run] == list(range(len(run)))
        out.setdefault(shape, []).append(tuple(p for _, p in run))
    return {k: sorted(v) for k, v in out.items()}


def test_rings_of_random_cells_equal_a_walk(spark):
    rng = random.Random(5)
    shapes = {f"s{n}": {(rng.randrange(9), rng.randrange(9)) for _ in range(n)} for n in (1, 20, 40, 70)}
    shapes["spiral"] = {(r, c) for r in range(0, 30, 2) for c in range(20)} | {(r, 19 if r % 4 == 1 else 0) for r in range(1, 29, 2)}
    shapes[None] = {(r, c) for r in range(5) for c in range(5)} - {(2, 2), (1, 1)}  # holes that touch at a corner
    rows = [(k, r, c) for k, v in shapes.items() for r, c in v]
    rows += rows[:7] + [("s20", None, 1), ("none", 1, None)]
    got = outlines.rings(spark.createDataFrame(rows, CELLS))
    assert found(got) == {k: walked(v) for k, v in shapes.items()}
    area = {}
    for m in outlines.measures(got).collect():
        area[m["shape"]] = area.get(m["shape"], 0) + m["area"]
        assert m["hole"] == (m["area"] < 0)
    assert area == {k: len(v) for k, v in shapes.items()}
    assert outlines.rings(spark.createDataFrame([], CELLS)).count() == 0


def test_a_union_keeps_its_hole_and_serves_as_a_zone(spark):
    res = 6
    bars = [(10.0, 60.0, 10.6, 63.0), (12.4, 60.0, 13.0, 63.0), (10.0, 60.0, 13.0, 60.6), (10.0, 62.4, 13.0, 63.0), (10.2, 60.3, 10.5, 62.0)]
    ring = lambda s, w, n, e: [(s, w), (s, e), (n, e), (n, w), (s, w)]
    zones = spark.createDataFrame([("z", ring(*b)) for b in bars] + [("empty", None)], "name string, ring array<struct<lat: double, lon: double>>")
    rings = outlines.united(zones, "name", res)
    sizes = sorted(m["area"] for m in outlines.measures(rings, "name").collect())
    assert sizes == [-900.0, 2500.0]
    shape = outlines.arrays(rings, res, "name").withColumnRenamed("name", "zone_id")
    points = spark.createDataFrame([(0, 10.3, 61.0), (1, 11.5, 61.5), (2, 12.7, 62.7), (3, 9.9, 61.0), (4, None, 61.0)], "point_id long, lat double, lon double")
    assert sorted(r.point_id for r in proximity.in_zones(points, shape).collect()) == [0, 2]
    assert all(p["lat"] == p["lat"] for r in shape.first().rings for p in r) and all(r[0] == r[-1] for r in shape.first().rings)


def test_features_of_several_parts_and_with_holes(spark):
    square = lambda w, s, e, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    line = lambda name, kind, c: (json.dumps({"type": "Feature", "properties": {"name": name, "k": "anchorage"}, "geometry": {"type": kind, "coordinates": c}}),)
    rows = [
        line("holed", "Polygon", [square(60, 10, 64, 14), square(61, 11, 62, 12)]), line("parts", "MultiPolygon", [[square(60, 10, 61, 11)], [square(70, 10, 72, 12), square(70.5, 10.5, 71, 11)]]),
        line("short", "MultiPolygon", [[square(60, 10, 61, 11)], [[[1, 1], [2, 2]]]]), line("line", "LineString", [[1, 1], [2, 2]]), line("metres", "MultiPolygon", [[square(60, 10, 61, 11)], [square(6e5, 10, 7e5, 11)]]),
    ]
    good, bad = feeds.zones(spark.createDataFrame(rows, "line string"))
    assert {r.name: r.reject_reason for r in bad.collect()} == {"short": "no polygon", "line": "no polygon", "metres": "not in degrees"}
    points = spark.createDataFrame([(0, 11.5, 61.5), (1, 13.0, 63.0), (2, 10.5, 60.5), (3, 10.7, 70.7), (4, 11.5, 71.5), (5, 11.5, 65.0)], "point_id long, lat double, lon double")
    got = sorted((r.name, r.point_id) for r in proximity.in_zones(points, good.select("zone_id", "name", "rings")).collect())
    assert got == [("holed", 1), ("holed", 2), ("parts", 2), ("parts", 4)]


def test_a_corridor_holds_its_width_along_a_bent_line(spark):
    rng = random.Random(2)
    path = [(10.0, 60.0), (12.0, 61.0), (12.0, 63.0), (12.0, 63.0), (58.0, 64.0)]
    points = [(i, rng.uniform(9.5, 13), rng.uniform(59.5, 64)) for i in range(400)] + [(1000 + i, rng.uniform(50, 58.3), rng.uniform(63.5, 64.4)) for i in range(200)]

    def distance(lat, lon):
        k, best = math.cos(math.radians(lat)), math.inf
        for a, b in pairwise(path):
            ax, ay, bx, by = (a[1] - lon) * k, a[0] - lat, (b[1] - lon) * k, b[0] - lat
            n = (bx - ax) ** 2 + (by - ay) ** 2
            u = min(1, max(0, -(ax * (bx - ax) + ay * (by - ay)) / n)) if n else 0
            best = min(best, math.hypot(ax + u * (bx - ax), ay + u * (by - ay)) * grid.DEGREE_M)
        return best

    lanes = spark.createDataFrame([("l", path, 15_000.0), ("point", [(1.0, 1.0)], 5.0), ("none", None, 5.0)], "path_id string, path array<struct<lat: double, lon: double>>, half_width_m double")
    got = {r.point_id: r.distance_m for r in outlines.in_corridors(spark.createDataFrame([*points, (9999, None, 1.0)], "point_id long, lat double, lon double").withColumn("extra", F.lit("x")), lanes).collect()}
    wanted = {i: d for i, lat, lon in points if (d := distance(lat, lon)) <= 15_000}
    assert got.keys() == wanted.keys() and len(wanted) > 60 and all(abs(got[i] - wanted[i]) < 0.01 for i in wanted)


def test_zones_are_dealt_out_before_they_are_spread_over_cells(spark):
    box = lambda s, w, h: [{"lat": a, "lon": o} for a, o in ((s, w), (s, w + h), (s + h, w + h), (s + h, w), (s, w))]
    zones = spark.createDataFrame([("n", box(5.0, 60.0, 1.0))] * 3 + [("n", box(5.5, 60.5, 1.0))], "nation string, ring array<struct<lat double, lon double>>").coalesce(1)
    held = outlines.cells_inside(zones, 5)
    assert held.rdd.getNumPartitions() == outlines.PARTS
    cells = {(r.row, r.col) for r in held.collect()}
    (m,) = outlines.measures(outlines.united(zones, "nation", 5), "nation").collect()
    assert m.area == len(cells) > 60
