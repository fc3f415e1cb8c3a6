"""Outlines of sets of cells, unions of zones, and corridors.

A set of cells is bounded by the edges that only one of them has: edges are counted, those counted twice cancel. What remains is
merged into straight runs, each run knows the one that follows it, and runs are numbered around their ring by doubling: after k
rounds a run has seen 2^k followers, so rounds grow with the logarithm of the longest ring. No ring is held by one task before
`arrays` asks for it.

Rows and columns are whole numbers from 0 to 2^29. Cells that touch at a corner only are apart, so a ring never meets itself in
an edge; holes run the other way around and have a negative area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo, grid
from tidewatch.sources.staging import cut, dropped

#: Directions of runs: along columns, along rows, and back. The next number is a turn to the left.
EAST, NORTH, WEST, SOUTH = range(4)
#: Pieces of a leg, in degrees, so that a long slanting leg covers the cells near it only.
PIECE_DEG = 0.2
#: Tasks that zones are dealt to.
PARTS = 96


def boundary(cells: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, level, line, at, direction): unit edges of the outline, the inside to their left. cells: shape, row, col; null ones and repeats do not count."""
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    four = [(True, r, c, EAST), (True, r + 1, c, WEST), (False, c, r, SOUTH), (False, c + 1, r, NORTH)]
    edges = F.array(*(F.struct(F.lit(level).alias("level"), line.alias("line"), at.alias("at"), F.lit(d).alias("direction")) for level, line, at, d in four))
    each = cells.filter("row is not null and col is not null").select(shape, r.alias("row"), c.alias("col")).distinct().select(shape, F.explode(edges).alias("e")).select(shape, "e.*")
    return each.groupBy(shape, "level", "line", "at").agg(F.count("*").alias("n"), F.min("direction").alias("direction")).filter("n = 1").drop("n")


def runs(edges: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, id, y, x, y_end, x_end, direction): edges in one direction merged along their line; id tells a run within its shape."""
    w = Window.partitionBy(shape, "level", "line", "direction").orderBy("at")
    merged = edges.withColumn("run", F.col("at") - F.row_number().over(w)).groupBy(shape, "level", "line", "direction", "run").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    ahead = F.col("direction").isin(EAST, NORTH)
    first, last = F.when(ahead, F.col("a")).otherwise(F.col("b")), F.when(ahead, F.col("b")).otherwise(F.col("a"))
    placed = merged.select(
        shape, F.when(F.col("level"), F.col("line")).otherwise(first).alias("y"), F.when(F.col("level"), first).otherwise(F.col("line")).alias("x"),
        F.when(F.col("level"), F.col("line")).otherwise(last).alias("y_end"), F.when(F.col("level"), last).otherwise(F.col("line")).alias("x_end"), "direction",
    )
    return placed.withColumn("id", grid.corner(F.col("y"), F.col("x"), F.col("direction")))


def rings(cells: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, ring, seq, y, x, y_end, x_end): the runs of all outlines, numbered around their ring from its lowest corner.

    ring is the id of its first run. A null shape is a shape. No cells give no rows.
    """
    # A struct around the shape, so that null equals null in joins.
    all_runs = cut(runs(boundary(cells.withColumn("_s", F.struct(F.col(shape).alias("s"))), "_s"), "_s"))
    start = all_runs.select("_s", F.col("y").alias("y_end"), F.col("x").alias("x_end"), F.col("id").alias("next"), F.col("direction").alias("d2"), F.count("*").over(Window.partitionBy("_s", "y", "x")).alias("n"))
    # Where two rings touch at a corner, a run goes on around the cell it belongs to: to the left.
    follows = all_runs.join(start, ["_s", "y_end", "x_end"]).filter((F.col("n") == 1) | (F.col("d2") == (F.col("direction") + 1) % 4))
    # head: the least id among a run and those that follow it, span in all; steps: how far ahead it is; next: the run span steps ahead.
    now, before, span = cut(follows.select("_s", "id", "next", F.col("id").alias("head"), F.lit(0).cast("long").alias("steps"))), None, 1
    while True:
        there = now.select("_s", F.col("id").alias("next"), F.col("next").alias("far"), F.col("head").alias("h2"), F.col("steps").alias("s2"))
        nearer = F.col("h2") < F.col("head")
        head, steps = F.when(nearer, F.col("h2")).otherwise(F.col("head")), F.when(nearer, F.col("s2") + span).otherwise(F.col("steps"))
        following = cut(now.join(there, ["_s", "next"]).select("_s", "id", F.col("far").alias("next"), head.alias("head"), steps.alias("steps")))
        dropped(now)
        now, span = following, span * 2
        # Once no head changes, each run has seen its whole ring: runs span steps apart agree, and some window of span runs holds the least.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("_s", "id", "head").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("id", "head", "_s"))).first()
        if state == before:
            break
        before = state
    size = now.groupBy("_s", "head").agg((F.max("steps") + 1).alias("n"))
    numbered = now.join(size, ["_s", "head"]).select("_s", "id", F.col("head").alias("ring"), ((F.col("n") - F.col("steps")) % F.col("n")).alias("seq"))
    return all_runs.join(numbered, ["_s", "id"]).select(F.col("_s.s").alias(shape), "ring", "seq", "y", "x", "y_end", "x_end")


def measures(of: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, ring, n_corners, length, area, hole) a ring, in edges of cells; a hole's area is negative. of: `rings`."""
    twice = F.sum(F.col("x") * F.col("y_end") - F.col("x_end") * F.col("y"))
    length = F.sum(F.abs(F.col("x_end") - F.col("x")) + F.abs(F.col("y_end") - F.col("y")))
    return of.groupBy(shape, "ring").agg(F.count("*").alias("n_corners"), length.alias("length"), (twice / 2).alias("area")).withColumn("hole", F.col("area") < 0)


def arrays(of: DataFrame, res: int, shape: str = "shape") -> DataFrame:
    """(shape, rings): closed rings of struct(lat, lon) of a grid level's cells, parts and holes alike, for `geo.rings_contain`."""
    edge = grid.LEVELS[res]
    corner = F.struct("seq", (F.col("y") * edge - 90).alias("lat"), (F.col("x") * edge - 180).alias("lon"))
    one = of.groupBy(shape, "ring").agg(F.array_sort(F.collect_list(corner)).alias("p"))
    closed = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return one.select(shape, "ring", closed.alias("points")).groupBy(shape).agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("r")).select(shape, F.col("r.points").alias("rings"))


def cells_inside(zones: DataFrame, res: int) -> DataFrame:
    """zones' columns with row and col of every cell of a level whose centre a zone holds. zones: rings, or ring."""
    shape = zones if "rings" in zones.columns else zones.withColumn("rings", F.array("ring"))
    lats, lons = (F.flatten(F.transform("rings", lambda r: r[c])) for c in ("lat", "lon"))
    # Few bytes of zones are many cells, so they are dealt out before they are spread.
    near = shape.filter("rings is not null").repartition(PARTS).withColumn("cell", F.explode(grid.cover_box(F.array_min(lats), F.array_min(lons), F.array_max(lats), F.array_max(lons), res)))
    lat, lon = grid.centre("cell", res)
    held = near.withColumns({"_lat": lat, "_lon": lon}).filter(geo.rings_contain("_lat", "_lon", F.col("rings")))
    return held.withColumns({"row": grid.row_of("cell"), "col": grid.col_of("cell")}).drop("cell", "_lat", "_lon", "rings", "ring")


def united(zones: DataFrame, by: str, res: int) -> DataFrame:
    """`rings` of the union of each group's zones, as exact as the level's cells."""
    shape = zones.select(by, "rings" if "rings" in zones.columns else F.array("ring").alias("rings"))
    return rings(cells_inside(shape.distinct(), res).select(by, "row", "col"), by)


def legs(paths: DataFrame) -> DataFrame:
    """(path_id, half_width_m, a, b): straight pieces of each path, short enough for the grid. paths: path_id, path array<struct<lat, lon>>, half_width_m."""
    p = F.col("path")
    pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = paths.filter(F.size(p) >= 2).select("path_id", "half_width_m", F.explode(pairs).alias("e")).select("path_id", "half_width_m", "e.a", "e.b")
    span = F.greatest(F.abs(F.col("b.lat") - F.col("a.lat")), F.abs(F.col("b.lon") - F.col("a.lon")))
    n = F.greatest(F.lit(1), F.ceil(span / PIECE_DEG))
    cut_at = lambda k, c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * k / F.col("n")
    pieces = each.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return pieces.select("path_id", "half_width_m", *(F.struct(*(cut_at(k, c).alias(c) for c in ("lat", "lon"))).alias(x) for x, k in (("a", F.col("k")), ("b", F.col("k") + 1))))


def leg_distance(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """Metres from a point to a leg, on the plane of the point's latitude."""
    scale = F.cos(F.radians(lat))
    x = lambda p: (p["lon"] - lon) * scale
    y = lambda p: p["lat"] - lat
    dx, dy = x(b) - x(a), y(b) - y(a)
    length = dx * dx + dy * dy
    u = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x(a) * dx + y(a) * dy) / length))).otherwise(0.0)
    return F.hypot(x(a) + u * dx, y(a) + u * dy) * grid.DEGREE_M


def in_corridors(points: DataFrame, paths: DataFrame, res: int = 5) -> DataFrame:
    """(point columns, path_id, distance_m): points within a path's half width of it, each path once, with the least distance.

    The corridor is the union of all legs' neighbourhoods, their round ends included. Pieces of legs cover the cells they may
    reach; a point meets the pieces of its own cell only. points carry point_id.
    """
    high = F.col("half_width_m") / grid.DEGREE_M * 1.001
    low, top = F.least("a.lat", "b.lat") - high, F.greatest("a.lat", "b.lat") + high
    wide = high / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(low), F.abs(top)))))
    box = grid.cover_box(low, F.least("a.lon", "b.lon") - wide, top, F.greatest("a.lon", "b.lon") + wide, res)
    covered = legs(paths).withColumn("cell", F.explode(box))
    d = leg_distance(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))
    near = points.withColumn("cell", grid.cell("lat", "lon", res)).join(covered, "cell").withColumn("distance_m", d).filter("distance_m <= half_width_m")
    kept = [c for c in points.columns if c != "point_id"]
    return near.groupBy("point_id", "path_id").agg(F.min("distance_m").alias("distance_m"), *(F.first(c).alias(c) for c in kept)).select(*points.columns, "path_id", "distance_m")
