"""Queries over outlines of cells, unions of zones, zones of several parts, and corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import grid
from tidewatch.operators import outlines, proximity
from tidewatch.plans.registry import query
from tidewatch.sources import feeds
from tidewatch.sources.bindings import PORTS, POSITIONS_SQL, positions, table

#: Corners, unit edges, area and rings (outer ones less holes) of cells (k, r, c), all from the cells alone: a corner by the four cells around it.
_MEASURES_SQL = """quads as (select k, r + i as r, c + j as c, count(*) as n, bit_xor(case when i = j then 1 else 2 end) as side from cells, (values (0, 0), (0, 1), (1, 0), (1, 1)) q(i, j) group by all),
    corners as (select k, sum(case when n in (1, 3) then 1 when n = 2 and side = 0 then 2 else 0 end) as n_corners,
        sum(case when n = 1 then 1 when n = 3 then -1 when n = 2 and side = 0 then 2 else 0 end) / 4 as outer_less_holes from quads group by k),
    sides as (select k, level, line, place from (select k, 0 as level, r + i as line, c as place from cells, (values (0), (1)) q(i) union all select k, 1, c + i, r from cells, (values (0), (1)) q(i)) group by all having count(*) = 1),
    lengths as (select k, count(*) as length from sides group by k), areas as (select k, count(*)::double as area from cells group by k)
    select k, n_corners::bigint as n_corners, outer_less_holes::bigint as outer_less_holes, length, area from corners join lengths using (k) join areas using (k)"""


def _totals(rings: DataFrame, shape: str) -> DataFrame:
    m = outlines.measures(rings, shape)
    return m.groupBy(F.col(shape).alias("k")).agg(
        F.sum("n_corners").alias("n_corners"), F.sum(F.when(F.col("hole"), -1).otherwise(1)).alias("outer_less_holes"), F.sum("length").cast("long").alias("length"), F.sum("area").alias("area")
    )


_EDGE = grid.EDGE[5]


@query(f"""with {POSITIONS_SQL}, cells as (select distinct kind as k, floor((lat + 90) / {_EDGE}::double)::bigint as r, floor((lon + 180) / {_EDGE}::double)::bigint as c from pos), {_MEASURES_SQL}""")
def cell_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the outline of the cells that each kind of report touches, as rings with holes; corners, length, area and rings."""
    cell = F.struct(grid.cell("lat", "lon", 5).alias("c"))["c"]
    seen = positions(spark, sf_dir).select("kind", grid.row_of(cell).alias("row"), grid.col_of(cell).alias("col"))
    return _totals(outlines.rings(seen, "kind"), "kind")


_BOX = {"s": "(s_suppkey * 131 % 1500) / 100.0", "w": "60 + (s_suppkey * 71 % 1300) / 100.0", "h": "(50 + s_suppkey * 17 % 250) / 100.0", "g": "(50 + s_suppkey * 29 % 250) / 100.0"}


def _closed(south, west, north, east):
    return F.array(*(F.struct(a.cast("double").alias("lat"), o.cast("double").alias("lon")) for a, o in ((south, west), (south, east), (north, east), (north, west), (south, west))))


@query(f"""with box as (select s_nationkey as k, ({_BOX['s']})::double + 0.0021 as s, ({_BOX['w']})::double + 0.0021 as w, ({_BOX['h']})::double as h, ({_BOX['g']})::double as g from supplier),
    cells as (select distinct k, r, c from box, unnest(range(floor((s + 90) / {_EDGE})::bigint, floor((s + h + 90) / {_EDGE})::bigint + 1)) a(r), unnest(range(floor((w + 180) / {_EDGE})::bigint, floor((w + g + 180) / {_EDGE})::bigint + 1)) b(c)
        where (r + 0.5) * {_EDGE} - 90 between s and s + h and (c + 0.5) * {_EDGE} - 180 between w and w + g), {_MEASURES_SQL}""")
def united_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the union of each nation's overlapping zones as rings."""
    s, w, h, g = (F.expr(_BOX[c]).cast("double") for c in "swhg")
    s, w = s + 0.0021, w + 0.0021
    zones = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), _closed(s, w, s + h, w + g).alias("ring"))
    return _totals(outlines.united(zones, "nation", 5), "nation")


_FEATURE = (
    '{"type": "Feature", "properties": {"name": "n%1$d", "k": "port limit"}, "geometry": {"type": "MultiPolygon", "coordinates": ['
    "[[[%2$d.0005, %3$d.0005], [%4$d.0005, %3$d.0005], [%4$d.0005, %5$d.0005], [%2$d.0005, %5$d.0005], [%2$d.0005, %3$d.0005]],"
    " [[%2$d.5005, %3$d.5005], [%2$d.9005, %3$d.5005], [%2$d.9005, %3$d.9005], [%2$d.5005, %3$d.9005], [%2$d.5005, %3$d.5005]]],"
    " [[[%6$d.0005, %3$d.0005], [%7$d.0005, %3$d.0005], [%7$d.0005, %5$d.0005], [%6$d.0005, %5$d.0005], [%6$d.0005, %3$d.0005]]]]}}"
)


@query(f"""with {POSITIONS_SQL}, z as (select n_nationkey as k, 60 + n_nationkey % 7 as w, 5 + n_nationkey % 11 as s from nation)
    select point_id, 'n' || k as zone from pos join z on lat between s + 0.0005 and s + 2.0005
        and (lon between w + 0.0005 and w + 2.0005 and not (lon between w + 0.5005 and w + 0.9005 and lat between s + 0.5005 and s + 0.9005) or lon between w + 4.0005 and w + 5.0005)""")
def points_in_multipart_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in zones of two parts, one of them with a hole, read from features of GeoJSON."""
    k = F.col("n_nationkey").cast("int")
    w, s = (60 + k % 7).cast("int"), (5 + k % 11).cast("int")
    lines = table(spark, sf_dir, "nation").select(F.format_string(_FEATURE, k, w, s, (w + 2).cast("int"), (s + 2).cast("int"), (w + 4).cast("int"), (w + 5).cast("int")).alias("line"))
    zones, _ = feeds.zones(lines)
    return proximity.in_zones(positions(spark, sf_dir), zones.select("zone_id", "rings", F.col("name").alias("zone"))).select("point_id", "zone")


_WIDTH_M = 20_000.0
_LEGS = [(a, b) for a, b in zip(PORTS, PORTS[1:], strict=False)]
_LEGS_SQL = ", ".join(f"({a[1]}::double, {a[2]}::double, {b[1]}::double, {b[2]}::double)" for a, b in _LEGS)


@query(f"""with {POSITIONS_SQL}, l(alat, alon, blat, blon) as (values {_LEGS_SQL}),
    p as (select point_id, (alon - lon) * cos(radians(lat)) as ax, alat - lat as ay, (blon - alon) * cos(radians(lat)) as dx, blat - alat as dy from pos cross join l),
    u as (select *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) as u from p),
    d as (select point_id, min(sqrt(pow(ax + u * dx, 2) + pow(ay + u * dy, 2))) * {grid.DEGREE_M} as m from u group by point_id)
    select point_id, round(m, 2) as distance_m from d where m <= {_WIDTH_M}""")
def fixes_in_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixes within 20 km of the lane along all ports, with their distance from its line."""
    path = F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for _, a, o in PORTS))
    lane = spark.range(1).select(F.lit("lane").alias("path_id"), path.alias("path"), F.lit(_WIDTH_M).alias("half_width_m"))
    return outlines.in_corridors(positions(spark, sf_dir), lane).select("point_id", F.round("distance_m", 2).alias("distance_m"))
