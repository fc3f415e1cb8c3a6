"""Queries over areas: lanes, waters, crossings, polygons, and looks of satellites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import areas, detectors, overpass, sequences
from tidewatch.plans.registry import query
from tidewatch.sources.bindings import MOVING_SQL, PORTS, POSITIONS_SQL, haversine_sql, moving_positions, ports, positions

r6 = lambda c: F.round(c, 6)
R2 = geo.EARTH_ZONE_M
_LANE = (14.0, 66.0, 16.0, 70.0)  # south, west, north, east
_WATERS = (12.0, 64.0, 20.0, 72.0)
_EXEMPT = (15.0, 67.0, 17.0, 69.0)


def _box(south: float, west: float, north: float, east: float):
    corners = [(south, west), (south, east), (north, east), (north, west), (south, west)]
    return F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in corners))


def _inside(b: tuple) -> str:
    return f"(lat between {b[0]} and {b[2]} and lon between {b[1]} and {b[3]})"


def _far(b: tuple) -> str:
    return haversine_sql("lat", "lon", f"least({b[2]}, greatest({b[0]}, lat))", f"least({b[3]}, greatest({b[1]}, lon))", R2)


def _runs_sql(condition: str, value: str, least_s: int) -> str:
    return f"""
    f0 as (select *, {value} as v from mov), f as (select *, coalesce({condition}, false) as on_ from f0),
    g as (select *, case when lag(on_) over o is distinct from on_ then 1 else 0 end as new_ from f window o as (partition by key order by t, point_id)),
    i as (select *, sum(new_) over (partition by key order by t, point_id rows unbounded preceding) as island from g),
    r as (select key, island, min(t) as t_start, max(t) - min(t) as duration_s, arg_max(v, t) as v from i where on_ group by key, island having max(t) - min(t) >= {least_s}),
    b as (select *, row_number() over (partition by key order by duration_s desc, t_start) as k from r)"""


@query(f"""with {MOVING_SQL}, {_runs_sql('sog >= 6 and v >= 60', f'case when {_inside(_LANE)} then 0 else {_far(_LANE)} / 1000 end', 3600)},
    s as (select key::varchar as subject, duration_s, v, least(1.0, 0.5 + 0.15 * least(v / 60, 2.0) + 0.1 * least(duration_s / 60 / 120, 1.0)) as score from b where k = 1)
    select subject, round(score, 6) as score, round(v, 3) as distance_km, round(duration_s / 60, 3) as duration_min from s where score >= 0.65""")
def lane_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under way far from the lane for an hour, by their longest run."""
    found = areas.lane_deviation(moving_positions(spark, sf_dir), [_box(*_LANE)], least_min=60.0)
    return detectors.alerts(found).select("subject", r6("score").alias("score"), F.round("distance_km", 3).alias("distance_km"), F.round("duration_min", 3).alias("duration_min"))


_PORT_KM = "least(" + ", ".join(haversine_sql("lat", "lon", str(a), str(o)) for _, a, o in PORTS) + ") / 1000"


@query(f"""with {MOVING_SQL}, {_runs_sql(f'sog <= 1 and {_inside(_WATERS)} and not {_inside(_EXEMPT)}', _PORT_KM, 900)},
    s as (select key::varchar as subject, duration_s, v, least(1.0, 0.55 + 0.1 * least(duration_s / 3600 / 0.25, 2.0) + case when v < 40 then 0.1 else 0 end) as score from b where k = 1)
    select subject, round(score, 6) as score, round(duration_s / 3600, 4) as hours, round(v, 3) as nearest_km from s where score >= 0.6""")
def anchored_outside_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that lie stopped in territorial waters outside every exempt area."""
    near = F.least(*(geo.haversine("lat", "lon", float(a), float(o)) for _, a, o in PORTS)) / 1000
    found = areas.anchored_outside(moving_positions(spark, sf_dir), [_box(*_WATERS)], [_box(*_EXEMPT)], near, least_hours=0.25)
    return detectors.alerts(found).select("subject", r6("score").alias("score"), F.round("hours", 4).alias("hours"), F.round("nearest_km", 3).alias("nearest_km"))


_CROSS = (10.0, 62.0, 16.0, 70.0)


@query(f"""with recursive {POSITIONS_SQL}, w as (select *, {_inside(_CROSS)} as in_, lag({_inside(_CROSS)}) over o as was, lag(t) over o as t0, lag(lat) over o as lat0, lag(lon) over o as lon0 from pos window o as (partition by key order by t, point_id)),
    c as (select * from w where was <> in_),
    h(point_id, lo, hi, n) as (select point_id, 0.0::double, 1.0::double, 0 from c union all
        select h.point_id, case when ((lat0 + (lat - lat0) * ((lo + hi) / 2) between {_CROSS[0]} and {_CROSS[2]}) and (lon0 + (lon - lon0) * ((lo + hi) / 2) between {_CROSS[1]} and {_CROSS[3]})) = in_ then lo else (lo + hi) / 2 end,
            case when ((lat0 + (lat - lat0) * ((lo + hi) / 2) between {_CROSS[0]} and {_CROSS[2]}) and (lon0 + (lon - lon0) * ((lo + hi) / 2) between {_CROSS[1]} and {_CROSS[3]})) = in_ then (lo + hi) / 2 else hi end, n + 1
        from h join c on h.point_id = c.point_id where n < 12)
    select c.point_id, in_ as entering, round(t0 + (t - t0) * hi, 3) as t, round(lat0 + (lat - lat0) * hi + 1e-8, 6) as lat, round(lon0 + (lon - lon0) * hi + 1e-8, 6) as lon,
        round((degrees(atan2(sin(radians(lon) - radians(lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon) - radians(lon0)))) + 360) % 360, 4) as bearing
    from h join c on h.point_id = c.point_id where n = 12""")
def area_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and exits of an area, on its boundary, with the bearing of the leg."""
    x = areas.transitions(positions(spark, sf_dir), _box(*_CROSS))
    return x.select("point_id", "entering", F.round("t", 3).alias("t"), r6(F.col("lat") + 1e-8).alias("lat"), r6(F.col("lon") + 1e-8).alias("lon"), F.round("bearing", 4).alias("bearing"))


@query(f"""with b as (select n_nationkey as k, n_nationkey % 20::double as s, 60 + n_nationkey % 7::double as w, 1 + n_nationkey % 4 as h, 2 + n_nationkey % 3 as g from nation)
    select k, round(h * g * pow({R2 / 1000} * pi() / 180, 2) * cos(radians(s + h / 2)), 4) as area_km2, round(s + h / 2, 6) as lat, round(w + g / 2, 6) as lon,
        printf('POLYGON ((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', w, s, w + g, s, w + g, s + h, w, s + h, w, s) as wkt, true as same from b""")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area, centroid and text of polygons, and back from the text."""
    k = F.col("n_nationkey")
    south, west = (k % 20).cast("double"), (60 + k % 7).cast("double")
    north, east = south + 1 + k % 4, west + 2 + k % 3
    ring = F.array(*(F.struct(a.alias("lat"), o.alias("lon")) for a, o in ((south, west), (south, east), (north, east), (north, west), (south, west))))
    b = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("k"), ring.alias("ring")).withColumn("wkt", areas.wkt(F.col("ring")))
    lat, lon = areas.centroid(F.col("ring"))
    return b.select("k", F.round(areas.area_km2(F.col("ring")), 4).alias("area_km2"), r6(lat).alias("lat"), r6(lon).alias("lon"), "wkt", (areas.ring_of("wkt") == F.col("ring")).alias("same"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("point_id")
    g = sequences.gaps(positions(spark, sf_dir))
    some = lambda c, keep: F.when(keep, F.col(c))
    return g.select(
        i.cast("string").alias("gap_id"), F.col("t").alias("t_start"), "t_end", some("lat", i % 5 != 0).alias("off_lat"), some("lon", i % 5 != 0).alias("off_lon"), some("lat_end", i % 7 != 0).alias("on_lat"), some("lon_end", i % 7 != 0).alias("on_lon")
    )


def _scenes(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    south, west = 5.0 + k * 7 % 16, 60.0 + k * 5 % 14
    ring = F.array(*(F.struct(a.cast("double").alias("lat"), o.cast("double").alias("lon")) for a, o in ((south, west), (south + 0.4, west + 4), (south + 4.4, west + 3.6), (south + 4, west - 0.4), (south, west))))
    return spark.range(60).select(F.concat(F.lit("s"), k).alias("scene_id"), (F.lit(1704067200.0) + k * 43_200 + 3600).alias("t_scene"), ring.alias("ring"))


@query()
def imaging_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks at every silence, with the share of the reachable region that the image covers."""
    o = overpass.opportunities(_gaps(spark, sf_dir), _scenes(spark))
    return o.select("gap_id", "scene_id", "tier", "basis", F.round("coverage", 4).alias("coverage"), F.round("reachable_km2", 1).alias("reachable_km2"), F.round("implied_kn", 4).alias("implied_kn"), "exceeds")


@query()
def looks_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: each silence's looks in order of tier and coverage."""
    return overpass.ranked(overpass.opportunities(_gaps(spark, sf_dir), _scenes(spark))).select("gap_id", F.size("looks").cast("long").alias("n"), F.col("looks")[0]["tier"].alias("best"), F.col("looks")[0]["scene_id"].alias("scene_id"))


@query(f"""with {POSITIONS_SQL}, w as (select *, lead(t) over o as t_end, lead(lat) over o as lat2, lead(lon) over o as lon2 from pos window o as (partition by key order by t, point_id)), d as (select *, t_end - t as dt from w where t_end is not null),
    m as (select key, quantile_cont(dt, 0.5) as med from d group by key), g as (select d.* from d join m on d.key = m.key where dt > greatest(900.0, 3 * greatest(med, 1.0))),
    h as (select *, (lat + lat2) / 2 as a, (lon + lon2) / 2 as o from g where point_id % 5 <> 0 and point_id % 7 <> 0),
    i as (select point_id, sqrt(pow({R2} * radians(lon2 - lon) * cos(radians(a)), 2) + pow({R2} * radians(lat2 - lat), 2)) / dt / 0.514444 as kn from h)
    select point_id::varchar as gap_id, round(kn, 3) as implied_kn, kn > 20 as exceeds from i""")
def implied_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the speed that the two ends of a silence imply, and whether it is above the assumed top speed."""
    g = _gaps(spark, sf_dir).filter("off_lat is not null and on_lat is not null")
    mid = (F.col("off_lat") + F.col("on_lat")) / 2
    x, y = R2 * F.radians(F.col("on_lon") - F.col("off_lon")) * F.cos(F.radians(mid)), R2 * F.radians(F.col("on_lat") - F.col("off_lat"))
    kn = F.sqrt(x * x + y * y) / (F.col("t_end") - F.col("t_start")) / geo.KNOT
    return g.select("gap_id", F.round(kn, 3).alias("implied_kn"), (kn > overpass.TOP_KN).alias("exceeds"))


@query(f"""with {POSITIONS_SQL}, v as (select point_id, key, sog, lat, lon from pos where {_inside(_CROSS)} and not ({" or ".join(f"{haversine_sql('lat', 'lon', str(a), str(o))} <= 150000" for _, a, o in PORTS)}))
    select key, count(*) as n, round(avg(sog), 6) as mean_sog from v group by key""")
def outside_waiting_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in an area but in no waiting area of a port."""
    from tidewatch.operators import proximity

    p = proximity.nearest_place(positions(spark, sf_dir).filter(geo.ring_contains("lat", "lon", _box(*_CROSS))), ports(spark), 150_000).filter("port is null")
    return p.groupBy("key").agg(F.count("*").alias("n"), r6(F.avg("sog")).alias("mean_sog"))
