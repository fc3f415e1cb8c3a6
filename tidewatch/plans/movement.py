"""Queries over positions: filters, sequences, joins in space and time, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo, grid
from tidewatch.operators import aggregates, kernels, proximity, sequences, silence
from tidewatch.plans.registry import query
from tidewatch.sources.bindings import PORTS_SQL, POSITIONS_SQL, cell_sql, haversine_sql, ports, positions

r6 = lambda c: F.round(c, 6)
WITH = f"with {POSITIONS_SQL}"
ORDER = "partition by key order by t, point_id"


@query(f"""{WITH} select point_id, key, round(d, 6) as distance_m, sog from (select *, {haversine_sql('lat', 'lon', '18.941', '72.890')} as d from pos) where d <= 300000""")
def candidates_near_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions within 300 km of a place."""
    near = proximity.within_radius(positions(spark, sf_dir), 18.941, 72.890, 300_000)
    return near.select("point_id", "key", r6("distance_m").alias("distance_m"), "sog")


@query(f"""{WITH} select kind, count(*) as n, count(*) filter (where lat between 5 and 25 and lon between 60 and 78) as n_inside, round(avg(sog), 6) as mean_sog from pos
    where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12' group by kind""")
def area_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and time range."""
    p = positions(spark, sf_dir).filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(geo.in_box("lat", "lon")).alias("n_inside"), r6(F.avg("sog")).alias("mean_sog"))


@query(f"""{WITH}, w as (select *, lag(t) over o as t0, lag(cog) over o as c0, lag(lat) over o as lat0, lag(lon) over o as lon0 from pos window o as ({ORDER}))
    select point_id, key, round(t - t0, 3) as dt, round(abs(((cog - c0 + 180) % 360 + 360) % 360 - 180), 6) as turn, round({haversine_sql('lat0', 'lon0', 'lat', 'lon')}, 3) as leg from w""")
def fix_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, turn and leg from the fix before."""
    d = sequences.deltas(positions(spark, sf_dir))
    return d.select("point_id", "key", F.round("dt", 3).alias("dt"), r6("turn").alias("turn"), F.round("leg", 3).alias("leg"))


@query(f"""{WITH}, w as (select *, lead(t) over ({ORDER}) as t_end from pos), d as (select *, t_end - t as dt from w where t_end is not null),
    m as (select key, quantile_cont(dt, 0.5) as med from d group by key)
    select d.key, point_id, round(dt, 3) as dt from d join m on d.key = m.key where dt > greatest(900.0, 3 * greatest(med, 1.0))""")
def reporting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences beyond thrice the key's cadence."""
    return sequences.gaps(positions(spark, sf_dir)).select("key", "point_id", F.round("dt", 3).alias("dt"))


@query(f"""{WITH}, w as (select *, case when t - lag(t) over ({ORDER}) > 21600 or lag(t) over ({ORDER}) is null then 1 else 0 end as new from pos),
    i as (select *, sum(new) over ({ORDER} rows unbounded preceding) as island from w),
    s as (select key, island, min(t) as a, max(t) as b, count(*) as n_points from i group by key, island)
    select key, cast(island as bigint) as island, round(b - a, 3) as span_s, n_points, cast(lag(island) over (partition by key order by island) as bigint) as fragmented_from from s""")
def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between silences of six hours, with lineage."""
    s = sequences.sessions(positions(spark, sf_dir), break_s=21_600)
    return s.select("key", F.col("island").cast("long").alias("island"), F.round(F.col("t_end") - F.col("t_start"), 3).alias("span_s"), "n_points", F.col("fragmented_from").cast("long").alias("fragmented_from"))


@query(f"""{WITH}, f as (select *, sog < 10 as on_, lag(sog < 10) over ({ORDER}) as was from pos),
    i as (select *, sum(case when was is null or was <> on_ then 1 else 0 end) over ({ORDER} rows unbounded preceding) as island from f)
    select key, count(*) as n, round(min(t), 3) as t_start, round(max(t) - min(t), 3) as duration_s, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon
    from i where on_ group by key, island having max(t) - min(t) >= 7200""")
def slow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of slow fixes of two hours and more."""
    runs = sequences.state_runs(positions(spark, sf_dir), F.col("sog") < 10, least_s=7200)
    return runs.select("key", "n", F.round("t_start", 3).alias("t_start"), F.round("duration_s", 3).alias("duration_s"), r6("lat").alias("lat"), r6("lon").alias("lon"))


_NEAR = f"""{WITH}, {PORTS_SQL}, pairs as (select pos.*, port, {haversine_sql('lat', 'lon', 'port_lat', 'port_lon')} as d from pos, ports),
    best as (select point_id, min_by(port, d) as port, min(d) as d from pairs where d <= 150000 group by point_id)"""


@query(f"""{_NEAR} select pos.point_id, port, round(d, 3) as distance_m from pos left join best on pos.point_id = best.point_id""")
def nearest_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest port within 150 km, null if none."""
    n = proximity.nearest_place(positions(spark, sf_dir), ports(spark), 150_000)
    return n.select("point_id", "port", F.round("distance_m", 3).alias("distance_m"))


@query(f"""{_NEAR}, s as (select pos.key, pos.t, pos.point_id, port, lag(port) over (partition by pos.key order by pos.t, pos.point_id) as was from pos join best on pos.point_id = best.point_id)
    select key, string_agg(port, '>' order by t, point_id) as calls from s where was is null or was <> port group by key""")
def port_call_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports in the order of calls."""
    p = proximity.nearest_place(positions(spark, sf_dir), ports(spark), 150_000)
    return sequences.call_sequence(p, F.col("port")).select("key", F.array_join("calls", ">").alias("calls"))


@query(f"""{_NEAR}, z as (select pos.*, port, t = min(t) over (partition by pos.key) as first_, t = max(t) over (partition by pos.key) as last_ from pos left join best on pos.point_id = best.point_id),
    m as (select *, case when t - lag(t) over (partition by key, port order by t, point_id) < 86400 then 0 else 1 end as new from z where port is not null),
    v as (select *, sum(new) over (partition by key, port order by t, point_id rows unbounded preceding) as visit from m)
    select key, port as zone, round(min(t), 3) as t_enter, round(max(t) - min(t), 3) as dwell_s, min(sog) as min_sog, bool_or(first_) as entry_censored, bool_or(last_) as open
    from v group by key, port, visit having max(t) - min(t) >= 900""")
def zone_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays near ports, merged over re-entries, censored at the ends."""
    p = proximity.nearest_place(positions(spark, sf_dir), ports(spark), 150_000)
    v = sequences.visits(p, F.col("port"), merge_s=86_400, dwell_s=900)
    return v.select("key", "zone", F.round("t_enter", 3).alias("t_enter"), F.round("dwell_s", 3).alias("dwell_s"), "min_sog", "entry_censored", "open")


@query(f"""{_NEAR}, v as (select pos.key, pos.t, port as zone, row_number() over (partition by pos.key, port order by pos.t) as i from pos join best on pos.point_id = best.point_id),
    n as (select key, zone, t, row_number() over (partition by key order by t, zone) - 1 as n_prior from v where i = 1)
    select key, zone, round(t, 3) as t, n_prior from n where n_prior >= 3""")
def maiden_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First visits of a zone after at least three others."""
    p = proximity.nearest_place(positions(spark, sf_dir), ports(spark), 150_000).filter("port is not null").select("key", F.col("port").alias("zone"), "t")
    return sequences.first_visits(p, "key", "zone", "t").select("key", "zone", F.round("t", 3).alias("t"), "n_prior")


@query(f"""{WITH}, n as (select *, row_number() over ({ORDER}) as i, count(*) over (partition by key) as n from pos)
    select point_id, key from n where (i - 1) % cast(ceil(n / 20.0) as bigint) = 0 or i = n""")
def decimated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th fix and the last."""
    return sequences.decimate(positions(spark, sf_dir), "key", ["t", "point_id"], 20).select("point_id", "key")


@query(f"""{WITH}, w as (select *, lead(t) over o as t2, lead(lat) over o as lat2, lead(lon) over o as lon2 from pos window o as ({ORDER})),
    p as (select * from w where t2 > t), m as (select key, quantile_cont(t2 - t, 0.5) as med from p group by key),
    q as (select p.* from p join m on p.key = m.key where t2 - t <= 2 * greatest(3600.0, 3 * med)),
    g as (select *, unnest(range(cast(ceil(t / 3600) as bigint), cast(ceil(t2 / 3600) as bigint))) * 3600 as g from q)
    select key, count(*) as n, min(g) as first_t, round(avg(lat + (g - t) / (t2 - t) * (lat2 - lat)), 5) as lat, round(avg(lon + (g - t) / (t2 - t) * (lon2 - lon)), 5) as lon from g group by key""")
def hourly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly positions by interpolation, summed up by key."""
    g = sequences.resample(positions(spark, sf_dir), step_s=3600)
    return g.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lon"), 5).alias("lon"))


@query(f"""{WITH}, c as (select * from pos where kind = 'error'), v as (select * from pos where kind = 'view'),
    b as (select c.point_id, max(v.t) as t_back from c left join v on v.key = c.key and v.t <= c.t group by c.point_id),
    n as (select c.point_id, min(v.t) as t_next from c left join v on v.key = c.key and v.t > c.t group by c.point_id)
    select b.point_id, round(t_back, 3) as t_back, round(t_next, 3) as t_next from b join n on b.point_id = n.point_id""")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states before and after each contact, by one union and sort."""
    p = positions(spark, sf_dir)
    j = sequences.as_of(p.filter("kind = 'error'").select("point_id", "key", "t"), p.filter("kind = 'view'").select("key", "t", "lat"), "key", "t", ["lat"])
    return j.select("point_id", F.round("t_asof", 3).alias("t_back"), F.round("t_next", 3).alias("t_next"))


@query(f"""{WITH}, w as (select key, point_id, t as t_start, lead(t) over ({ORDER}) as t_end from pos where kind = 'error')
    select point_id, (select count(*) from pos where pos.key = w.key and pos.t between w.t_start and w.t_end) as n_receipts from w where t_end is not null""")
def receipts_in_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports between two instants, both included."""
    p = positions(spark, sf_dir)
    w = Window.partitionBy("key").orderBy("t", "point_id")
    gaps = p.filter("kind = 'error'").select("key", "point_id", F.col("t").alias("t_start"), F.lead("t").over(w).alias("t_end")).filter("t_end is not null")
    return proximity.receipts_between(gaps, p).select("point_id", "n_receipts")


@query(f"""{WITH}, a as (select key, point_id, t as t_start, t + 86400 as t_end from pos where kind = 'error'), b as (select key, t as r_start, t + 43200 as r_end from pos where kind = 'purchase')
    select point_id, count(*) as n, round(min(r_start), 3) as first_overlap from a join b on a.key = b.key and t_start <= r_end and t_end >= r_start group by point_id""")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals of the same key."""
    p = positions(spark, sf_dir)
    a = p.filter("kind = 'error'").select("key", "point_id", F.col("t").alias("t_start"), (F.col("t") + 86_400).alias("t_end"))
    b = p.filter("kind = 'purchase'").select("key", F.col("t").alias("r_start"), (F.col("t") + 43_200).alias("r_end"))
    return proximity.overlaps(a, b, "key").groupBy("point_id").agg(F.count("*").alias("n"), F.round(F.min("r_start"), 3).alias("first_overlap"))


@query(f"""{WITH}, g as (select *, cast(floor(us / 691200e6) as bigint) as h from pos)
    select a.point_id as a, b.point_id as b, round({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) as d from g a join g b on a.h = b.h and a.key < b.key and {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 40000""")
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of keys within 40 km in the same eight days, by grid cell and time bucket."""
    p = positions(spark, sf_dir).select(F.col("point_id").alias("a"), F.col("key").alias("key_a"), "lat", "lon", F.floor(F.col("us") / 691_200e6).alias("h"))
    j = proximity.near(p, p.select(F.col("a").alias("b"), F.col("key_a").alias("key_b"), "lat", "lon", "h"), 40_000, ("h",), below=("key_a", "key_b"))
    return j.select("a", "b", geo.rounded("distance_m", 3).alias("d"))


_ZONES = [("box", [(10, 62), (10, 70), (16, 70), (16, 62), (10, 62)]), ("tri", [(18, 64), (24, 64), (18, 76), (18, 64)])]


@query(f"""{WITH} select point_id, 'box' as zone_id from pos where lat between 10 and 16 and lon between 62 and 70
    union all select point_id, 'tri' from pos where lat >= 18 and lon >= 64 and (lat - 18) / 6 + (lon - 64) / 12 <= 1""")
def points_in_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in polygons, edges included: cells first, the exact test after."""
    zones = spark.createDataFrame([(z, [{"lat": float(a), "lon": float(o)} for a, o in ring]) for z, ring in _ZONES], "zone_id string, ring array<struct<lat double, lon double>>")
    return proximity.in_zones(positions(spark, sf_dir), zones, res=4).select("point_id", "zone_id")


@query(f"""{WITH}, c as (select *, {cell_sql('lat', 'lon', 4)} // 1 as cell, cast(floor((lat + 90) / 5) as int) as band from pos),
    d as (select band, cast(ts as date) as day, count(distinct key) as k from c group by all), dd as (select band, round(avg(k), 2) as keys_a_day from d group by band)
    select c.band, count(*) as n, count(distinct key) as n_keys, round(quantile_cont(sog, 0.5), 3) as p50, round(quantile_cont(sog, 0.95), 3) as p95, round(quantile_cont(sog, 0.99), 3) as p99,
        round(avg(sog), 3) as mean, round(stddev_pop(sog), 3) as std, min(sog) as least, max(sog) as most, round(sqrt(pow(avg(cos(radians(cog))), 2) + pow(avg(sin(radians(cog))), 2)), 3) as course_r,
        any_value(keys_a_day) as keys_a_day, case when count(*) < 100 then 'insufficient' else 'usable' end as status
    from c join dd on c.band = dd.band group by c.band""")
def area_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: distribution of speeds by latitude band."""
    p = positions(spark, sf_dir).withColumn("band", F.floor((F.col("lat") + 90) / 5).cast("int"))
    return aggregates.baseline(p, "band")


@query(f"""{WITH} select {cell_sql('lat', 'lon', 4)} as cell, kind, count(*) as n, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from pos group by all""")
def event_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: events by cell and kind."""
    return aggregates.density(positions(spark, sf_dir), 4).select("cell", "kind", "n", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(f"""{WITH}, r as (select *, case when point_id % 3 = 0 then 'ter:a' when point_id % 3 = 1 then 'sat:b' else 'ter:a|sat:c' end as receiver from pos),
    h as (select {cell_sql('lat', 'lon', 4)} as cell, cast(floor(t / 3600) as bigint) as hour, split_part(unnest(string_split(receiver, '|')), ':', 1) as rx, key from r)
    select cell, hour, rx, count(distinct key) as n_keys from h group by all""")
def coverage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: distinct keys heard by cell, hour and receiver kind."""
    p = positions(spark, sf_dir).withColumn("receiver", F.when(F.col("point_id") % 3 == 0, "ter:a").when(F.col("point_id") % 3 == 1, "sat:b").otherwise("ter:a|sat:c"))
    return silence.heard(p).groupBy("cell", "hour", "rx").agg(F.count("*").alias("n_keys"))


@query(f"""{WITH}, h as (select distinct floor((lat + 90) / 0.4::double)::bigint as cr, floor((lon + 180) / 0.4::double)::bigint as cc, floor(t / 3600)::bigint as hour, case when point_id % 3 = 0 then 'ter' else 'sat' end as rx, key from pos),
    w as (select distinct cr, cc, hour from h),
    j as (select w.cr, w.cc, w.hour, count(distinct key) filter (where rx = 'ter') as ter, count(distinct key) as n from w join h on abs(h.cr - w.cr) <= 1 and abs(h.cc - w.cc) <= 1 and abs(h.hour - w.hour) <= 1 group by all)
    select hour, count(*) as n_cells, round(sum(ter / n * (1 - exp(-n::double))), 6) as p_ter from j group by hour""")
def heard_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: chance of being heard by land over the cells and hours around, summed up by hour."""
    p = positions(spark, sf_dir).withColumn("receiver", F.when(F.col("point_id") % 3 == 0, "ter:a").otherwise("sat:b"))
    rows = silence.heard(p)
    return silence.around(rows.select("cell", "hour").distinct(), rows).groupBy("hour").agg(F.count("*").alias("n_cells"), r6(F.sum("p_ter")).alias("p_ter"))


@query(f"""{WITH}, e as (select key, cast(floor((us - (select min(us) from pos)) / 900e6) as bigint) as epoch, us, point_id, (us - (select min(us) from pos)) / 900e6 as x from pos),
    r as (select *, row_number() over (partition by key, epoch order by abs(x - epoch - 0.5), point_id) as i from e) select key, epoch, point_id from r where i = 1""")
def epoch_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report a key and epoch of 900 s, the nearest to its middle."""
    p = positions(spark, sf_dir)
    first = p.agg(F.min("us").alias("u0"))
    e = p.crossJoin(F.broadcast(first)).withColumn("x", (F.col("us") - F.col("u0")) / 900e6).withColumn("epoch", F.floor("x"))
    return sequences.latest(e, ["key", "epoch"], F.abs(F.col("x") - F.col("epoch") - 0.5), F.col("point_id")).select("key", "epoch", "point_id")


@query(f"""{WITH}, v as (select key, kind, count(*) as n, min(us) as f from pos group by key, kind), t as (select key, count(*) as n_rows from pos group by key),
    b as (select *, row_number() over (partition by key order by n desc, f) as i from v)
    select t.key, n_rows, kind, round(n / n_rows, 6) as support from t join b on t.key = b.key where i = 1""")
def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's most common kind and its support."""
    v = aggregates.votes(positions(spark, sf_dir), "key", "kind", "us")
    return v.select("key", "n_rows", "kind", r6("support").alias("support"))


@query(f"""{WITH}, f as (select *, sog < 12 as on_, row_number() over ({ORDER}) as i, count(*) over (partition by key) as al, lag(sog < 12) over ({ORDER}) as was from pos),
    g as (select *, sum(case when was is null or was <> on_ then 1 else 0 end) over ({ORDER} rows unbounded preceding) as island from f),
    r as (select key, island, count(*) as n, min(i) as first_row, max(i) = any_value(al) as is_tail from g where on_ group by key, island),
    b as (select *, row_number() over (partition by key order by n desc, first_row) as k from r) select key, n, first_row, is_tail from b where k = 1""")
def longest_slow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of each key, the first of equals."""
    return sequences.longest_run(positions(spark, sf_dir), "key", ["t", "point_id"], F.col("sog") < 12).select("key", "n", "first_row", "is_tail")


@query(f"""{WITH}, s as (select key, t as t_start, t + 40000 + point_id % 7 * 5000 as t_end from pos where kind in ('view', 'error')),
    w as (select *, max(t_end) over (partition by key order by t_start, t_end rows between unbounded preceding and 1 preceding) as reach from s),
    i as (select *, sum(case when reach is null or t_start > reach then 1 else 0 end) over (partition by key order by t_start, t_end rows unbounded preceding) as island from w)
    select key, round(min(t_start), 3) as t_start, round(max(t_end), 3) as t_end, count(*) as n_merged from i group by key, island""")
def merged_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals as one."""
    s = positions(spark, sf_dir).filter(F.col("kind").isin("view", "error")).select("key", F.col("t").alias("t_start"), (F.col("t") + 40_000 + F.col("point_id") % 7 * 5000).alias("t_end"))
    return sequences.merge_intervals(s, "key").select("key", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), "n_merged")


@query(f"""{WITH}, c as (select point_id % 50 as scene_id, (point_id * 31 % 40) as spot, 100 + point_id % 17 as length_m, t, point_id from pos),
    x as (select *, 10.0::double + spot * 0.1 + (point_id % 5) * 0.0001 as lat, 65.0::double + spot * 0.1 as lon from c),
    m as (select spot, count(distinct scene_id) as n_scenes, quantile_cont(length_m, 0.5) as length_m from x group by spot having count(distinct scene_id) >= 3 and max(t) - min(t) >= 604800)
    select n_scenes, count(*) as n_objects from m group by n_scenes""")
def static_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects seen at one place in several scenes over a week."""
    p = positions(spark, sf_dir)
    spot = F.col("point_id") * 31 % 40
    c = p.select((F.col("point_id") % 50).alias("scene_id"), (100 + F.col("point_id") % 17).alias("length_m"), "t", (10.0 + spot * 0.1 + (F.col("point_id") % 5) * 0.0001 + 0.001).alias("lat"), (65.0 + spot * 0.1 + 0.001).alias("lon"))
    return aggregates.static_objects(c).groupBy("n_scenes").agg(F.count("*").alias("n_objects"))


@query()
def built_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by hypotheses, smoothed."""
    return kernels.tracks_of(kernels.build_tracks(positions(spark, sf_dir), break_s=21_600))


@query()
def duplicate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two hulls use at once."""
    return kernels.duplicate_identities(kernels.tracks_of(kernels.build_tracks(positions(spark, sf_dir))))
