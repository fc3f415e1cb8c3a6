"""Queries over behaviour: silences against coverage, contacts without a track, states between fixes, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo, ident
from tidewatch.operators import activity, aggregates, detectors, proximity, sequences, silence, states
from tidewatch.plans.registry import query
from tidewatch.sources.bindings import CLOSE_SQL, MOVING_SQL, PORTS, POSITIONS_SQL, close_positions, haversine_sql, moving_positions, positions

r6 = lambda c: F.round(c, 6)


def _passes(spark: SparkSession) -> DataFrame:
    """Satellite passes: ten minutes every 95, with an outage of thirty passes."""
    return spark.range(460).filter("id not between 100 and 130").select((F.lit(1704067200.0) + F.col("id") * 5700).alias("r_start"), (F.lit(1704067800.0) + F.col("id") * 5700).alias("r_end"))


def _spoofs(points: DataFrame) -> DataFrame:
    return points.filter("kind = 'signup' and point_id % 10 = 0").select("key", (F.col("t") - 3600).alias("r_start"), (F.col("t") + 3600).alias("r_end"))


_HEARD = f"""{CLOSE_SQL},
    passes as (select 1704067200.0::double + k * 5700 as r_start, 1704067800.0::double + k * 5700 as r_end from range(0, 460) r(k) where k not between 100 and 130),
    spoofs as (select key, t - 3600 as r_start, t + 3600 as r_end from near where kind = 'signup' and point_id % 10 = 0),
    h as (select distinct floor((lat + 90) / 0.4::double)::bigint as cr, floor((lon + 180) / 0.4::double)::bigint as cc, floor(t / 3600)::bigint as hour,
        case when starts_with(rx, 'sat') then 'sat' else 'ter' end as rx, key from (select *, unnest(string_split(receiver, '|')) as rx from near))"""


def _cover_sql(wanted: str) -> str:
    return f"""
    want as (select distinct cr, cc, hour from {wanted}),
    j as (select w.cr, w.cc, w.hour, h.key, h.rx, abs(h.hour - w.hour) <= 1 as close_ from want w join h on abs(h.cr - w.cr) <= 1 and abs(h.cc - w.cc) <= 1 and abs(h.hour - w.hour) <= 3),
    q as (select cr, cc, hour, count(distinct key) filter (where close_ and rx = 'ter') as ter, count(distinct key) filter (where close_ and rx = 'sat') as sat,
        count(distinct key) filter (where close_) as any_, count(*) filter (where rx = 'sat') as area from j group by all),
    cover as (select w.*, case when any_ > 0 then ter / any_ * (1 - exp(-any_::double)) else 0.0::double end as p_ter, 1 - exp(-coalesce(sat, 0)::double) as p_sat, 1 - exp(-coalesce(area, 0)::double) as sat_area
        from want w left join q on w.cr = q.cr and w.cc = q.cc and w.hour = q.hour)"""


_GAPS = f"""with {_HEARD},
    w as (select *, lead(t) over o as t_end, lead(lat) over o as lat_end, lead(lon) over o as lon_end, lead(receiver) over o as receiver_end from near window o as (partition by key order by t, point_id)),
    d as (select *, t_end - t as dt from w where t_end is not null), m as (select key, quantile_cont(dt, 0.5) as med from d group by key),
    g as (select d.*, greatest(4, least(24, floor(dt / 900)::int)) as n from d join m on d.key = m.key where dt > greatest(900.0, 3 * greatest(med, 1.0))),
    s as (select point_id, t + i / (n - 1) * (t_end - t) as ts, lat + i / (n - 1) * (lat_end - lat) as la, lon + i / (n - 1) * (lon_end - lon) as lo from (select *, unnest(range(0, n)) as i from g)),
    c as (select *, floor((la + 90) / 0.4::double)::bigint as cr, floor((lo + 180) / 0.4::double)::bigint as cc, floor(ts / 3600)::bigint as hour from s),
    {_cover_sql('c')},
    e as (select point_id, avg(p_ter) as mean_ter, avg(1 - (1 - p_ter) * (1 - case when exists (select 1 from passes p where c.ts between r_start and r_end) then p_sat else 0 end)) as mean_any, avg(sat_area) as path_sat
        from c join cover v on c.cr = v.cr and c.cc = v.cc and c.hour = v.hour group by point_id),
    n as (select point_id, count(*) filter (where r_start >= t and r_end <= t_end) as n_passes, sum(least(t_end, r_end) - greatest(t, r_start)) as covered_s from g join passes on t <= r_end and t_end >= r_start group by point_id),
    p as (select list_sort(list(x))[count(*) // 2 + 1] as period_s from (select r_start - lag(r_start) over (order by r_start) as x from passes) where x is not null),
    b as (select distinct point_id from g join spoofs s on g.key = s.key and r_start < t_end and r_end > t),
    f as (select g.*, mean_ter, mean_any, coalesce(n_passes, 0) as n_passes, coalesce(covered_s, 0) / dt as covered_fraction, b.point_id is not null as spoof_near, period_s,
        greatest(path_sat, case contains(receiver, 'sat')::int + contains(receiver_end, 'sat')::int when 2 then 0.85 when 1 then 0.6 else 0.0 end) as sat_cov
        from g join e on g.point_id = e.point_id left join n on g.point_id = n.point_id left join b on g.point_id = b.point_id cross join p),
    t3 as (select *, (sat_cov >= 0.5 or mean_ter >= 0.6) and n_passes >= 2 and not spoof_near as silent, n_passes = 0 and period_s > 0 and dt > 2 * period_s as starved from f),
    typed as (select *, case when silent then 'INTENTIONAL_SILENCE' when starved then 'COVERAGE_GAP' when sat_cov >= 0.5 then 'SAT_PASS_GAP' else 'COVERAGE_GAP' end as gap_type,
        least(1.0, case when silent then greatest(mean_ter, sat_cov) * (1 - exp(-0.6 * n_passes)) when starved then 1 - mean_any when sat_cov >= 0.5 then 1 - covered_fraction else 1 - mean_any end) as confidence from t3)"""


def _typed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = close_positions(spark, sf_dir)
    return silence.classify_gaps(sequences.gaps(p, carry=("receiver",)), silence.heard(p), _passes(spark), _spoofs(p))


@query(f"""{_GAPS} select point_id, key, gap_type, round(confidence, 6) as confidence, round(mean_any, 6) as coverage_along_path, n_passes, spoof_near from typed""")
def gap_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every silence sampled along its path against coverage, passes and spoofing episodes, then the decision tree."""
    return _typed_gaps(spark, sf_dir).select("point_id", "key", "gap_type", r6("confidence").alias("confidence"), r6("mean_any").alias("coverage_along_path"), F.col("n_passes").cast("long").alias("n_passes"), "spoof_near")


@query(f"""{_GAPS}, k as (select key, point_id as pid, t as k_start, t + 86400 as k_end from near where kind = 'purchase'),
    o as (select pid, case when bool_or(gap_type = 'INTENTIONAL_SILENCE') then 'INTENTIONAL_SILENCE' else min_by(gap_type, t) end as gap_type, count(*) as n from k join typed on typed.key = k.key and t <= k_end and t_end >= k_start group by pid)
    select pid as point_id, gap_type, n from o""")
def gap_type_of_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of silence over an interval; an intentional one wins, else the first that overlaps."""
    ask = close_positions(spark, sf_dir).filter("kind = 'purchase'").select("key", F.col("point_id").alias("pid"), F.col("t").alias("t_start"), (F.col("t") + 86_400).alias("t_end"))
    gaps = _typed_gaps(spark, sf_dir).select("key", F.col("t").alias("r_start"), F.col("t_end").alias("r_end"), "gap_type")
    met = proximity.overlaps(ask, gaps, "key").groupBy("pid").agg(
        F.when(F.bool_or(F.col("gap_type") == "INTENTIONAL_SILENCE"), "INTENTIONAL_SILENCE").otherwise(F.min_by("gap_type", "r_start")).alias("gap_type"), F.count("*").alias("n")
    )
    return met.withColumnRenamed("pid", "point_id")


@query(f"""with {_HEARD}, c as (select floor((lat + 90) / 0.4::double)::bigint as cr, floor((lon + 180) / 0.4::double)::bigint as cc, floor(t / 3600)::bigint as hour from near where kind = 'error'),
    {_cover_sql('c')} select hour, count(*) as n_cells, round(avg(p_ter), 6) as p_ter, round(avg(p_sat), 6) as p_sat, round(avg(sat_area), 6) as sat_area from cover group by hour""")
def coverage_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: chances of being heard by land and satellite at the cells of contacts."""
    p = close_positions(spark, sf_dir)
    wanted = p.filter("kind = 'error'").select(silence.grid.cell("lat", "lon", 4).alias("cell"), F.floor(F.col("t") / 3600).alias("hour")).distinct()
    c = silence.around(wanted, silence.heard(p))
    return c.groupBy("hour").agg(F.count("*").alias("n_cells"), *(r6(F.avg(x)).alias(x) for x in ("p_ter", "p_sat", "sat_area")))


_STATIC = [(10.0 + 0.15 * k, 65.0 + 0.15 * k) for k in range(12)]

_DARK = f"""with {_HEARD},
    k as (select point_id, lat, lon, t, key, floor(t / 3600)::bigint as hour, case when point_id % 8 = 0 then null else (10 + point_id % 60)::double end as length_m, 0.5::double + (point_id % 50) / 100.0::double as score, 1 + point_id % 4 as n_looks,
        floor((lat + 90) / 0.4::double)::bigint as cr, floor((lon + 180) / 0.4::double)::bigint as cc from near where kind = 'error'),
    {_cover_sql('k')},
    health as (select hour, 1 - exp(-0.05 * (select count(*) from h where rx = 'sat' and abs(h.hour - x.hour) <= 3)) as health from (select distinct hour from k) x),
    hb as (select k.*, greatest(p_ter, case when exists (select 1 from passes where r_start >= t - 7200 and r_end <= t) then health else 0.0 end) as hearable
        from k join cover v on k.cr = v.cr and k.cc = v.cc and k.hour = v.hour join health e on k.hour = e.hour),
    tr as (select key, hour, lat, lon, t from (select key, floor(t / 3600)::bigint as hour, lat, lon, t, row_number() over (partition by key, floor(t / 3600) order by t desc, point_id desc) as i from near) where i = 1),
    sp as (select tr.* from tr where exists (select 1 from spoofs s where s.key = tr.key and tr.t between r_start and r_end)),
    st(slat, slon) as (values {", ".join(f"({a!r}::double, {o!r}::double)" for a, o in _STATIC)}),
    x as (select hb.*, exists (select 1 from st where {haversine_sql('hb.lat', 'hb.lon', 'slat', 'slon')} <= 5000) as static_near,
        exists (select 1 from sp where sp.hour = hb.hour and {haversine_sql('hb.lat', 'hb.lon', 'sp.lat', 'sp.lon')} <= 25000) as spoof_near,
        (select min({haversine_sql('hb.lat', 'hb.lon', 'tr.lat', 'tr.lon')}) from tr where tr.hour = hb.hour and tr.key <> hb.key) as nearest from hb),
    y as (select *, score * hearable * least(1.0, (length_m - 20) / 20 + 0.5) * least(1.0, coalesce(nearest, 5000.0) / 5000 + 0.5) as ds from x)"""


def _contacts(points: DataFrame) -> DataFrame:
    i = F.col("point_id")
    return points.filter("kind = 'error'").select(
        i.alias("contact_id"), "lat", "lon", "t", F.floor(F.col("t") / 3600).alias("t_hour"), F.when(i % 8 != 0, (10 + i % 60).cast("double")).alias("length_m"), (0.5 + i % 50 / F.lit(100.0)).alias("score"),
        (1 + i % 4).alias("n_looks"), F.array("key").alias("spent"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = close_positions(spark, sf_dir)
    tracks = p.groupBy("key", F.floor(F.col("t") / 3600).alias("t_hour")).agg(F.max(F.struct("t", "point_id", "lat", "lon")).alias("b")).select("key", "t_hour", "b.lat", "b.lon", "b.t")
    spoofed = proximity.overlaps(tracks.withColumn("t_start", F.col("t")).withColumn("t_end", F.col("t")), _spoofs(p), "key").select("key", "t_hour", "lat", "lon").distinct()
    statics = spark.createDataFrame(_STATIC, "lat double, lon double")
    return silence.judge_contacts(_contacts(p), statics, spoofed, tracks.drop("t"), silence.heard(p), _passes(spark), static_m=5000.0, min_looks=2)


@query(f"""{_DARK} select point_id as contact_id, case when spoof_near then 'suppressed_spoof_ambiguity' when static_near then 'suppressed_static' when n_looks < 2 then 'suppressed_transient' when hearable < 0.5 then 'suppressed_coverage'
    when length_m is null or length_m < 20 then 'suppressed_size' when ds >= 0.5 then 'dark_candidate' else 'suppressed_score' end as status, round(hearable, 6) as hearable, static_near, spoof_near,
    case when nearest <= 40000 then round(nearest, 1) end as nearest_m from y""")
def dark_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts without a track: nearness to fixed objects and spoofed keys, hearing, the nearest live track, then the cascade."""
    near = F.when(F.col("nearest_m") <= 40_000, F.round("nearest_m", 1))
    return _judged(spark, sf_dir).select("contact_id", "status", r6("hearable").alias("hearable"), "static_near", "spoof_near", near.alias("nearest_m"))


@query(f"""{_DARK} select 'dark_vessel' as rule, point_id::varchar as subject, round(ds, 6) as score from y
    where not spoof_near and not static_near and n_looks >= 2 and hearable >= 0.5 and length_m >= 20 and ds >= 0.5""")
def dark_vessel_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the contacts that the cascade leaves as dark."""
    found = _judged(spark, sf_dir).filter("status = 'dark_candidate'").select(F.lit("dark_vessel").alias("rule"), F.col("contact_id").cast("string").alias("subject"), "t", F.col("dark_score").alias("score"))
    return detectors.alerts(found).select("rule", "subject", r6("score").alias("score"))


_Q = "0.05::double * 0.05::double"


@query(f"""with {MOVING_SQL},
    w as (select *, lead(t) over o as t2, lead(lat) over o as lat2, lead(lon) over o as lon2, lead(sog) over o as sog2, lead(cog) over o as cog2 from mov window o as (partition by key order by t, point_id)),
    v as (select *, sog * 0.514444 * sin(radians(cog)) as vx, sog * 0.514444 * cos(radians(cog)) as vy, t + (point_id % 10) / 10.0 * coalesce(t2 - t, 3600) as at_, 100.0 + point_id % 50 as p, 1.0 as c, 6.6 as v, 100.0 + point_id % 30 as p2 from w),
    f as (select *, (at_ - t) / (t2 - t) as f, at_ - t as dt, t2 - t as span from v),
    x as (select point_id, case when t2 is null or span <= 0 then lat + vy * dt / 111320 else (1 - f) * lat + f * lat2 end as blat,
        case when t2 is null or span <= 0 then lon + vx * dt / (111320 * cos(radians(lat))) else (1 - f) * lon + f * lon2 end as blon,
        case when t2 is null or span <= 0 then p + 2 * dt * c + dt * dt * v + {_Q} * dt * dt * dt / 3 else (1 - f) * (1 - f) * p + f * f * p2 + {_Q} * pow(span * f * (1 - f), 3) / 3 end as bp,
        p + 2 * dt * c + dt * dt * v + {_Q} * dt * dt * dt / 3 as pp, dt, t2 is null as last_ from f)
    select point_id, last_ as predicted, round(blat, 6) as lat, round(blon, 6) as lon, round(2.4477 * sqrt(bp), 3) as radius_m,
        round(case when dt > 0 then least(2.4477 * sqrt(pp), 60 * 0.514444 * dt) else 2.4477 * sqrt(pp) end, 3) as cone_m from x""")
def state_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States between fixes on the bridge, after the last fix predicted, with their 95 % radii."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy("t", "point_id")
    course, knots = F.radians("cog"), F.col("sog") * geo.KNOT
    p = moving_positions(spark, sf_dir).withColumn("vx", knots * F.sin(course)).withColumn("vy", knots * F.cos(course)).withColumn("p2", 100.0 + F.col("point_id") % 30)
    here = F.struct("t", "lat", "lon", "vx", "vy", (100.0 + F.col("point_id") % 50).alias("p"), F.lit(1.0).alias("c"), F.lit(6.6).alias("v"))
    p = p.withColumn("a", here).withColumn("t2", F.lead("t").over(w)).withColumn("n", F.lead("a").over(w))
    at = F.col("t") + F.col("point_id") % 10 / F.lit(10.0) * F.coalesce(F.col("t2") - F.col("t"), F.lit(3600.0))
    after = F.when(F.col("n").isNotNull(), F.struct(*(F.col(f"n.{c}").alias(c) for c in ("t", "lat", "lon", "vx", "vy")), F.col("p2").alias("p"), F.col("n.c").alias("c"), F.col("n.v").alias("v")))
    p = p.withColumn("at", at).withColumn("b", states.bridged(F.col("a"), after, F.col("at"))).withColumn("f", states.predicted(F.col("a"), F.col("at")))
    return p.select(
        "point_id", F.col("t2").isNull().alias("predicted"), r6("b.lat").alias("lat"), r6("b.lon").alias("lon"), F.round(states.radius95(F.col("b")), 3).alias("radius_m"),
        F.round(states.radius95(F.col("f"), F.col("at") - F.col("t")), 3).alias("cone_m"),
    )


@query(f"""with {POSITIONS_SQL}, w as (select *, lead(t) over o - t as dt, lead(lat) over o as lat2, lead(lon) over o as lon2, radians(lat) as a, radians(cog) as b, sog * 1852 * (lead(t) over o - t) / 3600 / 6371000.0::double as s from pos window o as (partition by key order by t, point_id)),
    p as (select *, asin(sin(a) * cos(s) + cos(a) * sin(s) * cos(b)) as la from w where dt between 1200 and 86400),
    q as (select *, degrees(la) as plat, (degrees(radians(lon) + atan2(sin(b) * sin(s) * cos(a), cos(s) - sin(a) * sin(la))) + 540) % 360 - 180 as plon, dt / 3600 as h from p),
    r as (select *, greatest(1.0, least(10 + 1852 * h, 60 * 1852 * h)) as radius from q)
    select point_id, round(plat, 6) as lat, round(plon, 6) as lon, round(radius, 3) as radius_m, round(greatest(0.05, 1 / (1 + h / 3)), 6) as confidence, round({haversine_sql('plat', 'plon', 'lat2', 'lon2')} / radius, 4) as departure from r""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dead reckoning from each fix to the next, leads of twenty minutes to a day, and how far the next departs from it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy("t", "point_id")
    p = positions(spark, sf_dir).select("*", (F.lead("t").over(w) - F.col("t")).alias("dt"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).filter(F.col("dt").between(1200, 86_400))
    hours = F.col("dt") / 3600
    lat, lon = geo.destination("lat", "lon", "cog", F.col("sog") * geo.NAUTICAL_MILE_M * F.col("dt") / 3600)
    q = p.select("point_id", lat.alias("lat"), lon.alias("lon"), geo.uncertainty(10.0, hours).alias("radius"), geo.projection_confidence(hours).alias("confidence"), "lat2", "lon2")
    far = states.departure(F.struct("lat", "lon"), F.col("lat2"), F.col("lon2"), F.col("radius"))
    return q.select("point_id", r6("lat").alias("lat"), r6("lon").alias("lon"), F.round("radius", 3).alias("radius_m"), r6("confidence").alias("confidence"), F.round(far, 4).alias("departure"))


_NEAR_PORT = " or ".join(f"{haversine_sql('lat', 'lon', str(a), str(o))} <= 100000" for _, a, o in PORTS)


def _feature_sql(source: str, by: str) -> str:
    on = " and ".join(f"f.{k} = l.{k}" for k in by.split(", "))
    turn = "abs(((lead(cog) over o - cog + 180) % 360 + 360) % 360 - 180)"
    return f"""
    fx as (select {by}, t, point_id, sog, lat, lon, {turn} as turn, greatest((lead(t) over o - t) / 60, 1e-6) as dt_min, lead(lat) over o as lat2, lead(lon) over o as lon2,
        avg(lat) over (partition by {by}) as clat, avg(lon) over (partition by {by}) as clon, coalesce(abs(((cog - lag(cog) over o + 180) % 360 + 360) % 360 - 180) > 45, true)::int as new_ from {source} window o as (partition by {by} order by t, point_id)),
    fl as (select *, sum(new_) over (partition by {by} order by t, point_id rows unbounded preceding) as leg from fx),
    lg as (select {by}, count(*) filter (where s >= 720) as legs from (select {by}, leg, max(t) - min(t) as s from fl group by {by}, leg) group by {by}),
    ft as (select {by}, count(*) as n, min(t) as t_start, max(t) as t_end, round((max(t) - min(t)) / 60, 1) as span_min, round(avg(sog), 2) as sog_mean, round(quantile_cont(sog, 0.5), 2) as sog_median, round(quantile_cont(sog, 0.9), 2) as sog_p90,
        round(coalesce(avg(turn / dt_min), 0), 2) as turn_rate, count(*) filter (where turn > 45) as alterations, count(*) filter (where abs(turn - 180) <= 35) as reciprocals,
        max({haversine_sql('clat', 'clon', 'lat', 'lon')}) as spread, coalesce(sum({haversine_sql('lat', 'lon', 'lat2', 'lon2')}), 0) as travelled, any_value(clat) as lat, any_value(clon) as lon,
        {haversine_sql('arg_min(lat, t)', 'arg_min(lon, t)', 'arg_max(lat, t)', 'arg_max(lon, t)')} as net from fl group by {by}),
    fe as (select f.*, case when f.n < 3 then 0 else l.legs end as legs, case when alterations > 0 then round(reciprocals / alterations, 3) else 0 end as rf, round(case when travelled > 1 then net / travelled else 0 end, 3) as straightness, round(spread, 1) as spread_m,
        ({_NEAR_PORT}) as waiting from ft f join lg l on {on}),
    cl as (select *, case when n < 4 or span_min < 30 then 'unclassified' when sog_median <= 2 and waiting and spread_m <= 800 then 'anchored'
        when legs >= 4 and reciprocals >= 3 and rf >= 0.5 and legs / greatest(span_min / 60, 1e-6) >= 0.1 and straightness < 0.35 and sog_median >= 1.5 then 'survey_pattern'
        when sog_median between 1.5 and 5 and turn_rate >= 4 and straightness < 0.5 then 'fishing' when sog_median >= 6 and turn_rate <= 1.5 then 'transiting' when sog_median <= 1.5 and spread_m > 800 then 'drifting'
        when sog_median <= 2 and not waiting then 'loitering' when turn_rate >= 8 and straightness < 0.35 then 'manoeuvring_erratically' else 'unclassified' end as activity from fe),
    ac as (select *, coalesce(round(least(0.99, (0.5 + 0.5 * least(1.0, span_min / 720)) * case activity when 'anchored' then 0.95 when 'survey_pattern' then 0.8 when 'fishing' then 0.75 when 'transiting' then 0.9 when 'drifting' then 0.7 when 'loitering' then 0.8
        when 'manoeuvring_erratically' then 0.6 end), 3), 0) as confidence from cl)"""


_WAITING = activity.in_radius(PORTS, 100_000.0)


@query(f"""with {MOVING_SQL}, {_feature_sql('mov', 'key')} select key, n, span_min, sog_mean, sog_median, sog_p90, turn_rate, alterations, reciprocals, legs, straightness, spread_m, waiting, activity, confidence from ac""")
def activity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each key's fixes and the activity that the ordered rules give."""
    a = activity.classified(activity.features(moving_positions(spark, sf_dir), ["key"], _WAITING))
    return a.select("key", "n", "span_min", "sog_mean", "sog_median", "sog_p90", "turn_rate", "alterations", "reciprocals", "legs", "straightness", "spread_m", "waiting", "activity", "confidence")


_PARTS = f"""with recursive {MOVING_SQL}, bg(key, part) as (select key, min(t) from mov group by key union all select bg.key, min(m.t) from bg join mov m on m.key = bg.key and m.t >= bg.part + 10800 group by bg.key, bg.part),
    pm as (select m.*, (select max(part) from bg where bg.key = m.key and bg.part <= m.t) as part from mov m), {_feature_sql('pm', 'key, part')},
    ei as (select *, case when lag(activity) over (partition by key order by part) is distinct from activity then 1 else 0 end as new2 from ac),
    eg as (select *, sum(new2) over (partition by key order by part rows unbounded preceding) as island from ei),
    ep as (select key, island, any_value(activity) as activity, min(t_start) as t_start, max(t_end) as t_end, max(confidence) as confidence, count(*) as n_parts from eg group by key, island)"""


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = activity.windows(moving_positions(spark, sf_dir), step_s=10_800)
    return activity.episodes(activity.classified(activity.features(parts, ["key", "part"], _WAITING)))


@query(f"""{_PARTS} select key, activity, round(t_start, 3) as t_start, round(t_end, 3) as t_end, confidence, n_parts from ep""")
def activity_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of three hours from each first fix on, classified, and neighbours of one activity merged."""
    return _episodes(spark, sf_dir).select("key", "activity", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), "confidence", "n_parts")


@query(f"""{_PARTS}, dm as (select *, round((t_end - t_start) / 3600 * greatest(confidence, 0.01), 6) as weight from ep where activity <> 'unclassified'),
    rk as (select *, row_number() over (partition by key order by weight desc, t_start) as i from dm) select key, activity, weight from rk where i = 1""")
def dominant_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each key did most of the time."""
    return activity.dominant(_episodes(spark, sf_dir))


@query(f"""{_PARTS} select 'notable_activity' as rule, key::varchar as subject, activity, round(case activity when 'survey_pattern' then 0.62 else 0.58 end * confidence, 6) as score from ep
    where activity in ('survey_pattern', 'manoeuvring_erratically') and case activity when 'survey_pattern' then 0.62 else 0.58 end * confidence >= 0.3""")
def notable_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey patterns and erratic courses as alerts."""
    found = activity.notable(_episodes(spark, sf_dir), {"survey_pattern": 0.62, "manoeuvring_erratically": 0.58})
    rows = found.select(F.lit("notable_activity").alias("rule"), F.col("key").cast("string").alias("subject"), F.col("t_start").alias("t"), "score", "activity")
    return detectors.alerts(rows).select("rule", "subject", "activity", r6("score").alias("score"))
