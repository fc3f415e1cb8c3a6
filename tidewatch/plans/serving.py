"""Queries of the serving layer and of the graph: pages, notes, health of the queue, sets, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo, grid, ident
from tidewatch.operators import aggregates, graph, kernels, proximity, sequences
from tidewatch.plans.registry import query
from tidewatch.sources.bindings import POSITIONS_SQL, cell_sql, haversine_sql, positions, table

r6 = lambda c: F.round(c, 6)
WITH = f"with {POSITIONS_SQL}"


@query(f"{WITH} select key, arg_max(point_id, (t, point_id)) as point_id, max(ts) as ts from pos group by key")
def last_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last position of each key."""
    return sequences.latest(positions(spark, sf_dir), ["key"], F.desc("t"), F.desc("point_id")).select("key", "point_id", "ts")


@query(f"""{WITH}, d as (select {cell_sql('lat', 'lon', 4)} as cell, cast(ts as date)::varchar as day, count(*) as n, round(avg(sog), 6) as mean from pos group by all),
    r as (select *, row_number() over (partition by cell order by day desc) as i from d) select cell, day, n, mean from r where i = 1""")
def latest_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of each cell's baseline."""
    p = positions(spark, sf_dir)
    days = p.groupBy(grid.cell("lat", "lon", 4).alias("cell"), F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), r6(F.avg("sog")).alias("mean"))
    return sequences.latest(days, ["cell"], F.desc("day"))


@query(f"""{WITH}, m as (select * from pos where lat between 5 and 25 and lon between 60 and 70 and kind = 'view')
    select point_id, sog, (select count(*) from m) as matching, (select count(*) from m) > 25 as truncated from m order by sog desc, point_id limit 25""")
def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the first rows of a filtered list, with how many match and whether the list was cut."""
    m = positions(spark, sf_dir).filter((F.col("kind") == "view") & geo.in_box("lat", "lon", east=70.0))
    total = m.agg(F.count("*").alias("matching"))
    return m.orderBy(F.desc("sog"), "point_id").limit(25).select("point_id", "sog").join(F.broadcast(total)).withColumn("truncated", F.col("matching") > 25)


_RISK = f"""{WITH}, a as (select key as subject, 1 - exp(-sum(sog / 20 * case when point_id % 5 = 1 then 1.0 else 0.6 end * pow(0.5, (epoch_us(timestamp '2024-02-01') - us) / 86400e6 / 30))) as anomaly from pos where kind = 'error' and point_id % 5 <> 0 group by key),
    k as (select distinct key as subject from pos), s as (select subject, 0.8 as v from k where subject % 7 = 0), f as (select subject, 1.0 as v from k where subject % 5 = 0), o as (select subject, 0.5 as v from k where subject % 11 = 0),
    r as (select k.subject, 0.45 * coalesce(anomaly, 0) + 0.30 * coalesce(s.v, 0) + 0.15 * coalesce(f.v, 0) + 0.10 * coalesce(o.v, 0) as risk
        from k left join a using (subject) left join s using (subject) left join f using (subject) left join o using (subject))"""


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("point_id")
    p = positions(spark, sf_dir)
    alerts = p.filter("kind = 'error'").select(F.col("key").alias("subject"), (F.col("sog") / 20).alias("score"), "ts", F.when(i % 5 == 0, "dismiss").when(i % 5 == 1, "confirm").alias("disposition"))
    keys = p.select(F.col("key").alias("subject")).distinct()
    some = lambda n, name, v: keys.filter(F.col("subject") % n == 0).withColumn(name, F.lit(v))
    parts = {"anomaly": aggregates.anomaly_part(alerts, "2024-02-01 00:00:00"), "sanctions": some(7, "sanctions", 0.8), "flag": some(5, "flag", 1.0), "ownership": some(11, "ownership", 0.5)}
    return aggregates.risk(parts)


@query(f"{_RISK} select subject, round(risk, 6) as risk from r where risk > 0")
def risk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted sum of anomaly, sanctions, flag and ownership."""
    return _risk(spark, sf_dir).select("subject", r6("risk").alias("risk"))


@query(f"{_RISK} select subject, round(risk, 6) as risk, row_number() over (order by risk desc, subject) as rank from r order by risk desc, subject limit 20")
def riskiest_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty subjects of most risk."""
    top = _risk(spark, sf_dir).orderBy(F.desc("risk"), "subject").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("risk"), "subject")).cast("long")).select("subject", r6("risk").alias("risk"), "rank")


_EDGES = "e as (select 'c' || o_custkey as src, 'p' || o_orderpriority as dst from orders)"


@query(f"with {_EDGES}, d as (select src as id, count(*) as degree from e group by src) select id, degree, row_number() over (order by degree desc, id) = 1 as focus from d order by degree desc, id limit 12")
def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the vessels of most edges to start from, and the one in focus."""
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "o_orderpriority").alias("dst"))
    top = graph.degrees(e).filter(F.col("id").startswith("c")).orderBy(F.desc("degree"), "id").limit(12)
    return top.withColumn("focus", F.row_number().over(Window.orderBy(F.desc("degree"), "id")) == 1)


@query("""with u as (select 'order' as kind, o_custkey as subject, o_totalprice as value, null::varchar as flag from orders union all select 'line', l_suppkey, l_quantity, l_returnflag from lineitem union all select event_type, user_id, value, null from events)
    select kind, count(*) as n, count(distinct subject) as n_subjects, count(flag) as n_flagged, round(sum(value), 2) as total from u group by kind""")
def united_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of several tables as one, columns that a table lacks being null."""
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("value"))
    li = table(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_suppkey").alias("subject"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("flag"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("subject"), "value")
    u = o.unionByName(li, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("n_subjects"), F.count("flag").alias("n_flagged"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""{WITH}, c as (select distinct key, {cell_sql('lat', 'lon', 4)} as cell, t < 1705363200 as early from pos),
    s as (select key, cell, bool_or(early) as a, bool_or(not early) as b from c group by key, cell)
    select key, count(*) as n_union, count(*) filter (where a and b) as n_both, count(*) filter (where b and not a) as n_new, count(*) filter (where a and not b) as n_left from s group by key""")
def cell_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: union, intersection and difference of the cells seen before and after an instant."""
    c = positions(spark, sf_dir).select("key", grid.cell("lat", "lon", 4).alias("cell"), (F.col("t") < 1705363200).alias("early"))
    s = c.groupBy("key", "cell").agg(F.bool_or("early").alias("a"), F.bool_or(~F.col("early")).alias("b"))
    return s.groupBy("key").agg(F.count("*").alias("n_union"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("b") & ~F.col("a")).alias("n_new"), F.count_if(F.col("a") & ~F.col("b")).alias("n_left"))


@query("""select distinct id from (select user_id as id from events where event_type = 'view' union select (user_id * 7 + 3) % 400 from events where event_type = 'error') where id is not null""")
def known_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids over subjects and counterparts of event tables."""
    e = table(spark, sf_dir, "events")
    a, b = e.filter("event_type = 'view'").select(F.col("user_id").alias("a")), e.filter("event_type = 'error'").select(((F.col("user_id") * 7 + 3) % 400).alias("b"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select(F.explode(F.array_compact(F.array("a", "b"))).alias("id")).distinct()


@query("""with n as (select 'p' || p_partkey as id, 'part' as type, p_brand as label from part), l as (select label, min(id) as lead from n group by label)
    select 's' || l_suppkey as src, lead as dst, 'supplies' as edge_type from lineitem join n on id = 'p' || l_partkey join l on n.label = l.label group by all""")
def merged_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one label as one, their edges led there."""
    n = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("part").alias("type"), F.col("p_brand").alias("label"))
    e = table(spark, sf_dir, "lineitem").select(F.lit("supplies").alias("edge_type"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graph.merged_authorities(n, e)[1].select("src", "dst", "edge_type")


@query("""select o_custkey as id, count(*) as n, string_agg(o_orderkey || ':' || o_orderstatus, ',' order by (o_orderstatus = 'O') desc, o_orderdate desc, o_orderkey desc) as history from orders group by 1""")
def vessel_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identity's intervals, the open ones first, then the newest."""
    o = table(spark, sf_dir, "orders")
    rank = F.struct((F.col("o_orderstatus") != "O").alias("closed"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"), (-F.col("o_orderkey")).alias("k"), F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("text"))
    g = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(rank)).alias("h"))
    return g.select("id", "n", F.array_join("h.text", ",").alias("history"))


@query(f"""{WITH} select point_id, key, round(t, 3) as t from pos where key in (3, 5, 8) and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-20' order by t, point_id limit 100""")
def track_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one page of the positions of some ids in a time range."""
    p = positions(spark, sf_dir).filter(F.col("key").isin(3, 5, 8) & (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return p.orderBy("t", "point_id").limit(100).select("point_id", "key", F.round("t", 3).alias("t"))


@query("""with g as (select event_id, case event_id % 4 when 0 then null when 1 then 1 else 0 end as disabling from events)
    select event_id, case when disabling is null then 'not assessed' when disabling = 1 then 'assessed as intentional' else 'assessed, not intentional' end as text from g""")
def gap_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: a finding of three values; not assessed is not the same as not intentional."""
    i = F.col("event_id")
    flag = F.when(i % 4 == 1, 1).when(i % 4 > 1, 0)
    return table(spark, sf_dir, "events").select("event_id", F.when(flag.isNull(), "not assessed").when(flag == 1, "assessed as intentional").otherwise("assessed, not intentional").alias("text"))


@query("""with g as (select event_id, user_id, case event_id % 6 when 0 then null when 1 then '1' when 2 then 'true' when 3 then 'false' else '0' end as x from events) select user_id as key, count(*) as n from g where (case when x in ('1', 'true') then 1 when x is null then null else 0 end) = 1 group by 1""")
def flagged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps flagged by a column that holds numbers in some tables and booleans in others; null is not flagged."""
    i = F.col("event_id") % 6
    e = table(spark, sf_dir, "events")
    whole = e.filter(~i.isin(2, 3)).select("user_id", F.when(i == 1, 1).when(i != 0, 0).cast("int").alias("flag"))
    truth = e.filter(i.isin(2, 3)).select("user_id", (i == 2).alias("flag"))
    both = whole.select("user_id", (F.col("flag").cast("int") == 1).alias("on")).unionByName(truth.select("user_id", (F.col("flag").cast("int") == 1).alias("on")))
    return both.filter("on").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))


@query("""with d as (select event_id, case when event_id % 9 = 0 then null else ts end as ts from events) select event_id, row_number() over (order by ts nulls last, event_id) as place from d order by ts nulls last, event_id limit 200""")
def detections_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: detections by time, those without one last."""
    d = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("ts"))
    page = d.orderBy(F.asc_nulls_last("ts"), "event_id").limit(200)
    return page.select("event_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("ts"), "event_id")).cast("long").alias("place"))


@query("""with p as (select lower('port ' || s_suppkey % 30) as name, 1 as pref, s_suppkey as id from supplier union all select lower('PORT ' || c_custkey % 50), 2, c_custkey from customer), r as (select *, row_number() over (partition by name order by pref, id) as i from p)
    select name, pref as source, id from r where i = 1""")
def ports_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports of two sources, the first source's entry of a name winning."""
    a = table(spark, sf_dir, "supplier").select(F.lower(F.concat(F.lit("port "), F.col("s_suppkey") % 30)).alias("name"), F.lit(1).alias("source"), F.col("s_suppkey").alias("id"))
    b = table(spark, sf_dir, "customer").select(F.lower(F.concat(F.lit("PORT "), F.col("c_custkey") % 50)).alias("name"), F.lit(2).alias("source"), F.col("c_custkey").alias("id"))
    return sequences.latest(a.unionByName(b), ["name"], F.asc("source"), F.asc("id"))


@query("""with m as (select min(ts) as a, max(ts) as b from events), c as (select least(min(o_orderdate), (select a from m)) as a, greatest(max(o_orderdate), (select b from m)) as b from orders)
    select date_diff('day', m.a, m.b) as motion_days, date_diff('day', c.a, c.b) as corpus_days, case when abs(epoch(c.b) - epoch(c.a) - epoch(m.b) + epoch(m.a)) >= 86400 then 'motion covers part of the corpus' end as note from m, c""")
def window_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V8: a note where positions span at least a day less than the corpus."""
    m = table(spark, sf_dir, "events").agg(F.min("ts").alias("ma"), F.max("ts").alias("mb"))
    o = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("oa"), F.max("o_orderdate").alias("ob"))
    j = m.join(F.broadcast(o)).select("ma", "mb", F.least("ma", "oa").alias("ca"), F.greatest("mb", "ob").alias("cb"))
    secs = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6
    days = lambda a, b: F.datediff(b, a).cast("long")
    return j.select(days("ma", "mb").alias("motion_days"), days("ca", "cb").alias("corpus_days"), F.when(F.abs(secs("ca", "cb") - secs("ma", "mb")) >= 86_400, "motion covers part of the corpus").alias("note"))


@query("""with z as (select c_custkey as id, 'zone ' || c_custkey % 200 as name, c_custkey % 3 = 0 as own, c_custkey as made from customer), t as (select id, made + 5 as made from z where own and id % 2 = 0)
    select 'geo_' || substr(sha1(name), 1, 12) as zone_id, max(id) as id, count(*) as n from z where not exists (select 1 from t where t.id = z.id and t.made >= z.made) group by name""")
def live_geofences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by the hash of their name, without those that a later tombstone removes; only own ones can be removed."""
    z = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("zone "), F.col("c_custkey") % 200).alias("name"), (F.col("c_custkey") % 3 == 0).alias("own"), F.col("c_custkey").alias("at"))
    tombs = z.filter("own and id % 2 = 0").select(F.col("id").alias("_id"), (F.col("at") + 5).alias("_at"))
    live = z.join(tombs, (F.col("id") == F.col("_id")) & (F.col("_at") >= F.col("at")), "left_anti")
    return live.groupBy("name").agg(F.max("id").alias("id"), F.count("*").alias("n")).select(ident.short_id("geo", "name").alias("zone_id"), "id", "n")


@query(f"""{WITH}, v as (select distinct key from pos where lat between 14 and 15 and lon between 66 and 67), k as (select key from v order by key limit 40),
    p as (select pos.key, count(*) as n, min(t) as t_first from pos join k on pos.key = k.key where lat between 14 and 15 and lon between 66 and 67 group by pos.key)
    select key, n, round(t_first, 3) as t_first, (select count(*) from v) as matching from p""")
def zone_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys seen in an area, the first forty by name, with how many there are."""
    inside = positions(spark, sf_dir).filter(geo.in_box("lat", "lon", 14.0, 15.0, 66.0, 67.0))
    keys = inside.select("key").distinct()
    kept = inside.join(F.broadcast(keys.orderBy("key").limit(40)), "key").groupBy("key").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("t_first"))
    return kept.join(F.broadcast(keys.agg(F.count("*").alias("matching"))))


@query("""with a as (select o_orderkey as alert_id, o_totalprice as score from orders), l as (select l_orderkey as alert_id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as made, l_returnflag as disposition from lineitem where l_linenumber > 2),
    d as (select alert_id, arg_max(disposition, made) as disposition, count(*) as n_entries from l group by alert_id), h as (select l_orderkey as alert_id, count(distinct l_suppkey) as hops from lineitem group by 1)
    select a.alert_id, coalesce(disposition, 'open') as disposition, coalesce(n_entries, 0) as n_entries, coalesce(hops, 0) as hops from a left join d on a.alert_id = d.alert_id left join h on a.alert_id = h.alert_id where coalesce(disposition, '') <> 'R'""")
def alert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the latest entry of the ledger and the number of their evidence's hops."""
    li = table(spark, sf_dir, "lineitem")
    ledger = li.filter("l_linenumber > 2").select(F.col("l_orderkey").alias("alert_id"), (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("at"), F.col("l_returnflag").alias("disposition"), F.lit("x").alias("analyst"))
    now = graph.dispositions(ledger).select("alert_id", "disposition").join(ledger.groupBy("alert_id").agg(F.count("*").alias("n_entries")), "alert_id")
    hops = li.groupBy(F.col("l_orderkey").alias("alert_id")).agg(F.count_distinct("l_suppkey").alias("hops"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id")).join(now, "alert_id", "left").join(hops, "alert_id", "left")
    out = a.select("alert_id", F.coalesce("disposition", F.lit("open")).alias("disposition"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("hops", F.lit(0)).alias("hops"))
    return out.filter("disposition <> 'R'")


@query(f"""{WITH}, s as (select key as subject, round(arg_max(lat, t), 1) as a, round(arg_max(lon, t), 1) as o from pos group by key), g as (select a, o, count(*) as n from s group by a, o), t as (select count(*) as n from s),
    f as (select kind, count(*) as n from pos where point_id % 3 = 0 or kind = 'view' group by kind), ft as (select sum(n) as n from f)
    select 'place' as issue, max(g.n) as n, max(g.n) >= 5 and max(g.n) / any_value(t.n) >= 0.4 as raised from g, t union all select 'factor', max(f.n), any_value(ft.n) >= 5 and max(f.n) / any_value(ft.n) >= 0.7 from f, ft""")
def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: whether one place holds most subjects, or one kind of factor most factors."""
    p = positions(spark, sf_dir)
    s = sequences.latest(p, ["key"], F.desc("t"), F.desc("point_id")).groupBy(F.round("lat", 1), F.round("lon", 1)).agg(F.count("*").alias("n"))
    f = p.filter("point_id % 3 = 0 or kind = 'view'").groupBy("kind").agg(F.count("*").alias("n"))
    place = s.agg(F.max("n").alias("n"), F.sum("n").alias("all")).select(F.lit("place").alias("issue"), "n", ((F.col("n") >= 5) & (F.col("n") / F.col("all") >= 0.4)).alias("raised"))
    kind = f.agg(F.max("n").alias("n"), F.sum("n").alias("all")).select(F.lit("factor").alias("issue"), "n", ((F.col("all") >= 5) & (F.col("n") / F.col("all") >= 0.7)).alias("raised"))
    return place.unionByName(kind)


@query(f"""{WITH} select count(distinct key) as tracks, count(*) filter (where kind = 'error') as alerts, count(distinct key) filter (where sog > 19.5) as subjects,
    round(count(*) filter (where kind = 'error') / nullif(count(distinct key) filter (where sog > 19.5), 0), 6) as alerts_a_subject, round(count(distinct key) / nullif(count(*) filter (where kind = 'nothing'), 0), 6) as undefined from pos""")
def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: tracks, alerts and subjects, and their ratios; none where the divisor is 0."""
    p = positions(spark, sf_dir).agg(F.count_distinct("key").alias("tracks"), F.count_if(F.col("kind") == "error").alias("alerts"), F.count_distinct(F.when(F.col("sog") > 19.5, F.col("key"))).alias("subjects"), F.count_if(F.col("kind") == "nothing").alias("_n"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return p.select("tracks", "alerts", "subjects", ratio("alerts", "subjects").alias("alerts_a_subject"), ratio("tracks", "_n").alias("undefined"))


@query(f"""{WITH}, l as (select key, arg_max(lat, t) as lat, arg_max(lon, t) as lon, max(ts) as ts from pos group by key) select c_custkey as subject, coalesce(c_name, 'vessel ' || c_custkey) as name, round(lat, 6) as lat, round(lon, 6) as lon, ts, c_custkey % 4 = 0 as synthetic
    from customer left join l on c_custkey = key""")
def subject_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: name, last position and origin of subjects."""
    last = sequences.latest(positions(spark, sf_dir), ["key"], F.desc("t"), F.desc("point_id")).select(F.col("key").alias("subject"), r6("lat").alias("lat"), r6("lon").alias("lon"), "ts")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.coalesce("c_name", F.concat(F.lit("vessel "), "c_custkey")).alias("name"), (F.col("c_custkey") % 4 == 0).alias("synthetic"))
    return c.join(last, "subject", "left").select("subject", "name", "lat", "lon", "ts", "synthetic")


@query(f"""{WITH}, s as (select key as subject, sog / 21 as x from pos where kind = 'purchase' and sog > 0), l as (select subject, ln(1 - x) as l, sum(ln(1 - x)) over (partition by subject) as t from s)
    select subject, count(*) as n, abs(sum((1 - exp(t)) * l / t) - max(1 - exp(t))) <= 5e-4 as adds_up from l group by subject""")
def score_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: whether each subject's points add up to its score."""
    s = positions(spark, sf_dir).filter("kind = 'purchase' and sog > 0").select(F.col("key").alias("subject"), (F.col("sog") / 21).alias("strength"))
    n = aggregates.noisy_or(s, "subject", "strength")
    return n.groupBy("subject").agg(F.count("*").alias("n"), (F.abs(F.sum("points") - F.max("score")) <= 5e-4).alias("adds_up"))


_FAMILY = {"view": "motion", "click": "motion", "error": "silence", "purchase": "identity", "signup": "registry"}
_FAMILY_SQL = "fam(kind, family) as (values " + ", ".join(f"('{k}', '{f}')" for k, f in _FAMILY.items()) + ")"


@query(f"""{WITH}, {_FAMILY_SQL}, h as (select distinct key as subject, family from pos join fam on pos.kind = fam.kind where sog > 15)
    select s.subject, (select count(*) from h where h.subject = s.subject) as n_families, coalesce((select string_agg(f, ',' order by f) from (select distinct family as f from fam) x where f not in (select family from h where h.subject = s.subject)), '') as missing
    from (select distinct key as subject from pos) s""")
def family_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5, Q7: families of factors that a subject has, and those that nothing speaks to."""
    of = F.create_map(*[F.lit(x) for kv in _FAMILY.items() for x in kv])
    p = positions(spark, sf_dir)
    have = p.groupBy(F.col("key").alias("subject")).agg(F.collect_set(F.when(F.col("sog") > 15, F.element_at(of, F.col("kind")))).alias("have"))
    every = F.array(*(F.lit(f) for f in sorted(set(_FAMILY.values()))))
    return have.select("subject", F.size("have").cast("long").alias("n_families"), F.array_join(F.array_sort(F.array_except(every, "have")), ",").alias("missing"))


@query("""select 'orders' as "table", 'no null key' as "check", case when count(*) filter (where o_orderkey is null) = 0 then 'ok' else 'bad' end as level, count(*) filter (where o_orderkey is null) as n from orders
    union all select 'events', 'result cap', case when count(*) % 1000 = 0 then 'warn' else 'ok' end, count(*) from events
    union all select 'events', 'positions without a cell', case when count(*) filter (where value is null) > 0 then 'warn' else 'ok' end, count(*) filter (where value is null) from events
    union all select 'lineitem', 'flag against source', case when count(*) filter (where l_returnflag = 'R' and l_linestatus = 'O') > 0 then 'bad' else 'ok' end, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'O') from lineitem
    union all select 'part', 'length bias', case when avg(p_size) > 25 then 'warn' else 'ok' end, count(*) filter (where p_size > 25) from part""")
def data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the landed tables, one aggregate each."""
    def check(name: str, what: str, n, bad, level: str) -> DataFrame:
        found = table(spark, sf_dir, name).agg(n.alias("n"), bad.alias("bad"))
        return found.select(F.lit(name).alias("table"), F.lit(what).alias("check"), F.when(F.col("bad"), level).otherwise("ok").alias("level"), "n")

    odd = F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    null = lambda c: F.count_if(F.col(c).isNull())
    found = [
        check("orders", "no null key", null("o_orderkey"), null("o_orderkey") > 0, "bad"), check("events", "result cap", F.count("*"), F.count("*") % 1000 == 0, "warn"),
        check("events", "positions without a cell", null("value"), null("value") > 0, "warn"), check("lineitem", "flag against source", odd, odd > 0, "bad"),
        check("part", "length bias", F.count_if(F.col("p_size") > 25), F.avg("p_size") > 25, "warn"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("""select o_orderstatus as flag, count(distinct o_custkey) as n_subjects from orders group by 1""")
def subjects_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct subjects by flag."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("flag")).agg(F.count_distinct("o_custkey").alias("n_subjects"))


@query("""with m as (select p_brand, max(case when p_size % 5 <> 0 then p_size end) as length from part group by 1) select count(*) as n, count(length) as n_with_length, round(count(length) / count(*), 6) as share from m""")
def length_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: subjects with a length in any of their rows."""
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).alias("length"))
    return m.agg(F.count("*").alias("n"), F.count("length").alias("n_with_length"), r6(F.count("length") / F.count("*")).alias("share"))


@query(f"""{WITH}, c as (select kind, greatest(0, least(t + 40000, 1705363200) - greatest(t, 1704844800)) as dwell, sog from pos)
    select kind, """ + ", ".join(f"round(quantile_cont(sog, {q}), 6) as q{round(100 * q)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(sum(dwell), 3) as dwell_s from c group by kind")
def quantile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by kind, and dwell clipped to a window."""
    p = positions(spark, sf_dir)
    q = aggregates.exact_quantiles(p, ["kind"], "sog", {f"q{round(100 * s)}": s for s in (0.05, 0.25, 0.5, 0.75, 0.95)})
    dwell = F.greatest(F.lit(0.0), F.least(F.col("t") + 40_000, F.lit(1705363200.0)) - F.greatest("t", F.lit(1704844800.0)))
    return p.groupBy("kind").agg(F.round(F.sum(dwell), 3).alias("dwell_s")).join(q, "kind").select("kind", *(r6(f"q{x}").alias(f"q{x}") for x in (5, 25, 50, 75, 95)), "dwell_s")


@query("""select case o_orderstatus when 'O' then 'cataloged' when 'P' then 'raw' else 'detected' end as status, count(*) as n, min(o_orderdate) as t_start, max(o_orderdate) as t_end from orders group by 1""")
def scene_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes by state, with their time range."""
    s = F.when(F.col("o_orderstatus") == "O", "cataloged").when(F.col("o_orderstatus") == "P", "raw").otherwise("detected")
    return table(spark, sf_dir, "orders").groupBy(s.alias("status")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("t_start"), F.max("o_orderdate").alias("t_end"))


@query("""with e as (select sha256('{"src":"' || o_custkey || '","dst":"' || o_orderpriority || '"}') as h from orders), p as (select ('0x' || substr(h, 1, 8))::bigint % 4096 as part, sha256(string_agg(h, '' order by h)) as d, count(*) as n from e group by 1)
    select sha256(string_agg(d, '' order by part)) as digest, sum(n)::bigint as n from p""")
def edge_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered digest of a table of edges, by parts."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"))
    return graph.ordered_digest(e, ["src", "dst"])


@query("""with m as (select quality = 1 as p, toxic = 0 as a, doc_id from labels), s as (select sum((p and a)::int)::double as tp, sum((p and not a)::int)::double as fp, sum((not p and a)::int)::double as fn, avg(abs(p::int - a::int)) as mae from m),
    f as (select avg(n) as fragmentation from (select o_custkey, count(distinct o_orderstatus) as n from orders group by 1))
    select round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(mae, 6) as mae, round(fp / 1847.5 * 1000, 6) as fp_per_1000_km2, round(fragmentation, 6) as fragmentation from s, f""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, mean absolute error, false alarms an area, fragments a track."""
    m = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("p"), (F.col("toxic") == 0).alias("a"))
    s = aggregates.precision_recall(m, "p", "a").select(r6("f1").alias("f1"), r6(F.col("fp") / 1847.5 * 1000).alias("fp_per_1000_km2"))
    mae = m.agg(r6(F.avg(F.abs(F.col("p").cast("int") - F.col("a").cast("int")))).alias("mae"))
    frag = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n")).agg(r6(F.avg("n")).alias("fragmentation"))
    return s.join(F.broadcast(mae)).join(F.broadcast(frag)).select("f1", "mae", "fp_per_1000_km2", "fragmentation")


@query(f"""{WITH}, r as (select key, kind, point_id % 5 as claim, max(sog / 21) as c from pos group by all), o as (select *, row_number() over (partition by key, kind order by c desc) as i from r)
    select key, kind, round(least(0.99, 1 - exp(sum(ln(1 - c)) filter (where i <= 3))), 6) as confidence, count(*) as n from o group by key, kind""")
def merged_restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restatements of one claim count once, by their largest; different occurrences add up."""
    p = positions(spark, sf_dir).groupBy("key", "kind", (F.col("point_id") % 5).alias("claim")).agg(F.max(F.col("sog") / 21).alias("c"))
    m = aggregates.merged_repeats(p, ["key", "kind"], "c")
    return m.select("key", "kind", r6("confidence").alias("confidence"), "n")


_IDENT = """i as (select o_custkey % 300 as mmsi, 'hull' || o_orderkey % 97 as hull, epoch(o_orderdate) as t_start, case when o_orderkey % 3 = 0 then null else epoch(o_orderdate) + 40000000 end as t_end, epoch(o_orderdate) + o_orderkey as observed_at from orders),
    k as (select user_id as mmsi, 820454400.0::double + event_id * 10000 as t from events where event_type = 'view')"""


def _identified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)
    i = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 300).alias("mmsi"), F.concat(F.lit("hull"), F.col("o_orderkey") % 97).alias("hull"), d.alias("t_start"), F.when(F.col("o_orderkey") % 3 != 0, d + 40_000_000).alias("t_end"), (d + F.col("o_orderkey")).alias("observed_at")
    )
    return i, table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("mmsi"), (F.lit(820454400.0) + F.col("event_id") * 10000).alias("t"))


@query(f"""with {_IDENT}, b as (select k.mmsi, k.t, arg_max(hull, (observed_at, hull)) as hull from k join i on k.mmsi = i.mmsi and i.t_start <= k.t and (t_end is null or k.t < t_end) group by k.mmsi, k.t)
    select k.mmsi, k.t, coalesce(hull, 'vessel:mmsi:' || k.mmsi) as hull, hull is null as provisional from (select distinct * from k) k left join b on k.mmsi = b.mmsi and k.t = b.t""")
def hull_of_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull that an identity stood for at a time, else a provisional one."""
    i, k = _identified(spark, sf_dir)
    return graph.identity_at(k, i)


@query(f"""with {_IDENT}, h as (select distinct 'hull' || (event_id % 97) as hull, 820454400.0::double + event_id * 10000 as t from events),
    b as (select h.hull, h.t, arg_max(mmsi, (observed_at, mmsi)) as mmsi from h join i on h.hull = i.hull and t_start <= h.t and (t_end is null or h.t < t_end) group by h.hull, h.t)
    select h.hull, h.t, mmsi from h left join b on h.hull = b.hull and h.t = b.t""")
def identity_of_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity that a hull used at a time, the latest observed of the valid."""
    i, _ = _identified(spark, sf_dir)
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("hull"), F.col("event_id") % 97).alias("hull"), (F.lit(820454400.0) + F.col("event_id") * 10000).alias("t"))
    return graph.mmsi_at(asked, i)


@query(f"""{WITH}, e as (select point_id, key, t as a, t + 20000 as b, lat, lon from pos where kind = 'purchase'), s as (select key, t, lat, lon from pos where kind = 'error')
    select e.point_id, exists (select 1 from s where s.key = e.key and s.t between e.a - 3600 and e.b + 3600) as by_track, exists (select 1 from s where abs(s.t - e.a) <= 43200 and {haversine_sql('e.lat', 'e.lon', 's.lat', 's.lon')} <= 30000) as by_place from e""")
def silent_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters that a silent contact had part in: by track with a slack of time, or by place."""
    p = positions(spark, sf_dir)
    e = p.filter("kind = 'purchase'").select("point_id", "key", F.col("t").alias("a"), "lat", "lon", (F.col("t") - 3600).alias("t_start"), (F.col("t") + 23_600).alias("t_end"))
    s = p.filter("kind = 'error'").select("key", F.col("t").alias("r_start"), F.col("t").alias("r_end"), "lat", "lon")
    track = proximity.overlaps(e.select("point_id", "key", "t_start", "t_end"), s.select("key", "r_start", "r_end"), "key").select("point_id").distinct().withColumn("by_track", F.lit(True))
    cells = lambda d: d.withColumn("cell", grid.cell("lat", "lon", 4))
    spread = cells(e.select("point_id", "lat", "lon", (F.col("a") - 43_200).alias("t_start"), (F.col("a") + 43_200).alias("t_end"))).withColumn("cell", F.explode(grid.reach("lat", "lon", 30_000, 4)))
    met = proximity.overlaps(spread, cells(s.select(F.col("lat").alias("slat"), F.col("lon").alias("slon"), "r_start", "r_end", "lat", "lon")).drop("lat", "lon"), "cell")
    place = met.filter(geo.haversine("lat", "lon", "slat", "slon") <= 30_000).select("point_id").distinct().withColumn("by_place", F.lit(True))
    return e.select("point_id").join(track, "point_id", "left").join(place, "point_id", "left").fillna(False, ["by_track", "by_place"])


@query(f"""{WITH}, n as (select key, point_id, t from pos where kind = 'signup'), g as (select key, point_id as gap, t from pos where kind = 'error' and point_id % 4 = 1)
    select n.point_id, gap, round((g.t - n.t) / 86400, 4) as days from n join g on n.key = g.key and abs(g.t - n.t) <= 3 * 86400""")
def renames_near_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed names and flagged gaps of one subject within three days of each other."""
    p = positions(spark, sf_dir)
    n = p.filter("kind = 'signup'").select("key", "point_id", F.col("t").alias("t0"), (F.col("t") - 259_200).alias("t_start"), (F.col("t") + 259_200).alias("t_end"))
    g = p.filter("kind = 'error' and point_id % 4 = 1").select("key", F.col("point_id").alias("gap"), F.col("t").alias("r_start"), F.col("t").alias("r_end"))
    return proximity.overlaps(n, g, "key").select("point_id", "gap", F.round((F.col("r_start") - F.col("t0")) / 86_400, 4).alias("days"))


@query()
def truth_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and predictions matched one to one inside a gate, by least total distance."""
    p = positions(spark, sf_dir).withColumn("scene_id", F.floor(F.col("us") / 86_400e6).cast("string"))
    truth = p.filter("kind = 'signup'").select("scene_id", F.col("point_id").cast("string").alias("contact_id"), "lat", "lon")
    found = p.filter("kind = 'click'").select("scene_id", F.col("point_id").cast("string").alias("track_id"), "lat", "lon")
    # Within the gate any match beats none.
    scored = proximity.near(truth, found, 40_000, ("scene_id",)).select("scene_id", "contact_id", "track_id", (1000.0 - F.col("distance_m") / 1000).alias("score"))
    out = kernels.associate(scored, truth.select("scene_id", "contact_id"), floor=-8.0)
    return out.select("scene_id", "contact_id", "track_id", F.round(1_000_000 - F.col("score") * 1000, 3).alias("distance_m"))


@query(f"""{WITH}, g as (select point_id as event_id, key from pos where kind = 'error'), i as (select (event_id * 3 % 10000)::varchar as gap_event_id, event_id % 3 as tier from events where event_type = 'view')
    select key, count(*) as n, min(tier) as best from g join i on cast(event_id as varchar) = gap_event_id where key between 10 and 60 group by key""")
def imaging_of_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks joined to gaps by the text of their id, for some vessels."""
    g = positions(spark, sf_dir).filter("kind = 'error' and key between 10 and 60").select(F.col("point_id").cast("string").alias("id"), "key")
    i = table(spark, sf_dir, "events").filter("event_type = 'view'").select((F.col("event_id") * 3 % 10000).cast("string").alias("id"), (F.col("event_id") % 3).alias("tier"))
    return g.join(i, "id").groupBy("key").agg(F.count("*").alias("n"), F.min("tier").alias("best"))


_OWNED = """own as (select 'c' || c_custkey as src, 'n' || c_nationkey as dst, 1 - c_custkey % 5 / 10.0::double as confidence from customer union all select 'n' || n_nationkey, 'r' || n_regionkey, 1 - n_nationkey % 4 / 10.0::double from nation),
    san(entity, s0, s1, sc) as (values ('n3', 800000000.0::double, null::double, 0.9::double), ('r2', 820000000.0::double, 860000000.0::double, 0.8::double), ('n11', 0.0::double, 810000000.0::double, 0.95::double)),
    walk(start, "end", hops, c) as (select src, dst, 1, confidence from own where src like 'c%' union all select w.start, own.dst, w.hops + 1, least(w.c, own.confidence) from walk w join own on w."end" = own.src where w.hops < 3)"""


def _sanctions(spark: SparkSession) -> DataFrame:
    rows = [("n3", 800_000_000.0, None, 0.9), ("r2", 820_000_000.0, 860_000_000.0, 0.8), ("n11", 0.0, 810_000_000.0, 0.95)]
    return spark.createDataFrame(rows, "entity string, t_start double, t_end double, confidence double")


@query(f"""with recursive {_OWNED}, m as (select 's' || l_suppkey as subject, 'c' || (l_orderkey % 1500 + 1) as cp, epoch(l_shipdate) as t, 0.5 + l_linenumber / 10.0 as mc from lineitem),
    h as (select subject, cp, entity, t, hops, least(mc, c, sc) as score from m join walk on start = cp join san on entity = "end" where s0 <= t and (s1 is null or s1 > t))
    select subject, cp as counterpart, entity, t, hops, round(score, 6) as score from h where score >= 0.3 group by all""")
def sanctioned_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings with vessels whose owner was sanctioned at the time, by the weakest link of the chain."""
    from tidewatch.plans.records import _ownership

    m = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.concat(F.lit("c"), F.col("l_orderkey") % 1500 + 1).alias("counterpart"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("t"), (0.5 + F.col("l_linenumber") / 10).alias("confidence")
    )
    found = graph.sanctioned_counterparts(m, _ownership(spark, sf_dir), _sanctions(spark))
    return found.select("subject", "counterpart", "entity", "t", "hops", r6("score").alias("score")).distinct()


@query(f"""with recursive {_OWNED}, g as (select 'c' || o_custkey as subject, epoch(o_orderdate) as t, case o_orderkey % 3 when 0 then 'INTENTIONAL_SILENCE' else 'COVERAGE_GAP' end as gap_type, 0.4 + o_orderkey % 6 / 10.0 as gc from orders),
    h as (select subject, entity, t, hops, least(gc, c, sc) as score from g join walk on start = subject join san on entity = "end" where gap_type = 'INTENTIONAL_SILENCE' and s0 <= t and (s1 is null or s1 > t))
    select subject, entity, t, hops, round(score, 6) as score from h where score >= 0.3 group by all""")
def sanctioned_owner_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intentional silences of vessels whose own owner was sanctioned at the time."""
    from tidewatch.plans.records import _ownership

    i = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").filter(i % 3 == 0).select(F.concat(F.lit("c"), "o_custkey").alias("subject"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("t"), (0.4 + i % 6 / 10).alias("confidence"))
    found = graph.sanctioned_counterparts(g.withColumn("counterpart", F.col("subject")), _ownership(spark, sf_dir), _sanctions(spark))
    return found.select("subject", "entity", "t", "hops", r6("score").alias("score")).distinct()


@query("""with a as (select 'v' || o_custkey as id, o_orderkey as made, o_orderpriority as p, o_orderstatus as s, o_orderkey % 4 = 0 as syn from orders)
    select id, arg_max(p, made) filter (where p is not null) as priority, arg_max(s, made) filter (where made % 5 <> 0) as status, bool_and(syn) as is_synthetic from a group by id""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: assertions of a node merged, later properties over earlier ones; real once anything real says so."""
    at = F.col("o_orderkey")
    props = F.map_concat(F.create_map(F.lit("priority"), F.col("o_orderpriority")), F.when(at % 5 != 0, F.create_map(F.lit("status"), F.col("o_orderstatus"))).otherwise(F.create_map().cast("map<string,string>")))
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), "o_custkey").alias("id"), F.lit("vessel").alias("type"), at.alias("at"), props.alias("props"), (at % 4 == 0).alias("is_synthetic"))
    n = graph.merged_nodes(a)
    return n.select("id", F.col("props")["priority"].alias("priority"), F.col("props")["status"].alias("status"), "is_synthetic")


@query("""with e as (select l_suppkey as src, l_partkey as dst, l_orderkey * 10 + l_linenumber as seen from lineitem), n as (select src, dst, max(seen) as seen, count(*) as n from e group by src, dst)
    select src, dst, seen + 1 as observed_at, seen + 1 as t_end, n from n""")
def closed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges closed by a further assertion, on top of their latest."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.lit("supplies").alias("edge_type"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(0).cast("long").alias("t_start"), F.lit(None).cast("long").alias("t_end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observed_at"))
    ends = e.groupBy("edge_type", "src", "dst").agg((F.max("observed_at") + 1).alias("observed_at"), F.count("*").alias("n")).withColumn("t_end", F.col("observed_at"))
    all_of_them = e.unionByName(graph.closed(e, ends))
    now = graph.latest_assertions(all_of_them).filter("t_end is not null")
    return now.join(ends.select("src", "dst", "n"), ["src", "dst"]).select("src", "dst", "observed_at", "t_end", "n")


@query("""with q as (select distinct user_id || ':' || event_type || ':' || date_trunc('day', ts)::date as k from events where hour(ts) < 12),
    f as (select event_id, user_id || ':' || event_type || ':' || date_trunc('day', ts)::date as k, row_number() over (partition by user_id || ':' || event_type || ':' || date_trunc('day', ts)::date order by ts, event_id) as i from events where hour(ts) >= 8)
    select event_id, k as event_key from f where i = 1 and k not in (select k from q)""")
def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events emitted once a key and day, less those that the morning's queue holds."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(":", "user_id", "event_type", F.to_date("ts").cast("string")).alias("event_key"), F.col("ts").alias("at"))
    return graph.emitted_once(e.filter(F.hour("at") < 12).select("event_key").distinct(), e.filter(F.hour("at") >= 8)).select("event_id", "event_key")


@query("""with v as (select 'identified-as' as edge_type, 'vessel:' || c_custkey as src, 'id:name:' || c_name as dst from customer union all select 'flagged-to', 'vessel:' || c_custkey, 'flag:' || n_name from customer join nation on c_nationkey = n_nationkey
    union all select 'met-with', 'vessel:' || o_custkey, 'vessel:' || (o_custkey + 1) from orders where o_orderkey % 5 = 0 union all select 'met-with', 'vessel:' || (o_custkey + 1), 'vessel:' || o_custkey from orders where o_orderkey % 5 = 0),
    d as (select distinct * from v) select edge_type, count(*) as n, count(distinct src) as n_src from d group by edge_type""")
def populated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of several types from landed tables; meetings stand in both directions."""
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    edge = lambda d, t, a, b: d.select(F.lit(t).alias("edge_type"), a.alias("src"), b.alias("dst"))
    v = lambda x: F.concat(F.lit("vessel:"), x)
    named = edge(c, "identified-as", v(F.col("c_custkey")), F.concat(F.lit("id:name:"), "c_name"))
    flags = edge(c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey), "flagged-to", v(F.col("c_custkey")), F.concat(F.lit("flag:"), "n_name"))
    met = graph.both_ways(edge(o.filter("o_orderkey % 5 = 0"), "met-with", v(F.col("o_custkey")), v(F.col("o_custkey") + 1)))
    return named.unionByName(flags).unionByName(met).distinct().groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"))
