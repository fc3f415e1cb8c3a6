"""Queries over records: identities, registries, graph, risk, findings, text, data health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import ident
from tidewatch.operators import aggregates, detectors, graph, sequences
from tidewatch.plans.registry import query
from tidewatch.sources import landing
from tidewatch.sources.bindings import POSITIONS_SQL, positions, table

r6 = lambda c: F.round(c, 6)
WITH = f"with {POSITIONS_SQL}"

_STATUS = "s as (select o_custkey as id, o_orderkey as k, o_orderdate as d, o_orderstatus as v from orders)"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderstatus").alias("v"))


@query(f"with {_STATUS} select id, k, v from (select *, row_number() over (partition by id order by d desc, k desc) as i from s) where i = 1")
def current_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest interval of each identity."""
    return sequences.latest(_status(spark, sf_dir), ["id"], F.desc("d"), F.desc("k")).select("id", "k", "v")


@query(f"with {_STATUS}, w as (select *, lag(v) over o as before, row_number() over o as i from s window o as (partition by id order by d, k)) select id, d, k, before, v as after from w where i > 1 and before is distinct from v")
def identity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals whose value differs from the one before."""
    return sequences.changes(_status(spark, sf_dir), "id", ["d", "k"], "v")


@query(f"""with {_STATUS}, w as (select *, min(v) over o as lo, max(v) over o as hi from s window o as (partition by id order by d, k rows between 1 following and unbounded following))
    select k, coalesce(lo <> v or hi <> v, false) as superseded from w""")
def superseded_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a later interval has another value."""
    return sequences.superseded(_status(spark, sf_dir), "id", ["d", "k"], "v").select("k", "superseded")


_SNAP = "a as (select o_custkey as id, count(*) as n, sum(o_totalprice) as s from orders where month(o_orderdate) = 1 group by 1), b as (select o_custkey as id, count(*) as n, sum(o_totalprice) as s from orders where month(o_orderdate) = 2 group by 1)"


@query(f"""with {_SNAP} select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change
    from a full join b on a.id = b.id where a.id is null or b.id is null or a.n <> b.n""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries added, removed or changed between two snapshots."""
    o = table(spark, sf_dir, "orders")
    snap = lambda m: o.filter(F.month("o_orderdate") == m).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return landing.snapshot_diff(snap(1), snap(2), "id", ["n"]).select("id", "change")


@query("""with x as (select o_custkey as id from orders where month(o_orderdate) = 3 except select o_custkey from orders where month(o_orderdate) = 4) select count(*) as n from x""")
def snapshot_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entries of one snapshot that another lacks."""
    o = table(spark, sf_dir, "orders")
    ids = lambda m: o.filter(F.month("o_orderdate") == m).select("o_custkey")
    return ids(3).subtract(ids(4)).agg(F.count("*").alias("n"))


_MATCH = """v as (select c_custkey as vessel_id, case when c_custkey % 3 = 0 then c_custkey % 400 end as imo, case when c_custkey % 2 = 0 then 'S' || (c_custkey % 90) end as call_sign, 'N' || (c_custkey % 70) as name from customer),
    g as (select s_suppkey as ent, s_suppkey * 7 as imo, 'S' || s_suppkey as call_sign, 'N' || (s_suppkey % 60) as name from supplier)"""


@query(f"""with {_MATCH}, i as (select imo, min(ent) as ent from g group by imo), c as (select call_sign, min(ent) as ent, min_by(name, ent) as name from g group by call_sign), n as (select name, min(ent) as ent from g group by name having count(distinct ent) = 1),
    j as (select v.vessel_id, v.name as name, i.ent as ie, c.ent as ce, c.name as cn, n.ent as ne from v left join i on v.imo = i.imo left join c on v.call_sign = c.call_sign left join n on v.name = n.name)
    select vessel_id, coalesce(ie, ce, ne) as ent, case when ie is not null then 'imo' when ce is not null and cn = name then 'call_sign_name' when ce is not null then 'call_sign' else 'name' end as tier,
        (ie is not null or (ce is not null and cn = name)) as is_finding from j where coalesce(ie, ce, ne) is not null""")
def registry_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by the first tier that holds; names that several entries share are out."""
    k = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").select(k.alias("vessel_id"), F.when(k % 3 == 0, k % 400).alias("imo"), F.when(k % 2 == 0, F.concat(F.lit("S"), k % 90)).alias("call_sign"), F.concat(F.lit("N"), k % 70).alias("name"))
    s = F.col("s_suppkey")
    g = table(spark, sf_dir, "supplier").select(s.alias("ent"), (s * 7).alias("imo"), F.concat(F.lit("S"), s).alias("call_sign"), F.concat(F.lit("N"), s % 60).alias("name"))
    return detectors.tiered_match(v, g).select("vessel_id", "ent", "tier", "is_finding")


_EDGES = """e as (select 'supplies' as edge_type, l_suppkey as src, l_partkey as dst, l_linenumber as rev, l_shipdate as seen, l_returnflag as flag, l_orderkey as ref from lineitem)"""


@query(f"""with {_EDGES}, r as (select *, row_number() over (partition by src, dst order by seen desc, rev desc, ref desc) as i from e where seen <= timestamp '1999-01-01') select src, dst, seen, flag from r where i = 1 and flag <> 'R'""")
def edges_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest assertions of those made by a time; closed edges stay closed."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1999-01-01").cast("timestamp_ntz"))
    e = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_shipdate").alias("seen"), F.col("l_returnflag").alias("flag"), "l_linenumber", "l_orderkey")
    return sequences.latest(e, ["src", "dst"], F.desc("seen"), F.desc("l_linenumber"), F.desc("l_orderkey")).filter("flag <> 'R'").select("src", "dst", "seen", "flag")


def _ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), (1 - F.col("c_custkey") % 5 / 10).alias("confidence"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), (1 - F.col("n_nationkey") % 4 / 10).alias("confidence"))
    return c.unionByName(n)


_OWN = """own as (select 'c' || c_custkey as src, 'n' || c_nationkey as dst, 1 - c_custkey % 5 / 10.0::double as confidence from customer union all select 'n' || n_nationkey, 'r' || n_regionkey, 1 - n_nationkey % 4 / 10.0::double from nation)"""


@query(f"""with recursive {_OWN}, walk(start, "end", hops, confidence) as (select src, dst, 1, confidence from own where src like 'c%' union all select w.start, own.dst, w.hops + 1, least(w.confidence, own.confidence) from walk w join own on w."end" = own.src where w.hops < 3)
    select start, "end", hops, round(confidence, 6) as confidence from walk""")
def ownership_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of up to three hops with the least confidence on the way."""
    own = _ownership(spark, sf_dir)
    starts = own.filter(F.col("src").startswith("c")).select(F.col("src").alias("id")).distinct()
    return graph.chains(own, starts).select("start", "end", "hops", r6("confidence").alias("confidence"))


@query(f"""with {_OWN} select id, count(*) as degree from (select src as id from own union all select dst from own) group by id""")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees over both ends."""
    return graph.degrees(_ownership(spark, sf_dir))


@query(f"""with {_OWN}, d as (select id, count(*) as n from (select src as id from own union all select dst from own) group by id order by n desc, id limit 30)
    select src, dst from own where src in (select id from d) and dst in (select id from d)""")
def top_degree_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: edges between the nodes of highest degree."""
    return graph.top_subgraph(_ownership(spark, sf_dir), 30).select("src", "dst")


@query(f"""with recursive {_OWN}, both_ as (select src, dst from own union select dst, src from own), near(id, k) as (select 'n7', 0 union select b.dst, near.k + 1 from near join both_ b on near.id = b.src where near.k < 2)
    select id, min(k) as distance from near group by id""")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops in both directions."""
    own = _ownership(spark, sf_dir)
    nodes = own.select("src").union(own.select("dst")).distinct().select(F.col("src").alias("id"), F.lit("organization").alias("type"))
    return graph.neighbourhood(own, nodes, spark.createDataFrame([("n7",)], "id string"), 2, 1_000_000)


@query(f"""with {_OWN}, a as (select case when src like 'c%' then 'owned-by' else 'docked-at' end as edge_type, confidence, (case when src like 'c%' then 100 else 1 end)::double as age, case when src like 'c%' then 365.0::double else 2.0::double end as life from own)
    select edge_type, count(*) as n, count(*) filter (where confidence * pow(0.5, age / life) < 0.6) as n_below, round(avg(confidence * pow(0.5, age / life)), 6) as mean_confidence from a group by edge_type""")
def decayed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life decay summed up by edge type."""
    own = _ownership(spark, sf_dir)
    c = F.col("src").startswith("c")
    e = own.select(F.when(c, "owned-by").otherwise("docked-at").alias("edge_type"), "confidence", (F.lit(1e9) - F.when(c, 100).otherwise(1) * 86_400).alias("observed_at"))
    return graph.decay_summary(e, 1e9, 0.6).withColumn("mean_confidence", r6("mean_confidence"))


@query(f"""{WITH}, s as (select key as subject, sog / 21 as strength, point_id from pos where kind = 'purchase'), l as (select *, ln(1 - strength) as l, sum(ln(1 - strength)) over (partition by subject) as t from s)
    select point_id, round(1 - exp(t), 6) as score, round((1 - exp(t)) * l / t, 6) as points from l where t <> 0""")
def noisy_or_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-OR by subject, and each factor's points."""
    s = positions(spark, sf_dir).filter("kind = 'purchase'").select(F.col("key").alias("subject"), (F.col("sog") / 21).alias("strength"), "point_id")
    return aggregates.noisy_or(s, "subject", "strength").filter("score > 0").select("point_id", r6("score").alias("score"), r6("points").alias("points"))


@query(f"""{WITH}, s as (select key, kind, sog / 21 as c, row_number() over (partition by key, kind order by sog desc) as i from pos)
    select key, kind, round(least(0.99, 1 - exp(sum(ln(1 - c)) filter (where i <= 3))), 6) as confidence, count(*) as n from s group by key, kind""")
def merged_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a factor merged."""
    s = positions(spark, sf_dir).select("key", "kind", (F.col("sog") / 21).alias("c"))
    return aggregates.merged_repeats(s, ["key", "kind"], "c").select("key", "kind", r6("confidence").alias("confidence"), "n")


@query(f"""{WITH}, a as (select key as subject, sog / 20 as score, greatest(0.0, (epoch_us(timestamp '2024-02-01') - us) / 86400e6) as age, case when point_id % 5 = 0 then 'dismiss' when point_id % 5 = 1 then 'confirm' end as d from pos where kind = 'error')
    select subject, round(1 - exp(-sum(score * case when d = 'confirm' then 1.0 else 0.6 end * pow(0.5, age / 30))), 6) as anomaly, count(*) as n_alerts from a where coalesce(d, '') <> 'dismiss' group by subject""")
def subject_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed alerts of each subject."""
    p = positions(spark, sf_dir).filter("kind = 'error'")
    a = p.select(F.col("key").alias("subject"), (F.col("sog") / 20).alias("score"), "ts", F.when(F.col("point_id") % 5 == 0, "dismiss").when(F.col("point_id") % 5 == 1, "confirm").alias("disposition"))
    return aggregates.anomaly_part(a, "2024-02-01 00:00:00").select("subject", r6("anomaly").alias("anomaly"), "n_alerts")


@query(f"""{WITH}, l as (select kind, round(sog / 20, 2) as score, case when point_id % 3 = 0 then 'confirm' else 'dismiss' end as label from pos),
    t as (select kind, score, sum(case when label = 'confirm' then 1 else 0 end) as tp, count(*) as n from l group by kind, score),
    c as (select kind, score, sum(tp) over w as tp, sum(n) over w as n, sum(tp) over (partition by kind) as pos from t window w as (partition by kind order by score desc rows unbounded preceding)),
    b as (select *, row_number() over (partition by kind order by tp / n desc, score) as i from c where tp / pos >= 0.5)
    select kind, score as threshold, round(tp / n, 6) as precision, round(tp / pos, 6) as recall from b where i = 1""")
def tuned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of best precision with enough recall."""
    lab = positions(spark, sf_dir).select("kind", F.round(F.col("sog") / 20, 2).alias("score"), F.when(F.col("point_id") % 3 == 0, "confirm").otherwise("dismiss").alias("label"))
    return aggregates.best_threshold(lab, "kind").select("kind", "threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("""select kind, count(*) as n, count(*) filter (where label = 'confirm') as confirmed, round(avg((label = 'confirm')::int), 6) as share from (select event_type as kind, case when event_id % 3 = 0 then 'confirm' else 'dismiss' end as label from events) group by kind""")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by detector."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 3 == 0).alias("yes"))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("yes").alias("confirmed"), r6(F.avg(F.col("yes").cast("int"))).alias("share"))


@query("""select quality = 1 as predicted, toxic = 1 as actual, count(*) as n from labels group by all""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confusion matrix."""
    return table(spark, sf_dir, "labels").groupBy((F.col("quality") == 1).alias("predicted"), (F.col("toxic") == 1).alias("actual")).agg(F.count("*").alias("n"))


@query("""with c as (select sum((quality = 1 and toxic = 0)::int)::double as tp, sum((quality = 1 and toxic <> 0)::int)::double as fp, sum((quality <> 1 and toxic = 0)::int)::double as fn from labels)
    select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall from c""")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall."""
    lab = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("p"), (F.col("toxic") == 0).alias("a"))
    return aggregates.precision_recall(lab, "p", "a").select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("""select event_type as kind, count(*) filter (where event_id % 4 <> 0) as real, count(*) filter (where event_id % 4 = 0) as synthetic from events group by 1""")
def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and synthetic counts, never blended."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 == 0, True).alias("is_synthetic"))
    return aggregates.split_counts(e, "kind")


_PROFILE = [("orders", "o_orderstatus"), ("orders", "o_orderpriority")]


@query("""select 'o_orderstatus' as column, count(*) as n, count(*) filter (where o_orderstatus is null) as n_null, min(o_orderstatus) as least, max(o_orderstatus) as most, count(distinct o_orderstatus) as n_distinct from orders
    union all select 'o_orderpriority', count(*), count(*) filter (where o_orderpriority is null), min(o_orderpriority), max(o_orderpriority), count(distinct o_orderpriority) from orders""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null rate, range and distinct values of columns."""
    return aggregates.profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""select round(avg((text is not null and text <> '')::int), 6) as text, round(avg((lang is not null and lang <> '')::int), 6) as lang from documents""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: share of rows with a value."""
    return aggregates.coverage_of(table(spark, sf_dir, "documents"), ["text", "lang"]).select(r6("text").alias("text"), r6("lang").alias("lang"))


@query("""select user_id as key, max(ts) as last_ts, count(*) as n from events group by 1 order by n desc, key limit 20""")
def busiest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by number of reports, with their last."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(20)


@query("""select user_id as key, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'click') as click from events group by 1""")
def kinds_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind as columns."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).pivot("event_type", ["view", "error", "click"]).count().fillna(0)


@query("""select min(lo) as lo, max(hi) as hi, sum(n)::bigint as n from (select min(ts) as lo, max(ts) as hi, count(*) as n from events union all select min(o_orderdate), max(o_orderdate), count(*) from orders)""")
def corpus_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time range over all tables."""
    span = lambda d, c: d.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count("*").alias("n"))
    both = span(table(spark, sf_dir, "events"), "ts").unionByName(span(table(spark, sf_dir, "orders"), "o_orderdate"))
    return both.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


@query("""select c_custkey as id, 'vessel:' || c_name as label from customer where contains(lower(c_name || ' ' || c_mktsegment), 'building') and c_acctbal >= 1000 order by c_custkey limit 25 offset 10""")
def vessel_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, K6: filtered list, one page."""
    c = table(spark, sf_dir, "customer")
    hit = c.filter(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")).contains("building") & (F.col("c_acctbal") >= 1000))
    return hit.orderBy("c_custkey").offset(10).limit(25).select(F.col("c_custkey").alias("id"), F.concat(F.lit("vessel:"), "c_name").alias("label"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where cast(json_extract_string(props, '$.k') as bigint) > 90""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON decoding."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return e.filter("k > 90")


@query("""with n as (select c_custkey, trim(regexp_replace(upper(case c_custkey % 4 when 0 then 'mv ' when 1 then 'ex m/v ' when 2 then 'the-vessel: ' else 'tug ' end || c_name || '-' || c_mktsegment), '[^A-Z0-9]+', ' ', 'g')) as x from customer) select c_custkey, regexp_replace(x, '^((VESSEL|MOPU|MSV|THE|AKA|M V|M T|M S|S S|F V|MV|MT|MS|SS|FV|EX) )+', '') as name from n""")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without signs and prefixes."""
    before = F.when(F.col("c_custkey") % 4 == 0, "mv ").when(F.col("c_custkey") % 4 == 1, "ex m/v ").when(F.col("c_custkey") % 4 == 2, "the-vessel: ").otherwise("tug ")
    return table(spark, sf_dir, "customer").select("c_custkey", ident.normalise_name(F.concat(before, "c_name", F.lit("-"), "c_mktsegment")).alias("name"))


_DIGIT = "substr(d, {}, 1)::int"


@query("""with d as (select c_custkey, lpad(((c_custkey * 7919 + 1234567) % 10000000)::varchar, 7, '0') as d from customer)
    select c_custkey, (substr(d, 1, 1)::int * 7 + substr(d, 2, 1)::int * 6 + substr(d, 3, 1)::int * 5 + substr(d, 4, 1)::int * 4 + substr(d, 5, 1)::int * 3 + substr(d, 6, 1)::int * 2) % 10 = substr(d, 7, 1)::int as ok from d""")
def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits."""
    d = F.lpad(((F.col("c_custkey") * 7919 + 1234567) % 10000000).cast("string"), 7, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", d.alias("d")).select("c_custkey", ident.imo_valid("d").alias("ok"))


@query("""select 'alr_' || substr(sha1('x|' || event_type || '|' || user_id), 1, 12) as id, count(*) as n from events group by 1""")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids."""
    return table(spark, sf_dir, "events").groupBy(ident.short_id("alr", F.lit("x"), "event_type", "user_id").alias("id")).agg(F.count("*").alias("n"))


@query("""with h as (select date_trunc('hour', ts) as hour, event_type as kind, value from events) select hour, kind, count(*) as n, round(sum(value), 4) as total from h group by all""")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows: counts by hour and kind."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("hour", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with m as (select l_orderkey, date_trunc('month', l_shipdate) as month, l_quantity from lineitem), t as (select month, count(*) as n, round(sum(l_quantity), 2) as qty from m group by month)
    select month, n, qty, sum(n) over (order by month rows unbounded preceding)::bigint as upto from t""")
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by month with a running sum over the few months."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return m.withColumn("upto", F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


@query("""with m as (select user_id as subject, event_id, epoch_us(ts) as t from events where event_type = 'signup'), a as (select user_id as subject, epoch_us(ts) as t from events where event_type = 'error')
    select m.subject, a.t, round(0.6 + 0.4 * (1 - min((a.t - m.t) / 86400e6) / 14), 6) as score from m join a on m.subject = a.subject and a.t - m.t >= 0 and (a.t - m.t) / 86400e6 <= 14 group by m.subject, a.t""")
def identity_then_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies within two weeks of a change of identity."""
    p = positions(spark, sf_dir)
    pick = lambda k: p.filter(F.col("kind") == k).select(F.col("key").alias("subject"), (F.col("us") / 1e6).alias("t"))
    out = detectors.identity_then_anomaly(pick("signup"), pick("error"))
    return out.select("subject", F.round(F.col("t") * 1e6).cast("long").alias("t"), r6("score").alias("score"))


@query("""with c as (select user_id as key, case when event_id % 11 = 0 then 'gulf' when event_id % 13 = 0 then 'bay' when event_id % 3 = 0 then 'south' end as port from events), r as (select key, port, case port when 'gulf' then 0.7 when 'bay' then 0.4 end as r from c)
    select key::varchar as subject, round(least(1.0, max(r) + 0.05 * (count(distinct port) - 1))::double, 6) as score from r where r is not null group by key""")
def port_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest port called at."""
    i = F.col("event_id")
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(i % 11 == 0, "gulf").when(i % 13 == 0, "bay").when(i % 3 == 0, "south").alias("port"))
    calls = c.filter("port is not null").groupBy("key").agg(F.collect_set("port").alias("calls"))
    return detectors.port_risk(calls, {"gulf": 0.7, "bay": 0.4}).select("subject", r6("score").alias("score"))
