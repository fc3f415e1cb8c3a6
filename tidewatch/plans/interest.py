"""Queries over subjects of interest: factors of six sources, the ranked list, next steps, findings. All sources are results of other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detectors, interest, sequences
from tidewatch.plans import conduct, motion, records, serving
from tidewatch.plans.registry import ORACLES, query
from tidewatch.sources.bindings import PORTS_SQL, POSITIONS_SQL, haversine_sql, ports, positions, table

r6 = lambda c: F.round(c, 6)
#: Time at which sanctions are judged, the silence that counts as assessed, the opaque flag of the bound table, entries that list an owner.
AT, ASSESSED_S, OPAQUE, OWNER_EACH = 850_000_000.0, 150_000.0, "P", 10


def _c(x) -> Column:
    return F.concat(F.lit("c"), F.col(x) if isinstance(x, str) else x)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of three detectors; by their second, a seventh is dismissed and a seventh confirmed."""
    found = reduce(DataFrame.unionByName, [d(spark, sf_dir).select("rule", "subject", "t", "score") for d in (conduct.rendezvous, conduct.loitering, conduct.maiden)])
    w = F.floor("t") % 7
    return found.withColumn("subject", _c("subject")).withColumn("disposition", F.when(w == 0, "dismiss").when(w == 1, "confirm"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels against two registries: suppliers of even and of odd keys."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    v = table(spark, sf_dir, "customer").select(k.alias("vessel_id"), F.when(k % 3 == 0, k % 400).alias("imo"), F.when(k % 2 == 0, F.concat(F.lit("S"), k % 90)).alias("call_sign"), F.concat(F.lit("N"), k % 70).alias("name"))
    g = table(spark, sf_dir, "supplier").select(s.alias("ent"), (s * 7).alias("imo"), F.concat(F.lit("S"), s).alias("call_sign"), F.concat(F.lit("N"), s % 60).alias("name"))
    each = [detectors.tiered_match(v, g.filter(F.col("ent") % 2 == i)).withColumn("registry", F.lit(r)) for i, r in enumerate("AB")]
    m = each[0].unionByName(each[1])
    return m.select(
        _c("vessel_id").alias("subject"), "registry", "tier", "is_finding", F.when(F.col("ent") % OWNER_EACH == 0, "owner").otherwise("vessel").alias("listed"), F.lit(None).cast("double").alias("t"),
        F.concat(F.lit("N"), F.col("ent") % 60).alias("name"), (F.col("ent") % 25).cast("string").alias("flag"),
    )


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sequences.gaps(positions(spark, sf_dir))
    return g.select(_c("key").alias("subject"), "t", (F.round("dt", 3) >= ASSESSED_S).alias("assessed"))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar tracks that were correlated and then held on in silence."""
    r = motion.radar_correlations(spark, sf_dir)
    status = F.when(F.col("status") == "correlated_then_dark", "dark_candidate").otherwise(F.col("status"))
    return r.select(F.col("radar_id").cast("string").alias("track"), status.alias("status"), "dark_from", F.col("support").alias("score"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals from changes of identity, open ones from the current identity."""
    t = F.unix_micros(F.col("d").cast("timestamp")) / 1e6
    closed = records.identity_changes(spark, sf_dir).select(_c("id").alias("subject"), F.col("before").alias("flag"), t.alias("t_end"))
    return closed.unionByName(records.current_identity(spark, sf_dir).select(_c("id").alias("subject"), F.col("v").alias("flag"), F.lit(None).cast("double").alias("t_end")))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.snapshot_changes(spark, sf_dir).filter("change = 'changed'").select(_c("id").alias("subject"), F.lit(None).cast("double").alias("t"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = interest.collected(
        _alerts(spark, sf_dir), _matches(spark, sf_dir), _gaps(spark, sf_dir), _contacts(spark, sf_dir), records._ownership(spark, sf_dir), serving._sanctions(spark),
        _flags(spark, sf_dir), _changes(spark, sf_dir), AT, (OPAQUE,),
    )
    return interest.scored(interest.merged(f))


def _registry(i: int, name: str) -> str:
    one = ORACLES["registry_matches"].replace("from supplier)", f"from supplier where s_suppkey % 2 = {i})")
    return f"select 'c' || vessel_id as subject, '{name}' as registry, ent, tier, is_finding from ({one})"


_KINDS = "kinds(kind, family, weight, restated) as (values " + ", ".join(f"('{k}', '{v[0]}', {v[1]}::double, {str(v[2]).lower()})" for k, v in interest.KINDS.items()) + ")"
_MATCHES = f"mt as ({_registry(0, 'A')} union all {_registry(1, 'B')})"
_GAPS = f"gp as (select 'c' || key as subject, dt >= {ASSESSED_S} as assessed from ({ORACLES['reporting_gaps']}))"
_RULES = " union all ".join(f"select rule, subject, t, score from ({s})" for s in (conduct.RENDEZVOUS_SQL, conduct.LOITERING_SQL, conduct.MAIDEN_SQL))
_SCORED = f"""with recursive {serving._OWNED}, {_KINDS}, {_MATCHES}, {_GAPS},
    al as (select 'c' || subject as subject, rule as kind, case when floor(t)::bigint % 7 = 1 then score + 0.3 * (1 - score) else score end as c from ({_RULES}) where floor(t)::bigint % 7 <> 0),
    ds as (select subject, count(distinct registry) as n, bool_or(tier = 'imo') as imo, bool_or(ent % {OWNER_EACH} <> 0) as hull from mt where is_finding group by subject),
    d2 as (select *, case when imo then 0.95 else 0.7 end::double as one from ds), d3 as (select *, case when n > 1 then least(0.99, one + 0.04 * (n - 1)) else one end as sure from d2),
    rc as (select * from ({ORACLES['radar_correlations']}) where status = 'correlated_then_dark' and dark_from is not null),
    fa as (select * from al union all select subject, case when hull then 'sanctions_designation' else 'sanctioned_ownership' end, case when hull then sure else least(sure, 0.8) end from d3
        union all select distinct subject, 'assessed_ais_disabling', 0.8::double from gp where assessed
        union all select 'contact:radar:' || radar_id, 'transponder_shutdown', least(0.95, case when coalesce(support, 0) = 0 then 0.5 else support end) from rc),
    nm as (select distinct subject from fa),
    ow as (select start as subject, greatest(0.2, 1.05::double - 0.2 * min(hops)) as c from walk join san on entity = "end" where s0 <= {AT} and (s1 is null or s1 > {AT}) group by start),
    fg as (select 'c' || id as subject, true as closed, before as v from ({ORACLES['identity_changes']}) union all select 'c' || id, false, v from ({ORACLES['current_identity']})),
    fo as (select subject, least(0.9, 0.5::double + 0.15 * count_if(closed)) as c from fg group by subject having count_if(closed) + count_if(not closed and v = '{OPAQUE}') > 0),
    ch as (select 'c' || id as subject, least(0.9, 0.4::double + 0.2 * count(*)) as c from ({ORACLES['snapshot_changes']}) where change = 'changed' group by id),
    fx as (select * from fa union all select subject, 'sanctioned_ownership', c from ow where subject in (select subject from nm)
        union all select subject, 'flag_opacity', c from fo where subject in (select subject from nm) union all select subject, 'identity_change', c from ch where subject in (select subject from nm)),
    rk as (select *, row_number() over (partition by subject, kind order by c desc) as i from fx),
    m0 as (select subject, kind, count(*) as n, max(c) as best, 1 - exp(sum(ln(1 - least(c, 0.999999))) filter (where i <= 3)) as anyof from rk group by subject, kind),
    m1 as (select m0.*, family, case when restated or n = 1 then best else least(0.99, anyof) end as confidence, weight from m0 join kinds using (kind)),
    m2 as (select *, least(0.99, weight * least(1.0, confidence)) as strength from m1),
    sc as (select *, 1 - exp(sum(ln(1 - strength)) over (partition by subject)) as score, (1 - exp(sum(ln(1 - strength)) over (partition by subject))) * ln(1 - strength) / sum(ln(1 - strength)) over (partition by subject) as points from m2)"""


@query(f"{_SCORED} select subject, kind, family, n, round(confidence, 6) as confidence, round(points, 6) as points from sc")
def interest_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of alerts, designations, silences, shutdowns, ownership, flags and changes, merged by kind, with their points."""
    return _scored(spark, sf_dir).select("subject", "kind", "family", "n", r6("confidence").alias("confidence"), r6("points").alias("points"))


@query(f"""{_SCORED}, li as (select subject, round(min(score), 9) as score, count(*) as n_kinds, sum(n)::bigint as n_factors, string_agg(distinct family, ',' order by family) as families, arg_max(kind, (round(points, 9), kind)) as lead from sc group by subject)
    select subject, round(score, 6) as score, n_kinds, n_factors, families, lead, case when score < 0.25 then 'below_attention_threshold' end as suppressed,
        case when score >= 0.25 then row_number() over (partition by score >= 0.25 order by score desc, subject) end as rank from li""")
def subjects_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked list, with those left off and why."""
    return interest.listed(_scored(spark, sf_dir)).withColumn("score", r6("score"))


_STEP_VALUES = ", ".join(f"('{k}', {v[0]}, {v[1] if v[1] else 'null'}::double)" for k, v in interest.STEPS.items())
_ASKED = ", ".join(f"('{k}', '{a}')" for k, v in interest.KINDS.items() for a in v[3])


@query(f"""{_SCORED}, stp(action, base, km) as (values {_STEP_VALUES}), ask(kind, action) as (values {_ASKED}), {POSITIONS_SQL}, {PORTS_SQL},
    lst as (select 'c' || key as subject, arg_max(lat, (t, point_id)) as lat, arg_max(lon, (t, point_id)) as lon from pos group by key),
    nst as (select subject, min({haversine_sql('lat', 'lon', 'port_lat', 'port_lon')}) / 1000 as d from lst, ports group by subject),
    by_ as (select subject, action, max(points) as points, arg_max(kind, (round(points, 9), kind)) as lead, count(*) as n_because from sc join ask using (kind) group by subject, action),
    fe as (select by_.*, base, km is null or coalesce(d <= km, false) as feasible from by_ join stp using (action) left join nst using (subject)),
    pi_ as (select *, (floor(round(base + 40 * points, 9)) - case when feasible then 0 else 60 end)::int as priority from fe)
    select subject, action, priority, n_because, lead, feasible, row_number() over (partition by subject order by priority desc, action) as rank from pi_""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that each subject's factors call for, by priority, and whether they are feasible from where it was last."""
    last = sequences.latest(positions(spark, sf_dir), ["key"], F.desc("t"), F.desc("point_id")).select(_c("key").alias("subject"), "lat", "lon")
    return interest.steps(_scored(spark, sf_dir), last, ports(spark))


@query(f"""with {_MATCHES}, {_GAPS}, {POSITIONS_SQL}, fm as (select mt.*, 'N' || ent % 60 as lname, (ent % 25)::varchar as lflag, 'N' || c_custkey % 70 as name, c_nationkey::varchar as flag from mt left join customer on subject = 'c' || c_custkey where is_finding),
    sg as (select subject, count(distinct registry) > 1 as a, bool_or(tier = 'imo') as b, coalesce(bool_or(lname <> name), false) as c, coalesce(bool_or(lflag <> flag), false) as d from fm group by subject),
    ga as (select subject, bool_or(assessed) as s, count_if(assessed)::bigint as n_gaps from gp group by subject), ev as (select 'c' || key as subject, count(*) as n_events, count_if(kind = 'view')::bigint as n_looks, min(point_id % 3) filter (where kind = 'view')::bigint as best_tier from pos group by key),
    jn as (select coalesce(sg.subject, ga.subject) as subject, coalesce(s, false) as s, coalesce(a, false) as a, coalesce(b, false) as b, coalesce(c, false) as c, coalesce(d, false) as d, coalesce(n_gaps, 0) as n_gaps from sg full join ga on sg.subject = ga.subject),
    pr as (select subject, 1000 * s::int + 400 * a::int + 200 * b::int + 100 * c::int + 50 * d::int as priority, n_gaps,
        concat_ws(',', case when s then 'intentional_silence' end, case when a then 'multi_registry' end, case when b then 'imo_match' end, case when c then 'name_disagreement' end, case when d then 'flag_disagreement' end) as basis from jn)
    select pr.subject, priority, basis, n_gaps, coalesce(n_looks, 0) as n_looks, best_tier, coalesce(n_events, 0) as n_events from pr left join ev on pr.subject = ev.subject where priority > 0""")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls with a signal of finding grade, by the weights of their signals, then by what was seen of them."""
    c = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("subject"), F.concat(F.lit("N"), F.col("c_custkey") % 70).alias("name"), F.col("c_nationkey").cast("string").alias("flag"))
    p = positions(spark, sf_dir).select(_c("key").alias("subject"), "kind", (F.col("point_id") % 3).alias("tier"))
    f = interest.findings(c, _matches(spark, sf_dir), _gaps(spark, sf_dir), p.select("subject", "kind"), p.filter("kind = 'view'").select("subject", "tier"))
    return f.orderBy(F.desc("priority"), F.desc("n_events"), "subject")
