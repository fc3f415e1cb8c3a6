"""Subjects of interest: factors of six sources, merged, scored and ranked, with the steps they call for; findings by weights.

A factor is a row (subject, kind, confidence, t): one claim of one source about one subject. Factors of a kind are merged
before they are scored, so a subject has at most one row a kind, and windows over a subject hold a handful of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import ident
from tidewatch.operators import aggregates, graph, proximity
from tidewatch.sources.staging import cut

#: Kinds of factors: family, weight, whether repeats restate one fact (else they are occurrences), and the steps called for (fixed values).
KINDS = {
    "dark_vessel": ("motion", 0.85, False, ("cue_eo_camera", "call_vhf", "check_imaging_opportunity", "dispatch_patrol", "monitor")),
    "transponder_shutdown": ("motion", 0.90, False, ("call_vhf", "cue_eo_camera", "compare_own_history", "dispatch_patrol", "escalate")),
    "dark_rendezvous": ("motion", 0.80, False, ("cue_eo_camera", "call_vhf", "compare_own_history", "check_arrival_notification", "monitor")),
    "loitering_sensitive": ("motion", 0.60, False, ("cue_eo_camera", "call_vhf", "query_zone_history", "monitor")),
    "lane_deviation": ("motion", 0.45, False, ("call_vhf", "compare_own_history", "monitor")),
    "anchored_outside_limits": ("motion", 0.50, False, ("call_vhf", "cue_eo_camera", "check_arrival_notification", "monitor")),
    "maiden_zone_visit": ("motion", 0.40, False, ("compare_own_history", "check_arrival_notification", "monitor")),
    "assessed_ais_disabling": ("motion", 0.70, False, ("check_imaging_opportunity", "compare_own_history", "monitor")),
    "notable_activity": ("motion", 0.50, False, ("cue_eo_camera", "call_vhf", "compare_own_history", "query_zone_history", "monitor")),
    "identity_contradiction": ("identity", 0.75, True, ("check_registry", "call_vhf", "compare_own_history", "escalate")),
    "ais_spoofing": ("identity", 0.85, False, ("call_vhf", "check_registry", "cue_eo_camera", "escalate")),
    "identity_then_anomaly": ("identity", 0.90, False, ("check_registry", "compare_own_history", "escalate")),
    "identity_change": ("identity", 0.35, True, ("check_registry", "compare_own_history")),
    "flag_opacity": ("identity", 0.30, True, ("check_registry",)),
    "sanctions_designation": ("network", 0.95, True, ("check_registry", "escalate", "monitor")),
    "sanctioned_ownership": ("network", 0.70, True, ("check_registry", "escalate")),
    "port_risk_propagation": ("network", 0.25, True, ("check_arrival_notification", "compare_own_history")),
}
#: Steps: base priority, and the range in km to the nearest station beyond which the step is not feasible, if any (fixed values).
STEPS = {
    "call_vhf": (90, 4.12 * (30.0**0.5 + 15.0**0.5)), "cue_eo_camera": (85, 20.0), "escalate": (80, None), "dispatch_patrol": (70, 50.0),
    "check_imaging_opportunity": (65, None), "check_registry": (60, None), "compare_own_history": (55, None), "check_arrival_notification": (50, None),
    "query_zone_history": (45, None), "monitor": (20, None),
}
#: Registers whose flag says little of the owner (fixed values).
OPAQUE_FLAGS = ("PA", "LR", "MH", "KM", "MT", "CY")
#: Signals of a finding and what each adds to its priority (fixed values).
SIGNALS = {"intentional_silence": 1000, "multi_registry": 400, "imo_match": 200, "name_disagreement": 100, "flag_disagreement": 50}
#: Largest strength of a single factor, how many repeats count, the score below which a subject is left off the list, and what an infeasible step loses (fixed values).
STRONGEST, REPEATS, LEAST_SCORE, INFEASIBLE = 0.99, 3, 0.25, 60


def _of(field: int, kind="kind") -> Column:
    """A field of the kind's entry as a column."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[field])]), F.col(kind))


def _factor(kind, confidence, t) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [F.col("subject").cast("string").alias("subject"), kind.alias("kind"), confidence.cast("double").alias("confidence"), t.cast("double").alias("t")]


def of_alerts(alerts: DataFrame) -> DataFrame:
    """Factors of alerts (subject, rule, score, t, disposition): dismissed ones go, a confirmed one moves 30 % of the way to certainty. Rules that are no kind are left out."""
    live = alerts.filter(F.col("rule").isin(*KINDS) & (F.coalesce("disposition", F.lit("")) != "dismiss"))
    score = F.coalesce("score", F.lit(0.0))
    sure = F.when(F.col("disposition") == "confirm", score + 0.3 * (1 - score)).otherwise(score)
    return live.select(*_factor(F.col("rule"), F.least(F.lit(1.0), sure), F.col("t")))


def of_designations(matches: DataFrame) -> DataFrame:
    """Factors of registry matches (subject, registry, tier, is_finding, listed, t), one a subject: a number outweighs names, and lists that agree add to it.

    listed: `vessel` (null is taken as one) or whatever else the list names; a subject none of whose listings is a vessel's is owned by a designated party.
    """
    by = matches.filter("is_finding and subject is not null").groupBy("subject").agg(
        F.count_distinct(F.coalesce("registry", F.lit("-"))).alias("n"), F.max(F.col("tier") == "imo").alias("imo"),
        F.max(F.coalesce("listed", F.lit("vessel")) == "vessel").alias("hull"), F.max("t").alias("t"),
    )
    one = F.when(F.col("imo"), 0.95).otherwise(0.7)
    sure = F.when(F.col("n") > 1, F.least(F.lit(0.99), one + 0.04 * (F.col("n") - 1))).otherwise(one)
    kind = F.when(F.col("hull"), "sanctions_designation").otherwise("sanctioned_ownership")
    return by.select(*_factor(kind, F.when(F.col("hull"), sure).otherwise(F.least(sure, F.lit(0.8))), F.col("t")))


def of_gaps(gaps: DataFrame) -> DataFrame:
    """Factors of silences that were assessed as intended (subject, t, assessed as a number or boolean), one a subject."""
    meant = gaps.filter(F.col("assessed").isNotNull() & (F.col("assessed").cast("int") == 1) & F.col("subject").isNotNull())
    return meant.groupBy("subject").agg(F.max("t").alias("t")).select(*_factor("assessed_ais_disabling", F.lit(0.8), F.col("t")))


def of_shutdowns(contacts: DataFrame) -> DataFrame:
    """Factors of radar tracks that went silent while held (track, status, dark_from, score): the subject is the contact, not a hull."""
    dark = contacts.filter((F.col("status") == "dark_candidate") & F.col("dark_from").isNotNull() & F.col("track").isNotNull())
    score = F.when(F.coalesce("score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("score"))
    return dark.withColumn("subject", F.concat(F.lit("contact:radar:"), F.col("track").cast("string"))).select(*_factor("transponder_shutdown", F.least(F.lit(0.95), score), F.col("dark_from")))


def of_ownership(subjects: DataFrame, ownership: DataFrame, sanctions: DataFrame, at: float, hops: int = 3) -> DataFrame:
    """Factors of subjects from which ownership (src, dst, confidence) leads to an entity sanctioned at `at` (entity, t_start, t_end); the shortest way counts."""
    held = sanctions.filter((F.col("t_start") <= at) & (F.col("t_end").isNull() | (F.col("t_end") > at))).select(F.col("entity").alias("end")).distinct()
    ways = graph.chains(ownership, subjects.select(F.col("subject").alias("id")), hops).join(held, "end", "left_semi")
    least = ways.groupBy(F.col("start").alias("subject")).agg(F.min("hops").alias("hops"))
    return least.select(*_factor("sanctioned_ownership", F.greatest(F.lit(0.2), 1.05 - 0.2 * F.col("hops")), F.lit(None)))


def of_flags(flags: DataFrame, opaque: tuple[str, ...] = OPAQUE_FLAGS) -> DataFrame:
    """Factors of flags (subject, flag, t_end): an open opaque one or any closed one makes a factor, each closed one strengthens it."""
    by = flags.groupBy("subject").agg(
        F.count_if(F.col("t_end").isNotNull()).alias("closed"), F.count_if(F.col("t_end").isNull() & F.col("flag").isin(*opaque)).alias("open"), F.max("t_end").alias("t")
    )
    return by.filter("closed + open > 0").select(*_factor("flag_opacity", F.least(F.lit(0.9), 0.5 + 0.15 * F.col("closed")), F.col("t")))


def of_changes(changes: DataFrame) -> DataFrame:
    """Factors of recorded changes of identity (subject, t), one a subject, stronger with each."""
    by = changes.groupBy("subject").agg(F.count("*").alias("n"), F.max("t").alias("t"))
    return by.select(*_factor("identity_change", F.least(F.lit(0.9), 0.4 + 0.2 * F.col("n")), F.col("t")))


def collected(alerts: DataFrame, matches: DataFrame, gaps: DataFrame, contacts: DataFrame, ownership: DataFrame, sanctions: DataFrame, flags: DataFrame, changes: DataFrame, at: float,
              opaque: tuple[str, ...] = OPAQUE_FLAGS) -> DataFrame:
    """All factors. Ownership, flags and changes of identity put nobody on the list: they count only for subjects that another source names.

    The first sources' factors are written down once, since four uses would find every alert and correlation again.
    """
    first = cut(reduce(DataFrame.unionByName, [of_alerts(alerts), of_designations(matches), of_gaps(gaps), of_shutdowns(contacts)]))
    named = first.select("subject").distinct()
    known = lambda d: d.withColumn("subject", F.col("subject").cast("string")).join(named, "subject", "left_semi")
    return reduce(DataFrame.unionByName, [first, of_ownership(named, ownership, sanctions, at), of_flags(known(flags), opaque), of_changes(known(changes))])


def merged(factors: DataFrame) -> DataFrame:
    """One row a subject and kind: confidence, n, t (the latest). A restated fact keeps its best confidence, occurrences add up as a noisy-or of the best few."""
    by = Window.partitionBy("subject", "kind").orderBy(F.desc("confidence"))
    # Only the best few of each partition are shuffled: the rank is a limit before the exchange, too.
    best = factors.select("subject", "kind", "confidence", F.row_number().over(by).alias("_i")).filter(F.col("_i") <= REPEATS)
    sure = best.groupBy("subject", "kind").agg(F.max("confidence").alias("_max"), (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))).alias("_or"), F.count("*").alias("_k"))
    n = factors.groupBy("subject", "kind").agg(F.count("*").alias("n"), F.max("t").alias("t"))
    confidence = F.when(_of(2) | (F.col("_k") == 1), F.col("_max")).otherwise(F.least(F.lit(0.99), "_or"))
    return n.join(sure, ["subject", "kind"]).select("subject", "kind", confidence.alias("confidence"), "n", "t")


def scored(factors: DataFrame) -> DataFrame:
    """Merged factors with family, strength, the subject's noisy-or score and the points of each, which add up to it."""
    strength = F.least(F.lit(STRONGEST), _of(1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    return aggregates.noisy_or(factors.withColumn("family", _of(0)).withColumn("strength", strength), "subject", "strength")


def ranked(subjects: DataFrame, score: str = "score", name: str = "subject") -> DataFrame:
    """subjects with `rank` from 1 by falling score, then name; rows without a score have none.

    Rows are ranked within blocks of scores (0 to 1), whose places come from counts, so no task sorts them all.
    """
    cut = subjects.withColumn("_b", F.floor(F.col(score) * 10_000))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # 10,001 blocks at most
    blocks = cut.filter("_b is not null").groupBy("_b").agg(F.count("*").alias("_k")).select("_b", F.coalesce(F.sum("_k").over(above), F.lit(0)).alias("_up"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(score), name))
    return cut.join(F.broadcast(blocks), "_b", "left").withColumn("rank", F.when(F.col("_b").isNotNull(), F.col("_up") + inside)).drop("_b", "_up")


def listed(scored_: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row a subject: score (to nine places, so that equal evidence scores equally), n_kinds, n_factors, families, lead (kind of most points), suppressed (why it is left off, else null) and rank."""
    s = scored_.groupBy("subject").agg(
        F.round(F.first("score"), 9).alias("score"), F.count("*").alias("n_kinds"), F.sum("n").alias("n_factors"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max(F.struct(F.round("points", 9), "kind"))["kind"].alias("lead"),
    )
    kept = F.col("score") >= least
    r = ranked(s.withColumn("_on", F.when(kept, F.col("score"))), "_on").drop("_on")
    return r.withColumn("suppressed", F.when(~kept, "below_attention_threshold"))


def steps(scored_: DataFrame, last: DataFrame, stations: DataFrame, most_m: float = 400_000.0) -> DataFrame:
    """The steps that each subject's factors call for: action, priority, n_because, lead, feasible, rank within the subject.

    last: a subject's last position (subject, lat, lon; none or null: nothing near it); stations: port, port_lat, port_lon. Infeasible steps stay, further down.
    """
    asked = F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*(F.lit(a) for a in v[3])))]), F.col("kind"))
    each = scored_.select("subject", "kind", "points", F.explode(asked).alias("action"))
    by = each.groupBy("subject", "action").agg(F.max("points").alias("points"), F.max(F.struct(F.round("points", 9), "kind"))["kind"].alias("lead"), F.count("*").alias("n_because"))
    at = proximity.nearest_place(last.filter("lat is not null and lon is not null").select("subject", "lat", "lon"), stations, most_m).select("subject", (F.col("distance_m") / 1000).alias("_km"))
    base = F.element_at(F.create_map(*[F.lit(x) for k, v in STEPS.items() for x in (k, v[0])]), F.col("action"))
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in STEPS.items() if v[1] for x in (k, v[1])]), F.col("action"))
    out = by.join(at, "subject", "left").withColumn("feasible", limit.isNull() | F.coalesce(F.col("_km") <= limit, F.lit(False)))
    out = out.withColumn("priority", F.floor(F.round(base + 40 * F.col("points"), 9)).cast("int") - F.when(F.col("feasible"), 0).otherwise(INFEASIBLE))
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("priority"), "action"))
    return out.select("subject", "action", "priority", "n_because", "lead", "feasible", place.cast("long").alias("rank"))


def findings(vessels: DataFrame, matches: DataFrame, gaps: DataFrame, events: DataFrame, looks: DataFrame) -> DataFrame:
    """Hulls with a signal of finding grade, by the sum of their signals' weights, with what stands behind it.

    vessels: subject, name, flag; matches: subject, registry, tier, is_finding, name, flag (as listed); gaps: subject, assessed; events: subject, kind;
    looks: subject, tier. A name alone is a lead and no finding. Columns: subject, priority, basis, n_gaps, n_looks, best_tier, n_events.
    """
    real = matches.filter("is_finding").select("subject", "registry", "tier", ident.normalise_name("name").alias("_name"), F.col("flag").alias("_flag"))
    m = real.join(vessels.select("subject", ident.normalise_name("name").alias("name"), "flag"), "subject", "left").groupBy("subject").agg(
        (F.count_distinct(F.coalesce("registry", F.lit("-"))) > 1).alias("multi_registry"), F.max(F.col("tier") == "imo").alias("imo_match"),
        F.max(F.coalesce(F.col("_name") != F.col("name"), F.lit(False))).alias("name_disagreement"), F.max(F.coalesce(F.col("_flag") != F.col("flag"), F.lit(False))).alias("flag_disagreement"),
    )
    meant = F.coalesce(F.col("assessed").cast("int") == 1, F.lit(False))
    g = gaps.groupBy("subject").agg(F.max(meant).alias("intentional_silence"), F.count_if(meant).alias("n_gaps"))
    e = events.groupBy("subject").agg(F.count("*").alias("n_events"))
    k = looks.groupBy("subject").agg(F.count("*").alias("n_looks"), F.min("tier").alias("best_tier"))
    all_ = m.join(g, "subject", "full").fillna(False, list(SIGNALS))
    weight = sum((F.when(F.col(s), w).otherwise(0) for s, w in SIGNALS.items()), F.lit(0)).alias("priority")
    basis = F.array_join(F.filter(F.array(*(F.when(F.col(s), s) for s in SIGNALS)), lambda x: x.isNotNull()), ",").alias("basis")
    kept = all_.select("subject", weight, basis, F.coalesce("n_gaps", F.lit(0)).alias("n_gaps")).filter("priority > 0")
    return kept.join(e, "subject", "left").join(k, "subject", "left").fillna(0, ["n_events", "n_looks"])
