"""Detectors: each gives alerts (rule, subject, t, score, confidence, evidence); thresholds and ids in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import ident
from tidewatch.operators import proximity
from tidewatch.operators.aggregates import when_chain

#: Least score of an alert by rule (fixed values).
THRESHOLDS = {
    "dark_vessel": 0.50, "ais_spoofing": 0.55, "dark_rendezvous": 0.50, "loitering_sensitive": 0.60, "identity_then_anomaly": 0.45, "port_risk_propagation": 0.50,
    "identity_contradiction": 0.40, "notable_activity": 0.30, "maiden_zone_visit": 0.60, "lane_deviation": 0.65, "anchored_outside_limits": 0.60,
    "sanctioned_owner_rendezvous": 0.30, "sanctioned_owner_dark_gap": 0.30,
}


def alerts(*found: DataFrame, apart: tuple = ()) -> DataFrame:
    """All detectors' rows (rule, subject, t, score, evidence) as alerts above their thresholds, one a rule, subject and second: the highest, then the earliest.

    apart: further columns that tell alerts of one second apart; they are part of the id.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    bar = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])
    kept = rows.filter(F.col("score") >= F.element_at(bar, F.col("rule")))
    named = kept.withColumn("_t", F.bround("t", 0).cast("long"))
    first = Window.partitionBy("rule", "subject", "_t", *apart).orderBy(F.desc("score"), "t")  # the whole key: short ids of different alerts may meet
    best = named.withColumn("_i", F.row_number().over(first)).filter("_i = 1")
    return best.withColumn("alert_id", ident.short_id("alr", "rule", "subject", "_t", *apart)).drop("_t", "_i")


def spoofing_score(kind, separation_km) -> Column:
    return F.when(F.col(kind) == "DUPLICATE_MMSI", F.least(F.lit(1.0), 0.55 + F.col(separation_km) / 2000)).otherwise(0.55)


def loitering_score(depth, hours) -> Column:
    return 0.5 + 0.3 * F.col(depth) + 0.1 * F.least(F.col(hours) / 6, F.lit(1.0))


def rendezvous_score(confidence, has_party, on_footprint) -> Column:
    return F.least(F.lit(1.0), 0.35 + 0.35 * F.col(confidence) + 0.25 * F.col(has_party).cast("int") + 0.10 * F.col(on_footprint).cast("int"))


def identity_then_anomaly(changes: DataFrame, anomalies: DataFrame, days: int = 14) -> DataFrame:
    """A hull that changed identity and acted oddly within `days` after. changes, anomalies: subject, t (epoch seconds)."""
    spans = changes.select("subject", F.col("t").alias("t_start"), (F.col("t") + days * 86_400).alias("t_end"))
    met = proximity.overlaps(spans, anomalies.select("subject", "t", F.col("t").alias("r_start"), F.col("t").alias("r_end")), "subject", bucket_s=7 * 86_400.0)
    near = met.withColumn("_c", F.col("t_start"))
    lag = (F.col("t") - F.col("_c")) / 86_400
    return near.filter((lag >= 0) & (lag <= days)).groupBy("subject", "t").agg(F.min(lag).alias("d")).select(
        F.lit("identity_then_anomaly").alias("rule"), "subject", "t", (0.6 + 0.4 * (1 - F.col("d") / days)).alias("score")
    )


def port_risk(calls: DataFrame, risks: dict[str, float], key: str = "key") -> DataFrame:
    """Subjects by the riskiest port called at, and how many risky ones. calls: key, calls array."""
    table = F.create_map(*[F.lit(x) for kv in risks.items() for x in kv])
    each = calls.select(key, F.explode("calls").alias("port")).withColumn("r", F.element_at(table, F.col("port"))).filter("r is not null")
    return each.groupBy(key).agg(F.max("r").alias("r"), F.count_distinct("port").alias("n")).select(
        F.lit("port_risk_propagation").alias("rule"), F.col(key).cast("string").alias("subject"), F.least(F.lit(1.0), F.col("r") + 0.05 * (F.col("n") - 1)).alias("score")
    )


def contradictions(checks: Column) -> Column:
    """Score of an array<double> of contradiction confidences: the largest, 0.05 more for each further; null for none."""
    return F.when(F.size(checks) > 0, F.least(F.lit(0.97), F.array_max(checks) + 0.05 * (F.size(checks) - 1)))


def activity(n: str, minutes: str, median_sog: str, turn_rate: str, straightness: str, spread_m: str, waiting: str, legs: str, reciprocals: str, reciprocal_fraction: str) -> Column:
    """Activity by ordered rules over rounded features, the most distinctive first; `unclassified` with too few fixes."""
    c = F.col
    per_hour = c(legs) / F.greatest(c(minutes) / 60, F.lit(1e-6))
    rules = [
        ((c(n) < 4) | (c(minutes) < 30), "unclassified"),
        ((c(median_sog) <= 2) & c(waiting) & (c(spread_m) <= 800), "anchored"),
        ((c(legs) >= 4) & (c(reciprocals) >= 3) & (c(reciprocal_fraction) >= 0.5) & (per_hour >= 0.1) & (c(straightness) < 0.35) & (c(median_sog) >= 1.5), "survey_pattern"),
        (c(median_sog).between(1.5, 5) & (c(turn_rate) >= 4) & (c(straightness) < 0.5), "fishing"),
        ((c(median_sog) >= 6) & (c(turn_rate) <= 1.5), "transiting"),
        ((c(median_sog) <= 1.5) & (c(spread_m) > 800), "drifting"),
        ((c(median_sog) <= 2) & ~c(waiting), "loitering"),
        ((c(turn_rate) >= 8) & (c(straightness) < 0.35), "manoeuvring_erratically"),
    ]
    return when_chain(rules, "unclassified")


def dark_verdict(rows: DataFrame) -> DataFrame:
    """The ordered cascade over contacts without a track: spoof_near, static_near, isolated, n_looks, min_looks, hearable, length_m, dark_score."""
    c = F.col
    rules = [
        (c("spoof_near"), "suppressed_spoof_ambiguity"), (c("static_near"), "suppressed_static"), (~c("isolated"), "suppressed_not_isolated"), (c("n_looks") < c("min_looks"), "suppressed_transient"),
        (c("hearable") < 0.5, "suppressed_coverage"), (c("length_m").isNull() | (c("length_m") < 20), "suppressed_size"), (c("dark_score") >= 0.5, "dark_candidate"),
    ]
    return rows.withColumn("status", when_chain(rules, "suppressed_score"))


def gap_type(rows: DataFrame) -> DataFrame:
    """Type and confidence of gaps from sampled coverage: mean_ter, sat_cov, mean_any, covered_fraction, n_passes, period_s, dt, spoof_near."""
    c = F.col
    covered = (c("sat_cov") >= 0.5) | (c("mean_ter") >= 0.6)
    silent = covered & (c("n_passes") >= 2) & ~c("spoof_near")
    starved = (c("n_passes") == 0) & (c("period_s") > 0) & (c("dt") > 2 * c("period_s"))
    kind = when_chain([(silent, "INTENTIONAL_SILENCE"), (starved, "COVERAGE_GAP"), (c("sat_cov") >= 0.5, "SAT_PASS_GAP")], "COVERAGE_GAP")
    sure = F.when(silent, F.greatest("mean_ter", "sat_cov") * (1 - F.exp(-0.6 * c("n_passes")))).when(starved, 1 - c("mean_any")).when(c("sat_cov") >= 0.5, 1 - c("covered_fraction")).otherwise(1 - c("mean_any"))
    return rows.withColumn("gap_type", kind).withColumn("confidence", F.least(F.lit(1.0), sure))


def tiered_match(vessels: DataFrame, designations: DataFrame) -> DataFrame:
    """The first tier that matches: imo, call sign with name, call sign, name. Names that several designations share are out.

    vessels: vessel_id, imo, call_sign, name; designations: ent, imo, call_sign, name (normalised).
    """
    first = lambda k: designations.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min_by(F.struct("ent", "name"), "ent").alias(f"_{k}"))
    names = designations.filter("name is not null").groupBy("name").agg(F.count_distinct("ent").alias("_k"), F.min("ent").alias("_name")).filter("_k = 1").drop("_k")
    j = vessels.join(first("imo"), "imo", "left").join(first("call_sign"), "call_sign", "left").join(names, "name", "left")
    sign = F.col("_call_sign")
    tier = F.when(F.col("_imo").isNotNull(), "imo").when(sign.isNotNull() & (sign["name"] == F.col("name")), "call_sign_name").when(sign.isNotNull(), "call_sign").when(F.col("_name").isNotNull(), "name")
    sure = F.create_map(*[F.lit(x) for x in ("imo", 0.95, "call_sign_name", 0.80, "call_sign", 0.40, "name", 0.35)])
    out = j.withColumn("tier", tier).filter("tier is not null").withColumn("confidence", F.element_at(sure, F.col("tier")))
    ent = F.when(F.col("tier") == "imo", F.col("_imo.ent")).when(F.col("tier") == "name", F.col("_name")).otherwise(F.col("_call_sign.ent"))
    return out.select("vessel_id", ent.alias("ent"), "tier", "confidence", (F.col("confidence") >= 0.5).alias("is_finding"))
