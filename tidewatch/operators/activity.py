"""What a track is doing: features of its fixes, and ordered rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo
from tidewatch.operators import detectors, sequences

#: Share of the base confidence by activity (fixed values).
SURENESS = {"anchored": 0.95, "survey_pattern": 0.8, "fishing": 0.75, "transiting": 0.9, "drifting": 0.7, "loitering": 0.8, "manoeuvring_erratically": 0.6}
ALTERATION_DEG, RECIPROCAL_DEG, LEG_S = 45.0, 35.0, 720.0


def windows(points: DataFrame, key: str = "key", step_s: float = 21_600.0) -> DataFrame:
    """Adds `part`: a new one begins at the first fix that is step_s or more after the part's first.

    A silence of step_s begins a part in any case, so the fold over times is one of a key's fixes without such a silence.
    """
    w = Window.partitionBy(key).orderBy("t", "point_id")
    runs = sequences.islands(points, key, ["t", "point_id"], F.col("t") - F.lag("t").over(w) >= step_s)
    times = runs.groupBy(key, "island").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    fold = F.aggregate(
        "ts", F.array().cast("array<double>"),
        lambda s, t: F.when((F.size(s) == 0) | (t - F.element_at(s, -1) >= step_s), F.concat(s, F.array(t))).otherwise(s),
    )
    begins = times.select(key, "island", fold.alias("begins"))
    return runs.join(begins, [key, "island"]).withColumn("part", F.element_at(F.filter("begins", lambda b: b <= F.col("t")), -1)).drop("begins", "island")


def features(points: DataFrame, keys: list[str], waiting) -> DataFrame:
    """Kinematics of each group of fixes: span, speeds, turning, legs, straightness, spread. waiting: (lat, lon) -> boolean column."""
    w, whole = Window.partitionBy(*keys).orderBy("t", "point_id"), Window.partitionBy(*keys)
    ahead = lambda c: F.lead(c).over(w)
    rows = points.select(
        *keys, "t", "point_id", "sog", "lat", "lon", geo.turn("cog", ahead("cog")).alias("turn"), (F.greatest((ahead("t") - F.col("t")) / 60, F.lit(1e-6))).alias("dt_min"),
        geo.haversine("lat", "lon", ahead("lat"), ahead("lon")).alias("leg"), F.avg("lat").over(whole).alias("clat"), F.avg("lon").over(whole).alias("clon"),
        F.coalesce(geo.turn(F.lag("cog").over(w), F.col("cog")) > ALTERATION_DEG, F.lit(True)).alias("_new"),
    )
    rows = rows.withColumn("_leg", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    legs = rows.groupBy(*keys, "_leg").agg((F.max("t") - F.min("t")).alias("s")).groupBy(*keys).agg(F.count_if(F.col("s") >= LEG_S).alias("legs"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.avg("sog").alias("sog_mean"), F.percentile("sog", F.array(F.lit(0.5), F.lit(0.9))).alias("q"),
        F.coalesce(F.avg(F.col("turn") / F.col("dt_min")), F.lit(0.0)).alias("rate"), F.count_if(F.col("turn") > ALTERATION_DEG).alias("alterations"), F.count_if(F.abs(F.col("turn") - 180) <= RECIPROCAL_DEG).alias("reciprocals"),
        F.max(geo.haversine("clat", "clon", "lat", "lon")).alias("spread"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("travelled"), F.first("clat").alias("lat"), F.first("clon").alias("lon"),
        F.min(F.struct("t", "point_id", "lat", "lon")).alias("a"), F.max(F.struct("t", "point_id", "lat", "lon")).alias("b"),
    )
    net = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return out.join(legs, keys).select(
        *keys, "n", "t_start", "t_end", F.round((F.col("t_end") - F.col("t_start")) / 60, 1).alias("span_min"), F.round("sog_mean", 2).alias("sog_mean"), F.round(F.col("q")[0], 2).alias("sog_median"), F.round(F.col("q")[1], 2).alias("sog_p90"),
        F.round("rate", 2).alias("turn_rate"), "alterations", "reciprocals", F.when(F.col("alterations") > 0, F.round(F.col("reciprocals") / F.col("alterations"), 3)).otherwise(0.0).alias("reciprocal_fraction"),
        F.round(F.when(F.col("travelled") > 1, net / F.col("travelled")).otherwise(0.0), 3).alias("straightness"), F.round("spread", 1).alias("spread_m"), F.when(F.col("n") < 3, 0).otherwise(F.col("legs")).alias("legs"),
        "lat", "lon", waiting(F.col("lat"), F.col("lon")).alias("waiting"),
    )


def classified(feats: DataFrame) -> DataFrame:
    """Adds activity and confidence: surer the more of twelve hours were seen."""
    label = detectors.activity("n", "span_min", "sog_median", "turn_rate", "straightness", "spread_m", "waiting", "legs", "reciprocals", "reciprocal_fraction")
    share = F.element_at(F.create_map(*[F.lit(x) for kv in SURENESS.items() for x in kv]), F.col("activity"))
    seen = 0.5 + 0.5 * F.least(F.lit(1.0), F.col("span_min") / 720)
    return feats.withColumn("activity", label).withColumn("confidence", F.coalesce(F.round(F.least(F.lit(0.99), seen * share), 3), F.lit(0.0)))


def episodes(parts: DataFrame, key: str = "key") -> DataFrame:
    """Neighbouring parts of one activity as one: key, activity, t_start, t_end, confidence (of the surer), n_parts."""
    w = Window.partitionBy(key).orderBy("part")
    runs = sequences.islands(parts, key, ["part"], ~F.lag("activity").over(w).eqNullSafe(F.col("activity")))
    return runs.groupBy(key, "island").agg(F.first("activity").alias("activity"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("confidence").alias("confidence"), F.count("*").alias("n_parts")).drop("island")


def dominant(found: DataFrame, key: str = "key") -> DataFrame:
    """The named activity of most time, weighed by its confidence; the first of equals."""
    weight = (F.col("t_end") - F.col("t_start")) / 3600 * F.greatest("confidence", F.lit(0.01))
    best = found.filter("activity <> 'unclassified'").groupBy(key).agg(F.max(F.struct(F.round(weight, 6).alias("weight"), (-F.col("t_start")).alias("k"), "activity")).alias("b"))
    return best.select(key, F.col("b.activity").alias("activity"), F.col("b.weight").alias("weight"))


def notable(found: DataFrame, base: dict[str, float]) -> DataFrame:
    """Alerts of notable activities: their base score times the confidence."""
    score = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("activity"))
    return found.withColumn("score", score * F.col("confidence")).filter("score is not null")


def in_radius(places: list[tuple], radius_m: float):
    """(lat, lon) -> whether any of a short list of (name, lat, lon) is within a radius."""

    def near(lat: Column, lon: Column) -> Column:
        tests = [geo.haversine(lat, lon, float(a), float(o)) <= radius_m for _, a, o in places]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return near
