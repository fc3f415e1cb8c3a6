"""Silences against coverage: who was heard where, integrated along the silent path, and what the silence then says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo, grid, ident
from tidewatch.operators import detectors, proximity

#: Passes that are broadcast (two numbers each); a longer schedule is joined by a shuffle.
BROADCAST_PASSES = 100_000
#: Area in which a compromised identity spoils a contact, metres (fixed value).
SPOOF_RADIUS_M = 25_000.0
#: Hours of the slots in which a key's receipts are counted; fewer than 32.
SLOT_H = 24


def heard(points: DataFrame, key: str = "key", receiver: str = "receiver", res: int = 4) -> DataFrame:
    """Distinct (cell, hour, rx, key): who was heard where; every kind of receiver of a pipe-joined list counts."""
    kinds = F.transform(F.filter(F.split(receiver, r"\|"), lambda x: x != ""), lambda x: F.when(x.startswith("sat"), "sat").otherwise("ter"))
    return points.select(grid.cell("lat", "lon", res).alias("cell"), F.floor(F.col("t") / 3600).alias("hour"), F.explode(F.array_distinct(kinds)).alias("rx"), F.col(key).alias("key")).distinct()


def around(wanted: DataFrame, rows: DataFrame, res: int = 4) -> DataFrame:
    """wanted (distinct cell, hour) with p_ter, p_sat, sat_area: chances of being heard over the cells around.

    p_ter: share of all keys heard within an hour that a land station heard; p_sat: keys that a satellite
    heard; both saturate with their number. sat_area: satellite receipts of three hours each way.

    A key's receipts of a day are brought together first, so each of its places counts once where it lies; what is then shuffled are counts by
    place and hour, not every receipt once for all 63 places and hours around it.
    """
    kind = F.when(F.col("rx") == "ter", 1).when(F.col("rx") == "sat", 2)
    days = F.array_distinct(F.array(F.floor((F.col("hour") - 1) / SLOT_H), F.floor((F.col("hour") + 1) / SLOT_H)))
    known = rows.filter(kind.isNotNull())
    dealt = known.select("key", "cell", "hour", kind.alias("kind"), F.explode(days).alias("_b")).repartition("key", "_b")
    dealt = dealt.select("key", "_b", "kind", grid.row_of("cell").alias("_y"), grid.col_of("cell").alias("_x"), (F.col("hour") - F.col("_b") * SLOT_H).alias("_h"))
    wide = F.lit(round(360 / grid.LEVELS[res]))
    # A place around a receipt as one number: row, column, hour of the slot and kind (0: any); plain arithmetic, which Spark compiles.
    place = lambda y, x, h, k: F.when(F.col("_h").between(-h, SLOT_H - 1 - h), (((F.col("_y") + y) * 131_072 + F.pmod(F.col("_x") + x, wide)) * 32 + F.col("_h") + h) * 4 + k)
    places = F.array(*(place(y, x, h, k) for y in (-1, 0, 1) for x in (-1, 0, 1) for h in (-1, 0, 1) for k in (F.lit(0), F.col("kind"))))
    near = dealt.select("key", "_b", places.alias("_r")).groupBy("key", "_b").agg(F.collect_list("_r").alias("_r"))
    each = near.select("_b", F.explode(F.array_distinct(F.flatten("_r"))).alias("_x")).filter("_x is not null")
    of = lambda k: F.count_if(F.col("_x") % 4 == k)
    counted = each.groupBy("_b", F.floor(F.col("_x") / 4).alias("_p")).agg(of(1).alias("ter"), of(2).alias("sat"), of(0).alias("any"))
    spot = F.floor(F.col("_p") / 32)
    keys = counted.select(
        grid.pack(res, F.floor(spot / 131_072), spot % 131_072).alias("cell"), (F.col("_b") * SLOT_H + F.col("_p") % 32).alias("hour"), "ter", "sat", "any", F.lit(0).cast("long").alias("area")
    )
    receipts = known.filter("rx = 'sat'").groupBy("cell", "hour").agg(F.count("*").alias("area"))
    zero = F.lit(0).cast("long")
    area = receipts.select(F.explode(grid.disk("cell", 1, res)).alias("cell"), "hour", "area").select("cell", F.explode(F.sequence(F.col("hour") - 3, F.col("hour") + 3)).alias("hour"), zero.alias("ter"), zero.alias("sat"), zero.alias("any"), "area")
    n = keys.unionByName(area).groupBy("cell", "hour").agg(*(F.sum(c).alias(c) for c in ("ter", "sat", "any", "area")))
    full = lambda c: 1 - F.exp(-F.col(c).cast("double"))
    shares = n.select("cell", "hour", F.when(F.col("any") > 0, F.col("ter") / F.col("any") * full("any")).otherwise(0.0).alias("p_ter"), full("sat").alias("p_sat"), full("area").alias("sat_area"))
    return wanted.join(shares, ["cell", "hour"], "left").fillna(0.0, ["p_ter", "p_sat", "sat_area"])


def _few(passes: DataFrame) -> DataFrame:
    return F.broadcast(passes) if passes.count() <= BROADCAST_PASSES else passes


def passes_over(intervals: DataFrame, passes: DataFrame, row: str, slot_s: float = 3600.0) -> DataFrame:
    """By row id: n_passes (whole ones inside t_start to t_end), covered_s, and inside (t_start lies in one).

    Passes belong to no key, so slots of time are all that deals the rows out: short ones for instants, longer ones for long intervals.
    """
    found = proximity.overlaps(intervals.select(row, "t_start", "t_end", F.lit(1).alias("_k")), _few(passes).select(F.lit(1).alias("_k"), "r_start", "r_end"), "_k", slot_s)
    whole = (F.col("r_start") >= F.col("t_start")) & (F.col("r_end") <= F.col("t_end"))
    common = F.least("t_end", "r_end") - F.greatest("t_start", "r_start")
    return found.groupBy(row).agg(F.count_if(whole).alias("n_passes"), F.sum(common).alias("covered_s"), F.bool_or(F.col("t_start").between(F.col("r_start"), F.col("r_end"))).alias("inside"))


def _passes_by_slot(passes: DataFrame, slot_s: float = 900.0) -> DataFrame:
    """One row a slot of time with its passes, so that an instant meets one row at most."""
    slots = passes.select("r_start", "r_end", F.explode(F.sequence(F.floor(F.col("r_start") / slot_s), F.floor(F.col("r_end") / slot_s))).alias("_slot"))
    return slots.groupBy("_slot").agg(F.collect_list(F.struct("r_start", "r_end")).alias("_passes"))


def nominal_period(passes: DataFrame) -> DataFrame:
    """One row, period_s: the (upper) median spacing of pass starts, 0 without two. The schedule is the bound of this sort."""
    w = Window.orderBy("r_start")
    gaps = passes.select((F.col("r_start") - F.lag("r_start").over(w)).alias("d")).filter("d is not null").agg(F.array_sort(F.collect_list("d")).alias("d"))
    return gaps.select(F.when(F.size("d") > 0, F.element_at("d", F.floor(F.size("d") / 2).cast("int") + 1)).otherwise(0.0).alias("period_s"))


def endpoint_evidence(before: str, after: str) -> Column:
    """The key was itself heard by satellite at the silence's ends."""
    n = sum(F.coalesce(F.col(c).contains("sat"), F.lit(False)).cast("int") for c in (before, after))
    return F.when(n == 2, 0.85).when(n == 1, 0.6).otherwise(0.0)


def classify_gaps(gaps: DataFrame, rows: DataFrame, passes: DataFrame, spoofs: DataFrame, key: str = "key", res: int = 4) -> DataFrame:
    """Type and confidence of each silence, from coverage sampled along the straight path between its ends.

    gaps: key, point_id, t, lat, lon, receiver, and the same of the other end with `_end`, dt; rows: of `heard`;
    passes: r_start, r_end; spoofs: key, r_start, r_end. Inside a spoofing episode silence is never held intentional.
    """
    gaps = gaps.withColumn("_gap", F.concat_ws("/", F.col(key).cast("string"), F.col("point_id").cast("string")))  # the whole key: short ids may meet
    n = F.greatest(F.lit(4), F.least(F.lit(24), F.floor(F.col("dt") / 900).cast("int")))
    f = F.col("i") / (F.col("n") - 1)
    lerp = lambda c: F.col(c) + f * (F.col(f"{c}_end") - F.col(c))
    samples = gaps.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    samples = samples.select("_gap", "i", lerp("t").alias("t_start"), grid.cell(lerp("lat"), lerp("lon"), res).alias("cell"), F.floor(lerp("t") / 3600).alias("hour"))
    cover = around(samples.select("cell", "hour").distinct(), rows, res)
    by_slot = _passes_by_slot(passes)
    seen = samples.withColumn("_slot", F.floor(F.col("t_start") / 900.0)).join(cover, ["cell", "hour"]).join(_few(by_slot), "_slot", "left")
    now = F.when(F.exists("_passes", lambda p: F.col("t_start").between(p["r_start"], p["r_end"])), F.col("p_sat")).otherwise(0.0)
    seen = seen.groupBy("_gap").agg(F.avg("p_ter").alias("mean_ter"), F.avg(1 - (1 - F.col("p_ter")) * (1 - now)).alias("mean_any"), F.avg("sat_area").alias("path_sat"))
    spans = gaps.select("_gap", key, F.col("t").alias("t_start"), F.col("t_end").alias("t_end"))
    missed = passes_over(spans, passes, "_gap").select("_gap", "n_passes", "covered_s")
    spoiled = proximity.overlaps(spans, spoofs, key).filter("r_start < t_end and r_end > t_start").select("_gap").distinct().withColumn("spoof_near", F.lit(True))
    out = gaps.join(seen, "_gap").join(missed, "_gap", "left").join(spoiled, "_gap", "left").join(F.broadcast(nominal_period(passes)))
    out = out.fillna(0, ["n_passes"]).fillna(0.0, ["covered_s"]).fillna(False, ["spoof_near"])
    out = out.withColumn("sat_cov", F.greatest("path_sat", endpoint_evidence("receiver", "receiver_end"))).withColumn("covered_fraction", F.col("covered_s") / F.col("dt"))
    return detectors.gap_type(out.drop("_gap").withColumn("gap_id", ident.short_id("gap", key, F.bround("t", 0).cast("long"))))


def hearable(contacts: DataFrame, rows: DataFrame, passes: DataFrame, res: int = 4, contact: str = "contact_id") -> DataFrame:
    """contacts (lat, lon, t) with `hearable`: the chance that a transmitter there would have been heard of late.

    By land as in `around`; by satellite if a whole pass lay in the two hours before, then by receipts anywhere within three hours.
    """
    placed = contacts.withColumn("cell", grid.cell("lat", "lon", res)).withColumn("hour", F.floor(F.col("t") / 3600))
    cover = around(placed.select("cell", "hour").distinct(), rows, res).select("cell", "hour", "p_ter")
    by_hour = rows.filter("rx = 'sat'").groupBy("hour").agg(F.count("*").alias("k"))
    feed = placed.select("hour").distinct().select("hour", F.explode(F.sequence(F.col("hour") - 3, F.col("hour") + 3)).alias("_h")).join(by_hour.select(F.col("hour").alias("_h"), "k"), "_h")
    feed = feed.groupBy("hour").agg((1 - F.exp(-0.05 * F.sum("k"))).alias("health"))
    recent = passes_over(contacts.select(contact, (F.col("t") - 7200).alias("t_start"), F.col("t").alias("t_end")), passes, contact).select(contact, (F.col("n_passes") >= 1).alias("recent"))
    out = placed.join(cover, ["cell", "hour"], "left").join(feed, "hour", "left").join(recent, contact, "left")
    return out.withColumn("hearable", F.greatest(F.coalesce("p_ter", F.lit(0.0)), F.when(F.coalesce("recent", F.lit(False)), F.coalesce("health", F.lit(0.0))).otherwise(0.0))).drop("cell", "hour", "p_ter", "health", "recent")


def near_any(contacts: DataFrame, places: DataFrame, radius_m: float, contact: str = "contact_id") -> DataFrame:
    """Distinct ids of contacts with one of places (lat, lon) within a radius; with a column t_hour in both, within the hour."""
    on = ("t_hour",) if "t_hour" in places.columns else ()
    return proximity.near(contacts.select(contact, "lat", "lon", *on), places.select("lat", "lon", *on), radius_m, on).select(contact).distinct()


#: Beyond it a track says nothing about how alone a contact is, metres.
NEAR_TRACK_M = 40_000.0


def nearest_track(contacts: DataFrame, tracks: DataFrame, contact: str = "contact_id") -> DataFrame:
    """By contact: nearest_m to a track's position (key, lat, lon, t_hour) within the contact's hour and NEAR_TRACK_M.

    Tracks in the contact's list `spent` (keys that the assignment used elsewhere) do not count. Isolation is full from 2,500 m on.
    """
    met = proximity.near(contacts.select(contact, "lat", "lon", "t_hour", "spent"), tracks.select("key", "lat", "lon", "t_hour"), NEAR_TRACK_M, ("t_hour",))
    free = met.filter(~F.coalesce(F.array_contains("spent", F.col("key")), F.lit(False)))
    return free.groupBy(contact).agg(F.min("distance_m").alias("nearest_m"))


def judge_contacts(contacts: DataFrame, statics: DataFrame, spoofed: DataFrame, tracks: DataFrame, rows: DataFrame, passes: DataFrame, static_m: float = 500.0, min_looks: int = 1) -> DataFrame:
    """The ordered cascade over unmatched contacts, with its inputs found by joins.

    contacts: contact_id, lat, lon, t, t_hour, length_m, score, n_looks, spent (array of keys); statics: lat, lon;
    spoofed, tracks: positions on the hour grid (key, lat, lon, t_hour), spoofed ones of keys inside an episode.
    """
    flag = lambda ids, n: ids.withColumn(n, F.lit(True))
    out = hearable(contacts, rows, passes)
    out = out.join(flag(near_any(contacts, statics, static_m), "static_near"), "contact_id", "left").join(flag(near_any(contacts, spoofed, SPOOF_RADIUS_M), "spoof_near"), "contact_id", "left")
    out = out.join(nearest_track(contacts, tracks), "contact_id", "left").fillna(False, ["static_near", "spoof_near"])
    out = out.withColumn("isolated", F.lit(True)).withColumn("min_looks", F.lit(min_looks)).withColumn("dark_score", geo.dark_score("score", "hearable", "length_m", "nearest_m"))
    return detectors.dark_verdict(out)
