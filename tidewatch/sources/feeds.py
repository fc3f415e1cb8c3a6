"""Feeds of other services as canonical rows: events, identities, detections, radar plots, registries, areas.

Every function takes rows as they came (JSON or CSV text, or columns under any of the usual names) and gives columns; what can't be
used is left out or comes back as rejects, and nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo, grid, ident

#: Levels of confidence of the event feed (fixed values).
CONFIDENCE = {"2": 0.3, "3": 0.6, "4": 0.9}
_ANCHORAGE = "struct<id:string,name:string,topDestination:string,lat:double,lon:double>"
_VESSEL = "struct<id:string,vesselId:string,ssvid:string,mmsi:string,imo:string,name:string,shipname:string,flag:string>"
EVENT = (
    f"id string, eventId string, type string, start string, startDate string, `end` string, endDate string, position struct<lat:double,lon:double>, lat double, lon double, vessel {_VESSEL}, vessels array<{_VESSEL}>, confidence string, "
    f"encounter struct<vessel:{_VESSEL},type:string,confidence:string>, port_visit struct<visitId:string,confidence:string,durationHrs:string,startAnchorage:{_ANCHORAGE},intermediateAnchorage:{_ANCHORAGE},endAnchorage:{_ANCHORAGE}>, "
    "gap struct<distanceKm:string,impliedSpeedKnots:string,durationHrs:string,durationHours:string,intentionalDisabling:boolean,offPosition:struct<lat:double,lon:double>,onPosition:struct<lat:double,lon:double>>"
)


def instant(text) -> Column:
    """A time from ISO text; one without a zone is UTC; null if it is none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(F.regexp_replace(c, r"Z$", "+00:00"))


def visit_structure(pv: Column, hours: Column) -> dict[str, Column]:
    """What a port visit's span measures: a dwell only with a stop and one anchorage throughout; unknown stays null."""
    start, mid, end = (pv[c] for c in ("startAnchorage", "intermediateAnchorage", "endAnchorage"))
    ids = F.array_compact(F.array(start["id"], mid["id"], end["id"]))
    stop = F.when(pv.isNotNull(), mid.isNotNull())
    agree = F.when(F.size(ids) >= 2, F.size(F.array_distinct(ids)) == 1)
    usable = lambda a: a["id"].isNotNull() | a["name"].isNotNull()
    pick = lambda f: F.when(usable(mid), f(mid)).when(usable(start), f(start)).when(usable(end), f(end))
    source = F.when(usable(mid), "intermediate").when(usable(start), "start").when(usable(end), "end")
    name, top = pick(lambda a: a["name"]), pick(lambda a: a["topDestination"])
    return {
        "visit_has_stop": stop, "visit_anchorages_agree": agree, "visit_port_id": pick(lambda a: a["id"]), "visit_port_name": F.coalesce(name, top),
        "visit_port_name_source": F.when(name.isNotNull(), "anchorage_name").when(top.isNotNull(), "top_destination"), "visit_port_source": source, "dwell_hours": F.when(stop & agree, hours),
    }


def events(lines: DataFrame, kind: str, line: str = "line") -> DataFrame:
    """Events of one kind (`encounters`, `loitering`, `port_visits`, `gaps`) from JSON text; without an id or start, or outside the area, they are left out."""
    # A generator's column is not pushed into the filter, so each text is parsed once, not once for every field that is asked for.
    e = lines.select(F.explode(F.array(F.from_json(line, EVENT))).alias("e")).select("e.*")
    number = lambda c: c.try_cast("double")
    start, end = F.coalesce(instant("start"), instant("startDate")), F.coalesce(instant("end"), instant("endDate"))
    own = F.col("port_visit.durationHrs") if kind == "port_visits" else F.coalesce("gap.durationHrs", "gap.durationHours") if kind == "gaps" else F.lit(None).cast("string")
    hours = F.coalesce(number(own), (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9)
    v, o = F.coalesce(F.col("vessel"), F.get("vessels", F.lit(0))), F.coalesce(F.get("vessels", F.lit(1)), F.col("encounter.vessel"))
    raw = F.coalesce("confidence", "port_visit.confidence", "encounter.confidence")
    e = e.select(
        F.coalesce("id", "eventId").alias("event_id"), F.lit(kind).alias("event_kind"), start.alias("start_time"), end.alias("end_time"), hours.alias("duration_hours"), F.coalesce("position.lat", "lat").alias("lat"), F.coalesce("position.lon", "lon").alias("lon"),
        F.coalesce(v["id"], v["vesselId"]).alias("vessel_id"), F.coalesce(v["ssvid"], v["mmsi"]).alias("mmsi"), v["imo"].alias("imo"), F.coalesce(v["name"], v["shipname"]).alias("ship_name"), v["flag"].alias("flag"),
        F.coalesce(o["id"], o["vesselId"]).alias("counterpart_vessel_id"), F.coalesce(o["name"], o["shipname"]).alias("counterpart_name"), F.col("encounter.type").alias("encounter_type"),
        *(c.alias(n) for n, c in visit_structure(F.col("port_visit"), hours).items()), number(F.col("gap.distanceKm")).alias("gap_distance_km"), number(F.col("gap.impliedSpeedKnots")).alias("gap_implied_speed_kn"),
        F.col("gap.intentionalDisabling").alias("intentional_disabling"), *(F.col(f"gap.{k}Position.{c}").alias(f"gap_{k}_{c}") for k in ("off", "on") for c in ("lat", "lon")),
        raw.alias("confidence_raw"), F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), raw).alias("confidence"),
    )
    return e.filter(F.col("event_id").isNotNull() & F.col("start_time").isNotNull() & (F.col("lat").isNull() | geo.in_box("lat", "lon")))


IDENTITY = "struct<id:string,ssvid:string,imo:string,callsign:string,shipname:string,flag:string,transmissionDateFrom:string,transmissionDateTo:string>"
REGISTRY = f"registryInfo array<{IDENTITY}>, selfReportedInfo array<{IDENTITY}>, registryOwners array<struct<name:string,flag:string,dateFrom:string,dateTo:string>>, combinedSourcesInfo array<struct<vesselId:string>>"


def identities(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identity intervals, owners, the current identity with counts) of vessels from JSON text."""
    r = lines.select(F.from_json(line, REGISTRY).alias("r")).select("r.*")
    vessel = F.coalesce(F.get("combinedSourcesInfo", F.lit(0))["vesselId"], F.get("selfReportedInfo", F.lit(0))["id"], F.get("registryInfo", F.lit(0))["id"])
    r = r.withColumn("vessel_id", vessel).filter("vessel_id is not null")
    said = lambda c, kind: r.select("vessel_id", F.lit(kind).alias("kind"), F.posexplode(c).alias("idx", "i"))
    each = said("registryInfo", "registry").unionByName(said("selfReportedInfo", "self_reported"))
    intervals = each.select(
        "vessel_id", "kind", "idx", F.col("i.ssvid").alias("mmsi"), F.col("i.imo").alias("imo"), F.col("i.callsign").alias("call_sign"), F.col("i.shipname").alias("name"), F.col("i.flag").alias("flag"),
        instant(F.col("i.transmissionDateFrom")).alias("valid_from"), instant(F.col("i.transmissionDateTo")).alias("valid_to"),
    )
    owners = r.select("vessel_id", F.explode("registryOwners").alias("o")).select("vessel_id", F.col("o.name").alias("owner"), F.col("o.flag").alias("flag"), instant(F.col("o.dateFrom")).alias("valid_from"), instant(F.col("o.dateTo")).alias("valid_to"))
    order = F.struct(F.col("valid_to").isNull().alias("open"), "valid_from", "kind", "idx")
    current = intervals.groupBy("vessel_id").agg(
        F.max_by(F.struct("mmsi", "imo", "call_sign", "name", "flag"), order).alias("c"), F.count_distinct("name").alias("n_names"), F.count_distinct("flag").alias("n_flags"), F.count_distinct("mmsi").alias("n_mmsi")
    )
    return intervals, owners, current.select("vessel_id", "c.*", "n_names", "n_flags", "n_mmsi")


#: Names that files of detections use for a field, in order of preference (fixed values).
ALIASES = {
    "lat": ("lat", "latitude", "detect_lat"), "lon": ("lon", "longitude", "detect_lon"), "timestamp": ("timestamp", "detect_timestamp", "date", "detection_time", "acquired_at"), "length_m": ("length_m", "length", "vessel_length_m"),
    "detection_id": ("detect_id", "detection_id", "id"), "scene_id": ("scene_id", "sar_scene_id", "granule_id"), "matched": ("matched", "is_matched", "ais_matched", "matched_to_ais"), "mmsi": ("mmsi", "ssvid", "matched_mmsi"),
    "presence_score": ("presence_score",),
}


def picked(rows: DataFrame, field: str) -> Column:
    """The first non-empty value under any of a field's names, upper or lower case."""
    have = {c.lower(): c for c in rows.columns}
    found = [F.when(F.col(have[a]).cast("string") != "", F.col(have[a]).cast("string")) for a in ALIASES[field] if a in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def truth(text: Column) -> Column:
    """True, false or null (not said) from the usual words."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes", "y", "matched"), True).when(t.isin("false", "0", "no", "n", "unmatched"), False)


def detections(rows: DataFrame) -> DataFrame:
    """Radar detections of a file under any column names; those without place or time, or outside the area, are left out."""
    number = lambda f: picked(rows, f).try_cast("double")
    d = rows.select(number("lat").alias("lat"), number("lon").alias("lon"), instant(picked(rows, "timestamp")).alias("ts"), number("length_m").alias("length_m"), picked(rows, "detection_id").alias("_id"), F.coalesce(picked(rows, "scene_id"), F.lit("portal")).alias("scene_id"),
                    truth(picked(rows, "matched")).alias("matched_to_ais"), picked(rows, "mmsi").alias("matched_mmsi"), number("presence_score").alias("confidence"))
    name = F.coalesce("_id", F.concat_ws("-", F.lit("sar"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.format_string("%.5f", "lat"), F.format_string("%.5f", "lon")))
    return d.filter(F.col("ts").isNotNull() & geo.in_box("lat", "lon")).withColumn("detection_id", name).drop("_id").withColumn("is_aggregate", F.lit(False))


def radar_plots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plots, rejects with a reason) of coastal radars: uncertainty from the range and length from the echo where the feed gives none."""
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    p = rows.select(
        "station_id", F.col("radar_track_id").cast("string").alias("radar_track_id"), instant(F.col("ts").cast("string")).alias("ts"), *(number(c).alias(c) for c in ("lat", "lon", "sog_kn", "cog_deg", "range_km", "rcs_dbsm", "position_sigma_m", "length_est_m")),
    )
    p = p.withColumn("position_sigma_m", F.coalesce(F.when(F.col("position_sigma_m") != 0, F.col("position_sigma_m")), geo.radar_sigma("range_km"))).withColumn("length_est_m", F.coalesce(F.when(F.col("length_est_m") != 0, F.col("length_est_m")), geo.length_from_rcs("rcs_dbsm")))
    p = p.withColumn("report_id", ident.short_id("rdr", "station_id", "radar_track_id", F.unix_micros("ts")))
    reason = F.when(~F.coalesce(F.col("radar_track_id").contains(":"), F.lit(False)), "track id without a station").when(~F.coalesce(geo.in_box("lat", "lon", -90, 90, -180, 180), F.lit(False)), "position").when(F.col("ts").isNull(), "time").when(~F.col("cog_deg").between(0, 360), "course")
    p = p.withColumn("reject_reason", reason)
    return p.filter("reject_reason is null").drop("reject_reason"), p.filter("reject_reason is not null")


OFAC = "ent_num, name, sdn_type, program, title, call_sign, vessel_type, tonnage, gross_tonnage, vessel_flag, vessel_owner, remarks".split(", ")


def ofac(lines: DataFrame, line: str = "line") -> DataFrame:
    """Designations from lines of the sanctions list; `-0-` is null, lines of fewer than four fields are left out."""
    parsed = lines.select(F.from_csv(line, ", ".join(f"{c} string" for c in OFAC), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("r"), F.col(line).alias("_line")).select("r.*")
    clean = lambda c: F.when(~F.trim(c).isin("", "-0-"), F.trim(c))
    return parsed.filter("program is not null").select(*(clean(F.col(c)).alias(c) for c in OFAC))


def designations(rows: DataFrame, registry: str, name: str = "name", text: str = "remarks", ent: str = "ent_num", call_sign: str | None = None, is_vessel: Column | None = None) -> DataFrame:
    """Designations for matching: the number said in the text, the call sign, and the name only where the row names a vessel."""
    vessel = ident.looks_like_vessel(name, text) if is_vessel is None else is_vessel
    sign = ident.normalise_call_sign(call_sign) if call_sign else F.lit(None).cast("string")
    return rows.select(F.lit(registry).alias("registry"), F.col(ent).alias("ent"), ident.extract_imo(text).alias("imo"), sign.alias("call_sign"), F.when(vessel, ident.normalise_name(name)).alias("name"))


#: Elements and attributes of the two consolidated lists (fixed values).
UN_FIELDS = ("DATAID", "FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME", "UN_LIST_TYPE", "REFERENCE_NUMBER", "LISTED_ON", "COMMENTS1")
EU_SCHEMA = (
    "_logicalId string, _euReferenceNumber string, nameAlias array<struct<_wholeName:string,_firstName:string>>, regulation array<struct<_programme:string,_numberTitle:string>>, "
    "birthdate array<struct<_birthdate:string>>, identification array<struct<_number:string>>"
)


def _present(text) -> Column:
    """A text without its outer blanks; null for nothing."""
    bare = F.trim(text)
    return F.when(bare != "", bare)


def un_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the United Nations' list (XML): data_id, name, entity_kind (individual or entity), list_type, reference_number, listed_on, comments.

    Spark splits the file at its rows, so that one large file is read by many tasks.
    """
    rows = None
    for kind in ("INDIVIDUAL", "ENTITY"):
        found = spark.read.format("xml").option("rowTag", kind).option("ignoreNamespace", "true").schema(", ".join(f"{f} string" for f in UN_FIELDS)).load(path)
        found = found.withColumn("entity_kind", F.lit(kind.lower()))
        rows = found if rows is None else rows.unionByName(found)
    name = _present(F.concat_ws(" ", *(_present(F.col(f"{n}_NAME")) for n in ("FIRST", "SECOND", "THIRD", "FOURTH"))))
    plain = {"UN_LIST_TYPE": "list_type", "REFERENCE_NUMBER": "reference_number", "LISTED_ON": "listed_on", "COMMENTS1": "comments"}
    return rows.select(_present(F.col("DATAID")).alias("data_id"), name.alias("name"), "entity_kind", *(_present(F.col(c)).alias(n) for c, n in plain.items()))


def eu_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the European Union's list (XML, namespaces ignored): logical_id, name, programme, identifier.

    Of several aliases, regulations, dates or documents the first that says something counts; a date of birth comes before a document's number.
    """
    rows = spark.read.format("xml").option("rowTag", "sanctionEntity").option("ignoreNamespace", "true").schema(EU_SCHEMA).load(path)
    either = lambda a, b=None: (lambda x: _present(x[a]) if b is None else F.coalesce(_present(x[a]), _present(x[b])))
    first = lambda listed, pick: F.get(F.filter(F.transform(listed, pick), lambda x: x.isNotNull()), F.lit(0))
    return rows.select(
        F.coalesce(_present(F.col("_logicalId")), _present(F.col("_euReferenceNumber"))).alias("logical_id"), first("nameAlias", either("_wholeName", "_firstName")).alias("name"),
        first("regulation", either("_programme", "_numberTitle")).alias("programme"),
        F.coalesce(first("birthdate", either("_birthdate")), first("identification", either("_number"))).alias("identifier"),
    )


def all_designations(ofac_rows: DataFrame, un_rows: DataFrame, eu_rows: DataFrame) -> DataFrame:
    """The three lists as one table for matching; of the United Nations' only entities, since no person is a hull."""
    un = un_rows.filter("entity_kind = 'entity'")
    return (
        designations(ofac_rows, "ofac", call_sign="call_sign")
        .unionByName(designations(un, "un", text="comments", ent="data_id"))
        .unionByName(designations(eu_rows, "eu", text="identifier", ent="logical_id"))
    )


def any_imo(text) -> Column:
    """Distinct checksum-valid numbers of seven digits anywhere in a text."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{7})(?![0-9])"), F.lit(1)), ident.imo_valid)))


def positions_from_csv(rows: DataFrame) -> DataFrame:
    """Historical positions of a public archive's columns, sentinels nulled, inside the area."""
    n = lambda c: F.col(c).try_cast("double")
    p = rows.select(F.col("MMSI").try_cast("long").alias("mmsi"), instant(F.col("BaseDateTime")).alias("ts"), geo.nulled(n("LAT"), "lat").alias("lat"), geo.nulled(n("LON"), "lon").alias("lon"), geo.nulled(n("SOG"), "sog").alias("sog"), geo.nulled(n("COG"), "cog").alias("cog"), geo.nulled(n("Heading"), "heading").alias("heading"))
    return p.filter(F.col("mmsi").isNotNull() & F.col("ts").isNotNull() & geo.in_box("lat", "lon"))


GEOJSON = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
#: Words in an area's properties and the kind they stand for (fixed values).
ZONE_KINDS = {"eez": "eez", "territorial sea": "territorial_sea", "12nm": "territorial_sea", "anchorage": "anchorage", "port limit": "port_limit", "oil terminal": "oil_terminal", "shipping lane": "shipping_lane"}


def zones(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(zones with kind, rings and the first ring, rejects) from one feature of GeoJSON a line; coordinates must be degrees.

    rings holds all parts of a multipolygon and all holes, for `geo.rings_contain`.
    """
    f = lines.select(F.from_json(line, GEOJSON).alias("f")).select("f.*")
    parts = F.when(F.col("geometry.type") == "Polygon", F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    parts = parts.when(F.col("geometry.type") == "MultiPolygon", F.flatten(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")))
    rings = F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon"))))
    said = F.lower(F.concat_ws(" ", F.map_values("properties")))
    kind = F.coalesce(*(F.when(said.contains(w), k) for w, k in ZONE_KINDS.items()))
    z = f.select(F.col("properties")["name"].alias("name"), kind.alias("kind"), F.get(rings, F.lit(0)).alias("ring"), rings.alias("rings"))
    z = z.withColumn("zone_id", ident.short_id("zone", "name", "kind"))
    metres = F.exists(F.flatten("rings"), lambda p: (F.abs(p["lat"]) > 90) | (F.abs(p["lon"]) > 180))
    broken = F.exists("rings", lambda r: r.isNull() | (F.size(r) < 4) | F.exists(r, lambda p: p["lat"].isNull() | p["lon"].isNull()))
    reason = F.when(F.col("ring").isNull() | broken, "no polygon").when(metres, "not in degrees").when(F.col("kind").isNull(), "unknown kind")
    z = z.withColumn("reject_reason", reason)
    return z.filter("reject_reason is null").drop("reject_reason"), z.filter("reject_reason is not null")


def stamped_cells(rows: DataFrame, resolutions: tuple = (4, 5, 6, 7, 8, 9)) -> DataFrame:
    """rows with a cell of every resolution; without a position they stay null."""
    return rows.withColumns({f"cell_r{r}": grid.cell("lat", "lon", r) for r in resolutions})


def satellite_messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """Positions heard by satellite from JSON text, receivers named `sat:`, sentinels nulled."""
    got = lambda *names: F.coalesce(*(F.get_json_object(line, f"$.{n}") for n in names))
    n = lambda kind, *names: geo.nulled(got(*names).try_cast("double"), kind)
    out = lines.select(
        got("mmsi", "vessel.mmsi").try_cast("long").alias("mmsi"), instant(got("timestamp", "position.timestamp")).alias("ts"), n("lat", "latitude", "position.latitude").alias("lat"), n("lon", "longitude", "position.longitude").alias("lon"),
        n("sog", "speed", "position.speed").alias("sog"), n("cog", "course", "position.course").alias("cog"), F.concat(F.lit("sat:"), F.coalesce(got("satellite", "collection_type"), F.lit("unknown"))).alias("receiver"),
    )
    return out.filter("mmsi is not null and ts is not null and lat is not null and lon is not null")


def pass_predictions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Passes as intervals of epoch seconds; those that end before they begin are left out."""
    at = lambda n: F.unix_micros(instant(F.get_json_object(line, f"$.{n}"))) / 1e6
    return lines.select(F.get_json_object(line, "$.satellite").alias("satellite"), at("start").alias("r_start"), at("end").alias("r_end")).filter("r_end >= r_start")


def gridded_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Counts of detections by grid cell and day; aggregates, not contacts, and marked as such."""
    g = lines.select(F.from_json(line, "lat double, lon double, date string, detections double, flag string, geartype string").alias("g")).select("g.*")
    return g.filter(geo.in_box("lat", "lon")).select("lat", "lon", F.to_date("date").alias("day"), F.col("detections").cast("long").alias("n_detections"), "flag", F.col("geartype").alias("gear"), F.lit(True).alias("is_aggregate"))
