import math

from pyspark.sql import functions as F

from tidewatch.functions import geo, grid, ident


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_geometry(spark):
    r = one(
        spark, same=geo.haversine(10.0, 20.0, 10.0, 20.0), quarter=geo.haversine(0.0, 0.0, 0.0, 90.0), antipode=geo.haversine(0.0, 0.0, 0.0, 180.0), north=geo.bearing(0.0, 0.0, 1.0, 0.0), west=geo.bearing(0.0, 0.0, 0.0, -1.0),
        wrap=geo.turn(350.0, 10.0), back=geo.turn(10.0, 350.0), none=geo.nulled(F.lit(102.3), "sog"), some=geo.nulled(F.lit(12.0), "sog"),
    )
    assert r.same == 0 and math.isclose(r.quarter, math.pi / 2 * geo.EARTH_M) and math.isclose(r.antipode, math.pi * geo.EARTH_M)
    assert (round(r.north, 9), round(r.west, 9), r.wrap, r.back, r.none, r.some) == (0, 270, 20, 20, None, 12)
    lat, lon = geo.destination(15.0, 65.0, 37.0, 50_000.0)
    there = one(spark, lat=lat, lon=lon)
    back = one(spark, d=geo.haversine(15.0, 65.0, float(there.lat), float(there.lon)), b=geo.bearing(15.0, 65.0, float(there.lat), float(there.lon)))
    assert math.isclose(back.d, 50_000, rel_tol=1e-9) and math.isclose(back.b, 37, rel_tol=1e-9)


def test_decay_and_radar_formulas(spark):
    r = one(spark, half=geo.decayed(F.lit(0.8), F.lit(30.0), F.lit(30.0)), keep=geo.decayed(F.lit(0.8), F.lit(30.0), F.lit(None).cast("double")), length=geo.length_from_rcs(geo.rcs_from_length(F.lit(80.0))))
    assert math.isclose(r.half, 0.4) and r.keep == 0.8 and math.isclose(r.length, 80)


def test_grid_ring_covers_the_edge(spark):
    points = [(lat / 7, lon / 3) for lat in range(-500, 500, 97) for lon in range(-500, 500, 131)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for res, edge in grid.EDGE.items():
        shifted = df.withColumn("lat2", F.col("lat") + edge * 0.99).withColumn("lon2", F.col("lon") - edge * 0.99)
        got = shifted.select(F.array_contains(grid.disk(grid.cell("lat", "lon", res), 1, res), grid.cell("lat2", "lon2", res)).alias("ok"), F.size(F.array_distinct(grid.disk(grid.cell("lat", "lon", res), 1, res))).alias("n"))
        assert got.filter("not ok or n <> 9").count() == 0
        lat, lon = grid.centre(grid.cell("lat", "lon", res), res)
        assert df.filter((F.abs(lat - F.col("lat")) > edge / 2 + 1e-9) | (F.abs(lon - F.col("lon")) > edge / 2 + 1e-9)).count() == 0


def test_only_the_grid_module_computes_cells():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "tidewatch"
    assert not [p for p in root.rglob("*.py") if p.name not in ("grid.py", "bindings.py") and re.search(r"shiftleft|<< 58", p.read_text())]


def test_names_and_identifiers(spark):
    df = spark.createDataFrame([("M/V  M.V. Sea-Star 2",), ("  ",), (None,), ("MVP",)], "n string")
    assert [r.n for r in df.select(ident.normalise_name("n").alias("n")).collect()] == ["SEA STAR 2", None, None, "MVP"]
    r = one(
        spark, good=ident.imo_valid(F.lit("9074729")), bad=ident.imo_valid(F.lit("9074728")), short=ident.imo_valid(F.lit("907472")), none=ident.imo_valid(F.lit(None).cast("string")),
        text=ident.extract_imo(F.lit("imo 1234560; IMO No. 9074729, IMO 9074729")), missing=ident.extract_imo(F.lit("9074729")), digits=ident.digits(F.lit("IMO 9074729.0")),
        flag=ident.mmsi_check(F.lit("419000001"), F.lit("PAN")), fine=ident.mmsi_check(F.lit(419000001), F.lit("IND")), unknown=ident.mmsi_check(F.lit("999000001"), F.lit("IND")), key=ident.vessel_key("gfw", F.lit("gfw:vessel:abc")),
    )
    assert (r.good, r.bad, r.short, r.none, r.text, r.missing, r.digits) == (True, False, False, False, "9074729", None, "9074729")
    assert (r.flag, r.fine, r.unknown, r.key) == ("contradiction", "ok", "not_checkable", "vessel:gfw:abc")


def test_points_in_rings(spark):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0), (3, 0.0, 1.0), (4, 4.0, 4.0), (5, -1.0, -1.0)], "i int, lat double, lon double")
    zone = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a, o in ring))
    assert [r.i for r in df.filter(geo.ring_contains("lat", "lon", zone)).orderBy("i").collect()] == [1, 3, 4]
