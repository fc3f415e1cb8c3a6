"""Gates, fusion, radar correlation, departures, and circles at any latitude."""

import itertools
import json
import math
import random

from pyspark.sql import functions as F

from tidewatch.functions import grid
from tidewatch.operators import fusion, kernels, projection, proximity, sequences

FIXES = "track_id string, point_id long, t double, lat double, lon double, vx double, vy double, p double, c double, v double"
CONTACTS = "scene_id string, contact_id string, t double, lat double, lon double, sigma_m double, length_m double, length_rel double"


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def state(fixes, t):
    """Position, speed, variance and seconds since the last report of one track's sorted fixes; None where it is too early or too late."""
    if t < fixes[0][0] - 3600 or t > fixes[-1][0] + 43_200:
        return None
    k = max([i for i, f in enumerate(fixes) if f[0] <= t], default=-1)
    if k < 0:
        f = fixes[0]
        return f[1], f[2], math.hypot(f[3], f[4]), f[5], f[0] - t
    a = fixes[k]
    q, dt = 0.05**2, t - a[0]
    if k + 1 == len(fixes):
        lat, lon = a[1] + a[4] * dt / 111_320, a[2] + a[3] * dt / (111_320 * math.cos(math.radians(a[1])))
        return lat, lon, math.hypot(a[3], a[4]), a[5] + 2 * dt * a[6] + dt * dt * a[7] + q * dt**3 / 3, dt
    b = fixes[k + 1]
    span = b[0] - a[0]
    f = dt / span
    to = a[2] + (b[2] - a[2] + 180) % 360 - 180
    vx, vy = (1 - f) * a[3] + f * b[3], (1 - f) * a[4] + f * b[4]
    return (1 - f) * a[1] + f * b[1], (1 - f) * a[2] + f * to, math.hypot(vx, vy), (1 - f) ** 2 * a[5] + f * f * b[5] + q * (span * f * (1 - f)) ** 3 / 3, dt


def gates(fixes, contacts):
    out = {}
    for _, cid, t, lat, lon, sigma, *_ in contacts:
        sigma = sigma if sigma and sigma > 0 else 60.0
        for tid, rows in fixes.items():
            found = state(rows, t)
            if found is None:
                continue
            y, x, speed, p, since = found
            r95 = min(2.4477 * math.sqrt(max(p, 0)), (2.5 * max(speed / 0.514444, 2) + 5) * 0.514444 * max(since, 120))
            d = haversine(lat, lon, y, x)
            if d <= r95 + 3 * sigma + 500:
                out[cid, tid] = (d, r95, math.sqrt((r95 / 2.4477) ** 2 + sigma**2 + (500 / 2.4477) ** 2))
    return out


def some_tracks(rng, n, where):
    fixes = {}
    for k in range(n):
        y, x = where(rng)
        t, rows = rng.uniform(0, 40_000), []
        for _ in range(rng.randint(1, 9)):
            rows.append((t, y, (x + 180) % 360 - 180, rng.uniform(-8, 8), rng.uniform(-8, 8), rng.uniform(50, 400), rng.uniform(0, 2), rng.uniform(0, 0.1)))
            t += rng.choice([300.0, 3000.0, 30_000.0])
            y, x = max(-89.0, min(89.0, y + rng.uniform(-0.2, 0.2))), x + rng.uniform(-0.4, 0.4)
        fixes[f"k{k}"] = rows
    return fixes


def test_gates_against_brute_force(spark):
    rng = random.Random(4)
    for where in (lambda r: (r.uniform(10, 12), r.uniform(65, 67)), lambda r: (r.uniform(66, 70), r.uniform(178, 182))):
        fixes = some_tracks(rng, 40, where)
        contacts = [(f"s{i % 7}", f"c{i}", rng.uniform(-5000, 200_000), *(lambda y, x: (y, (x + 180) % 360 - 180))(*where(rng)), rng.choice([None, 0.0, 30.0, 400.0]), None, None) for i in range(150)]
        rows = [(k, i, *f) for k, fs in fixes.items() for i, f in enumerate(fs)]
        got = fusion.gated(spark.createDataFrame(contacts, CONTACTS), spark.createDataFrame(rows, FIXES)).collect()
        want = gates(fixes, contacts)
        assert len(want) > 100 and len(got) == len(want) and {(r.contact_id, r.track_id) for r in got} == set(want)
        for r in got:
            d, r95, sigma = want[r.contact_id, r.track_id]
            assert math.isclose(r.distance_m, d, rel_tol=1e-6, abs_tol=1e-3) and math.isclose(r.r95, r95, rel_tol=1e-9) and math.isclose(r.sigma_pos, sigma, rel_tol=1e-9)


def test_empty_sides(spark):
    none, no_tracks = spark.createDataFrame([], CONTACTS), spark.createDataFrame([], FIXES)
    some = spark.createDataFrame([("s", "c", 0.0, 1.0, 1.0, None, None, None)], CONTACTS)
    assert fusion.gated(none, no_tracks).count() == 0 and fusion.gated(some, no_tracks).count() == 0
    assert [tuple(r)[1:5] for r in kernels.associate(spark.createDataFrame([], "scene_id string, contact_id string, track_id string, score double"), some).collect()] == [("c", None, None, "unmatched")]


def test_lengths_and_history_in_scores(spark):
    fixes = spark.createDataFrame([("a", 0, 0.0, 10.0, 65.0, 0.0, 0.0, 100.0, 0.0, 0.0), ("b", 1, 0.0, 10.0, 65.03, 0.0, 0.0, 100.0, 0.0, 0.0)], FIXES)
    contact = spark.createDataFrame([("s", "c", 10.0, 10.0, 65.0, None, 60.0, 0.25), ("s", "far", 10.0, 10.0, 65.003, None, None, None)], CONTACTS)
    pairs = fusion.gated(contact, fixes)
    lengths = lambda n: spark.createDataFrame([("a", n)], "track_id string, length double")
    by = lambda n: {(r.contact_id, r.track_id): r.score for r in fusion.scored(pairs, fixes, lengths(n)).collect()}
    exact, off, wrong = by(60.0), by(70.0), by(200.0)
    assert ("c", "a") not in wrong and ("far", "a") in wrong
    assert math.isclose(exact["c", "a"] - off["c", "a"], 0.5 * (10 / 17.5) ** 2)


def best_total(scores, n_contacts, n_tracks, floor):
    best = -1e9
    for choice in itertools.product(range(-1, n_tracks), repeat=n_contacts):
        used = [t for t in choice if t >= 0]
        if len(set(used)) == len(used) and all(t < 0 or (c, t) in scores for c, t in enumerate(choice)):
            best = max(best, sum(scores[c, t] if t >= 0 else floor for c, t in enumerate(choice)))
    return best


def test_assignment_is_the_best_of_all(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for scene in range(12):
        scores = {(c, t): rng.uniform(-12, 0) for c in range(4) for t in range(4) if rng.random() < 0.45}
        rows += [(str(scene), str(c), str(t), s) for (c, t), s in scores.items()]
        want[str(scene)] = best_total(scores, 4, 4, -8.0)
    contacts = spark.createDataFrame([(str(s), str(c)) for s in range(12) for c in range(4)], "scene_id string, contact_id string")
    got = kernels.associate(spark.createDataFrame(rows, "scene_id string, contact_id string, track_id string, score double"), contacts).collect()
    assert len(got) == 48
    for scene, total in want.items():
        mine = [r for r in got if r.scene_id == scene]
        assert math.isclose(sum(-8.0 if r.track_id is None else r.score for r in mine), total, abs_tol=1e-9)
        taken = [r.track_id for r in mine if r.track_id]
        assert len(set(taken)) == len(taken)
    for r in got:
        top = json.loads(r.top)
        own = sorted(((s, t) for sc, c, t, s in rows if (sc, c) == (r.scene_id, r.contact_id)), reverse=True)[:3]
        assert [t for t, _ in top] == [t for _, t in own]


def test_static_objects_take_their_contacts_back(spark):
    # A rig at (10, 65) is seen in nine scenes; in the last one a track passes by and explains the rig better than the ship beside it.
    day = 86_400.0
    contacts = [(f"s{d}", f"rig{d}", d * day, 10.0, 65.0, 40.0, 50.0, None) for d in range(9)] + [("s8", "ship", 8 * day, 10.0, 65.012, 40.0, 50.0, None)]
    pairs = [("s8", "rig8", "k", -1.0), ("s8", "ship", "k", -3.0)]
    berth = [(f"s{d}", f"ferry{d}", d * day, 12.0, 66.0, 40.0, 50.0, None) for d in range(9)]
    pairs += [(f"s{d}", f"ferry{d}", "f", -1.0) for d in range(5)]
    got = fusion.fused(
        spark.createDataFrame(contacts + berth, CONTACTS), spark.createDataFrame(pairs, "scene_id string, contact_id string, track_id string, score double")
    ).collect()
    by = {r.contact_id: r for r in got}
    assert len(got) == 19
    assert by["rig8"].status == "unmatched" and by["rig8"].reclaimed
    assert by["ship"].track_id == "k" and not by["ship"].reclaimed
    assert [by[f"ferry{d}"].track_id for d in range(9)] == ["f"] * 5 + [None] * 4  # a berth, mostly matched, is no object
    first = {r.contact_id: r.track_id for r in kernels.associate(spark.createDataFrame(pairs, "scene_id string, contact_id string, track_id string, score double"), spark.createDataFrame(contacts, CONTACTS)).collect()}
    assert first["rig8"] == "k" and first["ship"] is None


def test_six_statuses(spark):
    def track(name, marks, start=0):
        return [(name, e, float(e * 900 + 450), 10.0, 65.0, None if m == "." else m) for e, m in enumerate(marks, start)]

    rows = track("ok", "aaaa.aaa") + track("gone", "bbbbbb......") + track("late", "cccc............") + track("heard", "dddd............")
    rows += track("hole", "eeee............") + track("none", "........") + track("maybe", "f..f..f.") + track("short", "gggggg...")
    fixes = spark.createDataFrame([("d", 4 * 900 + 500.0), ("b", 100.0), ("c", 0.0)], "track_id string, t double")
    gaps = spark.createDataFrame([("e", 3000.0, 90_000.0, "COVERAGE_GAP"), ("c", 3000.0, 90_000.0, "COVERAGE_GAP"), ("c", 4000.0, 90_000.0, "INTENTIONAL_SILENCE")], "track_id string, r_start double, r_end double, gap_type string")
    tracks = spark.createDataFrame([(n,) for n in ("ok", "gone", "late", "heard", "hole", "none", "maybe", "short", "brief")], "radar_id string")
    found = fusion.correlations(spark.createDataFrame(rows, "radar_id string, epoch long, t double, lat double, lon double, track_id string"), fixes, gaps, tracks)
    by = {r.radar_id: r for r in found.collect()}
    assert {n: r.status for n, r in by.items()} == {
        "ok": "correlated", "gone": "correlated_then_dark", "late": "correlated_then_dark",
        "heard": "correlated_gap_explained", "hole": "correlated_gap_explained", "none": "dark", "maybe": "ambiguous", "short": "correlated", "brief": "transient",
    }
    assert by["gone"].track_id == "b" and by["gone"].is_tail
    assert by["late"].support == 1.0 and by["late"].dark_n == 12 and by["late"].gap_type == "INTENTIONAL_SILENCE" and by["late"].n_heard == 0


def test_census_counts_what_is_left_on_both_sides(spark):
    rows = spark.createDataFrame(
        [("x", 10, 0.0, 10.0, 65.0, None), ("y", 10, 0.0, 10.0, 65.01, None), ("z", 10, 0.0, 10.0, 65.0, "m"), ("w", 10, 0.0, 10.5, 65.0, None), ("v", 13, 0.0, 10.0, 65.0, "n")],
        "radar_id string, epoch long, t double, lat double, lon double, track_id string",
    )
    heard = [("m", 10), ("n", 9), ("p", 14), ("q", 15), ("p", 6)]
    fixes = spark.createDataFrame([(k, e * 900.0 + 5, 10.0, 65.0) for k, e in heard], "track_id string, t double, lat double, lon double")
    got = {r.radar_id: (r.n_unexplained, r.n_free) for r in fusion.census(rows, fixes, 0.0).collect()}
    assert got == {"x": (2, 1), "y": (2, 1), "w": (1, 0)}  # m and n are spent, q is heard too late


def test_departure_of_a_steady_leg_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(projection, "SLICE_S", 7200.0)
    rng = random.Random(1)
    rows = []
    for key, n in (("hot", 900), ("few", 40)):
        y, x, course = 10.0, 65.0, 90.0
        for i in range(n):
            course = (course + (rng.uniform(-5, 5) if i % 60 else 80)) % 360
            rows.append((key, i, i * 300.0 + rng.random(), y, x, 12.0, course))
            y, x = y + 12 * 0.514444 * 300 * math.cos(math.radians(course)) / 111_320, x + 12 * 0.514444 * 300 * math.sin(math.radians(course)) / 111_320 / math.cos(math.radians(y))
    df = spark.createDataFrame(rows, "key string, point_id long, t double, lat double, lon double, sog double, cog double")
    got = {(r.key, r.check): r for r in projection.checks(df, lead_h=1.0, most=200).collect()}
    for key in ("hot", "few"):
        own = [r for r in rows if r[0] == key]
        stride = max(1, len(own) // 200)
        assert sorted(c for k, c in got if k == key) == list(range(-(-(len(own) - 1) // stride)))
        for check in range(0, -(-(len(own) - 1) // stride), 7):
            i = check * stride
            after = [r for r in own if r[2] >= own[i][2] + 3600]
            turns = [abs((own[k][6] - own[k - 1][6] + 180) % 360 - 180) for k in range(max(1, i - 2), i + 1)]
            known = i >= 2 and max(turns) <= 20 and bool(after) and after[0][2] - own[i][2] - 3600 <= 1800
            r = got[key, check]
            assert (r.radii is not None) == known
            if known:
                h = (after[0][2] - own[i][2]) / 3600
                d = 12 * 1852 * h / 6_371_000
                a, o, b = math.radians(own[i][3]), math.radians(own[i][4]), math.radians(own[i][6])
                la = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(b))
                lo = o + math.atan2(math.sin(b) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(la))
                assert math.isclose(r.radii, haversine(math.degrees(la), math.degrees(lo), after[0][3], after[0][4]) / (1852 * h), rel_tol=1e-6)
    found = projection.departures(projection.checks(df, lead_h=1.0, most=200)).collect()
    assert found and all(r.n_checks >= 2 and r.radii > 1 for r in found)


def test_parts_see_what_the_key_sees(spark):
    rows = [("a", i, float(i // 2), float(i)) for i in range(500)] + [("b", 0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, point_id long, t double, x double")
    got = {(r.key, r.point_id): (r.i, r.n, r.before and r.before.x, r.after and r.after.x) for r in sequences.neighbours(df, ["x"], slice_s=40.0).collect()}
    assert got["b", 0] == (0, 1, None, None)
    assert all(got["a", i] == (i, 500, float(i - 1) if i else None, float(i + 1) if i < 499 else None) for i in range(500))
    cut = sequences.parts(sequences.numbered(df, slice_s=40.0), back=3, ahead=2, size=64).filter("key = 'a'").groupBy("part").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).collect()
    assert {r.part: (r.lo, r.hi) for r in cut} == {p: (max(0, 64 * p - 3), min(499, 64 * p + 65)) for p in range(8)}


def test_circles_are_covered_at_any_latitude(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        lat, lon, r = rng.choice([0.0, 45.0, 65.0, 80.0, 84.9, 85.1, 89.0, 89.99, -89.9]), rng.choice([0.0, 179.99, -180.0, 30.0]), rng.choice([500.0, 5000.0, 60_000.0])
        b, d = rng.uniform(0, 2 * math.pi), r * rng.choice([0.999, 1.01, rng.random()]) / 6_371_000
        a = math.radians(lat)
        la = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(b))
        lo = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(la))
        rows.append((i, r, lat, lon, math.degrees(la), (math.degrees(lo) + 540) % 360 - 180))
    df = spark.createDataFrame(rows, "i long, r double, lat double, lon double, lat2 double, lon2 double")
    for r in (500.0, 5000.0, 60_000.0):
        some = df.filter(F.col("r") == r)
        got = proximity.near(some.select("i", F.col("lat2").alias("lat"), F.col("lon2").alias("lon")), some.select("i", "lat", "lon"), r, ("i",)).collect()
        assert sorted(x.i for x in got) == [i for i, q, a, o, b, p in rows if q == r and haversine(a, o, b, p) <= r]


def test_a_box_and_a_point_in_it_share_one_cell(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        s, w, size = rng.uniform(-89, 80), rng.uniform(-190, 185), rng.choice([0.0001, 0.01, 0.3, 5.0, 40.0])
        rows.append((s, w, min(90.0, s + size), w + size, min(90.0, s + size * rng.random()), (w + size * rng.random() + 180) % 360 - 180))
    df = spark.createDataFrame(rows, "s double, w double, n double, e double, lat double, lon double").withColumn("level", grid.level_of(F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"))))
    df = df.withColumn("edge", grid.edge_of("level")).withColumn("cells", grid.cover_any("s", "w", "n", "e", "level", "edge"))
    got = df.select(F.size(F.array_intersect("cells", grid.levels("lat", "lon"))).alias("k"), F.size("cells").alias("m")).collect()
    assert all(r.k == 1 and r.m <= 9 for r in got)


def test_coverage_counts_each_key_once_and_shuffles_counts(spark):
    from tidewatch.functions import grid
    from tidewatch.operators import silence

    at = lambda r, c: (4 << 58) | (r << 29) | c
    heard = [(at(250, 899), 23, "ter", 1), (at(250, 0), 24, "ter", 1), (at(251, 0), 24, "sat", 2), (at(251, 0), 26, "sat", 3), (at(250, 1), 25, "sat", 1)]
    rows = spark.createDataFrame(heard, "cell long, hour long, rx string, key long")
    wanted = spark.createDataFrame([(at(250, 0), 24), (at(250, 0), 29), (at(10, 10), 24)], "cell long, hour long")
    out = silence.around(wanted, rows)
    got = {(r.cell, r.hour): (round(r.p_ter, 9), round(r.p_sat, 9), round(r.sat_area, 9)) for r in out.collect()}
    full = lambda n: 1 - 2.718281828459045**-n
    assert got == {(at(250, 0), 24): (round(full(2) / 2, 9), round(full(2), 9), round(full(3), 9)), (at(250, 0), 29): (0.0, 0.0, round(full(1), 9)), (at(10, 10), 24): (0.0, 0.0, 0.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(-3, 3" not in plan and "_d#" not in plan  # receipts are not spread over 63 places and hours
    assert grid.EDGE[4] == 0.4


def test_cells_stay_as_narrow_as_the_circle_towards_the_pole(spark):
    rng = random.Random(12)
    rows = [(i, i % 5, rng.uniform(59.5, 90.0), rng.choice((179.0, -181.0)) + 2 * rng.random()) for i in range(400)]
    rows = [(i, k, a, (o + 180) % 360 - 180) for i, k, a, o in rows]
    p = spark.createDataFrame(rows, "i long, k long, lat double, lon double")
    cells = p.select(F.size(grid.fitted_reach("lat", "lon", 10_000.0, 0.09)).alias("n"), grid.fitted("lat", "lon", 0.09).alias("own"), grid.fitted_reach("lat", "lon", 10_000.0, 0.09).alias("all"))
    assert cells.agg(F.max("n"), F.bool_and(F.array_contains("all", F.col("own")))).first() == (cells.agg(F.max("n")).first()[0], True) and cells.agg(F.avg("n")).first()[0] < 14
    got = proximity.near(p, p.select(F.col("i").alias("j"), F.col("k").alias("l"), "lat", "lon"), 10_000, (), "k < l")
    want = {(i, j): d for i, k, a, o in rows for j, m, b, q in rows if k < m and (d := haversine(a, o, b, q)) <= 10_000}
    assert {(r.i, r.j): round(r.distance_m, 3) for r in got.collect()} == {x: round(d, 3) for x, d in want.items()} and len(want) > 100


def test_scores_are_found_where_contacts_and_gates_meet(spark):
    rng = random.Random(5)
    where = lambda r: (r.uniform(10, 10.4), r.uniform(179.8, 180.2))
    fixes = [(k, i, *f) for k, fs in some_tracks(rng, 30, where).items() for i, f in enumerate(fs)]
    contacts = [(f"s{i % 5}", f"c{i}", rng.uniform(-3000, 90_000), y, (x + 180) % 360 - 180, rng.choice([None, 90.0]), rng.choice([None, 50.0, 60.0]), rng.choice([None, 0.4])) for i in range(200) for y, x in [where(rng)]]
    contacts += [("s", f"on{i}", f[2], f[3], f[4], 40.0, None, None) for i, f in enumerate(fixes)]
    c, f = spark.createDataFrame(contacts, CONTACTS), spark.createDataFrame(fixes, FIXES)
    lengths = spark.createDataFrame([(f"k{k}", 50.0 + k) for k in range(0, 30, 2)], "track_id string, length double")
    pairs = fusion.scored(fusion.gated(c, f), f, lengths).cache()
    want = {(r.contact_id, r.track_id): r.score for r in pairs.collect()}
    got = fusion.candidates(c, f, lengths).collect()
    assert len(want) > 300 and len(got) == len(want) and all(math.isclose(r.score, want[r.contact_id, r.track_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    for floor in (-8.0, -2.0):
        best = {r.contact_id: r.track_id for r in fusion.best_candidates(pairs, floor).collect()}
        assert best and {r.contact_id: r.track_id for r in fusion.best_of(c, f, lengths, floor).collect()} == best
    plan = fusion.best_of(c, f, lengths)._jdf.queryExecution().optimizedPlan().toString()
    assert "distance_m" not in plan  # no pair leaves the task that finds it


def test_census_spreads_broadcasters_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(fusion, "CENSUS_SPAN", 10)
    rng = random.Random(6)
    place = lambda: (rng.choice([9.99, 10.0, 10.02, 10.03]), rng.choice([179.99, -179.99, -179.97]))
    rows = [(f"r{i}", rng.randrange(-30, 30), 0.0, *place(), rng.choice([None, None, f"b{rng.randrange(9)}"])) for i in range(150)]
    heard = [(f"b{rng.randrange(9)}", rng.randrange(-35, 35), *place()) for _ in range(120)]
    row = lambda lat, lon: (math.floor((lat + 90) / 0.024), math.floor((lon + 180) / 0.024))
    beside = lambda p, q: abs(p[0] - q[0]) <= 1 and (p[1] - q[1]) % 15_000 in (0, 1, 14_999)
    want = {}
    for name, e, _, lat, lon, track in rows:
        if track is None:
            here = row(lat, lon)
            near = {k for k, h, a, o in heard if abs(h - e) <= 4 and beside(here, row(a, o))} - {k for _, h, _, a, o, k in rows if k and abs(h - e) <= 4 and beside(here, row(a, o))}
            want[name] = (len({n for n, h, _, a, o, k in rows if k is None and h == e and beside(here, row(a, o))}), len(near))
    found = fusion.census(
        spark.createDataFrame(rows, "radar_id string, epoch long, t double, lat double, lon double, track_id string"),
        spark.createDataFrame([(k, e * 900.0 + 5, a, o) for k, e, a, o in heard], "track_id string, t double, lat double, lon double"), 0.0,
    )
    assert {r.radar_id: (r.n_unexplained, r.n_free) for r in found.collect()} == want and any(n for _, n in want.values())


def test_few_rows_are_sent_to_many_tiles(spark):
    rng = random.Random(13)
    spots = [(0.0, 0.0), (70.0, 180.0), (-89.9, 20.0)]
    rows = [(i, i % 7, i % 2, max(-90.0, y + rng.uniform(-1, 1)), (x + rng.uniform(-1.5, 1.5) + 180) % 360 - 180) for i in range(600) for y, x in [rng.choice(spots)]]
    p = spark.createDataFrame(rows, "i long, k long, day long, lat double, lon double")
    got = proximity.near(p, p.select(F.col("i").alias("j"), F.col("k").alias("l"), "day", "lat", "lon"), 9_000, ("day",), "i % 5 > 0", below=("k", "l")).collect()
    want = {(i, j): d for i, k, m, a, o in rows for j, l, n, b, q in rows if m == n and k < l and i % 5 and (d := haversine(a, o, b, q)) <= 9_000}  # noqa: E741
    assert len(got) == len(want) > 200 and all(math.isclose(r.distance_m, want[r.i, r.j], rel_tol=1e-6, abs_tol=1e-3) for r in got)
    flat = spark.range(2000).select((F.col("id") * 7919 % 20_000 / 1000.0).alias("lat"), (F.col("id") * 104_729 % 18_000 / 1000.0).alias("lon"))
    size = proximity.TILE * 40_000 / grid.DEGREE_M
    assert flat.select(F.avg(F.size(grid.fitted_reach("lat", "lon", 40_000.0, size)))).first()[0] < 2
