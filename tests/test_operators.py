import itertools

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import aggregates, detectors, graph, kernels, proximity, sequences


def lane(spark, rows):
    return spark.createDataFrame([(str(k), i, float(t), float(a), float(o), float(s), 0.0) for i, (k, t, a, o, s) in enumerate(rows)], "key string, point_id long, t double, lat double, lon double, sog double, cog double")


def test_duplicate_identity_makes_two_tracks(spark):
    rows = []
    for i in range(12):
        rows += [("7", i * 300, 15 + i * 0.01, 65, 8), ("7", i * 300 + 60, 10 + i * 0.01, 70, 8)]
    points = kernels.build_tracks(lane(spark, rows)).cache()
    tracks = kernels.tracks_of(points)
    assert sorted(r.n_points for r in tracks.collect()) == [12, 12]
    (dup,) = kernels.duplicate_identities(tracks).collect()
    assert dup.event_type == "DUPLICATE_MMSI" and len(dup.track_ids) == 2


def test_impossible_jump_is_an_outlier_and_stays(spark):
    rows = [("1", i * 300, 15 + i * 0.01, 65, 8) for i in range(10)] + [("1", 1450, 22, 75, 8)]
    points = kernels.build_tracks(lane(spark, rows)).collect()
    assert len(points) == 11 and sum(p.quality == "outlier" for p in points) == 1


def test_silence_splits_a_track_with_lineage(spark):
    rows = [("1", i * 300 + (9 * 86_400 if i > 4 else 0), 15 + i * 0.01, 65, 8) for i in range(10)]
    t = sorted(kernels.tracks_of(kernels.build_tracks(lane(spark, rows))).collect(), key=lambda r: r.t_start)
    assert [r.n_points for r in t] == [5, 5] and t[0].fragmented_from is None and t[1].fragmented_from == t[0].track_id


def test_smoother_reduces_noise():
    rng = np.random.default_rng(0)
    t = np.arange(60) * 180.0
    true = 15 + t / 3600 * 0.1
    noisy = true + rng.normal(0, 100, 60) / 111_320
    lat, lon, sigma = kernels.smooth(t, noisy, np.full(60, 65.0), np.full(60, 100.0))
    assert np.abs(lat - true).mean() < np.abs(noisy - true).mean() and (sigma < 100).all()


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (3, 5), (4, 6)):
        cost = rng.normal(size=(n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = kernels.assign(cost)
        assert len(set(got)) == n and np.isclose(cost[np.arange(n), got].sum(), best)


def test_assignment_over_pairs_costs_as_little_as_that_of_a_table():
    rng = np.random.default_rng(4)
    for n, m, share in ((1, 1, 1.0), (5, 3, 0.7), (30, 30, 0.2), (60, 40, 0.1), (80, 90, 0.05)):
        for _ in range(20):
            cost = rng.normal(size=(n, m)) * 5
            there = rng.random((n, m)) < share
            table = np.full((n, m + n), 1e6)
            table[:, :m][there], table[np.arange(n), m + np.arange(n)] = cost[there], 3.0
            rows, cols = np.nonzero(there)
            got, paid = kernels.assign_sparse(n, m, rows, cols, cost[there], 3.0)
            real = got[got < m]
            assert len(set(real)) == len(real) and all(there[i, j] and paid[i] == cost[i, j] if j < m else paid[i] == 3.0 for i, j in enumerate(got))
            assert np.isclose(paid.sum(), table[np.arange(n), kernels.assign(table)].sum())


def test_association_is_global_with_a_floor(spark):
    cand = spark.createDataFrame([("s", "c1", "t1", 0.0), ("s", "c1", "t2", -1.0), ("s", "c2", "t1", -0.5), ("s", "c3", "t2", -9.0)], "scene_id string, contact_id string, track_id string, score double")
    contacts = spark.createDataFrame([("s", c) for c in ("c1", "c2", "c3", "c4")], "scene_id string, contact_id string")
    got = {r.contact_id: (r.track_id, r.status) for r in kernels.associate(cand, contacts).collect()}
    assert got["c1"][0] == "t2" and got["c2"][0] == "t1" and got["c3"] == (None, "unmatched") == got["c4"]


def test_encounter_crosses_a_cell_edge(spark):
    rows = [(k, 300 * i, a, 65.0, 1.0) for i in range(6) for k, a in (("b", 15.0479), ("a", 15.0481))]
    (e,) = proximity.encounters(lane(spark, rows)).collect()
    assert (e.key_a, e.key_b, e.n) == ("a", "b", 6) and e.min_distance_m < 500
    assert proximity.encounters(lane(spark, [(k, 300 * i, 15.0, 65.0, 9.0) for i in range(6) for k in "ab"])).count() == 0


def test_encounters_are_those_of_all_pairs_and_join_no_pairs_of_a_step(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(24):
        here, n = rng.integers(0, 3), int(rng.integers(22, 31))
        lat, lon = ((15.0, 65.0), (62.0, 179.999), (89.97, 0.0))[here]
        wide = (0.003, 0.006, 90.0)[here]
        for i in rng.choice(31, n, replace=False) - 4:
            o = lon + (k % 3 + rng.random()) * wide / 2
            rows.append((f"k{k}", 300 * int(i), lat + rng.random() * 0.003, (o + 180) % 360 - 180, rng.choice((1.0, 1.0, 1.0, 9.0))))
    rows += [(k, 300 * i, 15.0, 65.0 + a, 1.0) for i in range(40) for k, a in (("y", 1.0), ("z", 1.001))]
    points = lane(spark, rows)
    found = proximity.encounters(points)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    at = {(k, t): (a, o) for k, t, a, o, s in rows if s <= 2}
    keys, want = sorted({k for k, _ in at}), {}
    for a, b in itertools.combinations(keys, 2):
        run = []
        for t in range(-1500, 300 * 42, 300):
            p, q = at.get((a, t)), at.get((b, t))
            d = proximity._distance(*np.radians([*p, *q])) if p and q else np.inf
            if d <= 500:
                run.append((t, d))
            else:
                if len(run) >= 3:
                    want[a, b, run[0][0]] = (run[-1][0], len(run), round(float(min(d for _, d in run)), 3))
                run = []
    got = {(r.key_a, r.key_b, r.t_start): (r.t_end, r.n, round(r.min_distance_m, 3)) for r in found.collect()}
    assert got == want and want["y", "z", 0][1] == 40 and len({a for a, _, _ in want}) > 6


def test_visits_merge_and_censor(spark):
    inside = [0, 600, 1200, 5000, 5600, 20_000]
    rows = [("1", t, 1, 1, 3) for t in inside] + [("1", 3000, 50, 50, 3), ("1", 9000, 50, 50, 3)]
    zone = F.when(F.col("lat") < 10, "z")
    got = sorted((r.t_enter, r.dwell_s, r.entry_censored, r.open) for r in sequences.visits(lane(spark, rows), zone, dwell_s=0).collect())
    assert got == [(0, 1200, True, False), (5000, 600, False, False), (20_000, 0, False, True)]


def test_unknown_is_not_clean(spark):
    base = spark.createDataFrame([(1, "usable", 10.0), (2, "insufficient", 1.0)], "cell int, status string, p95 double")
    p = spark.createDataFrame([(1, 11.0), (1, 10.0), (2, 99.0), (3, 99.0)], "cell int, sog double")
    assert sorted(((r.cell, r.sog, r.unusual) for r in aggregates.is_unusual(p, base).collect()), key=str) == [(1, 10.0, False), (1, 11.0, True), (2, 99.0, None), (3, 99.0, None)]


def test_closed_edge_does_not_come_back(spark):
    e = spark.createDataFrame([("owned-by", "a", "b", 0.0, None, 0.9, 1.0), ("owned-by", "a", "b", 0.0, 5.0, 0.9, 6.0), ("owned-by", "a", "c", 7.0, None, 0.9, 7.0)], "edge_type string, src string, dst string, t_start double, t_end double, confidence double, observed_at double")
    read = lambda t: {r.dst for r in graph.latest_assertions(e, t).collect()}
    assert (read(2.0), read(6.5), read(8.0)) == ({"b"}, set(), {"c"})


def test_sanctioned_counterpart_as_of_the_meeting(spark):
    meet = spark.createDataFrame([("v1", "v2", 10.0, 0.9), ("v3", "v2", 99.0, 0.9)], "subject string, counterpart string, t double, confidence double")
    own = spark.createDataFrame([("v2", "o1", 0.8), ("o1", "o2", 0.7), ("o2", "o1", 0.7)], "src string, dst string, confidence double")
    sanc = spark.createDataFrame([("o2", 5.0, 50.0, 0.95)], "entity string, t_start double, t_end double, confidence double")
    (a,) = graph.sanctioned_counterparts(meet, own, sanc).collect()
    assert (a.subject, a.hops, a.path, a.score) == ("v1", 2, ["v2", "o1", "o2"], 0.7)


def test_meetings_are_not_grouped_by_the_few_sanctioned(spark):
    meet = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("subject"), F.concat(F.lit("w"), F.col("id") % 50).alias("counterpart"), F.lit(10.0).alias("t"), F.lit(0.9).alias("confidence"))
    own = spark.range(50).select(F.concat(F.lit("w"), "id").alias("src"), F.concat(F.lit("o"), F.col("id") % 2).alias("dst"), F.lit(0.8).alias("confidence"))
    sanc = spark.createDataFrame([("o1", 5.0, None, 0.95), ("o0", 5.0, None, 0.2)], "entity string, t_start double, t_end double, confidence double")
    found = graph.sanctioned_counterparts(meet, own, sanc)
    assert "hashpartitioning(entity" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 500 and found.select("entity", "score").distinct().collect() == [("o1", 0.8)]


def test_identity_at_a_time(spark):
    keys = spark.createDataFrame([("1", 5.0), ("1", 50.0), ("2", 5.0)], "mmsi string, t double")
    known = spark.createDataFrame([("1", "h1", 0.0, 10.0, 1.0), ("1", "h2", 0.0, 10.0, 2.0)], "mmsi string, hull string, t_start double, t_end double, observed_at double")
    assert {(r.mmsi, r.t): (r.hull, r.provisional) for r in graph.identity_at(keys, known).collect()} == {("1", 5.0): ("h2", False), ("1", 50.0): ("vessel:mmsi:1", True), ("2", 5.0): ("vessel:mmsi:2", True)}


def test_identity_at_any_time_is_that_of_all_intervals(spark):
    import random

    rng = random.Random(3)
    held = [(rng.choice("ab"), f"h{rng.randrange(9)}", float(s := rng.randrange(-50, 900)), None if rng.random() < 0.3 else float(s + rng.choice((0, 1, 7, 200, 900))), float(rng.randrange(60))) for _ in range(150)]
    asked = [(k, rng.choice((float(rng.randrange(1000)), rng.random() * 1000))) for k in "abc" for _ in range(300)] + [("a", None)]
    frame = spark.createDataFrame(held, "mmsi string, hull string, t_start double, t_end double, observed_at double")
    got = {(r.mmsi, r.t): r.hull for r in graph.valid_at(spark.createDataFrame(asked, "mmsi string, t double"), frame, "mmsi", "hull").collect()}
    best = lambda k, t: max(((o, h) for m, h, s, e, o in held if t is not None and m == k and s <= t and (e is None or t < e)), default=(0, None))[1]
    assert got == {(k, t): best(k, t) for k, t in asked}
    assert graph.valid_at(spark.createDataFrame([], "mmsi string, t double"), frame, "mmsi", "hull").count() == 0


def test_many_open_intervals_do_not_meet_many_times(spark):
    import time

    n, began = 60_000, time.time()
    held = spark.range(n).selectExpr("'a' as mmsi", "concat('h', id) as hull", "double(id) as t_start", "double(null) as t_end", "double(id % 1000) as observed_at")
    asked = spark.range(n).selectExpr("'a' as mmsi", "id * 2.0D as t")
    out = graph.valid_at(asked, held, "mmsi", "hull").agg(F.count("hull"), F.count("*")).first()
    assert tuple(out) == (n, n) and time.time() - began < 60  # 2.7 billion pairs


def test_edges_against_the_ontology(spark):
    nodes = spark.createDataFrame([("v", "vessel"), ("o", "organization")], "id string, type string")
    kinds = spark.createDataFrame([("owned-by", "vessel", "organization")], "edge_type string, src_type string, dst_type string")
    e = spark.createDataFrame([("owned-by", "v", "o", "s"), ("owned-by", "o", "v", "s"), ("owned-by", "v", "x", "s"), ("owned-by", "v", "o", None)], "edge_type string, src string, dst string, source string")
    good, bad = graph.valid_edges(e, nodes, kinds)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["against the ontology", "no provenance", "no such node"]


def test_alert_ids_and_thresholds(spark):
    rows = spark.createDataFrame([("ais_spoofing", "v", 1.4, 0.6), ("ais_spoofing", "v", 0.6, 0.9), ("ais_spoofing", "w", 1.0, 0.5)], "rule string, subject string, t double, score double")
    assert detectors.alerts(rows).count() == 1
    assert spark.range(1).select(detectors.contradictions(F.array(F.lit(0.9), F.lit(0.95), F.lit(0.5)))).first()[0] == 0.97


def test_alerts_of_one_second_are_told_apart(spark):
    rows = spark.createDataFrame([("ais_spoofing", "v", 1.4, 0.6, 1), ("ais_spoofing", "v", 1.4, 0.6, 2), ("ais_spoofing", "v", 0.6, 0.9, 3)], "rule string, subject string, t double, score double, point_id long")
    out = detectors.alerts(rows, apart=("point_id",)).collect()
    assert sorted(r.point_id for r in out) == [1, 2, 3] and len({r.alert_id for r in out}) == 3


def test_same_results_at_any_partition_count(spark):
    rows = [(str(i % 5), i * 400, 15 + i % 3, 65 + i % 4, i % 20) for i in range(200)]
    seen = set()
    for n in (1, 3, 16):
        got = sequences.state_runs(lane(spark, rows).repartition(n), F.col("sog") < 10).collect()
        seen.add(tuple(sorted(map(tuple, got))))
    assert len(seen) == 1


def test_scenes_go_forward_only(spark):
    from tidewatch.operators import catalog

    steps = {
        "a": "cataloged raw raw cataloged calibrated detected failed", "b": "cataloged failed failed raw failed calibrated", "c": "detected raw", "d": "unknown failed", "e": "unknown",
    }
    rows = [(s, x, k, k, f"{s}{k}" if x == "raw" else None) for s, line in steps.items() for k, x in enumerate(line.split())]
    ledger = spark.createDataFrame(rows, "scene_id string, status string, at int, seq int, uri string")
    taken = {}
    for r in sorted(catalog.accepted(ledger).collect(), key=lambda r: r.seq):
        taken.setdefault(r.scene_id, []).append(r.status)
    assert taken == {"a": ["cataloged", "raw", "calibrated", "detected"], "b": ["cataloged", "failed", "raw", "failed", "calibrated"], "c": ["detected"], "d": ["failed"]}
    assert {r.scene_id: (r.status, r.uri) for r in catalog.current(ledger).collect()} == {"a": ("detected", "a1"), "b": ("calibrated", "b3"), "c": ("detected", None), "d": ("failed", None)}
    twice = catalog.current(ledger.unionByName(ledger.withColumn("seq", F.col("seq") + 100).withColumn("at", F.col("at") + 100)))
    assert {r.scene_id: r.status for r in twice.collect()} == {"a": "detected", "b": "failed", "c": "detected", "d": "failed"}
    assert {r.status: r.n for r in catalog.state_counts(catalog.current(ledger)).collect()} == {"detected": 2, "calibrated": 1, "failed": 1}


def test_pages_of_a_scene_catalogue(spark):
    import json as js

    from tidewatch.operators import catalog

    one = {"Id": "1", "Name": "S1", "ContentDate": {"Start": "2024-01-05T01:02:03.000Z"}, "Footprint": "geography'SRID=4326;POLYGON ((1 2, 3 2, 3 4, 1 2))'", "Attributes": [{"Name": "orbitDirection", "Value": "ASC"}, {"Name": "relativeOrbitNumber", "Value": "34"}]}
    lines = [js.dumps({"value": [one, {"Id": "2", "Name": "S2"}, {"Name": "no id"}]}), js.dumps({"value": [one]}), "broken"]
    got = {r.scene_id: r for r in catalog.scene_pages(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert set(got) == {"1", "2"} and got["1"].footprint == "POLYGON ((1 2, 3 2, 3 4, 1 2))" and (got["1"].orbit_direction, got["1"].relative_orbit) == ("ASC", 34)
    assert got["2"].footprint is None and got["2"].sensed_at is None
