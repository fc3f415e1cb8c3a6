import math

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import conduct, interest

FACTOR = "subject string, kind string, confidence double, t double"


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_alerts_as_factors(spark):
    a = spark.createDataFrame(
        [("a", "dark_vessel", 0.6, 1.0, None), ("a", "ais_spoofing", 0.5, 2.0, "confirm"), ("b", "dark_vessel", 0.9, 1.0, "dismiss"), ("b", "no_such_rule", 0.9, 1.0, None), ("c", "lane_deviation", None, None, "watch")],
        "subject string, rule string, score double, t double, disposition string",
    )
    f = rows(interest.of_alerts(a), "subject", "kind")
    assert set(f) == {("a", "dark_vessel"), ("a", "ais_spoofing"), ("c", "lane_deviation")}
    assert f["a", "dark_vessel"].confidence == 0.6 and f["a", "ais_spoofing"].confidence == pytest.approx(0.65) and f["c", "lane_deviation"].confidence == 0


def test_designations(spark):
    m = spark.createDataFrame(
        [("a", "X", "imo", True, "vessel", 1.0), ("a", "Y", "name", True, None, 2.0), ("b", "X", "call_sign_name", True, "owner", 1.0), ("c", "X", "name", False, "vessel", 1.0), ("d", "X", "imo", True, "owner", 1.0), ("d", None, "imo", True, "owner", 1.0)],
        "subject string, registry string, tier string, is_finding boolean, listed string, t double",
    )
    f = rows(interest.of_designations(m), "subject")
    assert set(f) == {("a",), ("b",), ("d",)}
    assert f["a",].kind == "sanctions_designation" and f["a",].confidence == pytest.approx(0.99) and f["a",].t == 2.0
    assert f["b",].kind == "sanctioned_ownership" and f["b",].confidence == pytest.approx(0.7)
    assert f["d",].confidence == pytest.approx(0.8)


def test_merging_tells_restatements_from_occurrences(spark):
    f = spark.createDataFrame(
        [("a", "dark_vessel", c, float(i)) for i, c in enumerate((0.5, 0.4, 0.3, 0.2))] + [("a", "flag_opacity", 0.5, None), ("a", "flag_opacity", 0.8, 7.0)] + [("b", "dark_vessel", 1.0, None), ("b", "dark_vessel", 1.0, None)], FACTOR
    )
    m = rows(interest.merged(f), "subject", "kind")
    assert m["a", "dark_vessel"].confidence == pytest.approx(1 - 0.5 * 0.6 * 0.7) and m["a", "dark_vessel"].n == 4 and m["a", "dark_vessel"].t == 3.0
    assert m["a", "flag_opacity"].confidence == 0.8
    assert m["b", "dark_vessel"].confidence == 0.99


def test_list_is_ranked_and_points_add_up(spark):
    f = spark.createDataFrame([("a", "dark_vessel", 0.8, 1.0), ("a", "flag_opacity", 0.5, 1.0), ("b", "port_risk_propagation", 0.5, 1.0), ("c", "dark_vessel", 0.8, 1.0), ("d", "dark_vessel", 0.8, 1.0)], FACTOR)
    s = interest.scored(interest.merged(f))
    by = rows(s, "subject", "kind")
    want = 1 - (1 - 0.85 * 0.8) * (1 - 0.3 * 0.5)
    assert by["a", "dark_vessel"].score == pytest.approx(want)
    assert by["a", "dark_vessel"].points + by["a", "flag_opacity"].points == pytest.approx(want)
    out = rows(interest.listed(s), "subject")
    assert [out[x,]["rank"] for x in "abcd"] == [1, None, 2, 3]
    assert out["b",].suppressed == "below_attention_threshold" and out["a",].families == "identity,motion" and out["a",].lead == "dark_vessel"


def test_context_alone_puts_nobody_on_the_list(spark):
    alerts = spark.createDataFrame([("a", "dark_vessel", 0.6, 1.0, None)], "subject string, rule string, score double, t double, disposition string")
    matches = spark.createDataFrame([], "subject string, registry string, tier string, is_finding boolean, listed string, t double")
    gaps = spark.createDataFrame([("g", 5.0, 1), ("g", 6.0, 1), ("h", 1.0, 0), ("i", 1.0, None)], "subject string, t double, assessed int")
    contacts = spark.createDataFrame([("7", "dark_candidate", 9.0, 0.97), ("8", "suppressed_size", 9.0, 0.9), ("9", "dark_candidate", None, 0.9)], "track string, status string, dark_from double, score double")
    own = spark.createDataFrame([("a", "o1", 1.0), ("o1", "o2", 1.0), ("z", "o2", 1.0), ("g", "o3", 1.0)], "src string, dst string, confidence double")
    sanctions = spark.createDataFrame([("o2", 0.0, None), ("o3", 0.0, 50.0)], "entity string, t_start double, t_end double")
    flags = spark.createDataFrame([("a", "PA", None), ("a", "IN", 3.0), ("z", "PA", None), ("g", "IN", None)], "subject string, flag string, t_end double")
    changes = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("z", 1.0)], "subject string, t double")
    f = rows(interest.collected(alerts, matches, gaps, contacts, own, sanctions, flags, changes, at=100.0), "subject", "kind")
    assert {k: round(v.confidence, 6) for k, v in f.items()} == {
        ("a", "dark_vessel"): 0.6, ("g", "assessed_ais_disabling"): 0.8, ("contact:radar:7", "transponder_shutdown"): 0.95, ("a", "sanctioned_ownership"): 0.65, ("a", "flag_opacity"): 0.65, ("g", "identity_change"): 0.8,
    }
    assert f["g", "assessed_ais_disabling"].t == 6.0


def test_steps_sink_when_out_of_range(spark):
    s = interest.scored(interest.merged(spark.createDataFrame([("a", "dark_vessel", 1.0, 1.0), ("b", "dark_vessel", 1.0, 1.0), ("n", "dark_vessel", 1.0, 1.0), ("a", "ais_spoofing", 0.5, 1.0)], FACTOR)))
    last = spark.createDataFrame([("a", 10.0, 70.1), ("b", 14.0, 70.0), ("n", None, None)], "subject string, lat double, lon double")
    stations = spark.createDataFrame([("s", 10.0, 70.0)], "port string, port_lat double, port_lon double")
    out = rows(interest.steps(s, last, stations), "subject", "action")
    assert out["a", "call_vhf"].feasible and out["a", "cue_eo_camera"].feasible and out["a", "call_vhf"].n_because == 2 and out["a", "call_vhf"].lead == "dark_vessel"
    assert not out["b", "call_vhf"].feasible and not out["n", "dispatch_patrol"].feasible and out["b", "monitor"].feasible
    assert out["b", "call_vhf"].priority == math.floor(90 + 40 * 0.85) - 60 and out["b", "check_imaging_opportunity"]["rank"] == 1


def test_findings_need_a_signal(spark):
    v = spark.createDataFrame([("a", "MV Star", "PA"), ("b", "Moon", "IN"), ("c", "Sun", None)], "subject string, name string, flag string")
    m = spark.createDataFrame(
        [("a", "X", "imo", True, "STAR", "PA"), ("a", "Y", "imo", True, "Comet", "IR"), ("b", "X", "name", False, "Moon", "IN"), ("c", "X", "call_sign_name", True, "Sun", "IN")], "subject string, registry string, tier string, is_finding boolean, name string, flag string"
    )
    g = spark.createDataFrame([("b", 1), ("b", 1), ("c", 0), ("d", None)], "subject string, assessed int")
    e = spark.createDataFrame([("a", "k"), ("a", "k")], "subject string, kind string")
    k = spark.createDataFrame([("b", 2), ("b", 1)], "subject string, tier int")
    out = rows(interest.findings(v, m, g, e, k), "subject")
    assert set(out) == {("a",), ("b",)}
    assert out["a",].priority == 750 and out["a",].basis == "multi_registry,imo_match,name_disagreement,flag_disagreement" and out["a",].n_events == 2
    assert out["b",].priority == 1000 and out["b",].n_gaps == 2 and out["b",].best_tier == 1


MEET = "key_a long, key_b long, t_start double, t_end double, lat double, lon double, confidence double"


def test_meetings_need_a_silent_party(spark):
    m = spark.createDataFrame(
        [(1, 2, 1000.0, 5000.0, 12.0, 65.0, 0.8), (3, 4, 1000.0, 5000.0, 12.5, 65.0, 0.8), (5, 6, 1000.0, 5000.0, 18.9, 72.8, 1.0), (7, 8, 1000.0, 5000.0, 14.0, 65.0, 1.0), (9, 10, 1000.0, 5000.0, 12.0, 66.0, 0.1)], MEET
    )
    waiting = spark.createDataFrame([("p", 18.9, 72.8)], "port string, port_lat double, port_lon double")
    silent = spark.createDataFrame([(2, 5000.0 + 899), (6, 2000.0), (7, 6000.0)], "key long, t double")
    untracked = spark.createDataFrame([(12.51, 65.0, 1000.0 + 43_000), (14.0, 65.01, 1000.0 - 43_200), (14.05, 65.0, 1000.0), (12.0, 66.0, 1000.0)], "lat double, lon double, t double")
    out = rows(conduct.silent_meetings(m, waiting, silent, untracked), "subject")
    assert set(out) == {("1",), ("3",)}
    assert out["1",].score == pytest.approx(0.35 + 0.35 * 0.8 + 0.25) and out["1",].evidence == "party" and out["1",].counterpart == "2"
    assert out["3",].score == pytest.approx(0.35 + 0.35 * 0.8 + 0.1) and out["3",].evidence == "footprint"


def test_loitering_not_at_anchor(spark):
    fixes = [(1, i, i * 600.0, 12.0, 65.0, 1.0) for i in range(16)] + [(2, 100 + i, i * 600.0, 18.9, 72.8, 1.0) for i in range(16)] + [(3, 200 + i, i * 600.0, 12.0, 65.0, 1.0 if i != 8 else 5.0) for i in range(16)]
    p = spark.createDataFrame(fixes, "key long, point_id long, t double, lat double, lon double, sog double")
    waiting = spark.createDataFrame([("p", 18.9, 72.8)], "port string, port_lat double, port_lon double")
    runs = conduct.slow_outside(p, waiting, least_s=5400)
    assert [r.key for r in runs.collect()] == [1]
    ring = [{"lat": a, "lon": o} for a, o in ((11.5, 64.5), (11.5, 65.5), (12.5, 65.5), (12.5, 64.5), (11.5, 64.5))]
    zones = spark.createDataFrame([("z", ring, 12.0, 65.0, 50_000.0), ("y", ring, 0.0, 0.0, None)], "zone_id string, ring array<struct<lat double, lon double>>, centre_lat double, centre_lon double, radius_m double")
    out = conduct.loitering(runs, zones).collect()
    assert [(r.subject, r.evidence) for r in out] == [("1", "z")] and out[0].score == pytest.approx(0.5 + 0.3 + 0.1 * 2.5 / 6)


def test_first_visits_must_be_far(spark):
    places = spark.createDataFrame([("a", 10.0, 70.0), ("b", 10.1, 70.0), ("c", 10.2, 70.0), ("d", 11.0, 70.0), ("e", 20.0, 70.0), ("f", 15.0, 70.0)], "zone string, lat double, lon double")
    trips = {1: "abcde", 2: "abe", 3: "abcd", None: "abce", 4: "abcaef", 5: "eabcf"}
    v = spark.createDataFrame([(k, z, float(i)) for k, zs in trips.items() for i, z in enumerate(zs)], "key long, zone string, t double")
    out = {(r.subject, r.evidence): round(r.score, 6) for r in conduct.maiden_visits(v, places).collect()}
    assert out == {("1", "e"): 0.75, ("4", "e"): 0.7, ("4", "f"): 0.75, ("5", "f"): 0.75}
    at_once = spark.createDataFrame([(1, z, t) for z, t in (("a", 0.0), ("b", 1.0), ("c", 2.0), ("e", 9.0), ("f", 9.1))], "key long, zone string, t double")
    assert {r.evidence for r in conduct.maiden_visits(at_once, places).collect()} == {"e", "f"}
    empty = conduct.maiden_visits(v.filter(F.lit(False)), places)
    assert empty.count() == 0


def test_meetings_surely_near_a_contact_need_no_pairs(spark):
    import random

    rng = random.Random(2)
    place = lambda: rng.choice(((15.0, 65.0, 0.08), (72.0, 179.95, 0.15)))
    spot = lambda: (lambda a, o, w: (a + rng.random() * 0.08, (o + rng.random() * w + 180) % 360 - 180))(*place())
    contacts = [(*spot(), float(rng.randrange(-200_000, 200_000))) for _ in range(60)]
    meetings = [(f"a{i}", "b", float(rng.randrange(-200_000, 200_000)), *spot()) for i in range(300)]
    m = spark.createDataFrame([(a, b, t, t + 900, x, y, 1.0) for a, b, t, x, y in meetings], "key_a string, key_b string, t_start double, t_end double, lat double, lon double, confidence double")
    c = spark.createDataFrame(contacts, "lat double, lon double, t double")
    far = lambda p, q: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2))
    want = {a for a, _, t, x, y in meetings if any(abs(u - t) < 43_200 and far((x, y), (v, w)) < 3000 for v, w, u in contacts)}
    sure = {r.key_a for r in conduct.surely_near(m, c).filter("sure").collect()}
    assert sure <= want and len(sure) > len(want) / 4
    nowhere = spark.createDataFrame([("w", 0.0, 0.0)], "port string, port_lat double, port_lon double")
    found = conduct.silent_meetings(m, nowhere, spark.createDataFrame([], "key string, t double"), c)
    assert {r.subject for r in found.collect()} == want


def test_meetings_of_a_crowd_are_one_row_a_subject_and_start(spark, monkeypatch):
    import itertools
    import random

    from tidewatch.operators import proximity

    rng = random.Random(5)
    far = lambda p, q: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2))
    track = {}
    for k in range(24):
        y, x = 15.2 + rng.uniform(-0.004, 0.004), 65.12 + rng.uniform(-0.004, 0.004)
        for i in range(100, 140):
            y, x = y + rng.uniform(-6e-4, 6e-4), x + rng.uniform(-6e-4, 6e-4)
            if rng.random() < 0.97:
                track[k, i] = (y, x, rng.uniform(0, 2.05))
    silent = [(rng.randrange(24), rng.randrange(29_000, 43_000) + rng.choice((0.0, 0.25))) for _ in range(25)] + [(3, 33_900.0), (4, 32_100.0)]
    slow = {ki for ki, v in track.items() if v[2] <= 2}
    want = {}
    for a, b in itertools.combinations(range(24), 2):
        run = []
        for i in range(100, 142):
            if {(a, i), (b, i)} <= slow and far(track[a, i], track[b, i]) <= 500:
                run.append(i)
                continue
            if len(run) >= 3:
                party = any(k in (a, b) and run[0] * 300 - 900 <= t <= run[-1] * 300 + 900 for k, t in silent)
                want[a, b, run[0] * 300] = (run[-1] * 300, len(run), party, min(far(track[a, i], track[b, i]) for i in run), sum(track[a, i][0] + track[b, i][0] for i in run) / 2 / len(run))
            run = []
    g = spark.createDataFrame([(k, i * 300, *v) for (k, i), v in track.items()], "key long, t long, lat double, lon double, sog double")
    s = spark.createDataFrame(silent, "key long, t double")
    assert len(want) > 300 and {v[2] for v in want.values()} == {True, False} and max(v[1] for v in want.values()) > 12
    for steps, ahead in ((5, 0), (7, 3), (48, 8)):
        met = proximity.encounters(g, steps=steps, ahead=ahead, marks=conduct.silences(s))
        got = {(r.key_a, r.key_b, r.t_start): r for r in met.collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert (r.t_end, r.n, r.marked) == want[k][:3] and math.isclose(r.min_distance_m, want[k][3], abs_tol=1e-6) and math.isclose(r.lat, want[k][4])
    written, cut = [], conduct.cut
    met = cut(met)
    monkeypatch.setattr(conduct, "cut", lambda d: (lambda c: (written.append(c.count() if "key_a" in c.columns else 0), c)[1])(cut(d)))
    nowhere = spark.createDataFrame([("w", 0.0, 0.0)], "port string, port_lat double, port_lon double")
    told = lambda m, silent_, seen: {(r.subject, r.t, round(r.score, 9)) for r in conduct.silent_meetings(m, nowhere, silent_, seen).collect()}
    for seen in ([(15.2, 65.12, 36_000.0)], [(15.2 + 0.03, 65.12, -5_000.0)], []):
        c = spark.createDataFrame(seen, "lat double, lon double, t double")
        few = told(met, None, c)
        assert few == told(met.drop("marked"), s, c)
        n = {}
        for (a, b, t), v in want.items():
            foot = any(abs(u - t) < 43_200 and far((got[a, b, t].lat, got[a, b, t].lon), (y, x)) < 3000 for y, x, u in seen)
            score = min(1.0, 0.35 + 0.35 * got[a, b, t].confidence + 0.25 * v[2] + 0.1 * foot)
            if (v[2] or foot) and score >= 0.5:
                n[str(a), float(t)] = max(n.get((str(a), float(t)), 0), round(score, 9))
        assert few == {(*k, v) for k, v in n.items()}
        if seen != [(15.2 + 0.03, 65.12, -5_000.0)]:
            assert written[1] <= len(n) < len(want) / 1.3  # nothing of the size of the pairs is written
        written.clear()
