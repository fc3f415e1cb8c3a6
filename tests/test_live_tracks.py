"""A stream in any order and any cut gives the batch builder's hypotheses."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewatch.operators import kernels
from tidewatch.streaming.tracks import live_tracks

SCHEMA = "key string, point_id long, ts timestamp, lat double, lon double"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BREAK_S = 4 * 3600.0


def reports(seed):
    """Keys with one hull, with two at once, with stray places and with silences."""
    rng = random.Random(seed)
    rows = []
    for key, hulls in (("one", 1), ("two", 2), ("three", 3)):
        for hull in range(hulls):
            t = 0.0
            for k in range(60):
                t += rng.choice([60, 200, 600, 600, 3000]) + (5 * 3600 if k in (25, 45) else 0) + hull
                far = rng.random() < 0.06
                rows.append((key, t, 10 + 3 * hull + t / 1e6 + (20 if far else 0), 60.0 + rng.random() / 1000))
    rows.sort(key=lambda r: r[1])
    return [(k, i, START + timedelta(seconds=t), lat, lon) for i, (k, t, lat, lon) in enumerate(rows)]


def named(points):
    """{point: first point of its hypothesis} of the batch builder."""
    first = points.groupBy("key", "segment", "hypothesis").agg(F.min_by("point_id", F.struct("t", "point_id")).alias("first"))
    return {r.point_id: r["first"] for r in points.join(first, ["key", "segment", "hypothesis"]).collect()}


def streamed(spark, tmp_path, batches, name):
    source = tmp_path / name
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    found = live_tracks(stream, delay="10 minutes", break_s=BREAK_S)
    q = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_a_stream_gives_the_batchs_hypotheses(spark, tmp_path):
    rows = reports(4)
    end = [("end", 10_000, START + timedelta(days=9), 0.0, 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.unix_micros("ts") / 1e6)
    wanted = named(kernels.build_tracks(frame, break_s=BREAK_S))
    rng = random.Random(1)
    # Reports come late by up to eight minutes.
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 480)))
    batches = [late[i : i + 70] for i in range(0, len(late), 70)]
    broken = [(None, 1, START + timedelta(days=1), 1.0, 1.0), ("one", 20_000, None, 1.0, 1.0), ("one", 20_001, START + timedelta(days=1), None, 1.0)]
    got = streamed(spark, tmp_path, [*batches, broken, end, [("end", 10_001, START + timedelta(days=10), 0.0, 0.0)]], "live_a").collect()
    mine = [r for r in got if r.key != "end"]
    assert len(mine) == len(rows) and {r.point_id: r.first_point for r in mine} == wanted
    assert {(r.point_id, r.ts.replace(tzinfo=timezone.utc)) for r in mine} == {(r[1], r[2]) for r in rows}
    sizes = {}
    for r in sorted(mine, key=lambda r: (r.ts, r.point_id)):
        sizes[r.first_point] = sizes.get(r.first_point, 0) + 1
        assert r.n_points == sizes[r.first_point]
    tracks = kernels.tracks_of(kernels.build_tracks(frame, break_s=BREAK_S))
    twice = {r.key for r in kernels.duplicate_identities(tracks).collect()}
    assert twice == {"two", "three"} == {r.key for r in mine if r.rivals > 0}


def test_reports_behind_the_watermark_are_dropped(spark, tmp_path):
    at = lambda i, m, lat=10.0: ("k", i, START + timedelta(minutes=m), lat, 60.0)
    batches = [[at(0, 0), at(1, 30)], [at(2, 60)], [at(3, 5), at(4, 90)], [at(5, 24 * 60)], [at(6, 48 * 60)], [at(7, 72 * 60)]]
    got = {r.point_id: r.first_point for r in streamed(spark, tmp_path, batches, "live_b").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 4: 0, 5: 5, 6: 6}
