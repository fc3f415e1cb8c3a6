"""Tracks of a stream: the open hypotheses of each key as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geo import MAX_SPEED_KN
from tidewatch.operators import kernels

#: Open hypotheses as two byte strings (rows of five doubles, names), rows that wait for the watermark, and the last time judged.
STATE = "rows binary, names binary, waiting binary, last double"
LIVE = "key string, point_id long, ts timestamp, lat double, lon double, first_point long, n_points long, rivals long"


def live_tracks(stream: DataFrame, key: str = "key", time: str = "ts", delay: str = "10 minutes", break_s: float = 7 * 86_400.0, max_speed_kn: float = MAX_SPEED_KN) -> DataFrame:
    """LIVE rows: each report with the hypothesis it joins, named by its first report, as the batch builder has it.

    stream: key, point_id, a timestamp, lat, lon. Reports wait until the watermark (delay behind the latest one) has passed them and
    are then judged in the order of time and point_id, so batches of any cut give the same; a report behind the watermark is dropped. A
    hypothesis is real from its third report on (n_points); rivals counts other real ones of its key that overlap it, so that a
    positive number says the key is used twice. A key silent for the break leaves no state. Reports without a key, a time or a
    place take no part.

    State is the open hypotheses (48 bytes each) and the reports of one delay; a closed hypothesis leaves it.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    report = np.dtype([("us", "<i8"), ("point_id", "<i8"), ("lat", "<f8"), ("lon", "<f8")])

    def step(name, batches, state: GroupState):
        live, waiting, last = kernels.Live(), np.zeros(0, report), 0.0
        if state.exists:
            rows, names, held, last = state.get
            live = kernels.Live(np.frombuffer(rows).reshape(-1, 5).copy(), np.frombuffer(names, np.int64).copy())
            waiting = np.frombuffer(held, report)
        new = [waiting]
        for batch in batches:
            more = np.zeros(len(batch), report)
            for c in report.names:
                more[c] = batch[c].to_numpy()
            new.append(more)
        waiting = np.concatenate(new)
        waiting = waiting[np.lexsort((waiting["point_id"], waiting["us"]))]
        passed = state.getCurrentWatermarkMs()
        ready, waiting = waiting[waiting["us"] <= passed * 1000], waiting[waiting["us"] > passed * 1000]
        if len(ready):
            t = ready["us"] / 1e6
            first, n, rivals = kernels.follow(live, t, ready["lat"], ready["lon"], ready["point_id"], break_s, max_speed_kn)
            last = float(t[-1])
        closes = int((last + break_s) * 1000)
        if not len(waiting) and (not live.n or closes <= passed):
            state.remove()
        else:
            state.update((live.rows[: live.n].tobytes(), live.names[: live.n].tobytes(), waiting.tobytes(), last))
            wanted = int(waiting["us"][0] // 1000 + 1) if len(waiting) else closes
            state.setTimeoutTimestamp(max(wanted, passed + 1))
        if len(ready):
            yield pd.DataFrame({
                "key": name[0], "point_id": ready["point_id"], "ts": pd.to_datetime(ready["us"], unit="us", utc=True).tz_convert(zone),
                "lat": ready["lat"], "lon": ready["lon"], "first_point": first, "n_points": n, "rivals": rivals,
            })

    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    known = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("point_id").isNotNull())
    picked = known.withWatermark(time, delay).select(
        F.col(key).cast("string").alias("key"), F.col("point_id").cast("long").alias("point_id"), time, F.unix_micros(F.col(time)).alias("us"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")
    )
    return picked.groupBy("key").applyInPandasWithState(step, LIVE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
