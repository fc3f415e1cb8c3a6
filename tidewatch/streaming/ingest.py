"""Structured Streaming: idempotent landing, deduplication, windows and sessions.

Facts are never discarded: late rows go to their old day by the upsert in `foreachBatch`;
watermarks bound state only in the aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources import landing


def land_stream(stream: DataFrame, path: str, keys: list[str], time: str, checkpoint: str, once: bool = True):
    """Upsert every micro-batch; a repeated batch changes nothing."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: landing.land(df, path, keys, time))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 seconds")).start()


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def hourly_counts(stream: DataFrame, time: str = "ts", key: str = "kind", delay: str = "1 hour", length: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.avg("sog").alias("mean_sog"))


def live_sessions(stream: DataFrame, key: str = "key", time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n_points"), F.max(time).alias("last_ts"))


FRAGMENT_STATE = "began double, parts string"


def assembled_stream(parts: DataFrame, window_s: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """Whole payloads of a stream of fragments (seq, channel, n_parts, part, payload, ts), held by sequence and channel until complete.

    A first part begins a message and drops what was held; a message that waits longer than window_s is dropped, once the watermark
    (delay behind the latest part) has passed it. State is one open message a key.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        out = []
        if state.hasTimedOut:
            state.remove()
            return
        began, held = state.get if state.exists else (0.0, "{}")
        held = json.loads(held)
        for batch in batches:
            for r in batch.assign(s=batch["ts"].map(pd.Timestamp.timestamp)).sort_values(["s", "part"]).itertuples():
                if r.part == 1:
                    began, held = r.s, {}
                elif not held or r.s - began > window_s:
                    held = {}
                    continue
                held[str(r.part)] = r.payload
                if len(held) == r.n_parts:
                    out.append((pd.Timestamp(began, unit="s"), key[1], "".join(held[str(k + 1)] for k in range(r.n_parts))))
                    held = {}
        if held:
            state.update((began, json.dumps(held)))
            state.setTimeoutTimestamp(max(int((began + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["ts", "channel", "payload"])

    picked = parts.withWatermark("ts", delay).select("seq", "channel", "n_parts", "part", "payload", "ts")
    return picked.groupBy("seq", "channel").applyInPandasWithState(step, "ts timestamp, channel string, payload string", FRAGMENT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rules_on_stream(meetings: DataFrame, ownership: DataFrame, sanctions: DataFrame, path: str, checkpoint: str):
    """Every meeting of a stream against the present graph; alerts are appended to a table, a repeated batch's only once."""
    from tidewatch.operators import graph

    def one(batch: DataFrame, batch_id: int) -> None:
        graph.sanctioned_counterparts(batch, ownership, sanctions).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return meetings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start()


def mirror_closed(spark, source: str, target: str, hour: str, last: int = 6) -> list[str]:
    """Copy the last hourly partitions strictly older than `hour` (yyyy-MM-ddTHH) that the target lacks; their names."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    here, there = fs.Path(source), fs.Path(target)
    a, b = here.getFileSystem(conf), there.getFileSystem(conf)
    closed = sorted(s.getPath().getName() for s in a.listStatus(here) if s.getPath().getName().startswith("hour=") and s.getPath().getName()[5:] < hour)[-last:]
    moved = []
    for name in closed:
        if not b.exists(fs.Path(there, name)):
            part = fs.Path(there, f".{name}")
            fs.FileUtil.copy(a, fs.Path(here, name), b, part, False, True, conf)
            b.rename(part, fs.Path(there, name))
            moved.append(name)
    return moved
