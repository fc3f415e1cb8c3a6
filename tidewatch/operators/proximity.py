"""Spatial joins: grid cells and time buckets as equi-join keys, the exact predicate as residual."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.functions import geo, grid

#: Cells of places that are broadcast; more are joined by a shuffle of the points on their cell.
BROADCAST_CELLS = 200_000
#: Steps of time in a block of meetings, and the tasks that tiles and blocks are dealt to.
STEPS, PARTS = 8, 96
#: Radii that a tile of a search for pairs is wide.
TILE = 8


def within_radius(points: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows within a radius of a place, with distance_m; rows outside its latitudes go before the distance is found."""
    pad = radius_m / 111_000 * 1.01
    box = F.col("lat").between(lat - pad, lat + pad)
    return points.filter(box).withColumn("distance_m", geo.haversine("lat", "lon", lat, lon)).filter(F.col("distance_m") <= radius_m)


def near(left: DataFrame, right: DataFrame, radius_m: float, on: tuple = (), where: str | None = None, below: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows of left and right (both lat, lon) within a radius and equal in `on`, with distance_m; right's place as _lat, _lon.

    right is spread over the tiles that its circle touches, a left row has one; tiles are TILE times as wide as the radius at any latitude, so that few
    rows are sent to many. A task finds the pairs of a tile in arrays. The pairs' work does not follow their bytes, so both sides are dealt to a
    number of tasks of its own. where: a condition on pairs; below: a column of left that must be below one of right, tested before pairs are made.
    """
    if not 0 < radius_m <= 100_000:
        raise ValueError("a radius of up to 100 km")
    size = TILE * radius_m / grid.DEGREE_M * 1.000001
    known = " and ".join(["lat is not null", "lon is not null", *(f"`{c}` is not null" for c in on)])
    other = right.filter(known).withColumn("_cell", F.explode(grid.fitted_reach("lat", "lon", radius_m, size))).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    mine = left.filter(known).withColumn("_cell", grid.fitted("lat", "lon", size))
    side = lambda d, name: d.select("_cell", *on, F.struct(*(c for c in d.columns if c not in ("_cell", *on))).alias(name))
    met = side(mine, "_l").unionByName(side(other, "_r"), allowMissingColumns=True).repartition(2 * PARTS, "_cell", *on).sortWithinPartitions("_cell", *on)
    fields = [*(met.schema[c] for c in on), *met.schema["_l"].dataType.fields, *met.schema["_r"].dataType.fields, T.StructField("distance_m", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ("_cell", *on)):
            for at, mates, i, j, d in _within(block, ("_cell", *on), radius_m, below):
                held = pa.array(at[i])
                l, r = block.column("_l").take(held).flatten(), block.column("_r").take(pa.array(mates[j])).flatten()  # noqa: E741
                yield pa.RecordBatch.from_arrays([*(block.column(c).take(held) for c in on), *l, *r, pa.array(d)], [f.name for f in fields])

    out = met.mapInArrow(run, T.StructType(fields))
    return out.filter(where) if where else out


def blocks(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that hold whole groups."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        before = [x.column(c)[-1].as_py() for x in waiting[-1:] for c in by]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
        whole = int(cuts[-1]) if len(cuts) else 0
        if waiting and (whole or before != [x[0] for x in at]):
            head = [*waiting, batch.slice(0, whole)]
            yield pa.Table.from_batches(head).combine_chunks().to_batches()[0]
            waiting = []
        elif whole:
            yield batch.slice(0, whole)
        waiting.append(batch.slice(whole))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _within(block: pa.RecordBatch, by: tuple[str, ...], radius_m: float, below: tuple[str, str] | None, most: int = 1_000_000) -> Iterator[tuple]:
    """Rows of left and right of each group of a block, index pairs into both that lie within the radius, and their distance, some `most` candidates at a time."""
    right = block.column("_l").is_null().to_numpy(zero_copy_only=False)
    if right.all() or not right.any():
        return
    both = {}
    for k, (side, here) in enumerate((("_l", ~right), ("_r", right))):
        held = block.column(side).filter(pa.array(here))
        of = lambda c: held.field(c).to_numpy(zero_copy_only=False)  # noqa: B023,E731
        names = ("lat", "lon") if side == "_l" else ("_lat", "_lon")
        both[side] = (np.flatnonzero(here), *(of(c).astype(float) for c in names), of(below[k]) if below else None)
    keys = [block.column(c).to_numpy(zero_copy_only=False) for c in by]
    starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])])
    for begin, end in zip(starts, [*starts[1:], len(right)], strict=True):
        (at, lat, lon, low), (mates, lat2, lon2, up) = ([None if x is None else x[slice(*np.searchsorted(rows[0], (begin, end)))] for x in rows] for rows in both.values())
        if not len(at) or not len(mates):
            continue
        high = radius_m / grid.DEGREE_M * 1.000001
        top = min(max(np.abs(lat).max(), np.abs(lat2).max()) + high, 90.0)
        ratio = np.sin(np.radians(high)) / max(np.cos(np.radians(top)), 1e-9)
        width = 720.0 if top >= 90 or ratio >= 1 else np.degrees(np.arcsin(ratio)) * 1.000001
        away, away2 = (lon - lon[0] + 180) % 360, (lon2 - lon[0] + 180) % 360  # the strips' edge lies across the globe
        strips = width < 60 and min(away.min(), away2.min()) > width and max(away.max(), away2.max()) < 360 - width
        strip, strip2 = (np.floor(x / width) if strips else np.zeros(len(x)) for x in (away, away2))
        order = np.lexsort((lat2, strip2))
        place = strip2[order] * 1000 + lat2[order]
        a, o, a2, o2 = (np.radians(x) for x in (lat, lon, lat2, lon2))
        for step in (-1, 0, 1) if strips else (0,):
            mine = (strip + step) * 1000 + lat
            start, stop = np.searchsorted(place, mine - high), np.searchsorted(place, mine + high, "right")
            count, first = stop - start, 0
            upto = np.cumsum(count)
            while first < len(at):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right")))
                k = count[first:last]
                i = np.repeat(np.arange(first, last), k)
                j = order[np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + start[i]]
                if below:
                    keep = low[i] < up[j]
                    i, j = i[keep], j[keep]
                d = _distance(a[i], o[i], a2[j], o2[j])
                keep = d <= radius_m
                if keep.any():
                    yield at, mates, i[keep], j[keep], d[keep]
                first = last


def nearest_place(points: DataFrame, places: DataFrame, radius_m: float, name: str = "port") -> DataFrame:
    """Each point's nearest place within a radius (null if none), distance_m with it.

    Places go by the cells that their radius touches, one row a cell with all its places, so every point meets one row
    at most: the points are neither grouped nor joined back.
    """
    res = next(r for r in sorted(grid.EDGE, reverse=True) if grid.EDGE[r] * 111_000 >= radius_m / 2 or r == 4)
    covered = places.withColumn("_cell", F.explode(grid.reach(f"{name}_lat", f"{name}_lon", radius_m, res)))
    by_cell = covered.groupBy("_cell").agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(f"{name}_lat").alias("lat"), F.col(f"{name}_lon").alias("lon"))).alias("_places"))
    met = points.withColumn("_cell", grid.cell("lat", "lon", res)).join(F.broadcast(by_cell) if by_cell.count() <= BROADCAST_CELLS else by_cell, "_cell", "left")
    far = F.transform("_places", lambda p: F.struct(geo.haversine("lat", "lon", p["lat"], p["lon"]).alias("d"), p["name"].alias("name")))
    best = F.array_min(F.filter(far, lambda p: p["d"] <= radius_m))
    return met.withColumn("_best", best).withColumn(name, F.col("_best.name")).withColumn("distance_m", F.col("_best.d")).drop("_cell", "_places", "_best")


def encounters(
    grid_points: DataFrame, key: str = "key", step_s: int = 300, radius_m: float = 500.0, max_sog: float = 2.0, least_samples: int = 3, steps: int = STEPS, ahead: int = 0, marks: DataFrame | None = None
) -> DataFrame:
    """Pairs of keys that stay within a radius at low speed on consecutive time steps.

    grid_points: resampled positions (key, t on the grid, lat, lon, sog), one a key and step. A key's steps go in blocks, with the step before and
    the ones after, to the tiles that their circles touch. So a task sees whether a pair stays close, and gives runs of a block, not pairs of
    a step. A run that begins in its block and ends there or in the steps `ahead` of it is whole and goes on as it is found, neither shuffled nor
    written; the pieces of others are found from the blocks' ends and shuffled to be joined. steps: of a block; long ones tear fewer runs, short ones
    suit keys that cross tiles quickly; ahead: how many steps of the next block a run is followed, so that only those that last longer are torn.
    marks: (key, t_from, t_to), ends included; a run is then `marked` if either of its keys is so at one of its steps.
    """
    if not 0 <= ahead < steps <= 60 - ahead:
        raise ValueError("a block of up to 60 steps with those ahead, and fewer ahead than its own")
    block = F.floor(F.col("t") / (step_s * steps))
    at = F.round((F.col("t") - block * step_s * steps) / step_s).cast("int") + 1
    more = lambda here, to, slot: F.when(here, F.array(F.struct(to.alias("block"), slot.alias("at")))).otherwise(F.array().cast("array<struct<block:bigint,at:int>>"))
    slots = F.concat(F.array(F.struct(block.alias("block"), at.alias("at"))), more(at <= ahead + 1, block - 1, at + steps), more(at == steps, block + 1, F.lit(0)))
    slow = grid_points.filter((F.col("sog") <= max_sog) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = slow.select(key, "lat", "lon", "sog", F.explode(slots).alias("s")).select(F.col(key).alias("key"), "s.block", F.struct(F.col("s.at").cast("tinyint").alias("at"), "lat", "lon", "sog").alias("p"))
    if marks is not None:
        placed = placed.unionByName(_mark_bits(marks, key, step_s, steps, ahead), allowMissingColumns=True)
    else:
        placed = placed.withColumn("bits", F.lit(0).cast("long"))
    wide = placed.groupBy("key", "block").agg(F.collect_list("p").alias("p"), F.coalesce(F.bit_or("bits"), F.lit(0).cast("long")).alias("bits")).filter(F.size("p") > 0)
    least_m = max(8 * radius_m, max_sog * geo.KNOT * step_s * steps)  # a tile is as wide as the way of a block, so that few keys go to many
    res = next(r for r in sorted(grid.LEVELS, reverse=True) if grid.LEVELS[r] * grid.DEGREE_M >= least_m or r == min(grid.LEVELS))
    own = F.filter("p", lambda x: x["at"].between(1, steps))
    touched = F.array_distinct(F.flatten(F.transform(own, lambda x: grid.reach(x["lat"], x["lon"], radius_m, res))))
    dealt = wide.select("key", "block", "bits", *(F.col(f"p.{c}").alias(c) for c in ("at", "lat", "lon", "sog")), F.explode(touched).alias("cell")).repartition(PARTS, "cell", "block").sortWithinPartitions("cell", "block")
    kind = dict(grid_points.dtypes)[key]
    pieces = "key_a {0}, key_b {0}, t_start long, t_end long, n long, min_distance_m double, sog double, lat double, lon double, marked boolean".format(kind)
    found = lambda whole: dealt.mapInPandas(lambda frames: _close_runs(frames, step_s, radius_m, least_samples, res, steps, ahead, whole), pieces)
    sums = (F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.sum("n").alias("n"), F.min("min_distance_m").alias("min_distance_m"), *(F.sum(c).alias(c) for c in ("sog", "lat", "lon")), F.bool_or("marked").alias("marked"))
    w = Window.partitionBy("key_a", "key_b").orderBy("t_start")
    torn = found(False).withColumn("_new", F.when(F.col("t_start") - F.lag("t_end").over(w) <= 1.5 * step_s, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    joined = torn.groupBy("key_a", "key_b", "run").agg(*sums).drop("run").filter(F.col("n") >= max(2, least_samples))
    out = found(True).unionByName(joined)
    out = out.select(
        F.col("key_a").alias(f"{key}_a"), F.col("key_b").alias(f"{key}_b"), "t_start", "t_end", "n", "min_distance_m", (F.col("sog") / F.col("n")).alias("mean_sog"), *((F.col(c) / F.col("n")).alias(c) for c in ("lat", "lon")),
        *(["marked"] if marks is not None else []),
    )
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 3 * (1 - F.col("min_distance_m") / 1000)))


def _mark_bits(marks: DataFrame, key: str, step_s: int, steps: int, ahead: int) -> DataFrame:
    """(key, block, bits) of marks: a bit for every step of a block and ahead of it, from bit 1, that lies in one of the key's marks."""
    first, last = F.ceil(F.col("t_from") / step_s), F.floor(F.col("t_to") / step_s)
    span = marks.select(F.col(key).alias("key"), first.alias("_f"), last.alias("_l")).filter("_f <= _l").repartition("key")  # as the steps are, which then stay where they are
    span = span.withColumn("block", F.explode(F.sequence(F.floor((F.col("_f") - ahead) / steps), F.floor(F.col("_l") / steps))))
    low, high = F.greatest(F.col("_f") - F.col("block") * steps, F.lit(0)), F.least(F.col("_l") - F.col("block") * steps, F.lit(steps + ahead - 1))
    bits = 4 * grid.bit(high) - 2 * grid.bit(low)
    return span.select("key", "block", bits.alias("bits")).groupBy("key", "block").agg(F.bit_or("bits").alias("bits"))


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of sorted rows, each as one frame."""
    waiting: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        ids = frame[by].to_numpy()
        ends = [*(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(frame)]
        if waiting and (waiting[-1][by].iloc[-1].to_numpy() != ids[0]).any():
            yield pd.concat(waiting, ignore_index=True)
            waiting = []
        begin = 0
        for end in ends:
            waiting.append(frame.iloc[begin:end])
            if end < len(frame):
                yield pd.concat(waiting, ignore_index=True)
                waiting = []
            begin = end
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def _distance(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    """Metres between places in radians; nan where one is unknown."""
    h = np.sin((lat_b - lat_a) / 2) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin((lon_b - lon_a) / 2) ** 2
    return 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _candidates(lat: np.ndarray, lon: np.ndarray, radius_m: float, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that hold every pair within the radius once, some `most` at a time. Places lie in strips of longitude and are sorted by latitude."""
    high = radius_m / grid.DEGREE_M * 1.000001
    top = min(np.abs(lat).max() + high, 90.0)
    ratio = np.sin(np.radians(high)) / max(np.cos(np.radians(top)), 1e-9)
    width = 720.0 if top >= 90 or ratio >= 1 else np.degrees(np.arcsin(ratio)) * 1.000001
    away = (lon - lon[0] + 180) % 360  # the strips' edge lies across the globe
    strip = np.floor(away / width) if width < 60 and away.min() > width and away.max() < 360 - width else np.zeros(len(lon))
    order = np.lexsort((lat, strip))
    place = strip[order] * 1000 + lat[order]
    first = np.arange(len(lat))
    for start, stop in ((first + 1, np.searchsorted(place, place + high, "right")), (np.searchsorted(place, place + 1000 - high), np.searchsorted(place, place + 1000 + high, "right"))):
        count = np.maximum(stop - start, 0)
        upto = np.cumsum(count)
        begin = 0
        while begin < len(lat):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right")))
            k = count[begin:end]
            if k.sum():
                left = np.repeat(first[begin:end], k)
                yield order[left], order[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[begin:end], k)]
            begin = end


def _close_runs(frames: Iterator[pd.DataFrame], step_s: int, radius_m: float, least: int, res: int, steps: int, ahead: int, whole: bool) -> Iterator[pd.DataFrame]:
    """Runs of close steps of each tile and block: those that begin in it, end before its steps ahead do and are long enough, or else the pieces of longer ones."""
    edge, last = grid.LEVELS[res], steps + ahead
    # Whole runs are followed from their first step. A piece is the part of a longer run that no block before has followed: either it goes on from
    # one, or it is found at the block's last step and followed back to its first.
    starts = range(1, steps + 1) if whole else (ahead + 1, steps)
    for frame in _groups(frames, ["cell", "block"]):
        names, code = np.unique(frame["key"].to_numpy(), return_inverse=True)
        lat, lon, sog = _matrices(frame, last + 2)
        mark = (frame["bits"].to_numpy(np.int64)[:, None] >> np.arange(last + 2) & 1).astype(bool)
        row, col = np.floor((lat + 90) / edge), np.floor((lon + 180) / edge) % round(360 / edge)
        tile, start = int(frame["cell"].iloc[0]), int(frame["block"].iloc[0]) * steps
        own = (row == tile >> 29 & (1 << 29) - 1) & (col == tile & (1 << 29) - 1)
        a, o = np.radians(lat), np.radians(lon)
        for turn, s in enumerate(starts):
            back = not whole and turn == 1
            here = np.flatnonzero(~np.isnan(lat[:, s]))
            if len(here) < 2 or not own[:, s].any():
                continue
            for i, j in _candidates(lat[here, s], lon[here, s], radius_m):
                i, j = here[i], here[j]
                i, j = np.where(code[i] < code[j], i, j), np.where(code[i] < code[j], j, i)
                keep = own[j, s] & (code[i] != code[j])  # a pair is its later key's tile's
                i, j = i[keep], j[keep]
                d = _distance(a[i, s], o[i, s], a[j, s], o[j, s])
                keep = d <= radius_m
                i, j, d = i[keep], j[keep], d[keep]
                for k in (s - 1,) if whole else range(steps + 1, last + 2) if back else range(ahead, -1, -1):
                    keep = (_distance(a[i, k], o[i, k], a[j, k], o[j, k]) <= radius_m) != whole
                    i, j, d = i[keep], j[keep], d[keep]
                n, sums, marked = np.ones(len(i), np.int64), [(x[i, s] + x[j, s]) / 2 for x in (sog, lat, lon)], mark[i, s] | mark[j, s]

                def followed(ks: range) -> np.ndarray:
                    """Adds the steps that pairs stay close; gives those still close at the last one, which is not added if it lies outside."""
                    alive = np.arange(len(i))
                    for k in ks:
                        then = _distance(a[i[alive], k], o[i[alive], k], a[j[alive], k], o[j[alive], k])
                        on = then <= radius_m
                        alive, then = alive[on], then[on]
                        if not 1 <= k <= last or not len(alive):
                            break
                        n[alive] += 1
                        d[alive] = np.minimum(d[alive], then)
                        marked[alive] |= mark[i[alive], k] | mark[j[alive], k]
                        for x, total in zip((sog, lat, lon), sums, strict=True):
                            total[alive] += (x[i[alive], k] + x[j[alive], k]) / 2
                    return alive

                alive = followed(range(s + 1, last + 1 + (not back)))
                begin = np.full(len(i), start + s - 1)
                if back:
                    upto = n.copy()
                    alive = followed(range(s - 1, -1, -1))
                    begin -= n - upto
                keep = n >= (max(2, least) if whole else 1)
                if whole or back:  # what goes on at the other end is a piece, or a block's before
                    keep[alive] = False
                if keep.any():
                    t = begin[keep] * step_s
                    yield pd.DataFrame({
                        "key_a": names[code[i[keep]]], "key_b": names[code[j[keep]]], "t_start": t, "t_end": t + (n[keep] - 1) * step_s, "n": n[keep], "min_distance_m": d[keep],
                        "sog": sums[0][keep], "lat": sums[1][keep], "lon": sums[2][keep], "marked": marked[keep],
                    })


def _matrices(frame: pd.DataFrame, width: int) -> list[np.ndarray]:
    """lat, lon and sog of a frame's lists as one row a key and one column a step; nan where a key has none."""
    at = frame["at"].to_numpy()
    rows, cols = np.repeat(np.arange(len(frame)), [len(x) for x in at]), np.concatenate(at).astype(np.int64)
    out = []
    for c in ("lat", "lon", "sog"):
        m = np.full((len(frame), width), np.nan)
        m[rows, cols] = np.concatenate(frame[c].to_numpy())
        out.append(m)
    return out


def in_zones(points: DataFrame, zones: DataFrame, res: int = 5) -> DataFrame:
    """(point columns, zone_id) for each zone that covers a point. zones: zone_id and rings (parts and holes), or one ring of struct(lat, lon)."""
    shape = zones.drop("ring") if "rings" in zones.columns else zones.withColumn("rings", F.array("ring")).drop("ring")
    lats, lons = (F.flatten(F.transform("rings", lambda r: r[c])) for c in ("lat", "lon"))
    covered = shape.withColumn("cell", F.explode(grid.cover_box(F.array_min(lats), F.array_min(lons), F.array_max(lats), F.array_max(lons), res)))
    return points.withColumn("cell", grid.cell("lat", "lon", res)).join(covered, "cell").filter(geo.rings_contain("lat", "lon", F.col("rings"))).drop("cell", "rings")


def overlaps(left: DataFrame, right: DataFrame, key: str, bucket_s: float = 86_400.0) -> DataFrame:
    """Interval overlap join on a key: rows of left (t_start, t_end) with rows of right (r_start, r_end).

    Both sides are exploded over the time buckets they touch; a pair is taken in its first common bucket only.
    """
    spread = lambda d, a, b: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / bucket_s), F.floor(F.col(b) / bucket_s))))
    joined = spread(left, "t_start", "t_end").join(spread(right, "r_start", "r_end"), [key, "_b"])
    first = F.greatest(F.floor(F.col("t_start") / bucket_s), F.floor(F.col("r_start") / bucket_s))
    return joined.filter((F.col("t_start") <= F.col("r_end")) & (F.col("t_end") >= F.col("r_start")) & (F.col("_b") == first)).drop("_b")


def receipts_between(intervals: DataFrame, points: DataFrame, key: str = "key") -> DataFrame:
    """intervals with n_receipts: the key's points in [t_start, t_end], ends included (0 if none).

    A running count at each end, found by one sort of both sides, instead of a range join.
    """
    asked = intervals.select(key, "t_start", "t_end").distinct()
    marks = asked.select("*", F.explode(F.array(F.struct(F.col("t_start").alias("_t"), F.lit(0).alias("_o"), F.lit(-1).alias("_s")), F.struct(F.col("t_end").alias("_t"), F.lit(2).alias("_o"), F.lit(1).alias("_s")))).alias("_m"))
    both = marks.select(key, "t_start", "t_end", "_m.*").unionByName(points.select(key, F.col("t").alias("_t"), F.lit(1).alias("_o"), F.lit(0).alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_c", F.sum(F.when(F.col("_s") == 0, 1).otherwise(0)).over(w)).filter("_s <> 0")
    return intervals.join(seen.groupBy(key, "t_start", "t_end").agg(F.sum(F.col("_s") * F.col("_c")).alias("n_receipts")), [key, "t_start", "t_end"])
