"""The catalogue of scenes as an append-only ledger of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States of a scene in the order it passes them, and the one that stands beside them (fixed values).
STATES, FAILED = ("cataloged", "raw", "calibrated", "detected"), "failed"

_PAGE = "struct<value:array<struct<Id:string,Name:string,ContentDate:struct<Start:string>,Footprint:string,Attributes:array<struct<Name:string,Value:string>>>>>"


def scene_pages(lines: DataFrame, line: str = "line") -> DataFrame:
    """Scenes from pages of a catalogue service (one JSON page a line), each once: scene_id, title, sensed_at, footprint (WKT), orbit_direction, relative_orbit."""
    found = lines.select(F.explode(F.from_json(line, _PAGE)["value"]).alias("s")).filter("s.Id is not null")
    said = lambda name: F.get(F.filter("s.Attributes", lambda a: a["Name"] == name), F.lit(0))["Value"]
    wkt = F.regexp_extract("s.Footprint", r"((?:MULTI)?POLYGON ?\(.*\))", 1)
    rows = found.select(
        F.col("s.Id").alias("scene_id"), F.col("s.Name").alias("title"), F.to_timestamp("s.ContentDate.Start").alias("sensed_at"), F.when(wkt != "", wkt).alias("footprint"),
        said("orbitDirection").alias("orbit_direction"), said("relativeOrbitNumber").try_cast("int").alias("relative_orbit"),
    )
    return rows.groupBy("scene_id").agg(*(F.min(c).alias(c) for c in rows.columns if c != "scene_id"))


def accepted(ledger: DataFrame) -> DataFrame:
    """The rows of a ledger (scene_id, status, at, seq) that change a scene's state.

    A step goes forward only: a state at or before the furthest one reached changes nothing, so repeats and late arrivals are harmless. A failure is
    taken from any state but the last one, and once until the scene goes on. Unknown states are refused. Since refused steps never reach further than
    taken ones, the furthest state before a row is a running maximum over all rows.
    """
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    w = Window.partitionBy("scene_id").orderBy("at", "seq")
    rows = ledger.withColumn("_rank", rank).filter((F.col("_rank") > 0) | (F.col("status") == FAILED))
    rows = rows.withColumn("_before", F.coalesce(F.max("_rank").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    steps = rows.filter((F.col("_rank") > F.col("_before")) | ((F.col("status") == FAILED) & (F.col("_before") < len(STATES))))
    steps = steps.withColumn("_last", F.lag("status").over(w))
    return steps.filter((F.col("status") != FAILED) | ~F.coalesce(F.col("_last") == FAILED, F.lit(False))).drop("_rank", "_before", "_last")


def current(ledger: DataFrame) -> DataFrame:
    """Each scene's state: scene_id, status, at, and the last place of its data that a taken step named (uri)."""
    w = F.struct("at", "seq")
    return accepted(ledger).groupBy("scene_id").agg(F.max_by("status", w).alias("status"), F.max("at").alias("at"), F.max_by("uri", F.when(F.col("uri").isNotNull(), w)).alias("uri"))


def state_counts(states: DataFrame) -> DataFrame:
    """Scenes by state, with the range of the times they entered it."""
    return states.groupBy("status").agg(F.count("*").alias("n"), F.min("at").alias("t_start"), F.max("at").alias("t_end"))
