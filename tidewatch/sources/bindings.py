"""Deterministic bindings of the driver's tables to the engine's schemas.

The tables hold no coordinates; integer arithmetic on ids gives them some, the
same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as position reports: point_id, key, ts, t (epoch seconds), lat, lon, sog, cog, kind."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("point_id"), F.col("user_id").alias("key"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.lit(5.0) + (F.col("event_id") * 7919 % 20000) / F.lit(1000.0)).alias("lat"), (F.lit(60.0) + (F.col("event_id") * 104729 % 18000) / F.lit(1000.0)).alias("lon"),
        (F.col("value") % F.lit(20.0)).alias("sog"), (F.col("event_id") * 37 % 360).cast("double").alias("cog"), F.col("event_type").alias("kind"),
    ).withColumn("t", F.col("us") / F.lit(1e6))


#: The same as SQL, to stand before a query.
POSITIONS_SQL = """
    pos as (
        select event_id as point_id, user_id as key, ts, epoch_us(ts) as us, epoch_us(ts) / 1e6::double as t,
            5.0::double + (event_id * 7919 % 20000) / 1000.0::double as lat, 60.0::double + (event_id * 104729 % 18000) / 1000.0::double as lon,
            value % 20.0::double as sog, (event_id * 37 % 360)::double as cog, event_type as kind
        from events
    )
"""

def close_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within two degrees, with receivers, so that keys hear each other: also receiver."""
    i = F.col("point_id")
    near = positions(spark, sf_dir).withColumn("lat", F.lit(10.0) + (i * 7919 % 2000) / F.lit(1000.0)).withColumn("lon", F.lit(65.0) + (i * 104729 % 1800) / F.lit(1000.0))
    return near.withColumn("receiver", F.when(i % 3 == 0, "ter:a").when(i % 3 == 1, "sat:b").otherwise("ter:a|sat:c"))


CLOSE_SQL = POSITIONS_SQL + """,
    near as (
        select * exclude (lat, lon), 10.0::double + (point_id * 7919 % 2000) / 1000.0::double as lat, 65.0::double + (point_id * 104729 % 1800) / 1000.0::double as lon,
            case when point_id % 3 = 0 then 'ter:a' when point_id % 3 = 1 then 'sat:b' else 'ter:a|sat:c' end as receiver
        from pos
    )
"""


def moving_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on small circles, sixty times as fast, with speeds and courses of four kinds of keys."""
    k, i = F.col("key"), F.col("point_id")
    p = positions(spark, sf_dir).withColumn("t", F.floor(F.col("us") / 60) / F.lit(1e6))
    turn = F.col("t") / F.lit(3600.0) + k
    sog = F.when(k % 4 == 0, 0.0013 + F.col("sog") / 10).when(k % 4 == 1, 1.5013 + F.col("sog") / 8).when(k % 4 == 2, 6.0013 + F.col("sog") / 2).otherwise(0.0013 + F.col("sog") / 2)
    cog = F.when(k % 4 == 2, k * 37 % 360 + i % 10).when(k % 8 == 3, i % 2 * 180 + k % 90).otherwise(i * 97 % 360).cast("double")
    return p.select("point_id", "key", "ts", "us", "t", "kind", sog.alias("sog"), cog.alias("cog"), (12 + k % 12 + 0.05 * F.sin(turn)).alias("lat"), (64 + k % 10 + 0.05 * F.cos(turn)).alias("lon"))


MOVING_SQL = POSITIONS_SQL + """,
    mov as (
        select point_id, key, ts, us, t, kind, case when key % 4 = 0 then 0.0013::double + sog / 10 when key % 4 = 1 then 1.5013::double + sog / 8 when key % 4 = 2 then 6.0013::double + sog / 2 else 0.0013::double + sog / 2 end as sog,
            (case when key % 4 = 2 then key * 37 % 360 + point_id % 10 when key % 8 = 3 then point_id % 2 * 180 + key % 90 else point_id * 97 % 360 end)::double as cog,
            12 + key % 12 + 0.05::double * sin(t / 3600.0::double + key) as lat, 64 + key % 10 + 0.05::double * cos(t / 3600.0::double + key) as lon
        from (select * replace (floor(us / 60::double) / 1e6::double as t) from pos)
    )
"""

#: Places that stand for ports: a name and a position (fixed values).
PORTS = [("north", 18.941, 72.890), ("west", 23.0, 70.2), ("south", 9.96, 76.26), ("bay", 13.1, 66.4), ("gulf", 24.8, 67.0)]


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, "port string, port_lat double, port_lon double")


PORTS_SQL = "ports(port, port_lat, port_lon) as (values " + ", ".join(f"('{n}', {a}::double, {o}::double)" for n, a, o in PORTS) + ")"


def haversine_sql(a1: str, o1: str, a2: str, o2: str, radius: float = 6371000.0) -> str:
    return f"(2 * {radius}::double * asin(sqrt(least(1.0::double, pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin((radians({o2}) - radians({o1})) / 2), 2)))))"


def cell_sql(lat: str, lon: str, res: int) -> str:
    e = grid.EDGE[res]
    return f"(({res}::bigint << 58) | (floor(({lat} + 90) / {e}::double)::bigint << 29) | floor(({lon} + 180) / {e}::double)::bigint)"
