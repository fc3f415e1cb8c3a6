"""Connected components by alternating large-star and small-star, as DataFrame joins.

Each round replaces edges so that every node points nearer to the smallest node
of its component; stars are the fixed point. A hot node costs no more than its
own edges: minima are pre-aggregated before the shuffle, and the join back is an
ordinary one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges: (u, v) with u > v, distinct."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node. Nulls and loops link nothing."""
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(),
        "cc",
    )
    state = None
    while True:
        following = materialize(_star(_star(now, large=True), large=False), "cc")
        shape = following.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_materialized(now)
        now = following
        if shape == state:
            break
        state = shape
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
