"""Chat formatting after cumulative-snapshot collapse (operator 9), in DataFrame functions only.

Every turn gets a rolling hash of its conversation up to it. A conversation whose
whole hash is the rolling hash of a longer one, is a snapshot of it and goes by an
anti-join; of equal conversations the smallest id stays. What stays is rendered.

The rolling hash is a sum of hashes of (position, role, text), so a long conversation is
summed in blocks of BLOCK turns on many tasks and its blocks' sums are added up after.

Defined cases: turns are ordered by turn (null first), then role, then text, and
repeated rows are turns of their own; a null role is rendered as `unknown`, a null text as
empty, but neither equals a given one; rows with a null conversation id belong to no
conversation and are left out; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Turn numbers in a block, and turns rendered into one row.
BLOCK = 256


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: conv_id, block, turn, role, text, pos (from 1), h1 and h2, the rolling hashes up to it."""
    base = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")
    )
    base = base.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long"))
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    ranked = base.withColumn("rank", F.row_number().over(in_block))
    sizes = base.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = ranked.join(offsets, ["conv_id", "block"]).withColumn("pos", F.col("offset") + F.col("rank"))
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    # 62 bits of a hash as decimals: sums of them can't overflow, and are exact in any order.
    for k in (1, 2):
        placed = placed.withColumn(f"t{k}", F.shiftrightunsigned(F.xxhash64(F.lit(k), "pos", *said), 2).cast("decimal(20,0)"))
    sums = placed.groupBy("conv_id", "block").agg(F.sum("t1").alias("b1"), F.sum("t2").alias("b2"))
    zero = F.lit(0).cast("decimal(38,0)")
    before = sums.select("conv_id", "block", *(F.coalesce(F.sum(f"b{k}").over(earlier).cast("decimal(38,0)"), zero).alias(f"o{k}") for k in (1, 2)))
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.join(before, ["conv_id", "block"])
    return rolled.select(
        "conv_id", "block", "turn", "role", "text", "pos", *((F.col(f"o{k}") + F.sum(f"t{k}").over(upto)).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2))
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no beginning of a longer one, the smallest id of equal ones."""
    narrow = rolled.select("conv_id", "pos", "h1", "h2")
    last = narrow.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("whole")).select("conv_id", "whole.*")
    firsts = last.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    counts = last.select("conv_id", F.col("pos").alias("n_turns"))
    inner = narrow.join(counts, "conv_id").filter("pos < n_turns").select("pos", "h1", "h2").distinct()
    return firsts.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns, text. Longer ones than BLOCK turns have several parts."""
    rolled = materialize(prefixes(turns, conv_id, turn, role, text), "turns")
    kept = maximal(rolled)
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = rolled.join(kept, "conv_id").select("conv_id", "n_turns", F.floor((F.col("pos") - 1) / BLOCK).alias("part"), F.struct("pos", said.alias("line")).alias("said"))
    parts = lines.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list("said")).alias("said"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("said.line"), "").alias("text"))
