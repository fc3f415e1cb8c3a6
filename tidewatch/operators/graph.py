"""A bitemporal, append-only graph as tables.

nodes: id, type, at, is_synthetic; edges: edge_type, src, dst, t_start, t_end, confidence,
observed_at, source. Nothing is updated: closing an edge appends an assertion with an end, and
reads take the latest assertion of an edge as of a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo
from tidewatch.operators import proximity
from tidewatch.sources.staging import cut, dropped

#: Half-lives in days by edge type; others do not decay (fixed values).
HALF_LIFE_DAYS = {"owned-by": 365.0, "operated-by": 270.0, "flagged-to": 730.0, "docked-at": 2.0}
#: Types through which a neighbourhood expands.
EXPANDS = ("vessel", "organization", "person")
#: Chains to listed entities that are broadcast; more are joined by a shuffle of the meetings on their counterpart.
BROADCAST_CHAINS = 100_000


def valid_edges(edges: DataFrame, nodes: DataFrame, ontology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that fit, rejects with a reason): both ends exist, their types fit the ontology, a source is given."""
    ends = edges.join(nodes.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left").join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    kinds = ontology.select("edge_type", F.col("src_type").alias("_s"), F.col("dst_type").alias("_d"), F.lit(True).alias("_known"))
    checked = ends.join(kinds, (ends.edge_type == kinds.edge_type) & (ends.src_type == kinds._s) & (ends.dst_type == kinds._d), "left").drop(kinds.edge_type)
    reason = F.when(F.col("source").isNull(), "no provenance").when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "no such node").when(F.col("_known").isNull(), "against the ontology")
    checked = checked.withColumn("reason", reason)
    return checked.filter("reason is null").select(*edges.columns), checked.filter("reason is not null").select(*edges.columns, "reason")


def latest_assertions(edges: DataFrame, as_of=None) -> DataFrame:
    """One row an edge: its latest assertion, of those made by as_of; an edge that has ended by then is out.

    The latest assertion is found first and its end tested after, so a closed edge's earlier, open
    assertion can't come back.
    """
    if as_of is not None:
        edges = edges.filter(F.col("observed_at") <= as_of)
    w = Window.partitionBy("edge_type", "src", "dst").orderBy(F.desc("observed_at"), F.desc_nulls_last("t_end"))
    now = edges.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
    if as_of is not None:
        now = now.filter((F.col("t_start") <= as_of) & (F.col("t_end").isNull() | (F.col("t_end") > as_of)))
    return now


def with_decay(edges: DataFrame, as_of) -> DataFrame:
    """Adds decayed: confidence after decay since observed_at (epoch seconds), by edge type."""
    lives = F.create_map(*[F.lit(x) for kv in HALF_LIFE_DAYS.items() for x in kv])
    return edges.withColumn("decayed", geo.decayed("confidence", (F.lit(as_of) - F.col("observed_at")) / 86_400, F.element_at(lives, F.col("edge_type"))))


def decay_summary(edges: DataFrame, as_of, usable: float = 0.3) -> DataFrame:
    return with_decay(edges, as_of).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_if(F.col("decayed") < usable).alias("n_below"), F.avg("decayed").alias("mean_confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): each end counts; the ends are exploded, so no OR-join is needed."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_subgraph(edges: DataFrame, limit: int) -> DataFrame:
    """Edges between the `limit` nodes of highest degree."""
    kept = degrees(edges).orderBy(F.desc("degree"), "id").limit(limit).select("id")
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


def chains(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """Paths of up to `hops` edges from each start (column id): start, end, hops, path, confidence (the least on the way)."""
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("confidence").alias("_c"))
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("hops"), F.array("id").alias("path"), F.lit(1.0).alias("confidence"))
    out = None
    for _ in range(hops):
        now = now.join(step, F.col("end") == F.col("_s")).filter(~F.array_contains("path", F.col("_d"))).select(
            "start", F.col("_d").alias("end"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("_d")).alias("path"), F.least("confidence", "_c").alias("confidence")
        )
        out = now if out is None else out.unionByName(now)
    return out


def neighbourhood(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: int = 2, budget: int = 200) -> DataFrame:
    """(id, distance) of nodes within `hops` of a start, in both directions; only EXPANDS types are passed through."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = starts.select("id", F.lit(0).alias("distance"))
    for k in range(1, hops + 1):
        front = seen.filter(F.col("distance") == k - 1)
        if k > 1:
            front = front.join(nodes.filter(F.col("type").isin(*EXPANDS)).select("id"), "id", "left_semi")
        found = front.join(both, front.id == both.src).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        seen = seen.union(found.select("id", F.lit(k).alias("distance")))
    return seen.orderBy("distance", "id").limit(budget)


def sanctioned_counterparts(meetings: DataFrame, ownership: DataFrame, sanctions: DataFrame, least: float = 0.3, hops: int = 3) -> DataFrame:
    """Alerts for subjects that met a vessel whose owner, up to `hops` away, was sanctioned at the time.

    meetings: subject, counterpart, t, confidence; sanctions: entity, t_start, t_end, confidence.
    """
    parties = meetings.select(F.col("counterpart").alias("id")).distinct()
    owned = chains(ownership, parties, hops).select(F.col("start").alias("counterpart"), F.col("end").alias("entity"), "hops", "path", F.col("confidence").alias("chain_confidence"))
    listed = owned.join(sanctions.select("entity", F.col("t_start").alias("_f"), F.col("t_end").alias("_u"), F.col("confidence").alias("_c")), "entity")
    # Chains that end at a listed entity come first: meetings are never grouped by entity, of which there are few.
    listed = cut(listed.filter(F.coalesce(F.least("chain_confidence", "_c") >= least, F.lit(True))))
    hit = meetings.join(F.broadcast(listed) if listed.count() <= BROADCAST_CHAINS else listed, "counterpart")
    hit = hit.filter((F.col("_f") <= F.col("t")) & (F.col("_u").isNull() | (F.col("_u") > F.col("t")))).withColumn("score", F.least("confidence", "chain_confidence", "_c"))
    return hit.filter(F.col("score") >= least).select("subject", "counterpart", "entity", "t", "hops", "path", "score")


#: Slots of time by level: each is as long as this many of the level below.
RADIX = 4


def _slots_within(lo: Column, hi: Column, levels: int) -> Column:
    """Array of (level, node): the fewest slots that together are the finest slots from lo up to, not including, hi."""
    start = lambda k: F.floor((lo + RADIX**k - 1) / RADIX**k)
    end = lambda k: F.floor(hi / RADIX**k)
    run = lambda k, a, z: F.when(z > a, F.transform(F.sequence(a, z - 1), lambda x: F.struct(F.lit(k).alias("level"), x.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
    out = []
    for k in range(levels):
        a, z = start(k), end(k)
        if k == levels - 1:
            out.append(run(k, a, z))
            continue
        above = start(k + 1) < end(k + 1)
        out += [run(k, a, F.when(above, RADIX * start(k + 1)).otherwise(z)), run(k, F.when(above, RADIX * end(k + 1)).otherwise(z), z)]
    return F.concat(*out)


def valid_at(asked: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct asked (key, t) with the value that held then: of the intervals that contain t the latest observed; null without any.

    held: key, t_start, t_end (exclusive, null if open), observed_at, value; of equally observed values the greatest stands. An interval is cut in
    slots of several lengths, of which it fills a few, and only the best of each slot is kept; a time lies in one slot of each length. Times
    are tested one by one only against intervals that begin or end in their own finest slot, so long intervals and times do not multiply.
    """
    ask = cut(asked.select(key, "t").distinct())
    n, first, last = ask.agg(F.count("t"), F.min("t"), F.max("t")).first()
    first, last = float(first or 0.0), float(last or 0.0)
    width = max(4 * (last - first) / max(n, 1), 1.0)
    slots = int((last - first) / width) + 2
    levels = next(k for k in range(1, 64) if RADIX**k >= slots)
    slot = lambda t: F.floor((F.col(t) - first) / width)
    live = held.filter((F.col("t_start") <= last) & (F.col("t_end").isNull() | (F.col("t_end") > first)))
    spans = live.groupBy(key, "t_start", "t_end").agg(F.max(F.struct("observed_at", value)).alias("b"))
    spans = spans.withColumn("_a", F.when(F.col("t_start") < first, -1).otherwise(slot("t_start"))).withColumn("_z", F.when(F.col("t_end").isNull() | (F.col("t_end") > last), slots).otherwise(slot("t_end")))
    spans = cut(spans)
    filled = spans.select(key, F.explode(_slots_within(F.col("_a") + 1, F.col("_z"), levels)).alias("s"), "b").groupBy(key, "s.level", "s.node").agg(F.max("b").alias("b"))
    places = ask.select(key, slot("t").alias("slot")).distinct().select(key, "slot", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("slot") / RADIX**k).alias("node")) for k in range(levels)))).alias("s"))
    whole = places.select(key, "slot", "s.level", "s.node").join(filled, [key, "level", "node"]).groupBy(key, "slot").agg(F.max("b").alias("_whole"))
    edges = spans.select(key, "t_start", "t_end", "b", F.explode(F.array_distinct(F.array("_a", "_z"))).alias("slot"))
    placed = ask.withColumn("slot", slot("t"))
    within = placed.join(edges, [key, "slot"]).filter((F.col("t_start") <= F.col("t")) & (F.col("t_end").isNull() | (F.col("t") < F.col("t_end"))))
    part = within.groupBy(key, "t").agg(F.max("b").alias("_part"))
    best = placed.join(whole, [key, "slot"], "left").join(part, [key, "t"], "left")
    return best.select(key, "t", F.greatest("_whole", "_part")[value].alias(value))


def identity_at(keys: DataFrame, identified: DataFrame) -> DataFrame:
    """keys (mmsi, t) with the hull that the identity stood for then: latest observed of the valid; else a provisional one."""
    best = valid_at(keys, identified, "mmsi", "hull")
    return best.select("mmsi", "t", F.coalesce("hull", F.concat(F.lit("vessel:mmsi:"), F.col("mmsi"))).alias("hull"), F.col("hull").isNull().alias("provisional"))


def mmsi_at(keys: DataFrame, identified: DataFrame) -> DataFrame:
    """keys (hull, t) with the identity that the hull used then: latest observed of the valid; null if none is known."""
    return valid_at(keys, identified, "hull", "mmsi")


def pending(events: DataFrame, processed: DataFrame) -> DataFrame:
    return events.dropDuplicates(["event_id"]).join(processed.select("event_id"), "event_id", "left_anti")


def dispositions(ledger: DataFrame) -> DataFrame:
    """The latest disposition of each alert."""
    return ledger.groupBy("alert_id").agg(F.max_by(F.struct("disposition", "analyst", "at"), "at").alias("d")).select("alert_id", "d.*")


def checksum(edges: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: count, and the exclusive-or and sum of row hashes."""
    h = F.xxhash64(*columns)
    return edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.shiftrightunsigned(h, 16)).alias("sum"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step towards stars: every node hangs on the least node near it. edges: scope, u, v with u > v."""
    near = edges.unionByName(edges.select("scope", F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("scope", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.filter("v > u" if large else "true").join(least, ["scope", "u"]).select("scope", F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("scope", "u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def connected(pairs: DataFrame, scope: str, a: str, b: str) -> DataFrame:
    """(scope, node, label): the least node of each connected component of pairs within a scope. a and b share one space of names.

    Large and small stars in turn: rounds grow with the logarithm of a component, and a node with many edges costs no more than these.
    """
    ends = pairs.select(F.col(scope).alias("scope"), F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, shape = cut(ends.filter("u > v").distinct()), None
    while True:
        following = cut(_star(_star(now, True), False))
        dropped(now)
        now = following
        found = now.agg(F.count("*"), F.sum(F.hash("scope", "u", "v").cast("long")), F.bit_xor(F.xxhash64("scope", "u", "v"))).first()
        if found == shape:
            break
        shape = found
    stars = now.select("scope", F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select("scope", F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    alone = ends.filter("u = v").select("scope", F.col("u").alias("node"), F.col("u").alias("label")).distinct().join(stars.select("scope", "node"), ["scope", "node"], "left_anti")
    return stars.unionByName(alone).withColumnRenamed("scope", scope)


def merged_nodes(assertions: DataFrame) -> DataFrame:
    """One row a node: its type, properties merged in order of time (a later value replaces an earlier one), real if any assertion is.

    assertions: id, type, at, props (map of strings), is_synthetic.
    """
    each = assertions.select("id", "at", F.explode_outer("props").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "at").alias("v"))
    props = each.filter("k is not null").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    kinds = assertions.groupBy("id").agg(F.max_by("type", "at").alias("type"), F.bool_and(F.coalesce("is_synthetic", F.lit(False))).alias("is_synthetic"))
    return kinds.join(props, "id", "left")


def closed(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Assertions that close edges: the latest assertion of each (edge_type, src, dst) in `ends`, said again with its t_end and observed_at."""
    now = latest_assertions(edges).drop("t_end", "observed_at")
    return now.join(ends.select("edge_type", "src", "dst", "t_end", "observed_at"), ["edge_type", "src", "dst"]).select(*edges.columns)


def emitted_once(queue: DataFrame, events: DataFrame, key: str = "event_key") -> DataFrame:
    """New events whose key the queue does not hold, one a key: the earliest."""
    first = events.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("at", "event_id"))).filter("_i = 1").drop("_i")
    return first.join(queue.select(key), key, "left_anti")


def merged_authorities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with nodes of one type and label as one, the least id, and edges led there, each once."""
    lead = nodes.groupBy("type", "label").agg(F.min("id").alias("lead"))
    of = nodes.join(lead, ["type", "label"]).select("id", "lead")
    to = edges.join(of.select(F.col("id").alias("src"), F.col("lead").alias("_s")), "src", "left").join(of.select(F.col("id").alias("dst"), F.col("lead").alias("_d")), "dst", "left")
    moved = to.select("edge_type", F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst")).distinct()
    return lead.select(F.col("lead").alias("id"), "type", "label"), moved


def both_ways(edges: DataFrame) -> DataFrame:
    """Symmetric relations stored in both directions."""
    return edges.unionByName(edges.withColumn("_s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_s")).drop("_s")).distinct()


def ordered_digest(rows: DataFrame, columns: list[str], parts: int = 4096) -> DataFrame:
    """One row, digest: sha256 over the digests of parts in order, each over its rows' digests in order; so no task sorts all rows."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    each = rows.select(row.alias("h")).withColumn("part", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % parts)
    by = each.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    return by.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.sum("n").alias("n"))
