"""Merkle manifest of a table: a digest for every row, a subroot for every group, one root, and each row's path to it.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text. A row's leaf is H of its fields,
each `-` if null, else its length in UTF-8 bytes, a colon and the value. Within a group, rows ascend by key; while
several nodes remain, every `fanout` consecutive ones become their H (the last run may be shorter, down to one node). What
remains is the group's subroot, the leaf itself where the group has one row. Subroots, by group (null first, bytewise),
give the root in the same way.

How it scales: rows are numbered by ranges (row_number within a range, plus the rows of the group in earlier ranges), so
that no task sorts a whole group. Levels are DataFrames, each an eighth of the one below, written once. Paths are built
from the root down, one join a level, so what all rows under a node share is carried once for that node; a row's whole path
exists only in the projection that hashes it.

Defined cases: a null key sorts first; rows with equal keys ascend by leaf; repeated rows are leaves of their own. A row of
nulls is hashed as such. An empty table has no rows, and so no root. Columns that are no field, key or group are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

FANOUT = 8

PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """H of string columns, none of them null."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 length, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*(encoded(f) for f in fields))


def proof(path: str = "path") -> Column:
    """H of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(node: Column, path: str = "path") -> Column:
    """The root that `node` and the siblings of its path give."""
    return F.aggregate(path, node, lambda now, s: digest(s["before"], now, s["after"]))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `idx`, from 0 within its `g` by `order`, and `n`, the rows of its `g`."""
    ranged = materialize(
        rows.withColumn("salt", F.monotonically_increasing_id())  # repeats of one row need not share a range
        .repartitionByRange("g", *order, "salt").drop("salt").withColumn("part", F.spark_partition_id()),
        "merkle-ranges",
    )
    every, earlier = Window.partitionBy("g"), Window.partitionBy("g").orderBy("part")
    spans = ranged.groupBy("g", "part").agg(F.count("*").alias("rows")).select(
        "g", "part", (F.sum("rows").over(earlier) - F.col("rows")).alias("before"), F.sum("rows").over(every).alias("n")
    )
    within = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(spans, ["g", "part"]).withColumn("idx", F.col("before") + F.col("within")).drop("part", "before", "within")


def climb(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels above the nodes (g, idx, n, hash, own): rows (g, idx, n, hash, kids), kids being at most `fanout` nodes in order.

    A group whose nodes are down to one has no rows in higher levels.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, now, kid = [], nodes, F.struct("idx", "hash", "own")
    while most > 1:
        runs = now.filter("n > 1").groupBy("g", F.floor(F.col("idx") / fanout).alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
        now = materialize(
            runs.select(
                "g", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join(F.col("kids.hash"), ""), 256).alias("hash"), "kids"
            ),
            f"merkle-level{len(levels)}",
        )
        levels.append(now)
        kid, most = F.struct("idx", "hash"), -(-most // fanout)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last node (g, hash) of every group."""
    found = nodes.filter("n = 1").select("g", "hash")
    for level in levels:
        found = found.union(level.filter("n = 1").select("g", "hash"))
    return found


def descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, leaf, own, and the columns of `above`) for every node, its siblings appended in front of the path that `above` has for its group."""
    carried = [c for c in above.columns if c not in ("g", "path")]

    def ended(level: DataFrame, *kept: str) -> DataFrame:
        return level.filter("n = 1").select("g", "idx", *kept).join(above, "g")

    known = None
    for k in reversed(range(len(levels))):
        level, own = levels[k], k == 0
        at = ended(level)
        known = at if known is None else known.unionByName(at)
        open_runs = level.select("g", "idx", "kids").join(known, ["g", "idx"])
        each = open_runs.select("g", F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("i", "kid"), "path", *carried)
        step = F.struct(
            F.array_join(F.slice("hashes", F.lit(1), F.col("i")), "").alias("before"),
            F.array_join(F.slice("hashes", F.col("i") + 2, F.size("hashes")), "").alias("after"),
        )
        known = each.select(
            "g", F.col("kid.idx").alias("idx"), *([F.col("kid.hash").alias("hash"), F.col("kid.own").alias("own")] if own else []),
            F.concat(F.array(step), "path").alias("path"), *carried,
        )
    lone = ended(nodes, "hash", "own")
    return (lone if known is None else known.unionByName(lone)).withColumnRenamed("hash", "leaf").drop("idx")


def manifest(rows: DataFrame, group: Column, key: str, leaf: Column, own: Column, fanout: int = FANOUT) -> DataFrame:
    """(leaf, own, subroot, root, path) for every row.

    rows: any table. group, leaf, own: expressions over it; `own` is a struct that is carried along, its field `key` gives the order.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    hashed = rows.select(named.alias("g"), leaf.alias("hash"), own.alias("own"))
    nodes = numbered(materialize(hashed, "merkle-leaves").withColumn("key", F.col(f"own.{key}")), "key", "hash").drop("key")
    nodes = materialize(nodes, "merkle-nodes")
    levels = climb(nodes, fanout)
    groups = tops(nodes, levels).select(F.lit("").alias("g"), "hash", F.struct(F.col("g").alias("group")).alias("own"), F.col("g").alias("group"))
    subroots = materialize(numbered(groups, "group").drop("group"), "merkle-subroots")
    upper = climb(subroots, fanout)
    start = tops(subroots, upper).select("g", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    above = materialize(descend(subroots, upper, start).select(F.col("own.group").alias("g"), F.col("leaf").alias("subroot"), "root", "path"), "merkle-groups")
    return descend(nodes, levels, above).drop("g")


def documents_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root and path of every document.

    tampered: the leaf of the document after tampering (A-Z of the text lower-cased where 3 divides the CRC-32 of the decimal doc_id), else null.
    A null doc_id is never tampered with.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    own = F.struct("doc_id", F.when(struck, leaf(*fields, lowered)).alias("tampered"))
    found = manifest(docs, F.col("lang"), "doc_id", leaf(*fields, F.col("text")), own, fanout)
    return found.select("own.doc_id", "leaf", "own.tampered", "subroot", "root", "path")


def verified(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of a manifest of documents."""
    roots = found.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return roots.withColumn("verified", F.col("folded_root") == F.col("root"))
