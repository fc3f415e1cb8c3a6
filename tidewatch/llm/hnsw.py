"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards of about `SHARD_ROWS` by hash. A shard becomes one row of the index table: its distinct vectors, the rows that
have each, and the graph as flat neighbour arrays (level 0 with twice `LINKS` slots a node, upper levels after one another with
`LINKS`). Queries are sent to every shard in slices, walk down its graph, and return their nearest found; the merge keeps the best of
all shards. A task holds one graph and one slice of queries.

The graph is built in batches: each batch walks the graph so far for candidates, its own members are candidates of each other, links are chosen
by the diversity rule (a candidate nearer to a chosen neighbour than to the node waits until the others are chosen) and full lists choose anew.
Equal vectors are one node that keeps the smallest ids, as many as any query can ask for, so that a vector that a third of all rows have neither fills
lists with copies nor hides its neighbours. Scores are computed again on the original vectors in double precision.

Defined cases: rows whose vector is null, empty, zero, or holds null or non-finite entries take no part. A vector meets those of its length
only. Repeated rows are rows of their own: each is a candidate of the other and, if a query, has its results. A null id is no query; as a candidate it
comes last among ties. With no other row a query has no result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SHARD_ROWS, SLICE_ROWS = 8192, 50_000
#: Links a node chooses on each level (level 0 holds twice as many), breadth of the walk in building and in searching, nodes of a batch.
LINKS, BUILD_WIDTH, SEARCH_WIDTH, BATCH = 16, 64, 128, 512
#: Stands for a null id, so that it sorts last.
NO_ID = np.iinfo(np.int64).max

INDEX = "shard int, dims int, ids array<long>, ids_end array<int>, vectors array<double>, base array<int>, upper array<int>, upper_end array<int>, start int"


def usable(vector: str) -> Column:
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda c: c != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in single precision for walking; scaled first, so that squares neither overflow nor vanish."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with that of b, in double precision; equal rows give equal figures wherever they stand."""
    a, b = np.ascontiguousarray(a, np.float64), np.ascontiguousarray(b, np.float64)
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    odd = ~np.isfinite(norms) | (norms < 1e-290)
    if odd.any():
        a, b = (np.where(odd[:, None], v / np.abs(v).max(axis=1, keepdims=True), v) for v in (a, b))
        norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return (a * b).sum(axis=1) / norms


class Graph:
    """A navigable small-world graph over unit vectors, in flat arrays."""

    def __init__(self, units: np.ndarray, tops: np.ndarray, base: np.ndarray | None = None, upper: np.ndarray | None = None, start: int = 0, links: int = LINKS) -> None:
        n = len(units)
        self.units, self.tops, self.links, self.start = units, tops, links, start
        self.base = np.full((n, 2 * links), -1, np.int32) if base is None else base.reshape(n, 2 * links)
        self.ends = np.cumsum(tops)
        self.upper = np.full((int(tops.sum()), links), -1, np.int32) if upper is None else upper.reshape(-1, links)

    @staticmethod
    def levels(n: int, links: int = LINKS) -> np.ndarray:
        """Highest level of each node: geometric, the same in every run."""
        return np.floor(-np.log(1 - np.random.default_rng(1).random(n)) / np.log(links)).astype(np.int32)

    def at(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The array that holds a level, and the rows of nodes in it."""
        return (self.base, nodes) if level == 0 else (self.upper, self.ends[nodes] - self.tops[nodes] + level - 1)

    def walk(self, queries: np.ndarray, entry: np.ndarray, level: int, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of all queries at once: (distances, nodes) of the `width` nearest met, nearest first, -1 where fewer."""
        q = len(queries)
        seen = np.zeros((q, len(self.units) + 1), bool)
        dist, node = np.full((q, width), np.inf, np.float32), np.full((q, width), -1, np.int32)
        done = np.ones((q, width), bool)
        dist[:, 0], node[:, 0], done[:, 0] = 1 - np.einsum("qd,qd->q", self.units[entry], queries), entry, False
        seen[np.arange(q), entry] = True
        live = np.arange(q)
        expand = min(expand, width)
        while len(live):
            open_at = np.where(done[live], np.inf, dist[live])
            pick = np.argsort(open_at, axis=1)[:, :expand] if width > 1 else np.zeros((len(live), 1), int)
            ok = np.isfinite(np.take_along_axis(open_at, pick, 1))
            going = ok.any(axis=1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            chosen = np.where(ok, node[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            table, rows = self.at(np.maximum(chosen, 0), level)
            near = np.where((chosen >= 0)[:, :, None], table[rows], -1).reshape(len(live), -1)
            near = np.where(seen[live[:, None], near], -1, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[live[:, None], near] = True
            seen[live, -1] = False
            at, col = np.nonzero(near >= 0)
            found = np.full(near.shape, np.inf, np.float32)
            found[at, col] = 1 - np.einsum("kd,kd->k", self.units[near[at, col]], queries[live[at]])
            every = np.concatenate([dist[live], found], axis=1)
            keep = np.argpartition(every, width - 1, axis=1)[:, :width]
            dist[live] = np.take_along_axis(every, keep, 1)
            node[live] = np.take_along_axis(np.concatenate([node[live], near], axis=1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], found == np.inf], axis=1), keep, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        dist, node = np.take_along_axis(dist, order, 1), np.take_along_axis(node, order, 1)
        return dist, np.where(np.isfinite(dist), node, -1)

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes) of the nearest found of each query."""
        entry = np.full(len(queries), self.start)
        for level in range(int(self.tops[self.start]), 0, -1):
            entry = self.walk(queries, entry, level, 1)[1][:, 0]
        return self.walk(queries, entry, 0, width)

    def choose(self, nodes: np.ndarray, cand: np.ndarray, count: int) -> np.ndarray:
        """`count` links of each node out of its candidates (-1: none), diverse ones first, then the nearest of the rest."""
        out = np.full((len(nodes), count), -1, np.int32)
        step = max(1, 2_000_000 // (cand.shape[1] * max(cand.shape[1], self.units.shape[1])))
        for lo in range(0, len(nodes), step):
            own, some = nodes[lo : lo + step], cand[lo : lo + step]
            vectors = self.units[np.maximum(some, 0)]
            dist = np.where(some >= 0, 1 - np.einsum("ckd,cd->ck", vectors, self.units[own]), np.inf)
            order = np.argsort(dist, axis=1, kind="stable")
            some, dist = np.take_along_axis(some, order, 1), np.take_along_axis(dist, order, 1)
            vectors = np.take_along_axis(vectors, order[:, :, None], 1)
            between = 1 - vectors @ vectors.transpose(0, 2, 1)
            waits, taken, n = ~np.isfinite(dist), np.zeros(dist.shape, bool), np.zeros(len(own), int)
            for j in range(dist.shape[1]):
                take = ~waits[:, j] & (n < count)
                taken[:, j], n = take, n + take
                waits |= take[:, None] & (between[:, j] < dist)
            rank = np.where(taken, 0, np.where(np.isfinite(dist), 1, 2))
            order = np.argsort(rank, axis=1, kind="stable")[:, :count]
            kept = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(some, order, 1), -1)
            out[lo : lo + step, : kept.shape[1]] = kept
        return out

    def link(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Sets the links of new nodes, and links back to them; a full list chooses anew."""
        table, rows = self.at(nodes, level)
        table[rows, : chosen.shape[1]] = chosen
        src, col = np.nonzero(chosen >= 0)
        back, new = chosen[src, col], nodes[src]
        order = np.argsort(back, kind="stable")
        back, new = back[order], new[order].astype(np.int32)
        size = table.shape[1]
        while len(back):
            first = np.r_[True, back[1:] != back[:-1]]
            nth = np.arange(len(back)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            now = nth < size  # the others wait for the next turn
            targets, slot = np.unique(back[now], return_inverse=True)
            extra = np.full((len(targets), int(nth[now].max()) + 1), -1, np.int32)
            extra[slot, nth[now]] = new[now]
            _, rows = self.at(targets, level)
            both = np.concatenate([table[rows], extra], axis=1)
            room = (both >= 0).sum(axis=1) <= size
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :size]
            table[rows[room]] = packed[room]
            if not room.all():
                table[rows[~room]] = self.choose(targets[~room], both[~room], size)
            back, new = back[~now], new[~now]

    def insert(self, batch: np.ndarray, width: int = BUILD_WIDTH) -> None:
        """Links a run of new nodes; all of them see the graph without the run, and each other."""
        queries, top, tops = self.units[batch], int(self.tops[self.start]), self.tops[batch]
        entry = np.full(len(batch), self.start)
        pending = []
        for level in range(max(top, int(tops.max())), -1, -1):
            mine = tops >= level
            found = np.full((len(batch), width), -1, np.int32)
            if level <= top:
                for sel, breadth in ((np.flatnonzero(~mine), 1), (np.flatnonzero(mine), width)):
                    if len(sel):
                        near = self.walk(queries[sel], entry[sel], level, breadth)[1]
                        entry[sel], found[sel, :breadth] = near[:, 0], near
            at = np.flatnonzero(mine)
            if len(at):
                mates = np.full((len(at), min(self.links, max(1, len(at) - 1))), -1, np.int32)
                if len(at) > 1:
                    apart = 1 - queries[at] @ queries[at].T
                    np.fill_diagonal(apart, np.inf)
                    mates[:] = batch[at][np.argpartition(apart, mates.shape[1] - 1, axis=1)[:, : mates.shape[1]]]
                pending.append((level, batch[at], self.choose(batch[at], np.concatenate([found[at], mates], axis=1), self.links)))
        for level, nodes, chosen in pending:
            self.link(level, nodes, chosen)
        highest = batch[int(np.argmax(tops))]
        if self.tops[highest] > top:
            self.start = int(highest)

    @classmethod
    def build(cls, units: np.ndarray) -> Graph:
        graph, at = cls(units, cls.levels(len(units))), 1
        while at < len(units):
            size = min(BATCH, at, len(units) - at)
            graph.insert(np.arange(at, at + size))
            at += size
        return graph


def _lists(columns: dict[str, np.ndarray | int], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([columns[name]], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, float64 matrix) for each length of vectors."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    known = ids.fill_null(NO_ID).to_numpy()
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield known[at], flat[starts[at][:, None] + np.arange(length)]


def build(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index, written: a row for each shard and vector length."""
    rows = embeddings.filter(usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    shards = max(1, -(-rows.count() // shard_rows))
    # Rows equal in id and vector are counted before they are dealt, so that no shard gets all repeats of a row.
    counted = rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(nearest + 1)).alias("copies"))
    dealt = counted.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))

    def shard(table: pa.Table) -> pa.Table:
        batches, number = [], table["shard"][0].as_py()
        copies = table["copies"].to_numpy()
        spread = table.take(pa.array(np.repeat(np.arange(len(copies)), copies)))
        for ids, matrix in _matrices(spread["id"], spread["v"]):
            whole = np.ascontiguousarray(matrix + 0.0)
            order = np.lexsort((ids, *whole.T[::-1]))
            ids, whole = ids[order], whole[order]
            first = np.flatnonzero(np.r_[True, (whole[1:] != whole[:-1]).any(axis=1)])
            nth = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
            few = nth <= nearest
            size = np.add.reduceat(few.astype(int), first)
            mix = np.random.default_rng(2).permutation(len(first))  # sorted vectors would make poor batches
            owners = np.split(ids[few], np.cumsum(size)[:-1])
            vectors = whole[first][mix]
            graph = Graph.build(unit(vectors))
            batches.append(
                _lists(
                    {
                        "shard": number, "dims": vectors.shape[1], "ids": np.concatenate([owners[i] for i in mix]), "ids_end": np.cumsum(size[mix]),
                        "vectors": vectors.ravel(), "base": graph.base.ravel(), "upper": graph.upper.ravel(), "upper_end": graph.ends, "start": graph.start,
                    },
                    INDEX,
                )
            )
        return pa.Table.from_batches(batches)

    return materialize(dealt.groupBy("shard").applyInArrow(shard, INDEX), "hnsw-index")


class Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        take = lambda name: row[name].values.to_numpy(zero_copy_only=False)
        self.dims, self.ids, self.ids_end = row["dims"].as_py(), take("ids"), take("ids_end")
        self.vectors = take("vectors").reshape(-1, self.dims)
        tops = np.diff(take("upper_end"), prepend=0)
        self.graph = Graph(unit(self.vectors), tops, take("base"), take("upper"), row["start"].as_py())

    def nearest(self, ids: np.ndarray, queries: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's position, id, score) of the nearest rows found, a row of a query itself left out once."""
        _, nodes = self.graph.search(unit(queries), max(SEARCH_WIDTH, count + 1))
        at, col = np.nonzero(nodes >= 0)
        node = nodes[at, col]
        score = cosine(queries[at], self.vectors[node])
        same = (queries[at] == self.vectors[node]).all(axis=1)
        starts = self.ids_end[node] - np.diff(self.ids_end, prepend=0)[node]
        size = self.ids_end[node] - starts
        each = np.repeat(np.arange(len(node)), size)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        found = self.ids[starts[each] + nth]
        own = same[each] & (found == ids[at[each]])
        again = np.r_[False, own[1:] & own[:-1] & (each[1:] == each[:-1])]
        keep = ~(own & ~again)
        query, found, value = at[each][keep], found[keep], score[each][keep]
        order = np.lexsort((found, -value, query))
        query, found, value = query[order], found[order], value[order]
        first = np.r_[True, query[1:] != query[:-1]]
        rank = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(query) else np.zeros(0, int)
        best = rank < count
        return query[best], found[best], value[best]


def search(index: DataFrame, queries: DataFrame, key: str = "query_id", vector: str = "embedding", nearest: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the `nearest` rows of the index to each query (rows of key and vector), shard results merged."""
    asked = queries.filter(usable(vector) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).agg(F.count("*").alias("copies"))
    asked = materialize(asked.withColumn("mark", F.xxhash64("v")), "hnsw-queries")
    slices, shards = max(1, -(-asked.count() // SLICE_ROWS)), (index.agg(F.max("shard")).first()[0] or 0) + 1
    left = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = asked.select(
        "id", "v", "mark", F.pmod(F.xxhash64("id", "mark"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    schema = "id long, mark long, found long, score double"

    def meet(graphs: pa.Table, some: pa.Table) -> pa.Table:
        parts = [pa.table({"id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        marks = some["mark"].to_numpy()
        lengths = pa.compute.list_value_length(some["v"]).to_numpy()
        for k in range(graphs.num_rows):
            shard = Shard({name: graphs[name][k] for name in graphs.column_names})
            at = np.flatnonzero(lengths == shard.dims)
            for lo in range(0, len(at), BATCH):
                part = some.take(pa.array(at[lo : lo + BATCH]))
                ids, matrix = next(_matrices(part["id"], part["v"]))
                query, found, score = shard.nearest(ids, matrix + 0.0, nearest)
                parts.append(pa.table({"id": ids[query], "mark": marks[at[lo : lo + BATCH]][query], "found": found, "score": score}))
        return pa.concat_tables(parts)

    found = left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(meet, schema)
    best = Window.partitionBy("id", "mark").orderBy(F.desc("score"), "found")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest)
    again = ranked.join(asked.select("id", "mark", "copies"), ["id", "mark"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(F.col("id").alias("query_id"), "rank", F.when(F.col("found") != int(NO_ID), F.col("found")).alias("vec_id"), "score")


def every_nth(embeddings: DataFrame, nth: int = 50, key: str = "vec_id", vector: str = "embedding", nearest: int = 5) -> DataFrame:
    """The nearest rows of every row whose id is divisible by `nth`, against all rows."""
    rows = embeddings.select(F.col(key).alias("query_id"), F.col(vector).alias("embedding"))
    index = build(rows, "query_id", "embedding", nearest)
    return search(index, rows.filter(F.col("query_id") % nth == 0), nearest=nearest)
