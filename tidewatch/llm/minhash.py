"""MinHash near-duplicate detection with full verification (operator 6).

1. One pass over the texts gives each document's shingle count, a 128-bit digest
   of its shingle set and the minima of many universal hashes. Documents with
   equal digests are one node from here on, numbered as it is written; its
   smallest id owns it, and a text of that id stands for it.
2. Bands of minima are hashed; every bucket with two or more nodes is a star
   around its smallest node. Stars, not all pairs, are verified.
3. Candidates whose minima agree too rarely go (the bound lies so far below the
   threshold that a true link is lost with odds below one in a billion); the rest
   are confirmed on full shingle sets.
4. Components by large-star and small-star. A bucket whose nodes are now all in
   one component can add nothing. In the others, nodes of different components
   are compared in blocks, by minima first and by their PROFILE least shingle hashes
   next (all of them, for most sets), confirmed on full sets, and the components
   recomputed, so no link between different texts is lost to the star shape.

Defined cases: null or wordless texts have an empty set and link with nothing; a
document of fewer words than a shingle has its whole word sequence as its only
shingle; a null id is kept, with a null component, and links nothing; rows that share an id are
judged each by its own text (`row_key` tells them apart), rows equal in both stay or go together; ids may be of any
type that has an order; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, drop_materialized, join_ids, materialize, row_key, text_batches
from .components import components
from .words import BY_SPACE, U64, _seeded, chain, mix, split_words

#: Bands of 5 minima: a pair at similarity 0.8 shares no band with odds (1 - 0.8^5)^40 = 1.3e-7.
BANDS, ROWS = 40, 5
BLOCK = 512
#: Shingle hashes of a profile; smaller sets are compared whole.
PROFILE = 512
#: Nodes that are broadcast with their ids and digests (some 40 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def shingle_sets(column, words: int):
    """Yield (row, sorted distinct shingle hashes) for each row of a string column."""
    for w in split_words(column, BY_SPACE):
        whole = chain(w.hashes, words)
        for row, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True), w.lo):
            n = b - a
            if n >= words:
                yield row, np.unique(whole[a : b - words + 1])
            elif n:
                yield row, mix(chain(w.hashes, n, np.array([a])) + U64(n))
            else:
                yield row, np.zeros(0, U64)


def minima(shingles: np.ndarray, n_hashes: int) -> np.ndarray:
    """The low halves of the minima of n multiply-add hashes over the set."""
    a = (_seeded(n_hashes, 101) >> U64(32)).astype(np.uint32) | np.uint32(1)
    b = (_seeded(n_hashes, 202) >> U64(32)).astype(np.uint32)
    x = (shingles >> U64(32)).astype(np.uint32)
    least = np.full(n_hashes, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048]
        least = np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (mix(least.astype(U64)) & U64(0xFFFF)).astype(np.uint16)


def minima_of_runs(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_hashes: int) -> np.ndarray:
    """Whole minima, as minima() has halves of, of each run of shingles from a start to its end (none is empty), one row each."""
    out, lengths = np.zeros((len(starts), n_hashes), np.uint32), ends - starts
    upto = np.concatenate([[0], np.cumsum(lengths)])
    a = (_seeded(n_hashes, 101) >> U64(32)).astype(np.uint32) | np.uint32(1)
    b = (_seeded(n_hashes, 202) >> U64(32)).astype(np.uint32)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + 16_384, "right")) - 1)
        at = np.arange(upto[lo], upto[hi]) + np.repeat(starts[lo:hi] - upto[lo:hi], lengths[lo:hi])
        x = (shingles[at] >> U64(32)).astype(np.uint32)
        least = np.minimum.reduceat(x[None, :] * a[:, None] + b[:, None], upto[lo:hi] - upto[lo], axis=1)
        out[lo:hi] = least.T
        lo = hi
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, doc_id: str, text: str, words: int, n_hashes: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for _, s in shingle_sets(batch.column(2), words):
                sizes.append(len(s))
                digests.append(digest_of(s) if len(s) else None)
                sigs.append(minima(s, n_hashes).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", ROW, "n_shingles", "digest", "sig"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), row_key(text).alias(ROW), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {ROW} long, n_shingles long, digest binary, sig binary")


def band_keys(nodes: DataFrame, node: str, bands: int, rows: int, kind=np.uint16) -> DataFrame:
    """(key, node) for each of at most 64 bands; the low six bits of a key are its band. kind: of the minima."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(batch.num_rows, -1).astype(U64)
            keys = [(mix(chain(sig[:, k * rows : (k + 1) * rows].ravel(), rows, np.arange(batch.num_rows) * rows) + U64(k)) >> U64(6) << U64(6) | U64(k)).view(np.int64) for k in range(bands)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(batch.column(0).to_numpy(zero_copy_only=False), bands))], ["key", "node"])

    return nodes.select(F.col(node).alias("node"), "sig").mapInArrow(run, "key long, node long")


def agreement(pairs: DataFrame, least: float, kind=np.uint16) -> DataFrame:
    """Keep pairs (a, b, sig_a, sig_b) whose minima agree often enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(batch.num_rows, -1) for i in (2, 3))
                ok = (a == b).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text, node, digest) of every row that has the id of one of `nodes` (node, doc_id, digest)."""
    few = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.join(few, "doc_id").select("text", "node", "digest")


def sets_of(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(node, shingles) of `nodes` (node, doc_id, digest)."""

    def run(batches):
        for batch in batches:
            sets, at = [], []
            for (row, s), digest in zip(shingle_sets(batch.column(0), words), batch.column(2).to_pylist(), strict=True):
                if digest_of(s) == digest:
                    sets.append(s.view(np.int64))
                    at.append(row)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int32())), pa.ListArray.from_arrays(pa.array(ends), values)], ["node", "shingles"])

    return _texts(docs, nodes, doc_id, text).mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def profiles(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(node, profile): the PROFILE least shingle hashes of `nodes` (node, doc_id, digest), in order, as 32-bit numbers."""

    def run(batches):
        for batch in batches:
            least, at = [], []
            for (row, s), digest in zip(shingle_sets(batch.column(0), words), batch.column(2).to_pylist(), strict=True):
                if digest_of(s) == digest:
                    least.append((s[:PROFILE] >> U64(32)).astype(np.uint32).tobytes())
                    at.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int32())), pa.array(least, pa.binary())], ["node", "profile"])

    return _texts(docs, nodes, doc_id, text).mapInArrow(run, "node long, profile binary").dropDuplicates(["node"])


class Profiles:
    """Profiles of many sets, to compare one with several others."""

    def __init__(self, raw: list[bytes]):
        self.values = np.frombuffer(b"".join(raw), np.uint32)
        self.ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
        self.top = np.array([np.frombuffer(r[-4:], np.uint32)[0] if len(r) == 4 * PROFILE else 0xFFFFFFFF for r in raw], np.int64)

    def similar(self, i: int, others: np.ndarray, floor: float) -> np.ndarray:
        """Whether others may have a similarity of `floor` with i; a true one is missed with odds below one in a million."""
        own, starts, lengths = self.values[self.ends[i] : self.ends[i + 1]], self.ends[others], self.ends[others + 1] - self.ends[others]
        row = np.repeat(np.arange(len(others)), lengths)
        value = self.values[np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)]
        # Of larger sets, only hashes up to the last that both profiles cover count.
        cut = np.minimum(self.top[i], self.top[others])
        used = value <= cut[row]
        shared = used & (own[np.minimum(np.searchsorted(own, value), len(own) - 1)] == value)
        both, theirs = (np.bincount(row, x, len(others)) for x in (shared, used))
        union = theirs + np.searchsorted(own, cut, "right") - both
        slack = np.where(cut < 0xFFFFFFFF, 5 * (floor * (1 - floor) / np.maximum(union, 1)) ** 0.5, 0.005)
        return both >= (floor - slack) * union


def confirmed(pairs: DataFrame, sets, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union, on full sets. sets: gives (node, shingles) of a table of nodes."""
    found = materialize(sets(materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")), "sets")
    left, right = (found.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    out = materialize(pairs.join(left, "a").join(right, "b").filter(100 * both >= similarity * union).select("a", "b"), "edges")
    drop_materialized(found)
    return out


def unsettled(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, comp) of the buckets that hold nodes of several components, to be compared by mixed_bucket_pairs."""
    labelled = crowded.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"))
    # Of buckets of the same nodes one is enough: that of the lowest band, which holds its pairs' first common band.
    mixed = mixed.filter("lo < hi").groupBy("n", "who", "lo", "hi").agg(F.min_by("key", F.pmod("key", F.lit(64))).alias("key")).select("key")
    return labelled.join(mixed, "key", "left_semi")


def mixed_bucket_pairs(rows: DataFrame, known: DataFrame, floor: float, least: float, bands: int, per: int, kind=np.uint8) -> DataFrame:
    """Pairs of one bucket in different components that may be similar, found block against block.

    rows: (key, node, comp); known: (node, sig, profile); kind: of the minima. Nodes outside a bucket's largest component are its
    strays; blocks of strays meet blocks of all its nodes, so a large bucket spreads over many tasks and nodes
    of the largest component never meet each other. A pair is given by its first common band only.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    buckets = buckets.select(
        "key", F.col("top.comp").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nx"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("ny")
    )
    dealt = rows.join(buckets, "key").withColumn("h", F.xxhash64("node"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod("h", F.col(n)).cast("int")
    everyone = dealt.select("key", place("nx").alias("x"), spread("ny").alias("y"), F.lit(False).alias("stray"), "node", "comp")
    strays = dealt.filter("comp <> main").select("key", spread("nx").alias("x"), place("ny").alias("y"), F.lit(True).alias("stray"), "node", "comp")

    def compare(t: pa.Table) -> pa.Table:
        node, comp, stray = (t[c].to_numpy() for c in ("node", "comp", "stray"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), kind).reshape(len(node), -1)
        sets = Profiles(t["profile"].to_pylist())
        here, all_of_them = t["key"][0].as_py() & 63, np.flatnonzero(~stray)
        out_a, out_b = [], []
        for i in np.flatnonzero(stray).tolist():
            j = all_of_them[comp[all_of_them] != comp[i]]
            same = sig[j] == sig[i]
            first = same.reshape(len(j), bands, per).all(axis=2).argmax(axis=1) if len(j) else j
            j = j[(same.mean(axis=1) >= least) & (first == here)]
            if len(j):
                j = j[sets.similar(i, j, floor)]
            out_a += [node[i]] * len(j)
            out_b += node[j].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    pairs = everyone.union(strays).join(known, "node").groupBy("key", "x", "y").applyInArrow(compare, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row a document: doc_id, row_key, n_shingles, component_id (smallest id reachable), kept.

    similarity: least Jaccard similarity of linked documents, in hundredths (80 or more, else ValueError).
    """
    if not 80 <= similarity <= 100:
        raise ValueError("similarity must be 80 to 100: the bands are tuned for that")
    n_hashes = bands * rows
    floor = similarity / 100
    least = floor - 6.5 * (floor * (1 - floor) / n_hashes) ** 0.5
    all_docs = materialize(sketches(text_batches(docs), doc_id, text, words, n_hashes), "sketch")
    groups = all_docs.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    nodes = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    owners, signed_nodes = nodes.select("node", "doc_id", "digest"), nodes.select("node", "sig")

    keyed = materialize(band_keys(signed_nodes, "node", bands, rows, np.uint8), "bands")
    stars = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", "centre")
    crowded = materialize(keyed.join(stars, "key"), "crowded")
    drop_materialized(keyed)
    pairs = crowded.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    signed = pairs.join(signed_nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(signed_nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = materialize(agreement(signed.select("a", "b", "sig_a", "sig_b"), least, np.uint8), "pairs")
    of = lambda ids: join_ids(owners, ids, "node", "left_semi")
    sets = lambda ids: sets_of(docs, materialize(of(ids), "owners"), doc_id, text, words)
    edges = confirmed(pairs, sets, similarity)
    found = materialize(components(edges), "comp")

    rest = materialize(unsettled(crowded, found), "mixed")
    drop_materialized(crowded)
    if not rest.isEmpty():
        known = signed_nodes.join(profiles(docs, materialize(of(materialize(rest.select("node").distinct(), "strays")), "owners"), doc_id, text, words), "node")
        more = materialize(mixed_bucket_pairs(rest, known, floor, least, bands, rows).join(pairs, ["a", "b"], "left_anti"), "more")
        late = confirmed(more, sets, similarity)
        if not late.isEmpty():
            found = materialize(components(edges.union(late)), "comp")
    drop_materialized(rest)

    placed = owners.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = placed.join(smallest, "component").select("digest", "component_id")
    out = all_docs.join(groups, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", ROW, "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
