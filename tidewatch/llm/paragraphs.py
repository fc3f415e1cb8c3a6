"""Substring deduplication by paragraphs (operator 5).

Two kinds of paragraphs are deduplicated across documents:

* lines of at least `least_line` words: MinHash signatures over five-word shingles in
  many narrow bands (two minima of 32 bits each, so that recall is high and strangers seldom meet), stars of colliding
  lines, exact Jaccard similarity of at least 0.8 on full sets, and clusters by
  connected components; lines of different clusters that share a bucket are then
  compared in blocks, confirmed alike, and the clusters computed again;
* floating paragraphs, for passages spliced into other lines: every run of `least_words` words
  that an earlier document has too. Anchors (runs of half as many words whose hash is the
  least of a window) fall on the same words wherever a passage stands, and every run of
  `least_words` words holds one. Only around anchors that several documents share are runs looked
  up: all the words around at once where every document has the same, else run by run. So each
  removed word lies in a run that one earlier document has in a row.

A cluster's owner, the document of the smallest id, keeps its paragraph; the other
documents lose theirs. A document's own repeats are left alone.

Lines of fewer than `least_line` words and runs of fewer than `least_words` are left alone, exact copies
included: short lines recur in honest documents.

Defined cases: null and empty texts have no paragraphs; rows with a null id are left
alone; rows that share an id are one owner and do not lose paragraphs to each other, and each
loses its own spans (`row_key` tells them apart); ids may be of any type that has an order; an empty
table gives no rows; further columns pass through `remove` and are not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import minhash
from .common import ROW, drop_materialized, materialize, row_key, text_batches
from .components import components
from .words import BY_SPACE, U64, Words, chain, mix, slices, split_words, text_buffers

SHINGLE = 5
#: Rows named by id and text hash (16 bytes) that are broadcast; of more, all texts are shuffled to meet them.
BROADCAST_ROWS = 1_000_000
#: 12 bands of 2 minima: at similarity 0.8 a pair shares one with odds 1 - (1 - 0.64)^12, all but 5e-6.
BANDS, ROWS = 12, 2
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash of the words from each start to its end."""
    up = np.multiply.accumulate(np.append(U64(1), np.full(len(words), _BASE)))
    down = np.multiply.accumulate(np.append(U64(1), np.full(len(words), _INVERSE)))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(words * up[:-1])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def _slide(values: np.ndarray, n: int, pick) -> np.ndarray:
    """np.minimum or np.maximum of every n values in a row."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def segment_starts(words: np.ndarray, first: np.ndarray, least_words: int = 40) -> np.ndarray:
    """True at each word that begins an anchor; every run of least_words words of a row has a whole anchor in it."""
    n, size = len(words), max(1, least_words // 2)
    out, window = np.zeros(n, bool), least_words - size + 1
    if n < least_words:
        return out
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = run_hashes(words, np.arange(n - size + 1), np.arange(size, n + 1)) >> U64(1)
    least = np.where(row[: n - least_words + 1] == row[least_words - 1 :], _slide(hashes, window, np.minimum) + U64(1), U64(0))
    edge = np.zeros(window - 1, U64)
    out[: n - size + 1] = _slide(np.concatenate([edge, least, edge]), window, np.maximum) == hashes + U64(1)
    return out


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def anchors(docs: DataFrame, least_words: int) -> DataFrame:
    """Every anchor: its hash, and hash and place in words of all runs of least_words words that hold it."""
    size = max(1, least_words // 2)

    def run(batches):
        for batch in batches:
            for w in split_words(batch.column(2), BY_SPACE):
                at = np.flatnonzero(segment_starts(w.hashes, w.first, least_words))
                if not len(at):
                    continue
                row = np.searchsorted(w.first, at, "right") - 1
                start, end = np.maximum(at + size - least_words, w.first[row]), np.minimum(at + least_words, w.first[row + 1])
                around = mix(run_hashes(w.hashes, start, end) + (at - start).astype(U64))
                of = pa.array(w.lo + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_hashes(w.hashes, at, at + size).view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of),
                     pa.array((start - w.first[row]).astype(np.int32)), pa.array((end - w.first[row]).astype(np.int32))],
                    ["hash", "around", "doc_id", ROW, "start", "end"],
                )

    return docs.select("doc_id", ROW, "text").mapInArrow(run, f"hash long, around long, doc_id {_id_type(docs)}, {ROW} long, start int, end int")


def _places(docs: DataFrame, places: DataFrame, kind: str) -> DataFrame:
    """doc_id, row_key, text and `at` (list of kind) of the documents that `places` (doc_id, row_key, and the fields of kind) names."""
    wanted = materialize(places.groupBy("doc_id", ROW).agg(F.collect_list(F.struct(*kind.split())).alias("at")), "places")
    texts = docs.select("doc_id", ROW, "text")
    if wanted.count() <= BROADCAST_ROWS:  # only the texts that are wanted are shuffled, if any
        texts = texts.join(F.broadcast(wanted.select("doc_id", ROW)), ["doc_id", ROW], "left_semi")
    return texts.join(wanted, ["doc_id", ROW])


def _placed(column: pa.Array, w: Words, upto: np.ndarray, *fields: str) -> tuple[np.ndarray, ...]:
    """Row in w, and the fields, of the places of w's rows. upto: places before each row of the batch."""
    some = column.flatten().slice(int(upto[w.lo]), int(upto[w.hi] - upto[w.lo]))
    row = np.repeat(np.arange(w.hi - w.lo), np.diff(upto[w.lo : w.hi + 1]))
    return row, *(some.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)


def runs(docs: DataFrame, places: DataFrame, least_words: int) -> DataFrame:
    """Every run of least_words words within the places (doc_id, row_key, start, end): (hash, doc_id, row_key, start)."""

    def run(batches):
        for batch in batches:
            upto = np.cumsum([0, *batch.column(3).value_lengths().to_pylist()])
            for w in split_words(batch.column(2), BY_SPACE):
                row, start, end = _placed(batch.column(3), w, upto, "start", "end")
                a, b = w.first[row] + start, np.minimum(w.first[row] + end, w.first[row + 1]) - least_words + 1
                a, b, n = a[b > a], b[b > a], len(w.hashes) + 1
                begins = np.flatnonzero(np.cumsum(np.bincount(a, minlength=n) - np.bincount(b, minlength=n)) > 0)
                if len(begins):
                    row = np.searchsorted(w.first, begins, "right") - 1
                    of = pa.array(w.lo + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(run_hashes(w.hashes, begins, begins + least_words).view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array((begins - w.first[row]).astype(np.int32))],
                        ["hash", "doc_id", ROW, "start"],
                    )

    return _places(docs, places, "start end").mapInArrow(run, f"hash long, doc_id {_id_type(docs)}, {ROW} long, start int")


def lines(docs: DataFrame, least: int) -> DataFrame:
    """Every line of at least `least` words: its hash, place in words, and signature."""

    def some(texts: list):
        split = [(t or "").split("\n") for t in texts]
        ws = list(split_words(pa.array([x for p in split for x in p], pa.string()), BY_SPACE))
        hashes, counts = np.concatenate([w.hashes for w in ws]), np.concatenate([w.counts for w in ws])
        first = np.concatenate([[0], np.cumsum(counts)])
        long = np.flatnonzero(counts >= least)
        start, end = first[long], first[long + 1]
        n_lines = [len(p) for p in split]
        doc = np.repeat(np.arange(len(texts)), n_lines)[long]
        begin = first[np.cumsum([0, *n_lines])[:-1]][doc]
        sigs = minhash.minima_of_runs(chain(hashes, SHINGLE), start, end - SHINGLE + 1, BANDS * ROWS)
        return run_hashes(hashes, start, end).view(np.int64), doc, start - begin, end - begin, sigs

    def run(batches):
        for batch in batches:
            for lo, hi in slices(text_buffers(batch.column(2))[1]):
                keys, doc, start, end, sigs = some(batch.column(2).slice(lo, hi - lo).to_pylist())
                of = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column(0).take(of), batch.column(1).take(of), pa.array(start), pa.array(end), pa.array([s.tobytes() for s in sigs], pa.binary())],
                    ["hash", "doc_id", ROW, "start", "end", "sig"],
                )

    return docs.select("doc_id", ROW, "text").mapInArrow(run, f"hash long, doc_id {_id_type(docs)}, {ROW} long, start long, end long, sig binary")


def line_sets(docs: DataFrame, found: DataFrame, nodes: DataFrame, profile: bool = False) -> DataFrame:
    """(node, shingles) or (node, profile) of the lines `nodes` (node: a hash), each cut out of one document that has it."""
    one = found.select(F.col("hash").alias("node"), "doc_id", ROW, "start", "end").join(nodes, "node", "left_semi")
    one = one.groupBy("node").agg(F.min(F.struct("doc_id", ROW, "start", "end")).alias("p")).select("node", "p.*")

    def run(batches):
        for batch in batches:
            upto = np.cumsum([0, *batch.column(3).value_lengths().to_pylist()])
            for w in split_words(batch.column(2), BY_SPACE):
                row, node, start, end = _placed(batch.column(3), w, upto, "node", "start", "end")
                whole = chain(w.hashes, SHINGLE)
                sets = [np.unique(whole[a:b]) for a, b in zip((w.first[row] + start).tolist(), (w.first[row] + end - SHINGLE + 1).tolist(), strict=True)]
                if profile:
                    out = pa.array([(s[: minhash.PROFILE] >> U64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())
                else:
                    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(s.view(np.int64) for s in sets)])))
                yield pa.RecordBatch.from_arrays([pa.array(node), out], ["node", "profile" if profile else "shingles"])

    return _places(docs, one, "node start end").mapInArrow(run, "node long, profile binary" if profile else "node long, shingles array<long>")


def repeated_lines(docs: DataFrame, least_line: int, similarity: int) -> DataFrame:
    """Spans (doc_id, row_key, start, end, owner) of lines whose cluster has an earlier document."""
    signed_lines = materialize(lines(docs, max(least_line, SHINGLE)), "lines")
    nodes = materialize(signed_lines.select(F.col("hash").alias("node"), "sig").dropDuplicates(["node"]), "line-nodes")
    found = signed_lines.drop("sig")
    keyed = minhash.band_keys(nodes, "node", BANDS, ROWS, np.uint32)
    stars = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    stars = materialize(stars, "line-stars")
    crowded = materialize(keyed.join(stars.filter("n > 2").select("key", "a"), "key"), "line-crowded")
    pairs = stars.select("a", "b").union(crowded.filter("node <> a").select("a", F.col("node").alias("b"))).distinct()
    floor = similarity / 100
    least = max(floor - 4.5 * (0.16 / (BANDS * ROWS)) ** 0.5, 0.2)
    signed = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = materialize(minhash.agreement(signed.select("a", "b", "sig_a", "sig_b"), least, np.uint32), "line-pairs")
    drop_materialized(stars)
    sets = lambda ids: line_sets(docs, found, ids)
    edges = minhash.confirmed(pairs, sets, similarity)
    clusters = materialize(components(edges), "line-clusters")

    # Near lines whose star has another centre: nodes of different components meet within their buckets.
    rest = materialize(minhash.unsettled(crowded, clusters), "line-mixed")
    drop_materialized(crowded)
    if not rest.isEmpty():
        known = nodes.join(line_sets(docs, found, materialize(rest.select("node").distinct(), "line-strays"), profile=True), "node")
        more = minhash.mixed_bucket_pairs(rest, known, floor, least, BANDS, ROWS, np.uint32)
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "line-more")
        late = minhash.confirmed(more, sets, similarity)
        if not late.isEmpty():
            clusters = materialize(components(edges.union(late)), "line-clusters")
    placed = found.join(clusters.withColumnRenamed("node", "hash"), "hash", "left").withColumn("cluster", F.coalesce("component", "hash"))
    owners = placed.groupBy("cluster").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("cluster", "owner")
    spans = materialize(placed.join(owners, "cluster").filter("doc_id <> owner").select("doc_id", ROW, "start", "end", "owner"), "line-spans")
    drop_materialized(signed_lines, nodes, rest)
    return spans


def repeated_passages(docs: DataFrame, least_words: int) -> DataFrame:
    """Spans (doc_id, row_key, start, end, owner) of least_words words or more that the owner, an earlier document, has in a row."""
    found = materialize(anchors(docs, least_words), "anchors")
    groups = found.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min("around").alias("lo"), F.max("around").alias("hi"))
    groups = materialize(groups.filter("owner < last").select("hash", "owner", (F.col("lo") == F.col("hi")).alias("alike")), "anchor-groups")
    shared = materialize(found.join(groups, "hash").filter("not alike or doc_id <> owner").select("doc_id", ROW, "start", "end", "owner", "alike"), "shared-anchors")
    drop_materialized(found, groups)
    alike = shared.filter("alike").select("doc_id", ROW, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "owner")

    each = materialize(runs(docs, shared.filter("not alike").select("doc_id", ROW, "start", "end"), least_words), "runs")
    firsts = each.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("hash", "owner")
    again = each.join(materialize(firsts, "run-owners"), "hash").filter("doc_id <> owner")
    again = again.select("doc_id", ROW, F.col("start").cast("long").alias("start"), (F.col("start") + least_words).cast("long").alias("end"), "owner")
    spans = materialize(alike.union(again), "passage-spans")
    drop_materialized(each, shared)
    return spans


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_line: int = 25, least_words: int = 40, similarity: int = 80) -> DataFrame:
    """Spans to remove, merged: (doc_id, row_key, start, end, owner, n_words), positions in words of the text."""
    docs = text_batches(docs).select(F.col(doc_id).alias("doc_id"), row_key(text).alias(ROW), F.col(text).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    by_line, by_run = repeated_lines(docs, least_line, similarity), repeated_passages(docs, least_words)
    by_start = Window.partitionBy("doc_id", ROW).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    joined = by_line.union(by_run).withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by_start))
    merged = joined.groupBy("doc_id", ROW, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("owner").alias("owner"))
    out = materialize(merged.select("doc_id", ROW, "start", "end", "owner", (F.col("end") - F.col("start")).alias("n_words")), "spans")
    drop_materialized(by_line, by_run)
    return out


def remove(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the spans' words, and what stands between them, cut out of the text."""
    cut = "cuts"
    while cut in docs.columns:
        cut += "_"
    by_row = spans.groupBy("doc_id", ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cut))
    same = (docs[doc_id] == by_row["doc_id"]) & (row_key(docs[text]) == by_row[ROW])
    joined = text_batches(docs).join(by_row, same, "left").select(*(docs[c] for c in docs.columns), by_row[cut])
    place, names = docs.columns.index(text), docs.columns

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, found in enumerate(cuts):
                if not found or not texts[i]:
                    continue
                (w,) = split_words(pa.array([texts[i]], pa.string()), BY_SPACE)
                raw, out, done = texts[i].encode(), [], 0
                for s in found:
                    out.append(raw[done : w.starts[s["start"]]])
                    done = w.ends[s["end"] - 1]
                texts[i] = b"".join([*out, raw[done:]]).decode()
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
