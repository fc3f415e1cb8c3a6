"""Benchmark decontamination with an FM-index over each training shard (operator 1).

A shard is a slice of documents inside a Spark task, or a piece of a very long one. Its words become
symbols of the shard's own vocabulary, the suffixes of the symbol string are sorted, and the
Burrows-Wheeler string is stored as a wavelet matrix. Test phrases are searched
backwards through its ranks, all phrases at once; the occurrences are located by
walking to sampled suffix positions, and overlapping spans are merged.

Items are cut and hashed in tasks, long ones into pieces that overlap by all but one word of a window. The
pieces go to the tasks in blocks of at most `BLOCK_WORDS` words, so their size is bounded whatever the
benchmark's; every block meets all documents. With more than one block, the documents hit by each are
written and merged by id and text, so that rows of one id are told apart.

Defined cases: null texts have no words; an item of fewer words than a window is one
window, one without words none; repeated items count as items of their own, a null item id is the empty one,
repeated rows are documents of their own, and so are rows with a null id; an empty benchmark hits nothing; an
empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, row_key, text_batches, with_rows
from .words import BY_ALNUM, split_words

#: Words of test phrases in one broadcast block (8 bytes each, and as much again for each window).
BLOCK_WORDS = 1_000_000
#: Words of an item, or of a document, in one piece.
PIECE_WORDS = 1 << 16
#: Bytes of text in a shard, unless one document alone is longer.
SHARD_BYTES = 1 << 19
SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling on the groups that are still tied."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length() if n else 1)
    per = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(per):
        key <<= bits
        if k < n:
            key[: n - k] += symbols[k:]
    order = np.argsort(key)
    run = key[order]
    new = np.ones(n, bool)
    new[1:] = run[1:] != run[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    step = per
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(tied):
        at = order[tied]
        follow = at + step
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        group = rank[at]
        again = np.lexsort((second, group))
        at, second, group = at[again], second[again], group[again]
        order[tied] = at
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        head = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = head
        alone = fresh & np.append(fresh[1:], True)
        tied = tied[~alone]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a string, one bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.counts, self.zeros = bits, [], []
        now = symbols.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            one = (now >> level) & 1
            count = np.zeros(len(now) + 1, np.int32)
            np.cumsum(one, out=count[1:])
            self.counts.append(count)
            self.zeros.append(len(now) - int(count[-1]))
            mask = one.astype(bool)
            now = np.concatenate([now[~mask], now[mask]])

    def rank(self, symbols: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of symbols[i] before each of ends[i], less those before the symbol's own start."""
        at = [np.zeros(len(symbols), np.int64), *ends]
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbols >> level) & 1).astype(bool)
            count = self.counts[k]
            at = [np.where(one, self.zeros[k] + count[p], p - count[p]) for p in at]
        return [p - at[0] for p in at[1:]]


class FmIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        """symbols: 1 and above, in document order; 0 ends the text and is added here."""
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.tree = WaveletMatrix(self.last, max(1, int(n_symbols).bit_length()))
        kept = order % SAMPLE == 0
        self.kept_before = np.cumsum(kept) - kept
        self.kept, self.sampled = kept, order[kept]

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur. A phrase: symbols words[start : start + length]; 0: not in the text."""
        live = np.flatnonzero(lengths > 0)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.last), np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            turn = lengths[live] >= step
            symbol = words[starts[live] + np.maximum(lengths[live] - step, 0)]
            ok = ~turn | (symbol > 0)
            live, low, high, turn, symbol = live[ok], low[ok], high[ok], turn[ok], symbol[ok]
            if not len(live):
                break
            t = np.flatnonzero(turn)
            a, b = self.tree.rank(symbol[t], low[t], high[t])
            low[t], high[t] = self.before[symbol[t]] + a, self.before[symbol[t]] + b
            ok = low < high
            live, low, high = live[ok], low[ok], high[ok]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out, steps, at, left = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(left):
            there = self.kept[at]
            out[left[there]] = self.sampled[self.kept_before[at[there]]] + steps
            left, at = left[~there], at[~there]
            symbol = self.last[at]
            (a,) = self.tree.rank(symbol, at)
            at, steps = self.before[symbol] + a, steps + 1
        return out


def pieces(benchmark: DataFrame, item_id: str, text: str, words: int) -> DataFrame:
    """(item, words): hashed words of each item, long items in overlapping pieces."""

    def run(batches):
        for batch in batches:
            ids, names, out = batch.column(0).to_pylist(), [], []
            for w in split_words(batch.column(1), BY_ALNUM):
                for row, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True), w.lo):
                    for at in range(a, max(a + 1, b - words + 1), PIECE_WORDS) if b > a else ():
                        names.append(ids[row])
                        out.append(w.hashes[at : min(b, at + PIECE_WORDS + words - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["item", "words"])

    picked = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return text_batches(picked).mapInArrow(run, "item string, words binary")


class Phrases:
    """A block of item pieces: their words in one array, and start, length and item of every window."""

    def __init__(self, found: list[tuple[str, np.ndarray]], words: int):
        self.names = sorted({i for i, _ in found})
        place = {i: k for k, i in enumerate(self.names)}
        self.words = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in found)])
        sizes = np.array([len(h) for _, h in found], np.int64)
        n = np.maximum(sizes - words + 1, 1)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.starts = np.repeat(np.cumsum(sizes) - sizes, n) + within
        self.lengths = np.repeat(np.minimum(sizes, words), n)
        self.items = np.repeat(np.array([place[i] for i, _ in found], np.int64), n)


def blocks(pieces: DataFrame, words: int):
    """Yield the pieces as blocks; one at a time is held on the driver."""
    held, n = [], 0
    for r in pieces.toLocalIterator():
        held.append((r["item"], np.frombuffer(r["words"], np.uint64)))
        n += len(held[-1][1])
        if n >= BLOCK_WORDS:
            yield Phrases(held, words)
            held, n = [], 0
    yield Phrases(held, words)


def search_shard(hashes: np.ndarray, first: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in one shard: (window, start word, row). first: index of each row's first word, and the end."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(block.lengths):
        return none, none, none
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    # Rows are set apart by a symbol that no phrase has, one past the vocabulary.
    n_rows, n_words = len(first) - 1, len(hashes)
    text = np.full(n_words + n_rows, len(vocabulary) + 1, np.int64)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    text[np.arange(n_words) + row] = symbols + 1
    index = FmIndex(text, len(vocabulary) + 1)
    place = np.minimum(np.searchsorted(vocabulary, block.words), len(vocabulary) - 1)
    window, low, high = index.search(np.where(vocabulary[place] == block.words, place + 1, 0), block.starts, block.lengths)
    count = high - low
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else none
    at = index.locate(rows)
    starts = first[:-1] + np.arange(n_rows)
    of = np.searchsorted(starts, at, "right") - 1
    return np.repeat(window, count), at - of, of


def search_rows(hashes: np.ndarray, first: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search_shard, a long text in pieces that overlap by all but one word of the longest phrase."""
    over = int(block.lengths.max(initial=1)) - 1
    if len(first) != 2 or len(hashes) <= PIECE_WORDS + over:
        return search_shard(hashes, first, block)
    found = []
    for at in range(0, len(hashes) - over, PIECE_WORDS):
        part = hashes[at : at + PIECE_WORDS + over]
        window, start, row = search_shard(part, np.array([0, len(part)]), block)
        found.append((window, start + at, row))
    window, start, row = (np.concatenate(c) for c in zip(*found, strict=True))
    # A phrase shorter than the longest may lie in an overlap as a whole, and be found twice.
    once = np.unique(np.stack([window, start]), axis=1)
    return once[0], once[1], np.zeros(once.shape[1], np.int64)


_SPANS = "array<struct<start:long,end:long>>"


def occurrences(docs: DataFrame, keep: list[str], block, only_hit: bool = False) -> DataFrame:
    """Per document (last column: its text): `keep`, n_words, merged spans of hit words (start, end), and the items that occur."""

    def run(batches):
        phrases: Phrases = block.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for w in split_words(batch.column(len(keep)), BY_ALNUM, most=SHARD_BYTES):
                window, start, row = search_rows(w.hashes, w.first, phrases)
                change = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + phrases.lengths[window], -1)
                hit = np.cumsum(change)[:-1] > 0
                pairs = np.unique(np.stack([row, phrases.items[window]]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
                touched = set(pairs[0].tolist())
                for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    n_words.append(b - a)
                    if r not in touched:
                        spans.append([])
                        items.append([])
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                    items.append([phrases.names[i] for i in pairs[1][pairs[0] == r].tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(x) for x in spans])) if only_hit else out

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return text_batches(docs).mapInArrow(run, f"{kinds}, n_words long, spans {_SPANS}, items array<string>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 13, share: int = 5
) -> DataFrame:
    """One row a document: doc_id, row_key, n_words, n_hit, n_items, items (ids as strings, sorted), spans (in words), contaminated.

    share: percent of a document's words that must be hit for `contaminated`. row_key: see `common.row_key`.
    """
    sc = docs.sparkSession.sparkContext
    keyed = docs.select(F.col(doc_id).alias("doc_id"), row_key(text).alias(ROW), F.col(text).cast("string").alias("text"))
    found = materialize(pieces(benchmark, item_id, item_text, words), "items")
    if found.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] < 8 * BLOCK_WORDS:
        (block,) = blocks(found, words)
        out = occurrences(keyed, ["doc_id", ROW], sc.broadcast(block))
    else:
        parts = []
        for block in blocks(found, words):
            shared = sc.broadcast(block)
            parts.append(materialize(occurrences(keyed, ["doc_id", ROW], shared, only_hit=True), "hits"))
            shared.destroy()
        counted = occurrences(keyed, ["doc_id", ROW], sc.broadcast(Phrases([], words))).select("doc_id", ROW, "n_words")
        out = with_rows(counted, materialize(_merged(parts), "merged"))
        out = out.withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", ROW, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), "spans",
        ((n_hit > 0) & (100 * n_hit >= share * F.col("n_words"))).alias("contaminated"),
    )


def _merged(parts: list[DataFrame]) -> DataFrame:
    """(doc_id, row_key, spans, items) of the documents that any block hits; rows equal in id and text have equal hits in each."""
    both = reduce(DataFrame.unionByName, parts).groupBy("doc_id", ROW).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    start = F.struct(F.array().cast(_SPANS).alias("done"), F.lit(None).cast("struct<start:long,end:long>").alias("open"))

    def step(acc, s):
        joins = acc["open"].isNotNull() & (s["start"] <= acc["open"]["end"])
        wider = F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], s["end"]).alias("end"))
        closed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(joins, acc["done"]).otherwise(closed).alias("done"), F.when(joins, wider).otherwise(s).alias("open"))

    merged = F.aggregate("s", start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return both.select("doc_id", ROW, merged.alias("spans"), "items")
