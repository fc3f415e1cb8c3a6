"""Language-model scores by a hidden Markov model (operator 4).

Token counts of all training texts are summed across partitions. The VOCABULARY most
frequent tokens are symbols of the model; every other token, seen or not, is emitted
as one of CLASSES classes by its ending, and then by its smoothed count within the
class, so that the probabilities of all tokens sum to one. Each Baum-Welch round sums expected counts
of transitions and emissions across partitions; only those sums (states x symbols, a
fixed size) reach the driver. Scores are exact: the scaled forward recursion over each
whole document, and a join of its rarer tokens with the count table.

For training, documents are cut into pieces of PIECE tokens, each read with CONTEXT tokens before and after it that are not
counted: every token, and every step to a token, counts once, in its context, and only a document's first token as a start.

Defined cases: null and empty texts are the end token alone; a null id falls into the fold of the empty
text; repeated rows count and are scored each; with no training text every token is
unseen; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import BY_SPACE, U64, mix, split_words

STATES = 8
ROUNDS = 4
VOCABULARY = 60_000
CLASSES = 256
PIECE = 256
#: Tokens around a piece from which its states are judged; what lies farther has no weight to speak of.
CONTEXT = 32
#: Tokens of a group of sequences that run side by side.
GROUP = 1 << 18
ADD = 0.1
END = np.int64(0x656E64)


@dataclass
class Counts:
    """Broadcast part of the token counts. Symbols: frequent tokens by sorted hash, then classes, then the end token."""

    hashes: np.ndarray
    counts: np.ndarray
    class_mass: np.ndarray
    class_tokens: np.ndarray
    end: int
    total: int
    distinct: int

    @property
    def n_symbols(self) -> int:
        return len(self.hashes) + CLASSES + 1

    @property
    def kind(self) -> type:
        """Of a stored symbol."""
        return np.uint16 if self.n_symbols <= 1 << 16 else np.uint32

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts, self.class_tokens, [self.end]]).astype(float)

    def encode(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, frequent) of each token."""
        if not len(self.hashes):
            return classes.astype(np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        frequent = self.hashes[at] == hashes
        return np.where(frequent, at, len(self.hashes) + classes), frequent


def tokens(column):
    """Yield (Words, hashes as int64, class of each token by its last two bytes)."""
    for w in split_words(column, BY_SPACE):
        last = w.data[w.ends - 1].astype(U64)
        second = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(U64)
        yield w, w.hashes.view(np.int64), (mix(last * U64(257) + second) % U64(CLASSES)).astype(np.int64)


def token_counts(train: DataFrame) -> DataFrame:
    """(hash, class, c) over all training texts, the end token included (class -1)."""

    def run(batches):
        for batch in batches:
            hashes, classes = [np.full(batch.num_rows, END)], [np.full(batch.num_rows, -1)]
            for _, h, c in tokens(batch.column(0)):
                hashes.append(h)
                classes.append(c)
            u, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.concatenate(classes)[first].astype(np.int16)), pa.array(n)], ["hash", "class", "c"])

    return train.select("text").mapInArrow(run, "hash long, class short, c long").groupBy("hash").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


def summary(counts: DataFrame, vocabulary: int) -> Counts:
    top = counts.filter("class >= 0").orderBy(F.desc("c"), "hash").limit(vocabulary).toArrow()
    hashes, c, cls = (top[k].to_numpy() for k in ("hash", "c", "class"))
    order = np.argsort(hashes)
    mass, rare = np.zeros(CLASSES), np.zeros(CLASSES)
    by_class = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    total, distinct, end = sum(r.c for r in by_class), sum(r.n for r in by_class), 0
    for r in by_class:
        if r["class"] < 0:
            end = r.c
        else:
            mine = cls == r["class"]
            rare[r["class"]] = r.c - c[mine].sum()
            mass[r["class"]] = rare[r["class"]] + ADD * (r.n - mine.sum())
    return Counts(hashes[order], c[order], mass, rare, end, total, distinct)


def encoded(docs: DataFrame, counts: Counts) -> DataFrame:
    """One row a document: symbols (16 bits each, or 32), counts and base score of its frequent tokens, hashes of its rarer ones."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "held_out", "rid", "symbols", "n_tokens", "known", "base", "within", "rare"]

    def run(batches):
        m: Counts = shared.value
        scale = np.log10(m.total + ADD * (m.distinct + 1))
        base_of = np.log10(np.append(m.counts, 0) + ADD) - scale
        within_of = -np.log10(m.class_mass + ADD)
        for batch in batches:
            out = [[] for _ in names[3:]]
            for w, h, c in tokens(batch.column(3)):
                symbol, frequent = m.encode(h, c)
                sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[w.first])  # noqa: E731,B023
                n = w.counts
                base = sums(np.where(frequent, base_of[np.minimum(symbol, len(base_of) - 1)], -scale)) + np.log10(m.end + ADD) - scale
                ends = np.insert(symbol.astype(m.kind), w.first[1:], m.kind(m.n_symbols - 1))
                where = w.first + np.arange(len(w.first))
                out[0] += [ends[a:b].tobytes() for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                out[1].append(n + 1)
                out[2].append(sums(frequent).round().astype(np.int64) + (m.end > 0))
                out[3].append(base)
                out[4].append(sums(np.where(frequent, 0.0, within_of[c])))
                few = np.concatenate([[0], np.cumsum(~frequent)])[w.first]
                out[5].append((h[~frequent], np.diff(few)))
            lists = np.concatenate([[0], *(k for _, k in out[5])])
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum(lists).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(v for v, _ in out[5])])))
            flat = [np.concatenate(c) if c else np.zeros(0) for c in out[1:5]]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out[0], pa.binary()), *(pa.array(v.astype(k.to_pandas_dtype()), k) for v, k in zip(flat, kinds, strict=True)), rare], names)

    picked = docs.select("doc_id", "held_out", F.monotonically_increasing_id().alias("rid"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, rid long, symbols binary, n_tokens long, known long, base double, within double, rare array<long>")


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @property
    def kind(self) -> type:
        return np.uint16 if len(self.emit) <= 1 << 16 else np.uint32

    @staticmethod
    def first(counts: Counts, states: int, seed: int = 5) -> Hmm:
        """Unigrams, tilted by a seeded hash for each state; states tend to stay."""
        n = counts.n_symbols
        tilt = (mix(np.arange(n * states, dtype=U64) + U64(seed << 40)) >> U64(11)).astype(float).reshape(n, states) / 2.0**53
        emit = (counts.symbol_counts() + ADD)[:, None] * (0.5 + tilt)
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, symbols: np.ndarray, lengths: np.ndarray, keep: bool = False, number: type = np.float32):
        """(log probability of each sequence, alphas, scales). symbols: time x sequence, longest sequence first."""
        steps, width = symbols.shape
        logs, state = np.zeros(width), None
        alphas = np.zeros((steps, width, len(self.start)), number) if keep else None
        scales = np.ones((steps, width), number) if keep else None
        emit, move = self.emit.astype(number), self.move.astype(number)
        live = np.searchsorted(-lengths, -np.arange(steps), "left")
        for t in range(steps):
            k = live[t]
            state = (self.start.astype(number) if t == 0 else state[:k] @ move) * emit[symbols[t, :k]]
            scale = state.sum(axis=1)
            state /= scale[:, None]
            logs[:k] += np.log(scale)
            if keep:
                alphas[t, :k], scales[t, :k] = state, scale
        return logs, alphas, scales

    def expected(self, symbols: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, transitions, and emissions (symbols x states).

        Of each sequence only the tokens from first to before last count, with the steps to them; a start only where it begins a text.
        """
        steps, width = symbols.shape
        time = np.arange(steps)[:, None]
        used = (time >= (0 if first is None else first)) & (time < (lengths if last is None else last))
        _, alphas, scales = self.forward(symbols, lengths, keep=True)
        emit, back = self.emit.astype(np.float32), np.ascontiguousarray(self.move.T.astype(np.float32))
        live = np.searchsorted(-lengths, -np.arange(steps), "left")
        moves = np.zeros_like(self.move)
        beta = np.ones((width, len(self.start)), np.float32)
        for t in range(steps - 2, -1, -1):
            k = live[t + 1]
            ahead = emit[symbols[t + 1, :k]] * beta[:k] / scales[t + 1, :k, None]
            moves += alphas[t, :k].T @ (ahead * used[t + 1, :k, None])
            alphas[t + 1, :k] *= beta[:k]
            beta[:k] = ahead @ back
        alphas[0] *= beta
        gamma, seen = alphas[used], symbols[used]
        emitted = np.stack([np.bincount(seen, gamma[:, s], len(self.emit)) for s in range(len(self.start))], axis=1)
        starts = alphas[0] if begins is None else alphas[0][begins]
        return starts.sum(axis=0), moves * self.move, emitted


def pieces_of(symbols: np.ndarray) -> list[tuple[np.ndarray, int, int, bool]]:
    """(tokens with their context, first and last that count, whether the text begins here) of each piece of a text."""
    out = []
    for at in range(0, len(symbols), PIECE):
        low, end = max(0, at - CONTEXT), min(len(symbols), at + PIECE)
        out.append((symbols[low : end + CONTEXT], at - low, end - low, at == 0))
    return out


def groups(sequences: list[np.ndarray], most: int = GROUP):
    """Yield (places, time x sequence matrix, lengths) of sequences of like length, longest first."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        part = order[at : at + max(1, most // max(1, longest))]
        at += len(part)
        lengths = np.array([len(sequences[i]) for i in part])
        matrix = np.zeros((longest, len(part)), sequences[0].dtype)
        for k, i in enumerate(part):
            matrix[: lengths[k], k] = sequences[i]
        yield part, matrix, lengths


def baum_welch(symbols: DataFrame, model: Hmm, prior: np.ndarray) -> Hmm:
    """One round over all training sequences. prior: pseudo-counts of each symbol."""
    shared = symbols.sparkSession.sparkContext.broadcast(model)
    states, kind = len(model.start), model.kind
    columns = [f"s{i}" for i in range(states)]

    def run(batches):
        m: Hmm = shared.value
        starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros_like(m.emit)
        for batch in batches:
            pieces = []
            for raw in batch.column(0).to_pylist():
                pieces += pieces_of(np.frombuffer(raw, kind))
            first, last, begins = (np.array([p[i] for p in pieces], t) for i, t in ((1, int), (2, int), (3, bool)))
            for part, matrix, lengths in groups([p[0] for p in pieces]):
                a, b, c = m.expected(matrix, lengths, first[part], last[part], begins[part])
                starts, moves, emitted = starts + a, moves + b, emitted + c
        some = np.flatnonzero(emitted.any(axis=1))
        keys = np.concatenate([[-1], -2 - np.arange(states), some])
        values = np.concatenate([starts[None, :], moves, emitted[some]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(values[:, i]) for i in range(states))], ["key", *columns])

    sums = symbols.mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in columns))
    t = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    key, value = t["key"].to_numpy(), np.stack([t[c].to_numpy() for c in columns], axis=1)
    start, move, emit = np.full(states, ADD), np.full((states, states), ADD), np.repeat(prior[:, None], states, axis=1)
    for k, v in zip(key[key < 0].tolist(), value[key < 0], strict=True):
        if k == -1:
            start += v
        else:
            move[-2 - k] += v
    emit[key[key >= 0]] += value[key >= 0]
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def likelihoods(table: DataFrame, model: Hmm) -> DataFrame:
    """table's doc_id, held_out, rid, n_tokens, known, base, within, with hmm: log10 probability of the symbols."""
    shared, kind = table.sparkSession.sparkContext.broadcast(model), model.kind

    def run(batches):
        m: Hmm = shared.value
        for batch in batches:
            sequences = [np.frombuffer(raw, kind) for raw in batch.column(0).to_pylist()]
            logs = np.zeros(len(sequences))
            for places, matrix, lengths in groups(sequences):
                logs[places] = m.forward(matrix, lengths, number=np.float64)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(logs / np.log(10))], [*batch.schema.names[1:], "hmm"])

    picked = table.select("symbols", "doc_id", "held_out", "rid", "n_tokens", "known", "base", "within")
    id_type = table.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, rid long, n_tokens long, known long, base double, within double, hmm double")


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column. vocabulary: tokens that are symbols; the model is a table of vocabulary x states numbers.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    counts = materialize(token_counts(rows.filter(~F.col("held_out"))), "token-counts")
    known = summary(counts, vocabulary)
    table = materialize(encoded(rows, known), "symbols")
    model = Hmm.first(known, states)
    prior = ADD * (known.symbol_counts() + ADD) / states
    train = table.filter(~F.col("held_out")).select("symbols")
    for _ in range(rounds if known.total else 0):
        model = baum_welch(train, model, prior)

    rare = table.select("rid", F.explode("rare").alias("hash")).join(counts.select("hash", "c"), "hash", "left")
    by_doc = rare.groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("rare_logs"), F.count("c").alias("rare_known"))
    scored = likelihoods(table, model).join(by_doc, "rid", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("hmm") + F.col("within") + logs).alias("score"),
    )
