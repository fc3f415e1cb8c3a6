"""Language identification by interpolated Kneser-Ney character models (operator 2).

One model of 4-grams for each language, its tables being sorted arrays of hashes;
a document gets the language of the lowest cross-entropy a character. It is
rejected if even that is worse than a calibrated limit: a high quantile of held-back labelled documents, with a
margin, and more for short texts, whose cross-entropy spreads more. The fewer held-back documents a language has, the more
its limit follows the spread of all languages' documents around their means (POOLED documents weigh as much as the own
ones); with none at all it is the entropy of guessing characters blindly.

The classifier is fitted on at most FIT_ROWS whole labelled documents of each
language and FIT_CHARS characters of them, those with the least hashes of id and text (copies of a row teach once);
that bounds the model, which is broadcast. Everything is scored.

Letters are their code points; those beyond U+FFFF share 8,448 codes that no letter has, by a hash.

Defined cases: null texts and texts without a letter are `und`, with score 0, and
rejected; with nothing to learn from every document is `und`; rows with a null
label teach nothing; an empty table gives no rows. Further columns are kept; the four added ones replace columns of their names, unless a
`prefix` names them otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, text_batches
from .words import U64, mix, slices, text_buffers

ORDER = 4
FIT_ROWS = 2000
#: Characters of these documents; one that would go beyond is left out of the sample.
FIT_CHARS = 20_000_000
#: One in so many documents of the sample calibrates and is not counted.
CALIBRATE = 5
QUANTILE = 0.999
#: Nats a character above the quantile.
MARGIN = 0.25
#: Least addition for a text of n characters, nats times the root of n: a number or a key among few words is no other language.
SPREAD = 8.0
#: Characters from which a text's cross-entropy counts as it is, and how many own documents the spread of all languages weighs.
LONG, POOLED = 200, 30
#: More labels than that are no languages.
MAX_LANGUAGES = 1000
#: Up to so many grams times languages have their logarithms in one table (8 bytes each); beyond it each language looks up its own arrays. The results are the same.
TABLE_CELLS = 25_000_000
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-gram that ends at each character, first gram of each row and the end).

    Characters are lower-cased letters; a run of others is one blank (0); before a text stand blanks.
    """
    lowered = [(t or "").lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    letter = _letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    symbols, row, letter = codes[keep], row[keep], letter[keep]
    # 0xD800 to 0xF8FF are surrogates and private codes: no letters.
    symbols = np.where(symbols > 0xFFFF, 0xD800 + symbols * np.uint32(2654435761) % np.uint32(0x2100), symbols)
    symbols = np.where(letter, symbols, 0).astype(U64)
    pad = ORDER - 1
    at = np.arange(len(symbols)) + (row + 1) * pad
    padded = np.zeros(len(symbols) + len(texts) * pad, U64)
    padded[at] = symbols
    key = padded[at]
    for k in range(1, ORDER):
        key = key | (padded[at - k] << U64(16 * k))
    return key, np.searchsorted(row, np.arange(len(texts) + 1))


class SortedHashes:
    """Sorted hashes of keys, found through an index on their leading bits."""

    def __init__(self, keys: np.ndarray):
        h = mix(keys)
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], U64(0xFFFFFFFFFFFFFFFF))
        self.shift = U64(64 - max(4, int(len(keys)).bit_length() + 1))
        self.start = np.searchsorted(self.hashes[:-1], np.arange(1 << int(64 - int(self.shift)), dtype=U64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in sorted order, or -1."""
        h = mix(keys)
        at = self.start[h >> self.shift]
        behind = np.flatnonzero(self.hashes[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < h[behind]]
        return np.where((self.hashes[at] == h) & (at < len(self.order)), at, -1)


class _Table:
    """Values by key: value(key), 0 where absent."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.index = SortedHashes(keys)
        self.values = [np.append(np.asarray(v, np.float64)[self.index.order], 0.0) for v in values]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        at = self.index.find(keys)
        return [v[at] for v in self.values]


class KneserNey:
    """Interpolated Kneser-Ney over packed grams with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        now, c = keys, counts.astype(np.float64)
        for n in range(ORDER, 0, -1):
            ones, twos = float((c == 1).sum()), float((c == 2).sum())
            discount = ones / (ones + 2 * twos) if ones else 0.5
            context, inverse = np.unique(now >> U64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            self.levels.append((n, min(discount, 0.95), _Table(now, c), _Table(context, total, kinds)))
            if n > 1:  # continuation counts: different characters before
                now, c = np.unique(now & U64((1 << (16 * (n - 1))) - 1), return_counts=True)
        self.symbols = len(now) + 1

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1.0 / self.symbols)
        for n, discount, seen, contexts in reversed(self.levels):
            part = keys & U64((1 << (16 * n)) - 1) if n < ORDER else keys
            (c,) = seen.get(part)
            total, kinds = contexts.get(part >> U64(16))
            some = np.maximum(total, 1)
            p = np.where(total > 0, np.maximum(c - discount, 0) / some + discount * kinds / some * p, p)
        return p


@dataclass
class Model:
    languages: list[str]
    models: list[KneserNey]
    known: SortedHashes
    logs: np.ndarray
    limits: np.ndarray
    #: Added to a limit for a text of n characters: spread / sqrt(n).
    spreads: np.ndarray

    @staticmethod
    def of(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        models = [KneserNey(*counts[x]) for x in languages]
        keys = np.unique(np.concatenate([counts[x][0] for x in languages])) if languages else np.zeros(0, U64)
        if len(keys) * len(languages) > TABLE_CELLS:
            keys = keys[:0]
        known = SortedHashes(keys)
        keys = keys[known.order]
        logs = np.stack([np.log(m.probability(keys)) for m in models], axis=1) if models else np.zeros((0, 0))
        return Model(languages, models, known, logs, np.full(len(languages), np.inf), np.zeros(len(languages)))

    def calibrate(self, best: np.ndarray, n: np.ndarray, h: np.ndarray) -> None:
        """Sets the limits from held-back documents: best language, characters and nats a character of each.

        One rule for any number of them: the own quantile, drawn towards the own mean plus the common quantile of deviations.
        """
        short = SPREAD / np.sqrt(np.minimum(np.maximum(n, 1), LONG)) - SPREAD / np.sqrt(LONG)
        level = h - short  # what a text of LONG characters would have
        own = [np.flatnonzero((best == k) & (n >= 20)) for k in range(len(self.models))]
        means = np.array([level[i].mean() if len(i) else np.nan for i in own])
        if np.isnan(means).all():
            self.limits = np.array([np.log(m.symbols) for m in self.models])
            return
        apart = np.quantile(np.concatenate([level[i] - means[k] for k, i in enumerate(own)]), QUANTILE)
        for k, i in enumerate(own):
            mean = means[k] if len(i) else np.nanmean(means)
            quantile = np.quantile(level[i], QUANTILE) if len(i) else 0.0
            self.limits[k] = (len(i) * quantile + POOLED * (mean + apart)) / (len(i) + POOLED) + MARGIN
            brief = i[n[i] < LONG]
            over = (h[brief] - self.limits[k]) * np.sqrt(n[brief])
            self.spreads[k] = max([SPREAD, *([np.quantile(over, QUANTILE)] if len(over) else [])])

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters a row, nats a character by row and language)."""
        keys, first = grams(texts)
        n = np.diff(first)
        at = self.known.find(keys)
        unknown = np.flatnonzero(at < 0)
        per = np.empty((len(self.languages), len(texts)))
        rare, inverse = np.unique(keys[unknown], return_inverse=True)
        for k, m in enumerate(self.models):
            value = self.logs[:, k][at] if len(self.logs) else np.zeros(len(keys))
            if len(unknown):
                value[unknown] = np.log(m.probability(rare))[inverse]
            total = np.concatenate([[0.0], np.cumsum(value)])
            per[k] = -(total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        return n, per.T


def _texts(column) -> list[tuple[int, int]]:
    return list(slices(text_buffers(column)[1]))


def _counted(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gram counts of each language over (lang, text), summed across partitions."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi in _texts(batch.column(1)):
                keys, first = grams(batch.column(1).slice(lo, hi - lo).to_pylist())
                of = np.repeat(np.arange(lo, hi), np.diff(first))
                for x in set(langs[lo:hi]):
                    u, c = np.unique(keys[(langs == x)[of]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    summed = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    t = summed.toArrow()
    langs = np.array(t["lang"].to_pylist(), object)
    keys, n = t["gram"].to_numpy().view(U64), t["n"].to_numpy()
    return {x: (keys[langs == x], n[langs == x]) for x in sorted(set(langs))}


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """A model of the labelled documents: at most fit_rows of each language, and fit_chars characters of them (a tenth in one)."""
    rows = text_batches(docs).filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("h")
    )
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Hashes are even: four times the share that is wanted holds it all but surely, and is small whatever the table's size.
    most = (1 << 64) - 1
    edges = [(r.lang, int(min(1.0, 4 * fit_rows / r.n) * most) - (1 << 63) if r.n > 4 * fit_rows else (1 << 63) - 1) for r in totals]
    near = rows.join(F.broadcast(docs.sparkSession.createDataFrame(edges, "lang string, edge long")), "lang").filter("h <= edge")
    least = Window.partitionBy("lang").orderBy("h")
    ranked = near.groupBy("lang", "h").agg(F.max(F.length("text")).alias("size")).withColumn("rank", F.row_number().over(least)).filter(F.col("rank") <= fit_rows)
    ranked = ranked.filter(F.col("size") <= fit_chars // 10).withColumn("chars", F.sum("size").over(least)).filter(F.col("chars") <= fit_chars)
    picked = materialize(ranked.select("lang", "h"), "language-sample")
    sample = materialize(rows.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"]), "language-texts")
    held_back = F.pmod("h", F.lit(CALIBRATE)) == 0
    counts = _counted(sample.filter(~held_back))
    model = Model.of(sorted(counts), counts)
    if not model.languages:
        return model

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            n, h = shared.value.cross_entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.argmin(axis=1)), pa.array(n), pa.array(h.min(axis=1))], ["lang", "n", "h"])

    t = sample.filter(held_back).select("lang", "text").mapInArrow(measure, "lang long, n long, h double").toArrow()
    model.calibrate(*(t[c].to_numpy() for c in ("lang", "n", "h")))
    return model


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """docs' columns with lang_pred, score (posterior at equal priors), cross_entropy (nats a character), rejected; `prefix` stands before their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + c for c in ("lang_pred", "score", "cross_entropy", "rejected")]

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            col = batch.schema.get_field_index(text)
            pred, score, entropy, rejected = [], [], [], []
            for lo, hi in _texts(batch.column(col)):
                n, h = m.cross_entropies(batch.column(col).slice(lo, hi - lo).cast(pa.string()).to_pylist())
                if not m.languages:
                    h = np.zeros((hi - lo, 1))
                best = h.argmin(axis=1)
                low = h[np.arange(len(best)), best]
                odds = np.exp(-(h - low[:, None]) * n[:, None]).sum(axis=1)
                none = (n == 0) | (not m.languages)
                for k in range(hi - lo):
                    pred.append(UNDETERMINED if none[k] else m.languages[best[k]])
                    score.append(0.0 if none[k] else float(1 / odds[k]))
                    entropy.append(None if none[k] else float(low[k]))
                    rejected.append(bool(none[k] or low[k] > m.limits[best[k]] + m.spreads[best[k]] / n[k] ** 0.5))
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    docs = text_batches(docs).drop(*names)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)]))
