"""Whitening of embeddings by principal components, fitted by merging moments.

Vectors are put on a grid, x = floor(256 c), and each distinct x counts once (the fit list). Every partition of the fit list
computes its count, mean and centred scatter; partial moments are merged in pairs by Chan's formula in a treeReduce, so
the driver receives one matrix of dims x dims, however many rows there are. Its eigenvectors give the components, and a second pass over
the fit list merges the moments of the whitened values, which must have the identity as their covariance.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or huge entries (2^44 and more, whose x no double
holds exactly) are dropped. Vectors of different lengths are fitted apart, each length with its own n and components; the lengths of a
table are few, more than LENGTHS raise an error. Repeated rows count once in the fit and are all returned. A component without variance
(fewer distinct vectors than components) has a null `whitened` and is left out of the identity check; `explained` is null where all vectors
of a length are equal, `identity_error` where no component has variance. An empty table gives no rows. Null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

GRID = 256
LENGTHS = 64
LARGEST = float(2**44)
#: Eigenvalues below this share of the largest are rounding, not variance.
FLAT = 1e-12

#: Moments of some rows: count, sums (Python integers for x, so never too large), mean and centred scatter (the sum of outer products of the rows minus the mean).
Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def on_grid(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """embeddings with a usable vector, and its `x`."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST)
    usable = F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * GRID))
    return embeddings.filter(usable).withColumn("x", x)


def moments(rows: np.ndarray) -> Moments:
    """Of the rows of an integer or float matrix; the scatter is centred before multiplying."""
    safe = rows.dtype.kind == "f" or len(rows) * int(np.abs(rows).max(initial=0)) < 2**62
    sums = (rows if safe else rows.astype(object)).sum(axis=0).astype(object)
    mean = (sums / len(rows)).astype(float)
    centred = rows - mean
    return len(rows), sums, mean, centred.T @ centred


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula: the moments of two sets of rows from those of each."""
    (n, s, u, p), (m, t, v, q) = a, b
    apart, total = v - u, n + m
    return total, s + t, u + apart * (m / total), p + q + np.outer(apart, apart) * (n * m / total)


def merged_lengths(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    out = dict(a)
    for length, m in b.items():
        out[length] = merged(out[length], m) if length in out else m
    if len(out) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    return out


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length in a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, flat[starts[at][:, None] + np.arange(length)]


def summed(fit: DataFrame, whiten: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> dict[int, Moments]:
    """Moments by length of the fit list's x, or of its whitened values."""

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, Moments]:
        out: dict[int, Moments] = {}
        for batch in batches:
            for _, rows in by_length(batch.column(0)):
                length = rows.shape[1]
                if whiten is None:
                    out = merged_lengths(out, {length: moments(rows)})
                elif whiten[length][1].size:
                    out = merged_lengths(out, {length: moments((rows - whiten[length][0]) @ whiten[length][1])})
        return out

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(batches)
        if found:
            items = [(k, n, s.tolist(), u.tolist(), p.ravel().tolist()) for k, (n, s, u, p) in found.items()]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64() if whiten else pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*items, strict=True), kinds, strict=True)], ["length", "n", "sums", "mean", "scatter"])

    kind = "double" if whiten else "decimal(38,0)"
    parts = fit.select("x").mapInArrow(encode, f"length int, n long, sums array<{kind}>, mean array<double>, scatter array<double>").rdd
    decode = lambda r: {r.length: (r.n, np.array(r.sums if whiten else [int(s) for s in r.sums], object), np.array(r.mean), np.array(r.scatter).reshape(len(r.mean), -1))}
    local = parts.mapPartitions(lambda rows: [reduce(merged_lengths, map(decode, rows), {})])
    return local.treeReduce(merged_lengths) if local.getNumPartitions() else {}


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once, written: both passes read it."""
    return materialize(rows.select("x").distinct(), "whitening-fit")


class Model:
    """Components of one length: n, S, the matrix that whitens (dims x components with variance), each component's share of the variance."""

    def __init__(self, m: Moments, components: int) -> None:
        self.n, self.sums, _, scatter = m
        values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * self.n))
        order = np.argsort(-values, kind="stable")[:components]
        self.values, vectors = values[order], vectors[:, order]
        trace = float(np.trace(scatter)) / self.n
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]
        self.varies = self.values > FLAT * max(float(values.max()), 0.0)
        self.matrix = vectors[:, self.varies] / np.sqrt(self.values[self.varies])
        self.mean = (self.sums / self.n).astype(float)
        self.error: float | None = None

    def check(self, m: Moments | None) -> None:
        if m is not None:
            self.error = float(np.abs(m[3] / m[0] - np.eye(len(m[3]))).max())


def fit(rows: DataFrame, components: int = 4) -> dict[int, Model]:
    """A model for each length of `x`, its identity verified by a second pass."""
    listed = fit_list(rows)
    models = {length: Model(m, components) for length, m in summed(listed).items()}
    if models:
        whitened = summed(listed, {length: (m.mean, m.matrix) for length, m in models.items()})
        for length, m in models.items():
            m.check(whitened.get(length))
    drop_materialized(listed)
    return models


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """sum((n x - S)^2) of each row, exact: 64-bit integers where they suffice, else Python's."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 2**63:
        away = n * x - sums.astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    away = n * x.astype(object) - sums
    return (away * away).sum(axis=1).tolist()


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """A row for every usable row and component: key, component, n, deviation, whitened, explained, identity_error.

    deviation is decimal(38,0), since n and x may exceed what 64 bits hold; the sums S and all deviations are exact integers.
    """
    rows = on_grid(embeddings.select(key, vector), vector).select(F.col(key).alias("key"), "x")
    models = fit(rows, components)
    id_type = embeddings.schema[key].dataType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                model = models[x.shape[1]]
                k, values = len(model.values), np.full((len(x), len(model.values)), np.nan)
                values[:, model.varies] = (x - model.mean) @ model.matrix
                flat, each = values.ravel(), np.repeat(np.arange(len(x)), k)
                far = pa.array(deviations(x, model.n, model.sums), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), model.n)),
                        far.take(pa.array(each)),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(model.explained * len(x), pa.float64()),
                        pa.array([model.error] * len(each), pa.float64()),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = id_type.simpleString()
    found = rows.mapInArrow(apply, f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return found.withColumnRenamed("key", key)
