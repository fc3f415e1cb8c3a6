"""Exact length histogram of a corpus in tokens (operator 7).

Every whole text is encoded with a public vocabulary; one row for each distinct
length carries suffix sums, from which totals, quantiles and the tokens left after
truncation follow for any context limit.

Defined cases: null and empty texts have length 0; repeated rows all count; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern of the byte-level BPE vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK = 64
_encoders: dict[int, object] = {}


def _encoder(ranks: bytes):
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a document, column `length`. The vocabulary (under 2 MB) is read once and broadcast."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def lengths(batches):
        enc = _encoder(ranks.value)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lengths, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs, and over all documents: docs_at_least, tokens_at_least, truncated_total (a limit of `length`).

    Suffix sums go over blocks of lengths first and within a block then, so no
    single task sees every length.
    """
    # Written once: two branches read the bins, and the texts must not be encoded for each.
    bins = materialize(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths").withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = bins.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("block_docs").over(total).alias("docs"),
        F.sum("block_tokens").over(total).alias("tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    docs_ge = F.col("docs_later") + F.sum("n_docs").over(within)
    tokens_ge = F.col("tokens_later") + F.sum(F.col("n_docs") * F.col("length")).over(within)
    return bins.join(blocks, "block").select(
        "length",
        "n_docs",
        docs_ge.cast("long").alias("docs_at_least"),
        tokens_ge.cast("long").alias("tokens_at_least"),
        (F.col("tokens") - tokens_ge + F.col("length") * docs_ge).cast("long").alias("truncated_total"),
        (1 - (docs_ge - F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row for each context limit, of any size: docs_within, docs_over, tokens, tokens_kept (texts cut at the limit), tokens_lost.

    histogram: of `length_histogram`. One pass with partial aggregation; an empty histogram gives zeros.
    """
    over = lambda n: F.col("length") > n
    # The least length above the limit holds the suffix sums; below it all is kept.
    found = histogram.agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"),
        *(F.min(F.when(over(n), F.struct("length", "docs_at_least", "tokens_at_least"))).alias(f"after{k}") for k, n in enumerate(limits)),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = F.array(*(F.struct(F.lit(n).cast("long").alias("limit"), zero(F.col(f"after{k}.docs_at_least")).alias("docs_over"), zero(F.col(f"after{k}.tokens_at_least")).alias("above")) for k, n in enumerate(limits)))
    out = found.select(zero(F.col("docs")).alias("docs"), zero(F.col("tokens")).alias("tokens"), F.explode(rows).alias("r")).select("docs", "tokens", "r.*")
    lost = F.col("above") - F.col("limit") * F.col("docs_over")
    return out.select("limit", (F.col("docs") - F.col("docs_over")).alias("docs_within"), "docs_over", "tokens", (F.col("tokens") - lost).alias("tokens_kept"), lost.alias("tokens_lost"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of all documents has or stays under; shares above 0, up to 1."""
    found = histogram.agg(*(F.min(F.when(F.col("quantile") >= q - 1e-12, F.col("length"))).alias(f"q{k}") for k, q in enumerate(shares)))
    return found.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("length")) for k, q in enumerate(shares)))).alias("r")).select("r.*")
