"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: spark.checkpoint.dir.

    Only where it names none and Spark runs on this machine alone (unit tests), a temporary
    folder of this machine is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it again.

    A lost executor then costs the running tasks only. Column pruning and
    table statistics keep working, unlike with an opaque checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_materialized(*frames: DataFrame) -> None:
    """Remove intermediate tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {os.path.dirname(p) for p in df.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows of an Arrow batch of texts; Spark's own default of 10,000 holds tens of MB in the JVM and in Python, in and out.
TEXT_ROWS = 1000


def text_batches(docs: DataFrame) -> DataFrame:
    """docs, with small Arrow batches in its session unless another size than the default is set there."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if conf.get(name) == "10000":
        conf.set(name, str(TEXT_ROWS))
    return docs


#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def join_ids(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """left_semi or left_anti join with a written table of ids; texts are shuffled only if the ids are too many to broadcast."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


#: Name of the column that tells rows of one id apart.
ROW = "row_key"


def row_key(text: str | F.Column) -> F.Column:
    """A hash of the text. With the id it names a row: rows equal in both are copies of one document."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def _same_row(doc_id: F.Column, key: F.Column, rows: DataFrame) -> F.Column:
    return doc_id.eqNullSafe(rows["doc_id"]) & (key == rows[ROW])


def with_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (with doc_id and row_key) and, where found, the other columns of `rows`, which has one row a (doc_id, row_key)."""
    few = F.broadcast(rows) if rows.count() <= BROADCAST_IDS // 4 else rows
    return docs.join(few, _same_row(docs["doc_id"], docs[ROW], few), "left").select(*(docs[c] for c in docs.columns), *(few[c] for c in rows.columns if c not in ("doc_id", ROW)))


def without_rows(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs but the rows that the written table `gone` (doc_id, row_key) names; texts are shuffled only if these are too many to broadcast."""
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, _same_row(docs[doc_id], row_key(docs[text]), few), "left_anti")


def fold(column: str, buckets: int):
    """crc32 of an id's text, modulo `buckets`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


SPACE = r"\x20\x09-\x0D"
#: The words of a text in the contracts: runs of anything but ASCII white space.
WORD = rf"[^{SPACE}]+"
