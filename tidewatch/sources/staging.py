"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder of spark.checkpoint.dir and read again.

    It is computed once (a checkpoint computes it twice), survives lost executors, and has sizes that the planner knows. A temporary
    folder is set only where none is named and Spark runs on this machine alone.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Removes written tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {os.path.dirname(p) for p in df.inputFiles()}:
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
