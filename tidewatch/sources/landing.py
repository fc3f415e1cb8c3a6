"""Conformed tables: provenance envelope, idempotent upserts by natural key, honest readers."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ENVELOPE = ("source_id", "source_ref", "acquired_at", "ingested_at", "pipeline_version", "confidence", "is_synthetic")
SYNTHETIC_SOURCE = "synthetic-scenario"


def stamp(rows: DataFrame, source_id: str, source_ref: str, acquired_at, ingested_at, version: str, confidence: float | None = None, is_synthetic: bool = False) -> DataFrame:
    """rows with the envelope. The synthetic flag and the source must agree; times must carry a zone."""
    if is_synthetic != (source_id == SYNTHETIC_SOURCE):
        raise ValueError("is_synthetic and source_id disagree")
    for t in (acquired_at, ingested_at):
        if getattr(t, "tzinfo", 1) is None:
            raise ValueError("naive timestamp")
    values = (source_id, source_ref, acquired_at, ingested_at, version, confidence, is_synthetic)
    kinds = ("string", "string", "timestamp", "timestamp", "string", "double", "boolean")
    return rows.withColumns({n: F.lit(v).cast(k) for n, v, k in zip(ENVELOPE, values, kinds, strict=True)})


def natural_key(*columns: str) -> Column:
    """Key text: null is empty, times in UTC."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def position_key() -> Column:
    """Key of a position report: identity, time, and the place to four decimals."""
    return F.concat_ws("|", F.col("mmsi").cast("string"), F.col("ts").cast("string"), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"))


def valid_positions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with a reason); nothing raises."""
    c = F.col
    reason = (
        F.when(~c("lat").between(-90, 90) | c("lat").isNull(), "lat").when(~c("lon").between(-180, 180) | c("lon").isNull(), "lon")
        .when(c("cog").isNotNull() & ~c("cog").between(0, 360), "cog").when(c("mmsi").isNull() | (c("mmsi") <= 0) | (c("mmsi") >= 1_000_000_000), "mmsi").when(c("ts").isNull(), "ts")
    )
    marked = rows.withColumn("reject_reason", reason)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A conformed table; a missing one is empty, a missing synthetic flag is false."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    return df.withColumn("is_synthetic", F.coalesce("is_synthetic", F.lit(False))) if "is_synthetic" in df.columns else df


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins: new rows replace old of the same natural key; of equal new ones the last ingested stays."""
    w = Window.partitionBy(natural_key(*keys)).orderBy(F.desc("_seq"), F.desc_nulls_last("ingested_at"), *(F.desc_nulls_last(c) for c in old.columns if c not in keys and c != "ingested_at"))
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i", "_seq")


#: Types that take the values of narrower ones without loss.
WIDER = {"long": {"byte", "short", "integer"}, "integer": {"byte", "short"}, "double": {"float", "byte", "short", "integer"}}


def united(stored: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, the stored ones first. A column without a type (all null) takes the other side's; a narrower new type is widened, others must agree."""
    out = {f.name: f.dataType for f in stored}
    for f in new:
        held = out.get(f.name, T.NullType())
        if isinstance(held, T.NullType):
            out[f.name] = f.dataType
        elif not (held == f.dataType or isinstance(f.dataType, T.NullType) or f.dataType.typeName() in WIDER.get(held.typeName(), ())):
            raise ValueError(f"{f.name} is stored as {held.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(n, k) for n, k in out.items()])


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema, in its order and types; those that df lacks are null."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def stored_parts(spark: SparkSession, path: str, part: str, values: list[str]) -> tuple[DataFrame | None, T.StructType]:
    """(the named partitions with the columns of all their files, or None; the table's columns as far as one file and these partitions tell).

    Only the footers of these partitions are merged, so the cost does not grow with the table.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None, T.StructType([])
    text = lambda schema: T.StructType([T.StructField(f.name, T.StringType() if f.name == part else f.dataType) for f in schema])
    try:
        whole = text(spark.read.parquet(path).schema)
    except Exception as e:  # noqa: BLE001
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None, T.StructType([])
        raise
    there = [p for p in (f"{path}/{part}={v}" for v in values) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return None, whole
    schema = text(spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*there).schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*there), united(whole, schema)


def _upsert(new: DataFrame, path: str, keys: list[str], time: str, part: str, pattern: str) -> DataFrame:
    spark = new.sparkSession
    if not new.filter(F.col(time).isNull()).isEmpty():
        raise ValueError(f"rows without {time}")
    new = new.withColumn(part, F.date_format(time, pattern))
    touched = [r[0] for r in new.select(part).distinct().collect()]
    held, known = stored_parts(spark, path, part, touched)
    schema = united(known, new.schema)
    void = [f.name for f in schema if isinstance(f.dataType, T.NullType)]
    schema = T.StructType([f for f in schema if f.name not in void])  # Parquet stores no untyped column; its type comes with the first value
    fresh = conformed(new, schema)
    old = conformed(held, schema) if held is not None else fresh.limit(0)
    merged = merge_rows(old, fresh, keys)
    staged = f"{path}.staging-{uuid.uuid4().hex[:12]}"
    merged.write.partitionBy(part).parquet(staged)
    typed = T.StructType([f for f in merged.schema if f.name != part] + [T.StructField(part, T.StringType())])
    ready = spark.read.schema(typed).parquet(staged)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(part).parquet(path)
    remove(spark, staged)
    return spark.read.schema(typed).parquet(path).filter(F.col(part).isin(touched)).groupBy(part).agg(F.count("*").alias("partition_rows"))


def land(new: DataFrame, path: str, keys: list[str], time: str) -> DataFrame:
    """Upsert into a table partitioned by day; only touched days are read and rewritten. Returns rows by day.

    The table keeps every column it ever had: one that the new rows lack stays in the rows they do not replace, a new one is null in the
    old rows, and one that came without a type takes it from the other side. Types that contradict are refused before anything is written.
    Rows without a time have no day and are refused (`valid_positions` tells them apart). Writers stage under names of their
    own, but two that touch one day must not run at once: the later one would not see the earlier one's rows.
    """
    missing = [c for c in ENVELOPE[:5] if c not in new.columns]
    if missing:
        raise ValueError(f"rows without envelope: {missing}")
    return _upsert(new, path, keys, time, "day", "yyyy-MM-dd")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on the file system it names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Entries added, removed or changed between two snapshots of a registry."""
    packed = lambda d, n: d.select(key, F.struct(*columns).alias(n))
    both = packed(old, "before").join(packed(new, "after"), key, "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", kind).filter("change is not null").select(key, "change", "before", "after")


def receipts(rows: DataFrame) -> DataFrame:
    """Several receipts of one report as one: first non-null kinematics, receivers in order, their number."""
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("mmsi", "ts", "lat", "lon").agg(first("sog"), first("cog"), F.array_join(F.array_sort(F.collect_set("receiver")), "|").alias("receiver"), F.count("*").alias("n_receipts"))


def land_hourly(new: DataFrame, path: str, key: Column, time: str = "ts") -> DataFrame:
    """Upsert as `land` into a table partitioned by hour, by a key column: for positions `position_key()`, for detections their id."""
    return _upsert(new.withColumn("_key", key), path, ["_key"], time, "hour", "yyyy-MM-dd'T'HH")


def land_raw(spark: SparkSession, folder: str, name: str, content: bytes) -> str:
    """Keep an artifact as it came; the same bytes again change nothing, other bytes under its name are refused. Its sha256."""
    digest = hashlib.sha256(content).hexdigest()
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(f"{folder}/{name}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        held = spark.read.format("binaryFile").load(f"{folder}/{name}").select(F.sha2("content", 256)).first()[0]
        if held != digest:
            raise ValueError(f"{name} is there with other content")
        return digest
    part = fs.Path(f"{folder}/.{name}.{uuid.uuid4().hex[:12]}")
    out = system.create(part, False)
    out.write(bytearray(content))
    out.close()
    if not system.rename(part, target):
        raise OSError(f"{name} could not be put in place")
    return digest


def registered(table: DataFrame, name: str, time: str) -> DataFrame:
    """One row for the register of artifacts: table, rows, and the time range of its rows."""
    return table.agg(F.count("*").alias("n_rows"), F.min(time).alias("t_start"), F.max(time).alias("t_end")).select(F.lit(name).alias("artifact"), "n_rows", "t_start", "t_end")


def united_view(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """A temporary view over tables of unlike columns, by name, with the file of each row; folders that are not there are left out, none gives no view."""
    found = []
    for p in paths:
        try:
            found.append(spark.read.option("mergeSchema", "true").parquet(p).withColumn("filename", F.col("_metadata.file_path")))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "filename string")
    out.createOrReplaceTempView(name)
    return out


def landed_report(built: int, before: int, after: int) -> dict[str, int]:
    """What a landing did: rows built, rows new to the table, and rows merged into ones it had; never negative."""
    new = max(0, after - before)
    return {"built": built, "landed": min(built, new), "merged": max(0, built - new)}
