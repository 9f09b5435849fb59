"""What the training-data operators share: column picking, the shared folder, two-level prefix sums."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENTS = {"doc_id": "bigint", "text": "string"}


BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Unless the session has a setting of its own, texts go to Python a thousand at a time: ten thousand
    of some kilobytes each, held by the JVM and by Python, take much of a small executor's memory."""
    if spark.conf.get(BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast. Other columns are ignored, also those whose names differ in case alone;
    of columns with the same name the first counts."""
    at = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return at.select(*(F.col(f"_{df.columns.index(n)}").cast(t).alias(n) for n, t in columns.items()))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names and all executors see. Where that is unset, it is
    made in the machine's own temporary folder if Spark runs on this machine alone, and is an error otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/quoin-{os.getpid()}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: an executor lost later costs no
    recomputation of what led here."""
    path = f"{shared_dir(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, groups: list[str], block: str, order: list, value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one, in its group, by (block, order). Blocks
    are summed first (with map-side combine), so that a group of any size is sorted by many tasks, a block each."""
    sums = df.groupBy(*groups, block).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)),
        F.col(block).alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col(block).eqNullSafe(F.col("_b"))
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, same)
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_inside", "_start", "_b", "_sum", *(f"_g{i}" for i in range(len(groups))))
    )


def filesystem(uri: str):
    """Arrow's file system for a path of Spark's, and the path in it: tasks reach the shared folder by it. Spark's
    names for S3 are Arrow's s3; file, hdfs, s3, gs and abfs are the same for both."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)
