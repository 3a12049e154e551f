"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session names none and runs on one machine (tests) a temporary folder."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = getattr(spark, "_inkspan_scratch", None)
    if at is None:
        at = spark._inkspan_scratch = "file://" + tempfile.mkdtemp(prefix="inkspan-")
    return at


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below scratch_root, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/inkspan-{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "lz4_raw").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkspan_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table of materialise() that nothing reads any more; other DataFrames pass."""
    path = getattr(df, "_inkspan_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    A small Parquet file is one row group and so one task; a table with enough files passes as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
