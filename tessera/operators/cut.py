"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset, in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-cut-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, for plans that read it several times; columns
    that a plan does not use are not read. It goes with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def wide(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts both and never sends df whole through the driver. For what grows with the input: by
    the sizes of compressed files, rows of exploded facts not counted, Spark would take hundreds of megabytes for ten."""
    return df.hint("merge")


def spread(df: DataFrame, key: str, rows: int = 1000) -> DataFrame:
    """The same rows dealt by key into parts of about `rows`, where each row stands for much work: a table of short rows
    is often one part, whatever their number. Lineage is cut, else the optimiser moves filters on that work before the dealing."""
    parts = -(-df.count() // rows)
    return cut(df.repartition(parts, key)) if parts > 1 else df
