"""What the operators share: shared-folder tables, folds and record-batch slicing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN_DIR = "tessera-checkpoints-"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix=_OWN_DIR))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage,
    survives lost executors and lets a later plan start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}-{tag}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # what forget() leaves goes with the session
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


BATCH_ROWS = 2000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send at most `rows` whole texts to Python at once: Spark's default of 10,000 rows a batch is
    made for short rows, and holds each batch on both sides. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def forget(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no plan reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_tessera_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def crc_fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as decimal text, modulo folds (null keys count as empty text)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that memory does not follow Arrow's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


BATCH_BYTES = 1_000_000


def text_batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` whole texts and about `size` bytes of them (one text at least)."""
    for batch in slices(batches, rows):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 256) -> DataFrame:
    """Apply fn to whole rows in small Arrow batches; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, rows):
            yield fn(piece)

    return df.mapInArrow(run, schema)


def within_bytes(rows: DataFrame, text: str, group: str, most: int) -> DataFrame:
    """Of a bounded sample with __id, the first rows of each group by hash of the id whose texts together hold at most
    `most` bytes, and the first one of a group whatever its size; a sample within the bound stays whole and no text is cut."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    order = Window.partitionBy(group).orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("__total", F.sum(size).over(order)).withColumn("__first", F.count("*").over(order) == 1)
    return numbered.where((F.col("__total") <= most) | F.col("__first")).drop("__total", "__first")


def texts(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """A string column as Python text; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def lists(values, offsets, kind: pa.DataType) -> pa.ListArray:
    """A list column from a flat numpy array and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
