"""Continuous refresh of a store with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.code import listing
from ..sources.store import apply

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """Files of a folder as a stream of path, content_hash, mtime_ms, content and length; new files are seen as they appear."""
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(root)
    return found.select(F.regexp_replace("path", "^file:", "").alias("path"), F.sha2("content", 256).alias("content_hash"), F.unix_millis("modificationTime").alias("mtime_ms"), F.decode("content", "UTF-8").alias("content"), "length")


def sweep(spark: SparkSession, root: str, path: str, **options) -> dict[str, int]:
    """Commit a version without the files that are gone from a folder; nothing is read or parsed."""
    none = spark.createDataFrame([], "path string, content_hash string, mtime_ms long, content string")
    return apply(spark, none, path, listing(spark, [root], **options).select("path"))


def refresh_stream(stream: DataFrame, path: str, checkpoint: str, root: str | None = None, invokers: list[dict] | None = None) -> StreamingQuery:
    """Bring a store up to the files of each batch, one version a batch; the newest state of a path within a batch counts.

    A batch that is run again after a failure finds its files stored and writes nothing. With `root`, each batch also
    drops files that are gone from that folder (a stream does not tell of deletions; sweep() does it without a batch)."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content_hash", "mtime_ms", "content", "length"), F.struct("mtime_ms", "content_hash")).alias("f")).select("path", "f.*")
        apply(spark, newest, path, listing(spark, [root]).select("path") if root else None, invokers)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(facts: DataFrame) -> DataFrame:
    """The newest facts of each path, of facts that hold several (a store's do not)."""
    order = W.partitionBy("path").orderBy(F.desc("mtime_ms"), "content_hash")
    return facts.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
