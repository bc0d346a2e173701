"""A log of numbered versions over immutable segments.

A store is a folder of segments and a folder `_log` with one JSON file a version. A version names its segments, oldest
first. A segment holds tables; its `tombs` kill the rows that earlier segments hold for a path, or for one place of
a path. A version's file is written aside and renamed to its number, which fails if the number is taken: of two writers
one goes on and the other has to begin anew on the version that won. Readers see one whole version or the next.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_log"  # Spark's readers skip names with an underscore
TOMBS = "path string, place long"  # place null: all rows of the path
KEPT_VERSIONS = 2  # whose segments stay for readers that began on them


class Conflict(Exception):
    """Another writer has taken the number of the version."""


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _filesystem(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _filesystem(spark, path)
    fs.delete(at, True)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions whose log files are there, oldest first."""
    at, fs = _filesystem(spark, f"{path.rstrip('/')}/{LOG}")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _entry_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{LOG}/{number:020d}.json"


def segments(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, list[dict]]:
    """The number of a version, by default the newest (0 without one), and its segments: id and the names of its tables."""
    known = numbers(spark, path)
    if number is None:
        number = known[-1] if known else 0
    if not number:
        return 0, []
    at, fs = _filesystem(spark, _entry_path(path, number))
    stream = fs.open(at)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["segments"]
    finally:
        stream.close()


def new_segment() -> str:
    return f"s-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, number: int, content: list[dict]) -> None:
    """Make `content` version `number`, if no other writer has; then drop segments that only old versions name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, fs = _filesystem(spark, _entry_path(path, number))
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps({"version": number, "segments": content}).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(at), options)
    except Exception as problem:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(problem):
            raise Conflict(f"version {number} of {path}") from problem
        raise
    _forget(spark, path, number)


def _forget(spark: SparkSession, path: str, newest: int) -> None:
    """Delete old log files and the committed segments that no kept version names. Segments that were never committed
    may belong to a writer at work and stay."""
    old = [n for n in numbers(spark, path) if n <= newest - KEPT_VERSIONS]
    kept = {s["id"] for n in numbers(spark, path) if n > newest - KEPT_VERSIONS for s in segments(spark, path, n)[1]}
    for number in old:
        for name in {s["id"] for s in segments(spark, path, number)[1]} - kept:
            delete(spark, f"{path.rstrip('/')}/{name}")
        delete(spark, _entry_path(path, number))


def tombs(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame | None:
    """path, place and __killer (the place of the latest segment that kills the rows of earlier ones)."""
    out = None
    for i, s in enumerate(parts):
        if "tombs" in s["tables"]:
            part = spark.read.schema(TOMBS).parquet(f"{path.rstrip('/')}/{s['id']}/tombs").withColumn("__killer", F.lit(i))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("path", "place").agg(F.max("__killer").alias("__killer")) if out is not None else None


def alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """rows (with path, __segment and perhaps place) without those that a later segment kills."""
    if dead is None:
        return rows.drop("__segment")
    whole = dead.where("place IS NULL").select(F.col("path").alias("__dead"), "__killer")
    rows = rows.join(whole, (F.col("path") == F.col("__dead")) & (F.col("__killer") > F.col("__segment")), "left_anti")
    if "place" in rows.columns:
        single = dead.where("place IS NOT NULL").select(F.col("path").alias("__dead"), F.col("place").alias("__gone"), "__killer")
        rows = rows.join(single, (F.col("path") == F.col("__dead")) & (F.col("place") == F.col("__gone")) & (F.col("__killer") > F.col("__segment")), "left_anti")
    return rows.drop("__segment")
