"""Runtime recordings and heap histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMED = "struct<name:string>"
VALUES = f"struct<stackTrace:struct<frames:array<struct<method:struct<type:struct<name:string>,name:string>>>>,duration:bigint,path:string,bytesRead:bigint,bytesWritten:bigint,objectClass:{NAMED},tlabSize:bigint,monitorClass:{NAMED},thrownClass:{NAMED}>"
RECORDING = f"recording struct<events:array<struct<type:string,values:{VALUES}>>>"


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """Recordings printed as JSON documents, one a file; only the columns that reports use are parsed."""
    return spark.read.schema(RECORDING).option("multiLine", True).json(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """class_name, instances and bytes of a class histogram in text; other lines are skipped."""
    row = r"^\s*\d+:\s+(\d+)\s+(\d+)\s+(\S+)"
    lines = spark.read.text(path).where(F.col("value").rlike(row))
    return lines.select(F.regexp_extract("value", row, 3).alias("class_name"), F.regexp_extract("value", row, 1).cast("long").alias("instances"), F.regexp_extract("value", row, 2).cast("long").alias("bytes"))
