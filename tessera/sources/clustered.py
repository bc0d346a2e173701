"""Tables clustered by a name, with a zone map that tells which files may hold one.

A table is dealt by ranges of its name column and sorted, so equal names stand together, in one or two files unless
they fill more. The zone
map has for each file the least and the largest name and a blocked Bloom filter: a hash picks one block of 32,768 bits,
three others a bit each in it. A lookup reads the zone map, and opens only the files that pass; within them the
pages' statistics narrow the read further, since files are sorted.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_ROWS = 100_000  # of a file of a large table
LEAST_ROWS, SPREAD = 2_000, 64  # a small table has up to SPREAD files of at least LEAST_ROWS
BLOCK_BITS = 32_768  # those of one bitmap of Spark's bitmap functions
BLOCK_NAMES = 3_000  # names a block, at which three bits a name leave about 1 % false passes
PROBES = 3
AT_ONCE = 8  # tables that are written side by side
MANY_KEYS = 10_000  # names up to which a lookup goes by the zone map
ZONES = "file string, rows long, bytes long, lo string, hi string, blocks int, block int, bits binary"


def files_for(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS), min(SPREAD, -(-rows // LEAST_ROWS)))


def _block(name: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), name), blocks).cast("int")


def _position(name: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe + 1), name), F.lit(BLOCK_BITS)).cast("long")


def write(rows: DataFrame, name: str, path: str) -> None:
    """Write rows clustered by column `name`, which holds no nulls, at `path` and their zone map at `path`_zones."""
    spark, count = rows.sparkSession, rows.count()
    keys = [F.col(name), F.monotonically_increasing_id()]  # a name that most rows have is spread over files
    dealt = rows.coalesce(1) if count <= LEAST_ROWS else rows.repartitionByRange(files_for(count), *keys)
    dealt.sortWithinPartitions(name).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path).select(F.col(name).alias("name"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    if count <= LEAST_ROWS:  # one file of one block
        names = stored.groupBy("file", "name").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes")).withColumn("blocks", F.lit(1))
        probes = names.select("*", F.posexplode(_bits()).alias("probe", "bit"))
        extent = [F.sum(F.when(F.col("probe") == 0, F.col("n"))).alias("rows"), F.max("bytes").alias("bytes"), F.min("name").alias("lo"), F.max("name").alias("hi")]
        found = probes.groupBy("file").agg(*extent, F.lit(1).alias("blocks"), F.lit(0).alias("block"), F.bitmap_construct_agg("bit").alias("bits"))
    else:
        names = stored.groupBy("file", "name").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
        extent = names.groupBy("file").agg(F.sum("n").alias("rows"), F.max("bytes").alias("bytes"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.ceil(F.count("*") / BLOCK_NAMES).cast("int").alias("blocks"))
        bits = names.select("file", "name").join(extent.select("file", "blocks"), "file")
        bits = bits.select("file", _block(F.col("name"), F.col("blocks")).alias("block"), F.explode(_bits()).alias("bit"))
        found = extent.join(bits.groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bits")), "file")
    found.select("file", "rows", "bytes", "lo", "hi", "blocks", "block", "bits").coalesce(1).write.parquet(f"{path}_zones")


def _bits() -> Column:
    return F.array(*(_position(F.col("name"), p) for p in range(PROBES)))


def _may_hold(name: Column) -> Column:
    """Whether a zone's file may hold a name."""
    inside = (name >= F.col("lo")) & (name <= F.col("hi")) & (F.col("block") == _block(name, F.col("blocks")))
    for p in range(PROBES):
        at = _position(name, p)
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        inside &= F.getbit(byte, (at % 8).cast("int")) == 1
    return inside


def zones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ZONES).parquet(f"{path}_zones")


def candidates(spark: SparkSession, path: str, names: DataFrame | str) -> list[tuple[str, int]]:
    """Files, and their bytes, that may hold a name or one of a column `key` of names."""
    if isinstance(names, str):
        found = zones(spark, path).where(_may_hold(F.lit(names)))
    else:
        found = zones(spark, path).join(F.broadcast(names.select("key").distinct()), _may_hold(F.col("key")))  # both sides are bounded: zones, and at most MANY_KEYS names
    return [(r["file"], r["bytes"]) for r in found.select("file", "bytes").distinct().collect()]


def write_all(tables: list[tuple[DataFrame, str, str]]) -> None:
    """write() of several tables (rows, name, path) side by side: their jobs share the cluster."""
    with ThreadPoolExecutor(max(1, min(AT_ONCE, len(tables)))) as pool:
        list(pool.map(lambda t: write(*t), tables))


def lookup(spark: SparkSession, path: str, schema, files: list[str] | None = None) -> DataFrame:
    """The rows of the given files of a table, all files by default, none of an empty list."""
    if files is None:
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in files)) if files else spark.createDataFrame([], schema)
