"""Lines of files or documents behind an inverted index of three-character runs.

Postings name blocks of lines, not lines: a run that a block holds often is posted once. Blocks are numbered within
parts, stretches of lines that one task reads together, and a run has one row a part with the numbers of its blocks. A
block may be parted, a line may not, so all runs of a line are posted for one block of one part. A search takes the
rarest runs of each term, looks up their postings (both tables are clustered, so few files are opened), keeps the blocks
that have all of them, and tests the lines of those blocks exactly. Terms of fewer than three characters have no run and
are searched in all lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grams, text
from . import clustered, versions

BLOCK = 64  # lines
PART_BLOCKS, PART_CHARACTERS = 4_096, 4_000_000  # of a part; a longer line is a part of its own
PROBES = 3  # rarest runs of a term that are asked for
LINES = "key string, block int, line_no int, text string"
POSTINGS = "gram string, part string, places array<int>"
PARTS = "part string, keys array<string>, blocks array<int>"
OFTEN = "gram string, n long"
_POSTED = pa.schema([("gram", pa.string()), ("part", pa.string()), ("places", pa.list_(pa.int32())), ("keys", pa.list_(pa.string())), ("blocks", pa.list_(pa.int32()))])


def _runs(texts: list[str], places: list[int]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The distinct runs of three characters of lines, sorted; where each one's places begin and end; and these places.
    Lines of very many different characters are halved until a run and a place fit a number of 63 bits."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    letters = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(1, dtype=np.int64)
    bits, low = max(1, int(len(letters) - 1).bit_length()), int(max(places)).bit_length()
    if 3 * bits + low > 63:
        half = len(texts) // 2
        if half:
            yield from _runs(texts[:half], places[:half])
            yield from _runs(texts[half:], places[half:])
            return
        low, places, only = 0, [0], places[0]
    else:
        only = 0
    rank = np.zeros(int(letters[-1]) + 1, dtype=np.int64)
    rank[letters] = np.arange(len(letters))
    codes = rank[points]
    starts = np.ones(len(points), dtype=bool)
    ends = np.cumsum(lengths)
    for back in range(1, grams.GRAM):  # no run begins in a line's last two characters
        starts[(ends - back)[lengths >= back]] = False
    at = np.flatnonzero(starts)
    pairs = (codes[at] << 2 * bits | codes[at + 1] << bits | codes[at + 2]) << low | np.repeat(np.array(places, dtype=np.int64), lengths)[at]
    pairs = np.unique(pairs)
    runs = pairs >> low
    first = np.flatnonzero(np.diff(runs, prepend=-1))
    run, mask = runs[first], (1 << bits) - 1
    written = letters[np.stack([run >> 2 * bits, run >> bits & mask, run & mask], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    names = [written[i : i + grams.GRAM] for i in range(0, len(written), grams.GRAM)]
    yield names, np.append(first, len(pairs)), (pairs & ((1 << low) - 1)) + only


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of key, block and text (bytes) of lines: for each part a row a run with its places, and a row, without a run, of
    the keys and blocks that the places stand for."""
    blocks: dict[tuple[str, int], int] = {}
    texts, places, size = [], [], 0

    def part() -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        for names, bounds, found in _runs(texts, places):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([name] * len(names)), lists, pa.nulls(len(names), _POSTED.field("keys").type), pa.nulls(len(names), _POSTED.field("blocks").type)], schema=_POSTED)
        yield pa.RecordBatch.from_pylist([{"part": name, "keys": [k for k, _ in blocks], "blocks": [b for _, b in blocks]}], schema=_POSTED)

    for batch in batches:
        for key, block, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            line = line.decode("utf-8", "replace")
            if texts and (size + len(line) > PART_CHARACTERS or len(blocks) >= PART_BLOCKS):
                yield from part()
                blocks, texts, places, size = {}, [], [], 0
            places.append(blocks.setdefault((key, block), len(blocks)))
            texts.append(line)
            size += len(line)
    if texts:
        yield from part()


def build(lines: DataFrame, path: str, key: str = "path") -> None:
    """Write the index of lines (key, line_no, text) at `path`. Lines without key or text are not found."""
    spark = lines.sparkSession
    kept = lines.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("string").alias("key"), F.floor(F.col("line_no") / BLOCK).cast("int").alias("block"), F.col("line_no").cast("int").alias("line_no"), "text")
    clustered.write(kept, "key", f"{path}/lines")
    kept = spark.read.schema(LINES).parquet(f"{path}/lines")
    kept.select("key", "block", F.col("text").cast("binary")).mapInArrow(_post, "gram string, part string, places array<int>, keys array<string>, blocks array<int>").write.option("compression", "zstd").parquet(f"{path}/_posted")
    posted = spark.read.schema(f"{POSTINGS}, keys array<string>, blocks array<int>").parquet(f"{path}/_posted")
    posted.where("gram IS NULL").select("part", "keys", "blocks").write.parquet(f"{path}/parts")
    clustered.write(posted.where("gram IS NOT NULL").select("gram", "part", "places"), "gram", f"{path}/postings")
    often = posted.where("gram IS NOT NULL").groupBy("gram").agg(F.sum(F.size("places")).alias("n"))
    clustered.write(often, "gram", f"{path}/often")
    versions.delete(spark, f"{path}/_posted")


def _of(spark: SparkSession, path: str, table: str, schema: str, names: DataFrame) -> DataFrame:
    """Rows of a table that may be of the names in column `key`: by the zone map while they are few."""
    few = names.limit(clustered.MANY_KEYS + 1).count() <= clustered.MANY_KEYS
    return clustered.lookup(spark, f"{path}/{table}", schema, [f for f, _ in clustered.candidates(spark, f"{path}/{table}", names)] if few else None)


def blocks_with(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """term, key, block: blocks that hold the rarest runs of a term of three characters or more (column `term`)."""
    runs = terms.select("term", F.explode(grams.grams(grams.characters("term"), grams.GRAM)).alias("gram")).cache()
    often = _of(spark, path, "often", OFTEN, runs.select(F.col("gram").alias("key")))
    met = runs.join(often, "gram", "left")
    whole = met.groupBy("term").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, PROBES).alias("rarest"))  # runs of one term
    probes = whole.where(F.col("rarest")[0]["n"] > 0).select("term", F.size("rarest").alias("__need"), F.explode("rarest.gram").alias("gram"))
    postings = _of(spark, path, "postings", POSTINGS, probes.select(F.col("gram").alias("key")))
    met = postings.join(probes, "gram").select("term", "__need", "part", F.explode("places").alias("place"))
    found = met.groupBy("term", "part", "place").agg(F.count("*").alias("__n"), F.first("__need").alias("__need")).where("__n = __need")
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", F.posexplode(F.arrays_zip("keys", "blocks")).alias("place", "of"))
    return found.join(parts, ["part", "place"]).select("term", F.col("of.keys").alias("key"), F.col("of.blocks").alias("block")).distinct()


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The lines (key, line_no, text) that may hold a term of the pattern; terms are parted by `|`."""
    terms = [t for t in pattern.split("|") if t]
    if any(len(t) < grams.GRAM for t in terms):
        return spark.read.schema(LINES).parquet(f"{path}/lines").drop("block")
    if not terms:
        return spark.createDataFrame([], LINES).drop("block")
    blocks = blocks_with(spark, path, spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")).select("key", "block").distinct()
    return _of(spark, path, "lines", LINES, blocks.select("key").distinct()).join(blocks, ["key", "block"], "left_semi").drop("block")


def search(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """key, line_no, text and hit (the earliest place) of the lines that hold any term, literally and case-sensitively,
    as text.search() finds them in all lines."""
    return text.search(candidates(spark, path, pattern), pattern) if any(pattern.split("|")) else candidates(spark, path, "").withColumn("hit", F.lit(0))
