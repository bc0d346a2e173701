"""The innermost span around each point, by one sweep over each stretch of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRETCH = 4096  # lines of a key that are swept together; a span that is longer stands in several


def innermost(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and the span that is innermost from each place on (-1: none). Spans come by start, then the longer first,
    then by name; of those around a place the last in this order counts, so a stack of open spans tells it."""
    at, who, stack = [], [], []

    def close(before: int) -> None:
        while stack and ends[stack[-1]] < before:
            end = ends[stack.pop()]
            while stack and ends[stack[-1]] <= end:
                stack.pop()
            at.append(end + 1)
            who.append(stack[-1] if stack else -1)

    for i, start in enumerate(starts.tolist()):
        close(start)
        stack.append(i)
        at.append(start)
        who.append(i)
    if len(ends):
        close(int(ends.max()) + 1)
    return np.array(at, np.int64), np.array(who, np.int64)


def enclose(points: DataFrame, spans: DataFrame, key: str, at: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """points with the innermost span around them in column `name` (null without one).

    spans: key, start_line, end_line, name (text). The innermost is the one that starts last, ties to the one that ends first,
    then to the greater name. Lines of a key are dealt in stretches, so a large file is shared among tasks; each stretch
    is sorted, its spans first, and swept once: time grows with spans, points and the stretches that long spans cross.
    Spans without a key, bound or name enclose nothing; points without a key or line have none around them."""
    bucket = lambda c: F.floor(F.col(c) / stretch).cast("long")
    point_type, key_type = points.schema, points.schema[key].dataType
    marked = points.select(F.col(key).alias("__key"), bucket(at).alias("__stretch"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__start"), F.lit(None).cast("long").alias("__end"), F.lit(None).cast("string").alias("__name"), F.col(at).cast("long").alias("__at"), F.struct(*points.columns).alias("__point"))
    used = spans.where(F.col(key).isNotNull() & (F.col("start_line") <= F.col("end_line")) & F.col(name).isNotNull())
    used = used.withColumn("__stretch", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))))
    laid = used.select(F.col(key).cast(key_type).alias("__key"), "__stretch", F.lit(0).alias("__kind"), F.col("start_line").cast("long").alias("__start"), F.col("end_line").cast("long").alias("__end"), F.col(name).cast("string").alias("__name"), F.lit(None).cast("long").alias("__at"), F.lit(None).cast(point_type).alias("__point"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given: rows are short, but each key takes time, so few bytes must not become one task
    both = laid.unionByName(marked).repartition(parts, "__key", "__stretch").sortWithinPartitions("__key", "__stretch", "__kind", "__start", F.desc("__end"), "__name")
    group = F.xxhash64("__key", "__stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_spans, swept = None, [], None
        for batch in batches:
            keys, kinds = batch.column(0), np.asarray(batch.column(1))
            groups = np.asarray(keys)
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                if groups[start] != now:
                    now, open_spans, swept = groups[start], [], None
                part = batch.slice(start, end - start)
                if kinds[start] == 0:
                    open_spans.append(part)
                    continue
                if swept is None:
                    names = pa.concat_arrays([p.column(4) for p in open_spans]) if open_spans else pa.array([], pa.string())
                    bounds = [np.concatenate([np.asarray(p.column(c)) for p in open_spans]) if open_spans else np.zeros(0, np.int64) for c in (2, 3)]
                    swept = (*innermost(*bounds), names)
                places, who, names = swept
                asked = part.column(5)
                known = ~np.asarray(asked.is_null())
                lines = np.asarray(asked.fill_null(0))
                found = np.searchsorted(places, lines, side="right") - 1
                index = np.where((found >= 0) & known, who[np.maximum(found, 0)] if len(who) else -1, -1)
                yield pa.RecordBatch.from_arrays([part.column(6), names.take(pa.array(np.maximum(index, 0), mask=index < 0))], names=["__point", "__name"])

    out_type = T.StructType([T.StructField("__point", point_type), T.StructField("__name", T.StringType())])
    rows = both.select(group.alias("__group"), "__kind", "__start", "__end", "__name", "__at", "__point")
    return rows.mapInArrow(run, out_type).select("__point.*", F.col("__name").alias(name))
