"""Places of rows in a total order, without a window over all rows.

Rows are dealt by ranges of the order and sorted within them; a row's place is its place in its range plus the
sizes of the ranges before. Only those sizes (one for each range and group that meet) are summed by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, materialize

FEW_RUNS = 100_000  # ranges times groups up to which their offsets are broadcast
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the range


def placed(rows: DataFrame, group: str, order: list[Column | str], tag: str) -> DataFrame:
    """rows with __at (from 0, in `order` within the group) and __n (rows of the group), as a written table.

    `group` holds text without nulls, `rows` should be a written table (it is read twice, for the ranges' bounds and
    for the rows). Rows that `order` does not tell apart stand in any order. No task holds more than a range of rows,
    even where one group or one repeated row holds most of them: the last key is the order of the scan."""
    keys = [F.col(group), *(F.col(o) if isinstance(o, str) else o for o in order), F.col("__tie")]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.drop("__tie").withColumn("__row", F.monotonically_increasing_id()).withColumn("__run", F.shiftright("__row", _ROW_BITS))
    dealt = materialize(dealt, f"{tag}-order")
    runs = materialize(dealt.groupBy(group, "__run").agg(F.min("__row").alias("__first"), F.count("*").alias("__rows")), f"{tag}-runs")
    earlier = W.partitionBy(group).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")
    offsets = runs.select(group, "__run", shift, F.sum("__rows").over(W.partitionBy(group)).alias("__n"))
    if runs.count() <= FEW_RUNS:
        offsets = F.broadcast(offsets)
    found = dealt.join(offsets, [group, "__run"]).withColumn("__at", F.col("__row") + F.col("__shift"))
    out = materialize(found.drop("__row", "__run", "__shift"), f"{tag}-placed")
    forget(dealt, runs)
    return out
