"""Ranking, scoring and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import cut


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order that must be total; planned as a top-k, not a full sort."""
    return df.orderBy(*order).limit(k)


def top_within(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes each partition to k a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def with_total(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """top() with the number of all rows in `total` and whether some were left out in `truncated`."""
    count = df.agg(F.count("*")).scalar()
    return top(df, k, *order).withColumn("total", count).withColumn("truncated", F.col("total") > k)


def numbered(df: DataFrame, *order: str, name: str = "step") -> DataFrame:
    """Rows with their place in an order, from 1, without a window over all: places within sorted ranges plus the rows of
    the ranges before, whose counts alone are summed."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()))
    sizes = dealt.groupBy(F.shiftright("__row", 33).alias("__range")).agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = dealt.withColumn("__range", F.shiftright("__row", 33)).join(before, "__range")
    return placed.withColumn(name, F.col("__row").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1).drop("__row", "__range", "__before")


def within_budget(df: DataFrame, cost: str, budget: int, *order: Column) -> DataFrame:
    """The longest beginning of the order whose summed cost is within the budget, at least one row.

    Costs must be positive whole numbers: a beginning then has at most `budget` rows, so only that many of the
    order are taken before the running sum, and the window sees a bounded table."""
    first = df.orderBy(*order).limit(budget + 1)
    running = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = first.withColumn("running_cost", F.sum(cost).over(running)).withColumn("__place", F.row_number().over(W.orderBy(*order)))
    return summed.where((F.col("running_cost") <= budget) | (F.col("__place") == 1)).drop("__place")


def grade(score: Column) -> Column:
    """Letter of a debt score."""
    return F.when(score < 10, "A").when(score < 25, "B").when(score < 50, "C").when(score < 75, "D").otherwise("F")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.round(100 * part / whole)).cast("long")


def jaccard_pairs(items: DataFrame, targets: DataFrame) -> DataFrame:
    """a (a target), b (another owner), shared, union and jaccard of their item sets. items: owner, item.

    Counts meet on items, so owners that share nothing are never paired; item lists of the targets are
    joined in, not all pairs."""
    sets = items.select("owner", "item").distinct()
    sizes = sets.groupBy("owner").agg(F.count("*").alias("n"))
    mine = sets.join(targets.select("owner").distinct(), "owner", "left_semi").select(F.col("owner").alias("a"), "item")
    shared = mine.join(sets.select(F.col("owner").alias("b"), "item"), "item").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = shared.join(sizes.select(F.col("owner").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("owner").alias("b"), F.col("n").alias("n_b")), "b")
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return sized.select("a", "b", "shared", union.alias("union_size"), (F.col("shared") / union).alias("jaccard"))
