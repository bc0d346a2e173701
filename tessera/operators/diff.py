"""Snapshots: comparing, reusing and refreshing by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and status (added, deleted, modified, same) of two tables of key and content_hash: one full join."""
    joined = old.select(F.col(key).alias("__old"), F.col("content_hash").alias("__was")).join(new.select(F.col(key).alias("__new"), F.col("content_hash").alias("__is")), F.col("__old") == F.col("__new"), "full")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(~F.col("__was").eqNullSafe(F.col("__is")), "modified").otherwise("same")
    return joined.select(F.coalesce("__old", "__new").alias(key), status.alias("status"))


def split_reusable(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of new whose key and hash are in old, and the rest, which must be worked on."""
    known = old.select(key, "content_hash")
    return new.join(known, [key, "content_hash"], "left_semi"), new.join(known, [key, "content_hash"], "left_anti")


def refresh(facts: DataFrame, old: DataFrame, new: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """facts of a snapshot carried to the next: rows of unchanged keys stay, those of changed, added and
    deleted keys go, and `parsed` (facts of changed and added keys) comes in."""
    same = compare(old, new, key).where("status = 'same'").select(key)
    return facts.join(same, key, "left_semi").unionByName(parsed)
