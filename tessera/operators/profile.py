"""Aggregations of runtime profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import one_decimal
from .rank import top


def hot(samples: DataFrame, k: int = 20) -> DataFrame:
    """method, samples and pct (of all samples, one decimal) of the k methods sampled most."""
    counted = samples.groupBy("method").agg(F.count("*").alias("samples"))
    total = counted.agg(F.sum("samples")).scalar()
    ranked = top(counted, k, F.desc("samples"), F.asc("method"))
    return ranked.select("method", "samples", one_decimal(100.0 * F.col("samples") / total).cast("double").alias("pct"))


def pauses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pauses, total_ms, max_ms and avg_ms (whole) of rows with ms."""
    summed = rows.groupBy(*keys).agg(F.count("*").alias("pauses"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))
    return summed.withColumn("avg_ms", F.floor(F.col("total_ms") / F.col("pauses")).cast("long"))


def heap_growth(before: DataFrame, after: DataFrame, least: int = 10) -> DataFrame:
    """class_name, before, after, growth (instances) and byte_growth of what grew by at least `least` instances."""
    old = before.select("class_name", F.col("instances").alias("before"), F.col("bytes").alias("__bytes"))
    both = after.join(old, "class_name", "left")
    grown = both.select("class_name", F.coalesce("before", F.lit(0)).alias("before"), F.col("instances").alias("after"), (F.col("instances") - F.coalesce("before", F.lit(0))).alias("growth"), (F.col("bytes") - F.coalesce("__bytes", F.lit(0))).alias("byte_growth"))
    return grown.where(F.col("growth") >= least)


#: Event types of a runtime recording.
EVENT_KINDS = {"sample": "jdk.ExecutionSample", "gc": "jdk.GarbageCollection", "allocation": "jdk.ObjectAllocationInNewTLAB", "wait": "jdk.JavaMonitorWait", "enter": "jdk.JavaMonitorEnter", "exception": "jdk.JavaExceptionThrow", "read": "jdk.FileRead", "write": "jdk.FileWrite", "socket_read": "jdk.SocketRead", "socket_write": "jdk.SocketWrite"}


def events_of(recording: DataFrame) -> DataFrame:
    """type and values of each event of recordings read by sources.profile."""
    return recording.select(F.explode("recording.events").alias("e")).select("e.type", "e.values.*")


def summaries(events: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """All sections of a profile: hot, gc, io, allocations, contentions and exceptions."""
    kind = lambda *names: events.where(F.col("type").isin([EVENT_KINDS[n] for n in names]))
    frame = F.element_at("stackTrace.frames", 1)["method"]
    named = F.concat(F.replace(frame["type"]["name"], F.lit("/"), F.lit(".")), F.lit("."), frame["name"])
    ms = F.floor(F.col("duration") / 1_000_000).cast("long")
    return {
        "hot": hot(kind("sample").where(F.size("stackTrace.frames") > 0).select(named.alias("method")), k),
        "gc": pauses(kind("gc").select(F.lit("all").alias("scope"), ms.alias("ms")), ["scope"]),
        "io": kind("read", "write", "socket_read", "socket_write").groupBy("type").agg(F.count("*").alias("n")),
        "allocations": kind("allocation").groupBy(F.col("objectClass.name").alias("class_name")).agg(F.sum("tlabSize").alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("bytes"), "class_name").limit(k),
        "contentions": kind("wait", "enter").groupBy(F.col("monitorClass.name").alias("class_name")).agg(F.sum(ms).alias("ms"), F.count("*").alias("n")).orderBy(F.desc("ms"), "class_name").limit(k),
        "exceptions": kind("exception").groupBy(F.col("thrownClass.name").alias("class_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class_name").limit(k),
    }
