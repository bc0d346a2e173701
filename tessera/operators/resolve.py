"""Resolution of receiver markers to types by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, wide

#: Fixed value: the most passes over the markers.
MAX_PASSES = 5


def resolve_markers(markers: DataFrame, members: DataFrame, passes: int = MAX_PASSES, trace: bool = False) -> DataFrame:
    """type of each marker: owner, marker (`?field:name` and `?ret:name` segments, outermost last).

    members: owner, member (a method's name ends in `()`), type. Each pass joins the first open segment of
    every marker against the members of the type reached so far; `?` where a member is unknown or
    segments are left after the last pass. With `trace`, a column of that name lists the members asked for, `owner.member`
    each, found or not."""
    known = members.groupBy("owner", "member").agg(F.max("type").alias("__type"))
    state = markers.withColumn("__at", F.col("owner")).withColumn("__rest", F.col("marker")).withColumn("trace", F.array().cast("array<string>"))
    for _ in range(passes):
        name = F.regexp_extract("__rest", r"^\?(field|ret):([^?]*)", 2)
        member = F.concat(name, F.when(F.col("__rest").startswith("?ret:"), "()").otherwise(""))
        keyed = state.withColumn("__member", F.when(F.col("__rest") != "", member))
        if trace:
            asked = F.when(F.col("__member").isNotNull() & (F.col("__at") != "?"), F.array(F.concat_ws(".", "__at", "__member"))).otherwise(F.array().cast("array<string>"))
            keyed = keyed.withColumn("trace", F.concat("trace", asked))
        looked = keyed.join(wide(known.select(F.col("owner").alias("__at"), F.col("member").alias("__member"), "__type")), ["__at", "__member"], "left")
        state = looked.select(
            *markers.columns,
            "trace",
            F.when(F.col("__rest") == "", F.col("__at")).otherwise(F.coalesce("__type", F.lit("?"))).alias("__at"),
            F.when(F.col("__rest") == "", "").otherwise(F.expr("substring(__rest, length(regexp_extract(__rest, '^\\\\?(field|ret):([^?]*)', 0)) + 1)")).alias("__rest"),
        )
        state = cut(state)
        if state.where("__rest <> '' AND __at <> '?'").isEmpty():
            break
    return state.select(*markers.columns, F.when(F.col("__rest") == "", F.col("__at")).otherwise("?").alias("type"), *(["trace"] if trace else []))
