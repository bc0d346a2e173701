"""Connected components of an edge table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of each node of the undirected edges a, b.

    Each round gives a node the smallest label among its neighbours and then that label's own
    label, so path lengths at least halve; tables are cut in the shared folder each round and
    nothing but a count comes to the driver."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        hooked = materialize(labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "low").alias("component")), "hooked")
        parent = hooked.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = hooked.join(parent, "component", "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"))
        jumped = materialize(jumped, "labels")
        moved = jumped.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before").limit(1).count()
        forget(labels, hooked)
        labels = jumped
        if not moved:
            forget(both)
            return labels
