"""The star-schema tables as graphs, lines and samples, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def dependencies(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """G1: customer -> order -> part, customer -> nation, supplier -> nation -> region. Columns src, dst; a part that
    stands twice in an order gives one edge, unless distinct is False (closures do without that shuffle)."""
    read = lambda name: table(spark, sf_dir, name)
    edge = lambda name, s, a, d, b: read(name).select(node(s, a).alias("src"), node(d, b).alias("dst"))
    once = [edge("orders", "c", "o_custkey", "o", "o_orderkey"), edge("customer", "c", "c_custkey", "n", "c_nationkey"), edge("supplier", "s", "s_suppkey", "n", "s_nationkey"), edge("nation", "n", "n_nationkey", "r", "n_regionkey")]
    out = edge("lineitem", "o", "l_orderkey", "p", "l_partkey")
    out = out.distinct() if distinct else out
    for other in once:
        out = out.unionAll(other)
    return out


G1 = """g AS (
  SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: an event type and the one that follows it for the same user; a small cyclic graph."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    moved = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"))
    return moved.where("dst IS NOT NULL").distinct()


G2 = """g2 AS (
  SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: doc_id, line_no (from 1) and text of every line of documents."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "text")


L = """l AS (
  SELECT doc_id, i AS line_no, a[i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), unnest(range(1, len(a) + 1)) AS u(i)
)"""
