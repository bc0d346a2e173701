"""Stores over two versions of the source tree: the tree as the tables give it, and the same after edits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands
from ..operators.cut import shared_dir
from ..sources import store
from . import tree_queries
from .registry import query

_BUILT: dict[tuple[str, str], str] = {}  # by application and folder, so that the queries of a session share a store


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree in which the nations of region 1 call their label `title`, and the test of nation 0 is gone."""
    nations = tree_queries.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src/geo/Nation"), "n_nationkey", F.lit(".java")).alias("path"), F.lit(True).alias("__renamed"))
    files = tree_queries.tree(spark, sf_dir).join(nations, "path", "left").where("path <> 'src/geo/Nation0Test.java'")
    text = F.when(F.col("__renamed"), F.replace("content", F.lit("String label()"), F.lit("String title()"))).otherwise(F.col("content"))
    return files.withColumn("content", text).drop("__renamed")


def stored(spark: SparkSession, sf_dir: str) -> str:
    """A store that was built from the tree and then brought up to the edited one."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = f"{shared_dir(spark).rstrip('/')}/tessera-store-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        store.refresh(spark, tree_queries.tree(spark, sf_dir), path)
        store.refresh(spark, edited(spark, sf_dir), path)
        _BUILT[key] = path
    return _BUILT[key]


_ARITY = "CASE {0} WHEN 'note' THEN 1 WHEN 'get' THEN 1 WHEN 'visit' THEN 2 WHEN 'serve' THEN 2 WHEN 'add' THEN -1 ELSE 0 END"
_EDGES = f"""{tree_queries.WITH}, x AS (
  SELECT caller AS caller_class, method AS caller_method, {_ARITY.format('method')} AS caller_arity, callee AS callee_class, called AS callee_method,
    CASE WHEN called = callee THEN -1 WHEN called = 'label' AND callee IN (SELECT 'Nation' || n_nationkey FROM nation WHERE n_regionkey = 1) THEN -1 ELSE {_ARITY.format('called')} END AS callee_arity, line, path
  FROM e WHERE path <> 'src/geo/Nation0Test.java')
"""


@query(_EDGES + "SELECT * FROM x")
def store_edges_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored edges after the edits: all are those of a full resolution."""
    return store.open_code(spark, stored(spark, sf_dir)).edges


@query(_EDGES + """SELECT * FROM x WHERE regexp_extract(path, 'Nation([0-9]+)[.]java', 1) IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1) OR (callee_method = 'label' AND callee_arity = -1)""")
def store_edges_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second refresh has written: calls of edited files, and calls that were resolved through what they renamed."""
    return store.Store(spark, stored(spark, sf_dir)).newest("edges").drop("place")


@query("""SELECT status, n FROM (SELECT 'parsed' AS status, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n UNION ALL SELECT 'deleted', (SELECT count(*) FROM nation WHERE n_nationkey = 0 AND n_regionkey = 0)
UNION ALL SELECT 'reused', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_regionkey <> 1) + (SELECT count(*) FROM nation WHERE n_regionkey = 0 AND n_nationkey <> 0) + (SELECT count(*) FROM supplier) + 1) WHERE n > 0""")
def store_refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file of the newest version came from."""
    last = store.Store(spark, stored(spark, sf_dir))
    first = store.Store(spark, last.path, last.number - 1)
    both = first.seen().select("path", F.col("content_hash").alias("was")).join(last.seen().select("path", "content_hash"), "path", "full")
    status = F.when(F.col("content_hash").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("content_hash")), "reused").otherwise("parsed")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(_EDGES + """, g AS (SELECT callee_class, callee_method, count(*) AS n FROM x GROUP BY ALL)
SELECT name, signature, a AS start_line, coalesce(n, 0) AS callers, vis AS visibility FROM (SELECT class_name, CASE WHEN name = 'label' THEN 'title' ELSE name END AS name, replace(signature, 'label', 'title') AS signature, a, vis FROM own WHERE class_name = 'Nation1') o
LEFT JOIN g ON g.callee_class = o.class_name AND g.callee_method = o.name""")
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class of the edited tree, by look-ups in the clustered tables."""
    return commands.summary(commands.CodeBase(store.open_code(spark, stored(spark, sf_dir))), "Nation1").select("name", "signature", "start_line", "callers", "visibility")


@query("SELECT 'implementor' AS relation, 'Nation' || n_nationkey AS name FROM nation WHERE n_regionkey = 1")
def store_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.hierarchy(commands.CodeBase(store.open_code(spark, stored(spark, sf_dir))), "Region1")
