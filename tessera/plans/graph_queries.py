"""Call-graph style questions on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rank
from ..session import table
from .bindings import G1, G2, dependencies, transitions
from .registry import query


def _seed(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"WITH {G1} SELECT src, dst FROM g WHERE dst = 'p:1'")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends directly on one part."""
    return graph.neighbours(dependencies(spark, sf_dir), _seed(spark, "p:1"), incoming=True).select("src", "dst")


@query(f"WITH {G1} SELECT src, dst FROM g WHERE src = 'c:1'")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one customer depends on directly."""
    return graph.neighbours(dependencies(spark, sf_dir), _seed(spark, "c:1")).select("src", "dst")


@query(f"WITH {G1} SELECT dst AS node, count(DISTINCT src) AS n FROM g WHERE dst LIKE 'p:%' GROUP BY dst ORDER BY n DESC, node LIMIT 30")
def hotspots_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty parts that most orders depend on. Pre-aggregated before the shuffle, then a top-k."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    counted = items.groupBy("l_partkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("p:"), F.col("l_partkey")).alias("node"), "n")
    return rank.top(counted, 30, F.desc("n"), F.asc("node"))


def _closure_sql(seed: str, src: str, dst: str, view: str, name: str, bound: int) -> str:
    return f"""WITH RECURSIVE {view}, r AS (
  SELECT '{seed}' AS node, 0 AS depth UNION SELECT {name}.{dst}, r.depth + 1 FROM r JOIN {name} ON {name}.{src} = r.node WHERE r.depth < {bound}
) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node"""


@query(_closure_sql("p:1", "dst", "src", G1, "g", 30))
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a change of one part would reach, with the fewest steps."""
    return graph.closure(dependencies(spark, sf_dir, distinct=False), _seed(spark, "p:1"), incoming=True)


@query(_closure_sql("r:0", "dst", "src", G1, "g", 2))
def impact_closure_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a region, two levels up."""
    return graph.closure(dependencies(spark, sf_dir, distinct=False), _seed(spark, "r:0"), incoming=True, max_levels=2)


@query(_closure_sql("c:1", "src", "dst", G1, "g", 10))
def flow_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one customer reaches, level by level."""
    return graph.closure(dependencies(spark, sf_dir, distinct=False), _seed(spark, "c:1"), max_levels=10)


@query(_closure_sql("signup", "src", "dst", G2, "g2", 8))
def cyclic_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability in a graph with cycles."""
    return graph.closure(transitions(spark, sf_dir), _seed(spark, "signup"), max_levels=8)


@query(f"""WITH RECURSIVE {G1}, r AS (
  SELECT ['p:1'] AS path, 'p:1' AS node UNION ALL SELECT list_append(path, g.src), g.src FROM r JOIN g ON g.dst = r.node WHERE len(path) <= 20 AND NOT list_contains(path, g.src)
) SELECT array_to_string(list_reverse(path), ' -> ') AS chain, (len(path) - 1)::INTEGER AS depth FROM r WHERE len(path) > 1 AND node NOT IN (SELECT dst FROM g)""")
def call_chain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chains from a root to one part."""
    found = graph.chains_to_roots(dependencies(spark, sf_dir), _seed(spark, "p:1"))
    return found.select(F.array_join("chain", " -> ").alias("chain"), "depth")


@query(f"""WITH RECURSIVE {G2}, r AS (
  SELECT ['signup'] AS path, 'signup' AS node UNION ALL SELECT list_append(path, g2.dst), g2.dst FROM r JOIN g2 ON g2.src = r.node WHERE len(path) <= 4 AND NOT list_contains(path, g2.dst)
) SELECT array_to_string(path, ' -> ') AS chain, (len(path) - 1)::INTEGER AS depth FROM r WHERE len(path) > 1""")
def simple_paths_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of up to four steps in a cyclic graph."""
    found = graph.simple_paths(transitions(spark, sf_dir), _seed(spark, "signup"), max_edges=4)
    return found.select(F.array_join("path", " -> ").alias("chain"), (F.size("path") - 1).alias("depth"))


@query(f"""WITH RECURSIVE {G1}, r AS (
  SELECT ['p:1'] AS path, 'p:1' AS node UNION ALL SELECT list_append(path, g.src), g.src FROM r JOIN g ON g.dst = r.node
  WHERE len(path) <= 20 AND NOT list_contains(path, g.src) AND NOT regexp_matches(r.node, '^o:.*$')
) SELECT array_to_string(list_reverse(path), ' -> ') AS chain, (len(path) - 1)::INTEGER AS depth FROM r
WHERE len(path) > 1 AND (node NOT IN (SELECT dst FROM g) OR regexp_matches(node, '^o:.*$'))""")
def call_chain_stop_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that also end at nodes of a stop pattern."""
    edges = dependencies(spark, sf_dir)
    stop = edges.select(F.col("src").alias("node")).where(F.col("node").rlike("^o:.*$")).distinct()
    found = graph.chains_to_roots(edges, _seed(spark, "p:1"), stop=stop)
    return found.select(F.array_join("chain", " -> ").alias("chain"), "depth")


@query(f"WITH {G2} SELECT a.src AS a, a.dst AS b FROM g2 a JOIN g2 b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of event types that follow each other both ways."""
    return graph.two_cycles(transitions(spark, sf_dir))


@query("SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def dead_end_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no finished urgent order refers to."""
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    lone = customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti")
    return lone.select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("node"))


@query("""SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of rows that nothing refers to, by anti joins."""
    kinds = [("part", "part", "p_partkey", "lineitem", "l_partkey"), ("document", "documents", "doc_id", "labels", "doc_id"), ("customer", "customer", "c_custkey", "orders", "o_custkey")]
    out = None
    for kind, name, key, by, ref in kinds:
        used = table(spark, sf_dir, by).select(F.col(ref).alias("__ref"))
        rows = table(spark, sf_dir, name).select(F.col(key).alias("id")).join(used, F.col("id") == F.col("__ref"), "left_anti").select(F.lit(kind).alias("kind"), "id")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("""WITH d AS (SELECT p_partkey, count(DISTINCT l_orderkey) AS callers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT p_partkey, callers, CASE WHEN callers = 0 THEN 'none' WHEN callers <= 3 THEN 'low' WHEN callers <= 10 THEN 'medium' ELSE 'high' END AS risk FROM d""")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of changing each part by its direct dependants."""
    counted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    joined = parts.join(counted, parts["p_partkey"] == counted["l_partkey"], "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("callers"))
    return joined.withColumn("risk", graph.risk("callers", 3, 10))


@query("""SELECT r_name AS parent, string_agg(n_name, ',' ORDER BY n_name) AS children, count(n_name) AS n_children,
  CASE WHEN count(n_name) = 0 THEN 'none' WHEN count(n_name) <= 3 THEN 'low' WHEN count(n_name) <= 10 THEN 'medium' ELSE 'high' END AS risk
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def breaking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct children of each region and the risk of changing it."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    joined = regions.join(nations, regions["r_regionkey"] == nations["n_regionkey"], "left")
    grouped = joined.groupBy(F.col("r_name").alias("parent")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"), F.count("n_name").alias("n_children"))
    return grouped.withColumn("risk", graph.risk("n_children", 3, 10))


@query(f"""WITH RECURSIVE {G1}, r AS (
  SELECT 'p:1' AS node, 0 AS depth UNION SELECT g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node WHERE r.depth < 30 AND r.node NOT LIKE 'c:%'
), m AS (SELECT node, min(depth) AS depth FROM r WHERE node LIKE 'c:%' GROUP BY node)
SELECT node, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN 'high' WHEN depth = 1 THEN 'medium' ELSE 'low' END AS confidence FROM m""")
def test_for_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse search that stops at customers, which stand for tests; nearer ones are surer."""
    edges = dependencies(spark, sf_dir)
    stop = edges.where("src LIKE 'c:%'").select(F.col("src").alias("node"))
    reached = graph.closure(edges, _seed(spark, "p:1"), incoming=True, stop=stop).where("node LIKE 'c:%'")
    return reached.withColumn("confidence", F.when(F.col("depth") == 0, "high").when(F.col("depth") == 1, "medium").otherwise("low"))


test_for_confidence.__test__ = False  # not a test of ours


@query("""SELECT 'region' AS level, r_name AS name, NULL::VARCHAR AS parent FROM region
UNION ALL SELECT 'nation', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of regions, nations and suppliers, each with its parent."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    top = r.select(F.lit("region").alias("level"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    mid = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lit("nation"), "n_name", "r_name")
    low = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.lit("supplier"), "s_name", "n_name")
    return top.unionAll(mid).unionAll(low)


@query("SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one named parent."""
    r = table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf_dir, "nation").join(r, "n_regionkey", "left_semi").select(F.col("n_name").alias("name"))


@query("""SELECT 's:' || s_suppkey AS node, 2 AS depth FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'n:' || n_nationkey, 1 FROM nation""")
def inheritance_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ancestors each supplier and nation has, by following parents."""
    edges = dependencies(spark, sf_dir).where("src LIKE 's:%' OR src LIKE 'n:%'")
    return graph.chain_depth(edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")))


@query("""WITH h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 1)
SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM h) AND l_partkey <> 1 GROUP BY l_partkey ORDER BY n DESC, part LIMIT 10""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts most often ordered together with one part."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    mine = items.where("l_partkey = 1").select("l_orderkey").distinct()
    together = items.where("l_partkey <> 1").join(mine, "l_orderkey", "left_semi").distinct()
    return rank.top(together.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n")), 10, F.desc("n"), F.asc("part"))


#: Fixed values of a small fixture: declared types by owner and member, and markers to resolve.
MEMBERS = [("Order", "customer", "Customer"), ("Customer", "address()", "Address"), ("Address", "city", "City"), ("City", "name", "String")]
MARKERS = [("Order", "?field:customer"), ("Order", "?field:customer?ret:address"), ("Order", "?field:customer?ret:address?field:city"), ("Order", "?field:customer?ret:nothing"), ("City", "?field:name")]


@query("""SELECT * FROM (VALUES ('Order', '?field:customer', 'Customer'), ('Order', '?field:customer?ret:address', 'Address'),
('Order', '?field:customer?ret:address?field:city', 'City'), ('Order', '?field:customer?ret:nothing', '?'), ('City', '?field:name', 'String')) AS t(owner, marker, type)""")
def marker_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver markers resolved one segment a pass against declared member types."""
    from ..operators.resolve import resolve_markers

    members = spark.createDataFrame(MEMBERS, "owner string, member string, type string")
    markers = spark.createDataFrame(MARKERS, "owner string, marker string")
    return resolve_markers(markers, members).select("owner", "marker", "type")
