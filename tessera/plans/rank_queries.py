"""Scores, rankings, budgets and naming statistics on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rank
from ..session import table
from .registry import query


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS item FROM lineitem), n AS (SELECT owner, count(*) AS n FROM s GROUP BY owner),
p AS (SELECT x.owner AS a, y.owner AS b, count(*) AS shared FROM s x JOIN s y ON x.item = y.item AND x.owner <> y.owner WHERE x.owner IN (1, 2, 3) GROUP BY 1, 2),
j AS (SELECT a, b, shared / (na.n + nb.n - shared)::DOUBLE AS jaccard FROM p JOIN n na ON na.owner = a JOIN n nb ON nb.owner = b)
SELECT a, b, round(100 * (0.7 * jaccard + 0.3 * (sa.s_nationkey = sb.s_nationkey)::INT))::BIGINT AS score FROM j JOIN supplier sa ON sa.s_suppkey = a JOIN supplier sb ON sb.s_suppkey = b
WHERE 0.7 * jaccard + 0.3 * (sa.s_nationkey = sb.s_nationkey)::INT >= 0.1""")
def similar_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers like three given ones: 0.7 of the Jaccard similarity of their parts, 0.3 for the same nation."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item"))
    targets = spark.createDataFrame([(1,), (2,), (3,)], "owner long")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = rank.jaccard_pairs(items, targets)
    for side in "ab":
        pairs = pairs.join(suppliers.select(F.col("s_suppkey").alias(side), F.col("s_nationkey").alias(f"nation_{side}")), side)
    mixed = 0.7 * F.col("jaccard") + 0.3 * (F.col("nation_a") == F.col("nation_b")).cast("int")
    return pairs.where(mixed >= 0.1).select("a", "b", F.round(100 * mixed).cast("long").alias("score"))


@query("""WITH r AS (SELECT 'c' || c_custkey AS name, 3 AS w FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier WHERE s_nationkey = 7
UNION ALL SELECT 'c' || o_custkey, 2 FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)
UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) AND n_nationkey <> 7)
SELECT name, sum(w)::BIGINT AS score FROM r GROUP BY name ORDER BY score DESC, name LIMIT 15""")
def related_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is most related to one nation: weighted rows of four kinds, summed."""
    read = lambda t: table(spark, sf_dir, t)
    name = lambda k, c: F.concat(F.lit(k), F.col(c)).alias("name")
    own = read("customer").where("c_nationkey = 7").select("c_custkey")
    region = read("nation").where("n_nationkey = 7").select("n_regionkey")
    rows = own.select(name("c", "c_custkey"), F.lit(3).alias("w"))
    rows = rows.unionAll(read("supplier").where("s_nationkey = 7").select(name("s", "s_suppkey"), F.lit(2)))
    rows = rows.unionAll(read("orders").where("o_orderstatus = 'F'").join(own.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(name("c", "o_custkey"), F.lit(2)))
    rows = rows.unionAll(read("nation").where("n_nationkey <> 7").join(region, "n_regionkey", "left_semi").select(name("n", "n_nationkey"), F.lit(1)))
    return rank.top(rows.groupBy("name").agg(F.sum("w").alias("score")), 15, F.desc("score"), F.asc("name"))


@query("""WITH d AS (SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey), c AS (SELECT part, n, (p_size + 10)::BIGINT AS cost FROM d JOIN part ON p_partkey = part),
r AS (SELECT *, (sum(cost) OVER (ORDER BY n DESC, part ROWS UNBOUNDED PRECEDING))::BIGINT AS running_cost, row_number() OVER (ORDER BY n DESC, part) AS k FROM c) SELECT part, n, cost, running_cost FROM r WHERE running_cost <= 2000 OR k = 1""")
def map_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most used parts that fit a budget of summed costs."""
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") + 10).cast("long").alias("cost"))
    return rank.within_budget(used.join(parts, "part"), "cost", 2000, F.desc("n"), F.asc("part")).select("part", "n", "cost", "running_cost")


@query("""WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), x AS (SELECT p_brand, count(DISTINCT l_orderkey) AS orders FROM b GROUP BY p_brand),
d AS (SELECT a.p_brand, count(DISTINCT o.p_brand) AS dependencies FROM b a JOIN b o ON a.l_orderkey = o.l_orderkey AND a.p_brand <> o.p_brand GROUP BY a.p_brand)
SELECT p.p_brand AS package, count(*) AS classes, any_value(orders) AS orders, any_value(dependencies) AS dependencies FROM part p JOIN x USING (p_brand) JOIN d USING (p_brand) GROUP BY p.p_brand""")
def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as packages: members, orders and other brands met in one order. Pairs are made distinct
    before and after the join, so a brand pair crosses the shuffle once a task."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").select("l_orderkey", "p_brand").distinct()
    met = items.join(items.withColumnRenamed("p_brand", "other"), "l_orderkey").where("p_brand <> other").select("p_brand", "other").distinct()
    out = parts.groupBy("p_brand").agg(F.count("*").alias("classes"))
    out = out.join(items.groupBy("p_brand").agg(F.count("*").alias("orders")), "p_brand").join(met.groupBy("p_brand").agg(F.count("*").alias("dependencies")), "p_brand")
    return out.withColumnRenamed("p_brand", "package")


@query("SELECT l_orderkey AS owner, count(*) AS loc, greatest(1, count(*) // 5)::INTEGER AS complexity FROM lineitem GROUP BY l_orderkey ORDER BY loc DESC, complexity DESC, owner LIMIT 30")
def complexity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty longest orders and the estimate from their length."""
    sized = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("owner")).agg(F.count("*").alias("loc"))
    return rank.top(sized.withColumn("complexity", scalars.complexity("loc")), 30, F.desc("loc"), F.desc("complexity"), F.asc("owner"))


@query("""WITH o AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS fan_out, count(DISTINCT l_orderkey) AS fan_in, count(*) AS loc FROM lineitem GROUP BY l_partkey)
SELECT l_partkey AS part, fan_in, fan_out, CASE WHEN fan_in + fan_out > 50 THEN 'high' WHEN fan_in + fan_out > 25 THEN 'medium' ELSE 'low' END AS coupling,
  CASE WHEN loc > 40 THEN 'large' WHEN loc > 20 THEN 'medium' ELSE 'small' END AS effort FROM o""")
def complexity_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct neighbours on both sides, with grades."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_orderkey").alias("fan_in"), F.countDistinct("l_suppkey").alias("fan_out"), F.count("*").alias("loc"))
    both = F.col("fan_in") + F.col("fan_out")
    return counted.select("part", "fan_in", "fan_out", F.when(both > 50, "high").when(both > 25, "medium").otherwise("low").alias("coupling"), F.when(F.col("loc") > 40, "large").when(F.col("loc") > 20, "medium").otherwise("small").alias("effort"))


DEBT_SQL = """d AS (SELECT p_partkey AS part, least(100, 2 * least(p_size, 30) + least(count(DISTINCT l_orderkey), 50) + CASE WHEN count(l_orderkey) = 0 THEN 15 ELSE 0 END
  + greatest(0, (p_size - 40)) // 10)::BIGINT AS score FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size)"""


def _debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    n = F.coalesce("n", F.lit(0))
    score = 2 * F.least("p_size", F.lit(30)) + F.least(n, F.lit(50)) + F.when(n == 0, 15).otherwise(0) + F.floor(F.greatest(F.lit(0), F.col("p_size") - 40) / 10)
    return parts.select(F.col("p_partkey").alias("part"), F.least(F.lit(100), score).cast("long").alias("score"))


@query(f"WITH {DEBT_SQL} SELECT part, score FROM d ORDER BY score DESC, part LIMIT 20")
def debt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores with caps, the twenty worst."""
    return rank.top(_debt(spark, sf_dir), 20, F.desc("score"), F.asc("part"))


@query(f"WITH {DEBT_SQL}, m AS (SELECT floor(avg(score))::BIGINT AS mean FROM d) SELECT mean, CASE WHEN mean < 10 THEN 'A' WHEN mean < 25 THEN 'B' WHEN mean < 50 THEN 'C' WHEN mean < 75 THEN 'D' ELSE 'F' END AS grade FROM m")
def debt_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean score and its letter."""
    mean = _debt(spark, sf_dir).agg(F.floor(F.avg("score")).cast("long").alias("mean"))
    return mean.withColumn("grade", rank.grade(F.col("mean")))


@query("SELECT split_part(p_name, ' ', -1) AS suffix, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, suffix LIMIT 5")
def naming_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest last words of names."""
    words = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("suffix"))
    return rank.top(words.groupBy("suffix").agg(F.count("*").alias("n")), 5, F.desc("n"), F.asc("suffix"))


@query("SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, prefix LIMIT 5")
def naming_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest first words of names."""
    words = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("prefix"))
    return rank.top(words.groupBy("prefix").agg(F.count("*").alias("n")), 5, F.desc("n"), F.asc("prefix"))


@query("""WITH b AS (SELECT p_name, list_sort(list(DISTINCT p_type)) AS layers FROM part GROUP BY p_name HAVING count(DISTINCT p_type) >= 2)
SELECT array_to_string(layers, ' > ') AS chain, count(*) AS n FROM b GROUP BY layers HAVING count(*) >= 1 ORDER BY n DESC, chain LIMIT 5""")
def layer_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest sets of layers that one base name has."""
    sets = table(spark, sf_dir, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_type")).alias("layers")).where(F.size("layers") >= 2)
    return rank.top(sets.groupBy(F.array_join("layers", " > ").alias("chain")).agg(F.count("*").alias("n")), 5, F.desc("n"), F.asc("chain"))


@query("""SELECT event_type AS kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events))::BIGINT AS share FROM events GROUP BY event_type""")
def pattern_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each kind and whole percents."""
    counted = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("total", total).select("kind", "n", rank.percent(F.col("n"), F.col("total")).alias("share"))


@query("SELECT p_brand, arg_max(p_type, (n, p_type)) AS style, max(n) AS n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def style_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest type of each brand, ties to the later name."""
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return counted.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("style"), F.max("n").alias("n"))


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS covered, count(*) AS total, (100 * count(*) FILTER (l.doc_id IS NOT NULL) // count(*))::BIGINT AS percent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a label."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"))
    joined = docs.join(labels, docs["doc_id"] == labels["l_doc"], "left")
    return joined.agg(F.count("l_doc").alias("covered"), F.count("*").alias("total")).withColumn("percent", F.floor(100 * F.col("covered") / F.col("total")).cast("long"))


@query("""SELECT o_orderkey, CASE WHEN d > 365 THEN (d // 365) || 'y' WHEN d > 30 THEN (d // 30) || 'mo' ELSE d || 'd' END AS age
FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-12-31') AS d FROM orders)""")
def todo_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each order on a fixed day."""
    days = F.datediff(F.lit("2001-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.age_bucket(days).alias("age"))


@query("""SELECT p_brand, p_partkey, p_retailprice, total, rank FROM (SELECT p_brand, p_partkey, p_retailprice, count(*) OVER (PARTITION BY p_brand) AS total,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::BIGINT AS rank FROM part) WHERE rank <= 3""")
def top_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand and how many it has. The count is an aggregate of its own, so the
    ranking can drop rows before the shuffle."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    best = rank.top_within(parts, ["p_brand"], 3, F.desc("p_retailprice"), F.asc("p_partkey"))
    totals = parts.groupBy("p_brand").agg(F.count("*").alias("total"))
    return best.join(totals, "p_brand").select("p_brand", "p_partkey", "p_retailprice", "total", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, p_name, total, total > 25 AS truncated FROM (SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE p_size = 7) ORDER BY p_partkey LIMIT 25")
def compact_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortened listing that tells how many rows there are."""
    return rank.with_total(table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey", "p_name"), 25, F.asc("p_partkey"))


@query("""SELECT p_name, lower(regexp_replace(replace(p_name, ' ', 'X'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS words, count(*) AS n FROM part GROUP BY p_name""")
def humanised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names turned to words at their capitals."""
    named = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return named.select("p_name", scalars.humanise(F.replace("p_name", F.lit(" "), F.lit("X"))).alias("words"), "n")
