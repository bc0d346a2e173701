"""How source files are dealt over tasks and how often they are parsed; debt and methods that very many call."""

from pyspark.sql import functions as F

from tessera.operators import commands, packs, rules
from tessera.operators.cut import spread
from tessera.plans import rule_tree, tree_queries
from tessera.sources import code

DATA = "/root/testdata/sf0.01"


def test_rows_are_dealt_and_filters_stay_behind(spark):
    keys = spark.range(0, 5000, 1, 1).withColumnRenamed("id", "k")
    dealt = spread(keys, "k").where("k % 2 = 0")
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 2500
    assert spread(keys.limit(10), "k").count() == 10
    assert rule_tree.tree(spark, DATA).rdd.getNumPartitions() > 1


def test_files_of_suppliers_are_dealt_and_parsed_once(spark, tmp_path):
    for name in ("region", "nation"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    few = spark.read.parquet(f"{DATA}/supplier.parquet").limit(50)
    copies = few.crossJoin(spark.range(50)).withColumn("s_suppkey", F.col("s_suppkey") + 1_000 * F.col("id")).drop("id")
    copies.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = tree_queries.tree(spark, str(tmp_path)).where("path LIKE '%Supplier%'")
    assert files.count() == 2500 and files.select(F.spark_partition_id()).distinct().count() == 3
    asked = commands.api(tree_queries.base(spark, str(tmp_path)), "trade")
    assert "MapInArrow" not in asked._jdf.queryExecution().optimizedPlan().toString()


def test_rules_on_text_parse_nothing_and_security_parses_files_with_hits(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    base = rule_tree.base(spark, DATA)
    assert "MapInArrow" not in plan(commands.compat(base)) + plan(commands.migrate(base))
    some = rule_tree.tree(spark, DATA).where(rules.in_some_line("content", packs.SECURITY)).select("path").distinct()
    hits = rules.scan(base.code.texts, packs.SECURITY).select("path").distinct()
    assert hits.count() > 0 and some.exceptAll(hits).isEmpty() and hits.exceptAll(some).isEmpty()


def test_debt_counts_the_calls_of_a_hot_method_once(spark):
    n = packs.HOT_METHOD + 1
    files = [("A.java", "class A {\n    void m() {\n    }\n}\n")] + [(f"C{i}.java", f"class C{i} {{\n    A a;\n    void go() {{\n        a.m();\n    }}\n}}\n") for i in range(n)]
    source = spark.createDataFrame([(p, None, 0, s) for p, s in files], "path string, content_hash string, mtime_ms long, content string")
    base = commands.CodeBase(code.Code(code.extract(source)))
    assert commands.perf(base).where("rule_id = 'HOT_METHOD'").count() == 1
    assert commands.debt(base, n + 1).where(F.col("fqn") == "A").first().score == 1 + 50 + 15
