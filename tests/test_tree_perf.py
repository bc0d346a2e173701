"""tree_perf where methods of nations have more callers than a hot method needs."""

import duckdb
from pyspark.sql import functions as F

from tessera.operators import commands, packs
from tessera.plans import catalogue, tree_queries

DATA = "/root/testdata/sf0.01"


def test_rows_equal_the_sql_beyond_the_callers_of_a_hot_method(spark, tmp_path):
    for name in ("region", "nation"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    few = spark.read.parquet(f"{DATA}/supplier.parquet").orderBy("s_suppkey").limit(2)
    copies = few.crossJoin(spark.range(packs.HOT_METHOD + 1)).withColumn("s_suppkey", F.col("s_suppkey") + 1_000 * F.col("id")).drop("id")
    copies.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("region", "nation", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(catalogue.oracle_sql()["tree_perf"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["tree_perf"](spark, str(tmp_path)).collect()]
    assert len(want) == 6 * (packs.HOT_METHOD + 1) and sorted(got) == sorted(want)
    indexed = commands.perf(tree_queries.base(spark, str(tmp_path))).where("scope = 'index'")
    assert {r.rule_id for r in indexed.collect()} == {"HOT_METHOD"}


def test_no_side_of_a_join_is_broadcast(spark):
    base = tree_queries.base(spark, DATA)
    asked = [catalogue.queries()["tree_perf"](spark, DATA), commands.perf(base)]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in asked]
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
