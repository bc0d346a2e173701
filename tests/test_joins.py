"""Joins of facts with facts: none sends a side that grows with the input through the driver, however small Spark takes it to be."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import commands
from tessera.sources import code

A = """package a;
class A {
    B b;
    void go(int n) {
        for (int i = 0; i < n; i++) {
            b.step(n);
        }
    }
}
"""
B = """package a;
class B {
    void step(int n) { hop(n); } void idle() { }
    void hop(int n) {
        for (int x : all) {
            if (x > n) { break; }
        }
        db.executeQuery("a");
    }
}
"""


def _base(spark, **files):
    rows = [(f"{name}.java", None, 0, text) for name, text in files.items()]
    return commands.CodeBase(code.Code(code.extract(spark.createDataFrame(rows, "path string, content_hash string, mtime_ms long, content string"))))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_of_deep_performance_rules_or_of_resolution_broadcasts(spark):
    base = _base(spark, A=A, B=B)
    plan = _plan(commands.perf(base, deep=2)) + _plan(base.edges)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_deep_hits_and_lines_that_facts_stand_for(spark):
    base = _base(spark, A=A, B=B)
    deep = commands.perf(base, deep=2).where("call_path IS NOT NULL").select("path", "line_no", "rule_id", "call_path")
    way = ["A.go/1", "B.step/1", "B.hop/1"]
    assert sorted(tuple(r) for r in deep.collect()) == [("B.java", 5, "LINEAR_SCAN", way), ("B.java", 8, "DB_QUERY", way)]
    told = base.code.lines_told(F.transform("statements", lambda s: F.struct(s["line"].alias("line_no"), s["kind"].alias("kind")))).where("kind = 'linear_scan'")
    assert told.collect() == [Row(path="B.java", line_no=5, text="        for (int x : all) {", in_comment=False, in_loop=False, kind="linear_scan")]
