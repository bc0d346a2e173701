"""Targets, same-line resolution, walks and name helpers on small sources."""

import hashlib

from pyspark.sql import functions as F

from tessera.functions import java, scalars
from tessera.operators import commands, graph
from tessera.sources import code as source
from tessera.sources import sinks


def code_base(spark, **files):
    rows = [(f"src/{name}.java", hashlib.sha256(text.encode()).hexdigest(), 0, text) for name, text in files.items()]
    facts = source.extract(spark.createDataFrame(rows, "path string, content_hash string, mtime_ms long, content string"))
    return commands.CodeBase(source.Code(facts))


A = """package a;
import b.*;
class Desk {
    Repo repos() { return null; }
    Optional<Repo> maybe() { return null; }
    void work(int[] xs) {
        (repos()).save(1);
        xs[0].save(2);
        for (int x : xs) {
            if (x > 3) { break; }
        }
    }
    void save(int a, int b) { }
}
class StockProblem extends RuntimeException { }
"""
B = """package b;
public class Repo { void save(int x) { flush(); } void flush() { } }
"""


def test_a_result_on_the_same_line_names_the_class(spark):
    base = code_base(spark, Desk=A, Repo=B)
    saved = {(r.line, r.callee_class) for r in base.edges.where("callee_method = 'save'").collect()}
    assert saved == {(7, "Repo"), (8, "?")}  # two classes declare it, so only the result on line 7 tells


def test_targets_and_places(spark):
    base = code_base(spark, Desk=A, Repo=B)
    run = commands.COMMANDS
    got = run["target"](base, "save").first()
    assert (got.status, got.candidates) == ("ambiguous", ["?.save()", "Desk.save(int, int)", "Repo.save(int)"])
    assert run["target"](base, "Repo.save(int)").first().status == "found" and run["target"](base, "Repo.gone").first().status == "missing"
    assert {r.type: r.qualified for r in run["qualify"](base, "Desk").collect()} == {"Repo": "b.Repo", "Optional": "Optional"}
    assert [run["locate"](base, n).first()[1:3] for n in ("Repo.java", "b.Repo", "flush", "nothing")] == [("found", "file"), ("found", "class"), ("found", "method"), ("missing", None)]
    assert [r.name for r in run["daos"](base).collect()] == []
    kinds = {(r.kind, r.name): r.n for r in run["patterns"](base).collect()}
    assert kinds["null_handling", "Optional"] == 1 and kinds["error_handling", "custom exception"] == 1 and kinds["class_suffix", "Problem"] == 1


def test_loops_that_look_for_one_thing():
    kinds = [s["kind"] for s in java.parse(A)["types"] and java.parse(A)["statements"]]
    assert kinds.count("linear_scan") == 1
    assert not [s for s in java.parse("class A { void f() { for (;;) { g(); return; } while (a()) b(); } }")["statements"] if s["kind"] == "linear_scan"]


def test_daos_by_name_super_and_interface(spark):
    base = code_base(spark, X="class OrderDao { } class B extends JdbcTemplate { } class C implements CrudRepository<X, Y> { } class D implements Runnable { }")
    assert sorted(r.name for r in commands.daos(base).collect()) == ["B", "C", "OrderDao"]


def test_first_paths_equal_a_depth_first_walk(spark):
    edges = [("s", "b", 9), ("s", "a", 2), ("a", "c", 1), ("c", "a", 1), ("c", "b", 4), ("b", "d", 1), ("a", "d", 3), ("d", "s", 1)]
    seen = []

    def walk(node):
        seen.append(node)
        for line, dst in sorted((line, dst) for src, dst, line in edges if src == node):
            if dst not in seen:
                walk(dst)

    walk("s")
    df = spark.createDataFrame(edges, "src string, dst string, line int")
    got = graph.first_paths(df, spark.createDataFrame([("s",)], "node string"), 10).orderBy("path").collect()
    assert [r.node for r in got] == seen and {r.node: r.caller for r in got} == {"s": None, "a": "s", "c": "a", "b": "c", "d": "b"}
    assert [r.node for r in graph.first_paths(df, spark.createDataFrame([("s",)], "node string"), 1).orderBy("path").collect()] == ["s", "a", "b"]


def test_name_helpers(spark):
    names = ["OrderService", "FacturaDetailBean", "FacturaDAO", "XMLParser", "OAuth2Handler", "App", "ThingX"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(scalars.class_suffix("n")).collect()] == ["Service", "DetailBean", "DAO", "Parser", "Handler", None, None]
    line = spark.createDataFrame([("if (a.b(x) && super.go(1) && List.of() == Make(y)) run(2.f(3)); f(z); // g1()",)], "t string")
    assert line.select(scalars.calls_in("t").alias("c")).first().c == ["a.b", "super.go", "this.run", "this.g1"]
    shown = spark.range(3).select(scalars.display_name(F.lit("A"), F.lit("f"), F.col("id")).alias("n")).orderBy("n").collect()
    assert [r.n for r in shown] == ["A.f()", "A.f(1 param)", "A.f(2 params)"]
    assert sinks.text_table(spark.createDataFrame([("x", 12), ("long", None)], "a string, b int")) == "a     b\nx     12\nlong"
