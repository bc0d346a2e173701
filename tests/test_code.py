import os

import pytest

from tessera.functions import java
from tessera.operators import calls
from tessera.sources import code as source

ROOT = os.path.join(os.path.dirname(__file__), "fixtures", "shop")


@pytest.fixture(scope="module")
def shop(spark):
    facts = source.extract(source.scan_files(spark, [ROOT])).cache()
    yield source.Code(facts)
    facts.unpersist()


def test_literals_and_comments_hide_braces():
    found = java.parse('class A { String s = "}{ // not"; /* } */ char c = \'}\'; String t = """\n } class B {\n"""; void f() { g("//"); } }')
    assert [t["name"] for t in found["types"]] == ["A"]
    assert [m["name"] for m in found["types"][0]["methods"]] == ["f"]
    assert [(e["callee_method"], e["arg_count"]) for e in found["edges"]] == [("g", 1)]


def test_generic_overloads_nested_and_record_members():
    found = java.parse("class A<T> { <K, V> Map<K, List<V>> f(Map<K, V> a, int... b) throws X, y.Z { return null; } static class B extends A<String> implements I<T>, J {} } record P(int x, List<String> y) { P { check(x); } }")
    types = {t["name"]: t for t in found["types"]}
    f = types["A"]["methods"][0]
    assert f["params"] == [{"type": "Map<K, V>", "name": "a"}, {"type": "int...", "name": "b"}] and f["throws"] == ["X", "y.Z"]
    assert types["B"]["outer"] == "A" and types["B"]["super_class"] == "A<String>" and types["B"]["interfaces"] == ["I<T>", "J"]
    assert [x["name"] for x in types["P"]["fields"]] == ["x", "y"] and types["P"]["methods"][0]["is_constructor"]


def test_odd_sources_do_not_raise():
    for text in ("", "class", "class A {", "}}}", "((((", "@", "class A { int x = ; void f(int { }", '"unfinished', "/* open", "import ;", "enum E { A, B", "interface I { default void f() {} }"):
        java.parse(text)


def test_tables(shop):
    assert {r.name for r in shop.types.collect()} == {"OrderService", "Order", "Customer", "BaseService", "Handler", "Notifier", "Status", "OrderController", "OrderRepository", "JdbcRepository", "OrderServiceTest", "Broken"}
    service = shop.types.where("name = 'OrderService'").first()
    assert (service.fqn, service.super_class, service.interfaces, service.loc) == ("com.acme.shop.OrderService", "BaseService", ["Handler"], 38)
    assert shop.annotations.where("name = 'RequestMapping'").first().attrs == {"value": "/orders"}
    assert shop.lines.where("in_loop").count() >= 3 and shop.errors.count() == 0


def test_resolved_edges(shop):
    edges = {(r.caller_class, r.caller_method, r.callee_class, r.callee_method, r.callee_arity) for r in calls.resolve(shop).collect()}
    assert ("OrderController", "get", "OrderService", "find", 1) in edges
    assert ("OrderService", "find", "OrderRepository", "byId", 1) in edges
    assert ("OrderService", "place", "Customer", "mail", 0) in edges
    assert ("JdbcRepository", "save", "JdbcRepository", "save", 2) in edges
    assert ("OrderController", "main", "OrderController", "OrderController", -1) in edges


def test_reflective_edges(shop):
    rows = calls.reflective_edges(shop, [{"method": "find", "target_arg": 0, "prefix": "X"}]).collect()
    assert [(r.callee_class, r.callee_method) for r in rows] == [("XOrderServiceTest", "1")]


def test_scan_options(spark):
    assert source.scan_files(spark, ["/no/such/folder"]).count() == 0
    assert source.scan_files(spark, [ROOT], no_test=True).where("path LIKE '%/test/%'").count() == 0
    assert source.scan_files(spark, [ROOT], excludes=["Model.java"]).where("path LIKE '%Model.java'").count() == 0
