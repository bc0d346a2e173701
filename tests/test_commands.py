import inspect
import os

import pytest

from tessera.operators import commands
from tessera.sources import code as source
from tessera.sources import config, sinks, spec, store, versions
from tessera.streaming import refresh

ROOT = os.path.join(os.path.dirname(__file__), "fixtures", "shop")
CONFIG = """
sourceRoots: [src]
architecture:
  layers:
    - {name: web, glob: "*Controller"}
    - {name: service, glob: "*Service", annotations: [Service]}
  rules:
    - {id: web-no-db, from: web, denyImport: ["com.acme.db"]}
    - {id: inject, layer: web, require: constructor-injection}
  chainStopMethods: ["stop*"]
"""
RUN = commands.COMMANDS


@pytest.fixture(scope="module")
def shop(spark):
    facts = source.extract(source.scan_files(spark, [ROOT])).cache()
    yield commands.CodeBase(source.Code(facts), config.read_config(CONFIG))
    facts.unpersist()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_navigation(shop):
    assert RUN["overview"](shop).first().types == 12
    assert rows(RUN["hierarchy"](shop, "OrderRepository"), "relation", "name") == [("implementor", "JdbcRepository")]
    assert rows(RUN["hierarchy"](shop, "OrderService"), "relation", "name") == [("interface", "Handler"), ("super", "BaseService")]
    assert rows(RUN["implements"](shop, "Handler"), "name") == [("OrderService",)]
    assert ("field", "OrderRepository") in rows(RUN["deps"](shop, "OrderService"), "kind", "dependency")
    assert RUN["related"](shop, "OrderService").first().name in ("OrderRepository", "OrderController")
    assert ("JdbcRepository",) in rows(RUN["similar"](shop, "OrderRepository"), "name")
    assert "class com.acme.shop.OrderService" in RUN["explain"](shop, "OrderService").first().text
    assert RUN["read"](shop, "OrderService.find").first().source.strip().startswith("public Order find")
    assert RUN["stats"](shop, "OrderService").first().inheritance_depth == 1
    assert RUN["map"](shop, 60).count() >= 1 and RUN["mini"](shop, "OrderService").first().called_by == ["OrderController", "OrderServiceTest"]
    assert RUN["context"](shop, "OrderService").first().layer == "service"
    assert [r.step for r in RUN["context-for"](shop, "fix the crash in OrderService").collect()] == ["read", "callers"]


def test_call_graph(shop):
    assert rows(RUN["callers"](shop, "OrderService.find(String)"), "src") == [("OrderController.get/1",), ("OrderServiceTest.finds/0",)]
    assert ("OrderRepository.byId/1",) in rows(RUN["callees"](shop, "OrderService.find"), "dst")
    chains = rows(RUN["call-chain"](shop, "OrderRepository.byId"), "chain")
    assert ("OrderController.main -> OrderController.get -> OrderService.find -> OrderRepository.byId",) in chains
    impact = {r.class_name: (r.depth, r.risk) for r in RUN["impact"](shop, "OrderRepository.byId").collect()}
    assert impact["OrderService"] == (1, "low") and impact["OrderController"][0] == 2
    assert rows(RUN["test-for"](shop, "OrderService.find"), "test", "confidence") == [("OrderServiceTest", "high")]
    assert ("OrderRepository", "byId") in rows(RUN["flow"](shop, "OrderController.get"), "class_name", "method")
    assert RUN["breaking-changes"](shop, "OrderRepository").first().overrides == ["byId", "save"]
    changed = shop.code.types.where("name = 'OrderRepository'").select("path")
    assert ("OrderController",) in rows(RUN["diff-impact"](shop, changed), "name")


def test_search(shop):
    hit = RUN["search"](shop, "hunter2|TODO").collect()
    assert [(h.method, h.in_comment) for h in hit] == [("place", True), ("neverCalled", False)]
    assert RUN["find"](shop, [["order"], ["controller", "web"]]).first().fqn == "com.acme.web.OrderController"
    assert RUN["scope"](shop, "order, repository").first().fqn.endswith("OrderRepository") or RUN["scope"](shop, "order, repository").count() > 0
    assert ("method", "OrderService.neverCalled") in rows(RUN["unused"](shop), "kind", "name")
    assert ("OrderController", "import") in rows(RUN["imports"](shop, "OrderService"), "class_name", "relation")
    checked = {r.ref: r for r in RUN["validate"](shop, "OrderService.find(String); OrderService.fnd; JdbcRepository.save").collect()}
    assert checked["OrderService.find(String)"].status == "found" and "find" in checked["OrderService.fnd"].suggestions and checked["JdbcRepository.save"].status == "ambiguous"
    assert RUN["type-check"](shop, "OrderRepository.save").first().is_void
    assert RUN["resolve"](shop, "OrderService.repo.byId").first().signature == "Order byId(String id)"
    assert rows(RUN["co-annotations"](shop, "RestController"), "name") == [("RequestMapping",)]


def test_rules(shop):
    found = {r.rule_id for r in RUN["smells"](shop).collect()}
    assert {"EMPTY_CATCH_BLOCK", "CATCH_GENERIC_EXCEPTION", "MAGIC_NUMBER", "UNUSED_PARAMETER"} <= found
    perf = {r.rule_id for r in RUN["perf"](shop, deep=2).collect()}
    assert {"DB_QUERY", "SQL_CONCAT", "SELECT_STAR", "STATIC_MUTABLE_COLLECTION"} <= perf
    assert {"SQL_INJECTION", "HARDCODED_SECRET"} == {r.rule_id for r in RUN["security"](shop).collect()}
    assert "VECTOR_USAGE" in {r.rule_id for r in RUN["migrate"](shop, 17).collect()}
    assert "URL_CONSTRUCTOR" not in {r.rule_id for r in RUN["migrate"](shop, 17).collect()}
    assert RUN["compat"](shop).count() == 0
    todo = RUN["todo"](shop).collect()
    assert [(t.mark, t.method, t.text) for t in todo] == [("TODO", "place", "TODO: check stock")]
    assert ("mutable_static", "OrderService", "names") in rows(RUN["lint"](shop), "kind", "class_name", "detail")
    assert rows(RUN["check"](shop), "rule_id", "fqn") == [("inject", "com.acme.web.OrderController")]
    assert rows(RUN["layer"](shop, "web"), "fqn") == [("com.acme.web.OrderController",)]


def test_aggregates_and_entries(shop):
    assert RUN["hotspots"](shop).first().callers >= 3
    assert {r.package for r in RUN["packages"](shop).collect()} >= {"com.acme.shop", "com.acme.web", "com.acme.db"}
    assert ("com.acme.db", ["com.acme.shop"]) in [(r.package, r.cycles) for r in RUN["packages"](shop).collect()]
    assert RUN["debt"](shop).first().grade in "ABCDF"
    assert rows(RUN["endpoints"](shop), "verb", "path") == [("GET", "/orders/{id}"), ("POST", "/orders/new")]
    assert {r.kind for r in RUN["entry-points"](shop).collect()} == {"rest", "main"}
    assert RUN["scaffold"](shop, "service", "Stock").first().source.startswith("package com.acme.shop;")
    assert RUN["doc"](shop, "OrderService").count() > 0 and RUN["snippet"](shop, "Service").first().fqn == "com.acme.shop.OrderService"


def test_every_command_without_arguments_runs(shop):
    for name, fn in RUN.items():
        needed = [p for p in [*inspect.signature(fn).parameters.values()][1:] if p.default is p.empty]
        if not needed:
            RUN[name](shop).limit(3).collect()
    assert len(RUN) > 55


def test_batch_projection_and_sinks(shop):
    out = RUN["batch"](shop, [("layer", {"name": "web"}), ("drift", {})])
    assert {r.command for r in out.collect()} == {"layer", "drift"}
    assert commands.project(RUN["layer"](shop, "web"), "fqn,nothing").columns == ["fqn"]
    assert "| fqn |" in sinks.markdown_table(commands.project(RUN["layer"](shop, "web"), "fqn"))
    diagram = sinks.mermaid_sequence(RUN["call-chain"](shop, "OrderService.find")).first().diagram
    assert diagram.startswith("sequenceDiagram\n  Order")


def test_specification(shop, spark):
    wanted = spec.read_spec(spark, "# OrderService\n### Order find(String id)\n- throws: IOException\n- annotations: @Override\n### void gone()\n")
    kinds = rows(RUN["verify"](shop, "OrderService", wanted), "kind", "method")
    assert ("missing_method", "gone") in kinds and ("missing_throws", "find") in kinds and ("missing_annotation", "find") in kinds and ("undocumented_method", "place") in kinds


def test_store_and_stream_refresh(spark, tmp_path):
    tree, facts = tmp_path / "tree", str(tmp_path / "facts")
    tree.mkdir()
    (tree / "A.java").write_text("class A { void f() { g(); } void g() {} }")
    (tree / "B.java").write_text("class B {}")
    status = lambda: dict(rows(store.refresh(spark, source.scan_files(spark, [str(tree)]), facts), "status", "n"))
    assert status() == {"parsed": 2}
    (tree / "A.java").write_text("class A { void f() {} }")
    (tree / "B.java").unlink()
    (tree / "C.java").write_text("class C {}")
    assert status() == {"parsed": 2, "deleted": 1}
    assert status() == {"reused": 2}
    streamed = str(tmp_path / "streamed")
    for _ in range(2):
        refresh.refresh_stream(refresh.file_stream(spark, str(tree)), streamed, str(tmp_path / "progress")).awaitTermination()
    (tree / "D.java").write_text("class D {}")
    refresh.refresh_stream(refresh.file_stream(spark, str(tree)), streamed, str(tmp_path / "progress")).awaitTermination()
    assert sorted(t.name for t in source.Code(refresh.latest(store.load(spark, streamed))).types.collect()) == ["A", "C", "D"]


def test_serving(shop):
    from tessera.plans import serve

    said = []
    lines = ['{"command": "implements", "arg": "Handler"}', "not json", '{"command": "implments"}', '{"command": "layer", "args": {"name": "we\\u0001b"}}', '{"command": "callers"}', "", "quit", '{"command": "overview"}']
    assert serve.serve(shop, lines, lambda line: said.append(__import__("json").loads(line))) == 5
    assert [r["name"] for r in said[0]["rows"]] == ["OrderService"] and said[0]["elapsed_ms"] >= 0
    assert "error" in said[1] and "implements" in said[2]["error"] and said[3]["error"] == "control characters" and "ref" in said[4]["error"]
    assert serve.closest_class(shop, "OrderServce").first().name == "OrderService"
    assert serve.resolve_class(shop, "OrderService").first().status == "found" and serve.resolve_class(shop, "Nope").first().status == "missing"
    assert serve.check_input("../etc") and serve.check_input("A.b(String)") is None


def test_watch_sees_new_files(spark, tmp_path):
    import json

    from tessera.plans import serve

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "A.java").write_text("class A implements I {}")

    def requests():
        yield '{"command": "implements", "arg": "I"}'
        (tree / "B.java").write_text("class B implements I {}")
        yield '{"command": "implements", "arg": "I"}'
        yield "quit"

    said = []
    assert serve.watch(spark, [str(tree)], str(tmp_path / "facts"), requests(), lambda line: said.append(json.loads(line))) == 2
    assert [sorted(r["name"] for r in x["rows"]) for x in said] == [["A"], ["A", "B"]]
    assert serve.hints("summary", "A") == ["read A", "callers A", "related A"] and serve.hints("nothing") == []


def test_find_by_words(shop):
    from tessera.operators import packs, text

    got = text.concepts_of("Handling of the database errors, in Shop!", packs.SYNONYMS)
    assert got["handling"][0] == "handling" or got["handling"] == list(packs.SYNONYMS["handle"])
    assert got["errors"] == list(packs.SYNONYMS["error"]) and got["database"][0] == "database" and got["shop"] == ["shop"] and "the" not in got
    first = RUN["find"](shop, "web order").first()
    assert first.fqn == "com.acme.web.OrderController" and first.concepts == ["web", "order"] and first.score == 10
    assert RUN["find"](shop, "the of").count() == 0


def test_method_search(shop):
    found = RUN["method"](shop, "OrderService.find(String)").collect()
    assert [(r.class_name, r.total, r.truncated) for r in found] == [("OrderService", 1, False)]
    assert RUN["method"](shop, "OrderService.find(int)").count() == 0 and RUN["method"](shop, "OrderService.find()").count() == 0
    every = RUN["method"](shop, "find", 1)
    assert every.count() == 1 and every.first().total >= 1


def test_trend_and_correlation(shop, spark):
    from tessera.sources.profile import RECORDING

    path = shop.code.types.where("name = 'OrderService'").first().path
    rows = RUN["smells-trend"](shop, spark.createDataFrame([(path,), (path,)], "path string")).collect()
    here = shop.code.types.sparkSession.createDataFrame(RUN["smells"](shop).where(f"path = '{path}'").collect()).count()
    assert sum(r.n_changed for r in rows) == here > 0 and {r.trend for r in rows} == {"needs-attention"}
    assert {r.trend for r in RUN["smells-trend"](shop, spark.createDataFrame([], "path string")).collect()} == {"clean"}
    frame = lambda c, m: {"type": "jdk.ExecutionSample", "values": {"stackTrace": {"frames": [{"method": {"type": {"name": c}, "name": m}}]}}}
    text = __import__("json").dumps({"recording": {"events": [frame("com/acme/shop/OrderService", "find")] * 3 + [frame("java/lang/Object", "wait")]}})
    from pyspark.sql import functions as F

    recording = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", RECORDING).alias("r")).select("r.*")
    got = RUN["correlate"](shop, recording).collect()
    assert [(r.method, r.samples, r.confirmed) for r in got] == [("com.acme.shop.OrderService.find", 3, True), ("java.lang.Object.wait", 1, False)]


def test_store_keeps_the_version_before(spark, tmp_path):
    tree, facts = tmp_path / "tree", tmp_path / "facts"
    tree.mkdir()
    for k in range(3):
        (tree / f"C{k}.java").write_text(f"class C{k} {{}}")
        before = store.load(spark, str(facts))
        store.refresh(spark, source.scan_files(spark, [str(tree)]), str(facts))
        assert before.count() == k and store.load(spark, str(facts)).count() == k + 1
    assert versions.numbers(spark, str(facts)) == [2, 3]
