"""The code engine end to end on a small inline source tree, with the expected rows."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import commands
from tessera.sources import code

CASES = {}


def query(expected):
    def register(fn):
        CASES[fn.__name__] = (fn, *expected)
        return fn

    return register


SOURCES = {
    "shop/Shop.java": """package shop;
import java.util.Vector;
@RestController
@RequestMapping("/shop")
public class Shop implements Seller {
    private Stock stock;
    static Vector<String> names = new Vector<>();
    @GetMapping("/{id}")
    public Item get(String id) {
        return stock.find(id);
    }
    public void sell(String id, int spare) {
        for (int i = 0; i < 7; i++) {
            String sql = "SELECT * FROM item WHERE id = " + i;
        }
        try { stock.take(get(id)); } catch (Exception e) { }
    }
}
""",
    "shop/Stock.java": """package shop;
public class Stock {
    Item find(String id) { return null; }
    void take(Item item) { item.owner().bill(); }
    void idle() { }
}
interface Seller { void sell(String id, int spare); }
record Item(String name, Customer owner) { public Customer owner() { return owner; } }
class Customer extends Person { void bill() { // TODO send it
    }
}
abstract class Person { }
""",
}


def _base(spark: SparkSession) -> commands.CodeBase:
    files = spark.createDataFrame([(p, None, 0, s) for p, s in SOURCES.items()], "path string, content_hash string, mtime_ms long, content string")
    return commands.CodeBase(code.Code(code.extract(files)))


def _values(columns: str, *rows: tuple) -> tuple:
    return columns.split(", "), rows


@query(_values("fqn, kind, super_class, n_methods, loc", ("shop.Shop", "class", "", 2, 16), ("shop.Stock", "class", "", 3, 5), ("shop.Seller", "interface", "", 1, 1), ("shop.Item", "record", "", 1, 1), ("shop.Customer", "class", "Person", 1, 3), ("shop.Person", "class", "", 0, 1)))
def source_facts(spark: SparkSession) -> DataFrame:
    return _base(spark).code.types.select("fqn", "kind", "super_class", "n_methods", "loc")


@query(_values("src, dst", ("Shop.get/1", "Stock.find/1"), ("Shop.sell/2", "Shop.get/1"), ("Shop.sell/2", "Stock.take/1"), ("Shop.<init>/0", "Vector.Vector/-1"), ("Stock.take/1", "Item.owner/0"), ("Stock.take/1", "Customer.bill/0")))
def source_calls(spark: SparkSession) -> DataFrame:
    return _base(spark).graph.select("src", "dst").distinct()


@query(_values("chain, depth", ("Shop.sell -> Shop.get -> Stock.find", 2)))
def source_call_chain(spark: SparkSession) -> DataFrame:
    return commands.call_chain(_base(spark), "Stock.find")


@query(_values("class_name, depth, risk", ("Stock", 1, "low"), ("Shop", 2, "low")))
def source_impact(spark: SparkSession) -> DataFrame:
    return commands.impact(_base(spark), "Customer.bill").select("class_name", "depth", "risk")


@query(_values("rule_id, line", ("MAGIC_NUMBER", 13), ("EMPTY_CATCH_BLOCK", 16), ("CATCH_GENERIC_EXCEPTION", 16), ("UNUSED_PARAMETER", 12), ("UNUSED_PARAMETER", 3)))
def source_smells(spark: SparkSession) -> DataFrame:
    return commands.smells(_base(spark)).select("rule_id", "line")


@query(_values("rule_id, line_no, scope", ("SELECT_STAR", 14, "loop"), ("SQL_CONCAT", 14, "loop"), ("SQL_CONCAT", 14, "class"), ("VECTOR_HASHTABLE", 7, "class")))
def source_performance(spark: SparkSession) -> DataFrame:
    return commands.perf(_base(spark)).select("rule_id", "line_no", "scope")


@query(_values("rule_id, line_no, class_name", ("SQL_INJECTION", 14, "Shop")))
def source_security(spark: SparkSession) -> DataFrame:
    return commands.security(_base(spark)).select("rule_id", "line_no", "class_name")


@query(_values("rule_id, line_no", ("VECTOR_USAGE", 7)))
def source_migration(spark: SparkSession) -> DataFrame:
    return commands.migrate(_base(spark), 8).where("category = 'api'").select("rule_id", "line_no")


@query(_values("kind, name", ("method", "Stock.idle"), ("method", "Shop.sell"), ("method", "Seller.sell"), ("class", "Shop"), ("class", "Item"), ("class", "Seller"), ("class", "Person")))
def source_unused(spark: SparkSession) -> DataFrame:
    return commands.unused(_base(spark)).select("kind", "name")


@query(_values("verb, path, class_name, method", ("GET", "/shop/{id}", "Shop", "get")))
def source_endpoints(spark: SparkSession) -> DataFrame:
    return commands.endpoints(_base(spark))


@query(_values("mark, method, line_no", ("TODO", "bill", 9)))
def source_todo(spark: SparkSession) -> DataFrame:
    return commands.todo(_base(spark)).select("mark", "method", "line_no")


@query(_values("relation, name", ("interface", "Seller")))
def source_hierarchy(spark: SparkSession) -> DataFrame:
    return commands.hierarchy(_base(spark), "Shop")


@query(_values("line_no, class_name, method, in_comment", (9, "Customer", "bill", False)))
def source_search(spark: SparkSession) -> DataFrame:
    return commands.search(_base(spark), "TODO|FIXME").select("line_no", "class_name", "method", "in_comment")


@query(_values("name, score", ("Stock", 8), ("Seller", 1), ("Item", 1), ("Customer", 1), ("Person", 1)))
def source_related(spark: SparkSession) -> DataFrame:
    return commands.related(_base(spark), "Shop").where("name <> 'Vector'").select("name", F.col("score").cast("int").alias("score"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_rows(spark, name):
    fn, columns, rows = CASES[name]
    assert sorted((tuple(r[c] for c in columns) for r in fn(spark).collect()), key=str) == sorted(rows, key=str)
