"""Documents of all classes, and findings of all rules on a tree of parts: a class a part holds one line of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import commands
from ..sources import brackets
from .registry import query
from .tree_queries import WITH, base, tree

_DOCUMENTS = f"""{WITH}, ty AS (
  SELECT t.*, package || '.' || t.name AS fqn, CASE WHEN t.name LIKE 'Supplier%' THEN 'Base' ELSE '' END AS super_class, CASE WHEN t.name LIKE 'Nation%' AND NOT is_test THEN 'Region' || n_regionkey ELSE '' END AS face
  FROM t LEFT JOIN nation ON t.name = 'Nation' || n_nationkey
), imp AS (
  SELECT 'geo.Nation' || n_nationkey AS fqn, 'java.util.List' AS i FROM nation UNION ALL SELECT 'trade.p' || s_nationkey || '.Supplier' || s_suppkey, x.i FROM supplier, (VALUES ('trade.Base'), ('java.util.Vector')) AS x(i)
  UNION ALL SELECT 'trade.p' || s_nationkey || '.Supplier' || s_suppkey, 'geo.Nation' || s_nationkey FROM supplier
), calls AS (
  SELECT callee AS class_name, called AS name, 'called by' AS label, 2 AS sub, caller || '.' || method AS other FROM e UNION SELECT caller, method, 'calls', 3, callee || '.' || called FROM e
), shown AS (
  SELECT class_name, name, sub, '- ' || label || ': ' || string_agg(other, ', ' ORDER BY other) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY class_name, name, sub ORDER BY other) AS k FROM calls) GROUP BY class_name, name, sub, label
), lines AS (
  SELECT fqn, path, 0 AS section, 0 AS place, 0 AS sub, '# ' || name AS text FROM ty UNION ALL SELECT fqn, path, 1, 0, 0, '**Package:** `' || package || '`' FROM ty
  UNION ALL SELECT fqn, path, 2, 0, 0, '**Extends:** `' || super_class || '`' FROM ty WHERE super_class <> '' UNION ALL SELECT fqn, path, 3, 0, 0, '**Implements:** `' || face || '`' FROM ty WHERE face <> ''
  UNION ALL SELECT fqn, path, 4, 0, 0, '**Annotations:** ' || CASE WHEN name LIKE 'Supplier%' THEN 'RestController, RequestMapping' ELSE 'Service' END FROM ty WHERE name LIKE 'Supplier%' OR face <> ''
  UNION ALL SELECT fqn, path, 5, 0, 0, '## Methods' FROM ty UNION ALL SELECT fqn, path, 6, a, 0, '### ' || signature FROM own
  UNION ALL SELECT own.fqn, own.path, 6, own.a, 1, '- annotations: @' || notes.name FROM own JOIN notes ON notes.owner_kind = 'method' AND notes.class_name = own.class_name AND notes.owner = own.name
  UNION ALL SELECT fqn, path, 6, a, sub, text FROM own JOIN shown USING (class_name, name)
  UNION ALL SELECT DISTINCT imp.fqn, path, 7, 0, 0, '## Imports' FROM imp JOIN ty USING (fqn) UNION ALL SELECT imp.fqn, path, 8, 0, 0, '- ' || i FROM imp JOIN ty USING (fqn)
  UNION ALL SELECT DISTINCT fqn, smell.path, 9, 0, 0, '## Smells' FROM smell JOIN ty ON ty.path = smell.path AND ty.name = class_name
  UNION ALL SELECT fqn, smell.path, 10, line, 0, '- line ' || line || ': ' || rule_id || ' (' || severity || ')' FROM smell JOIN ty ON ty.path = smell.path AND ty.name = class_name
)
SELECT fqn, path, string_agg(text, chr(10) ORDER BY section, place, sub, text) AS markdown FROM lines GROUP BY fqn, path"""


@query(_DOCUMENTS)
def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document of every class: head, methods with callers and callees, imports, smells."""
    return commands.documents(base(spark, sf_dir))


@query(WITH + "SELECT path, a AS start_line, z AS end_line FROM own WHERE name IN ('visit') AND class_name NOT LIKE 'Region%'")
def tree_extract_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the methods of a name, by bracket matching in the text."""
    return brackets.extract_methods(tree(spark, sf_dir), "visit").select("path", "start_line", "end_line")


@query(WITH + "SELECT path, a AS start_line, z AS end_line FROM own WHERE name = 'get'")
def tree_extract_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a method with an annotation whose text holds brackets."""
    return brackets.extract_methods(tree(spark, sf_dir), "get").select("path", "start_line", "end_line")


_CORE = """x AS (SELECT callee AS name, count(*) AS callers FROM e WHERE caller <> callee AND callee IN (SELECT name FROM t) GROUP BY callee)"""


@query(f"""{WITH}, {_CORE}, s AS (SELECT count(*) AS files, count(*) FILTER (kind <> 'interface') AS classes, count(*) FILTER (kind = 'interface') AS interfaces, sum(n_methods)::BIGINT AS methods, count(DISTINCT package) AS packages FROM t)
SELECT 'size' AS kind, 'files' AS name, files AS n FROM s UNION ALL SELECT 'size', 'classes', classes FROM s UNION ALL SELECT 'size', 'interfaces', interfaces FROM s UNION ALL SELECT 'size', 'methods', methods FROM s UNION ALL SELECT 'size', 'packages', packages FROM s
UNION ALL (SELECT 'core', name, callers FROM x ORDER BY callers DESC, name LIMIT 10)
UNION ALL SELECT 'convention', 'injection: ' || CASE WHEN count(*) > 5 THEN 'constructor' ELSE 'unknown' END, NULL FROM supplier UNION ALL SELECT 'convention', 'logging: unknown', NULL UNION ALL SELECT 'stack', 'Spring', NULL""")
def tree_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, the classes called most, conventions and frameworks of the tree."""
    return commands.tour(base(spark, sf_dir))


@query(f"{WITH}, n AS (SELECT count(*) FILTER (is_test) AS a, count(*) FILTER (NOT is_test) AS b FROM t) SELECT a AS test_classes, b AS production_classes, a AS tested_by_name, (100 * a) // b AS percent FROM n")
def tree_test_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.test_coverage(base(spark, sf_dir))


@query(f"{WITH}, {_CORE} SELECT name, callers FROM x WHERE name NOT IN (SELECT replace(name, 'Test', '') FROM t WHERE is_test) ORDER BY callers DESC, name LIMIT 10")
def tree_untested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.untested(base(spark, sf_dir))


_CALLERS = """c AS (SELECT DISTINCT caller || ' (' || path || ':' || line || ')' AS at_, path FROM e WHERE callee = 'Nation{0}' AND called = '{1}' AND caller <> callee)"""


@query(f"""{WITH}, {_CALLERS.format(4, "visit")}, s AS (
  SELECT 0 AS o, 'edit' AS action, 'src/geo/Nation4.java' AS location, 'Change Nation4.visit: rename it' AS description UNION ALL SELECT 2, 'update-caller', at_, 'Call it by the new name' FROM c UNION ALL SELECT 4, 'test', 'tests', 'Run the tests'
) SELECT row_number() OVER (ORDER BY o, location) AS step, action, location, description FROM s""")
def tree_checklist_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps to rename a method: the edit, each caller, the tests."""
    return commands.checklist_steps(base(spark, sf_dir), "Nation4.visit", "rename it")


@query(f"""{WITH}, c AS (SELECT DISTINCT caller || ' (' || e.path || ':' || line || ')' AS at_, package FROM e JOIN t USING (path) WHERE called = 'label' AND caller <> callee AND callee LIKE 'Nation%'),
g AS (SELECT count(DISTINCT at_) AS n, count(DISTINCT package) AS p, string_agg(DISTINCT at_, ', ' ORDER BY at_) AS l FROM c), s AS (
  SELECT 0 AS o, 'edit' AS action, (SELECT min(path) FROM t WHERE name = (SELECT min(class_name) FROM own WHERE name = 'label')) AS location, 'Change label: add a null check' AS description
  UNION ALL SELECT 1, 'add-import', (SELECT min(path) FROM t WHERE name = (SELECT min(class_name) FROM own WHERE name = 'label')), 'Import java.util.Objects if it is missing'
  UNION ALL SELECT 3, 'check-callers', CASE WHEN n <= 10 THEN l ELSE n || ' callers' END, CASE WHEN n <= 10 THEN 'Look at ' || n || ' caller(s)' ELSE 'Look at callers in ' || p || ' package(s)' END FROM g
  UNION ALL SELECT 4, 'test', 'tests', 'Run the tests'
) SELECT row_number() OVER (ORDER BY o, location) AS step, action, location, description FROM s""")
def tree_checklist_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a change of a method with very many callers."""
    return commands.checklist_steps(base(spark, sf_dir), "label", "add a null check")
