"""Rule packs, layers and profiles on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import profile, rank, rules
from ..session import table
from .bindings import L, lines
from .registry import query

#: A small pack for document lines, in the form of the engine's own packs.
PACK = [
    rules.Rule("documents", "SECRET", "CRITICAL", any_of=('token = "',), message="A secret in plain text"),
    rules.Rule("documents", "LICENCE", "INFO", any_of=("License", "CC BY"), message="A licence line"),
    rules.Rule("documents", "EMAIL", "WARNING", regex=r".*[a-z]+@[a-z]+\.[a-z]+.*", message="An address"),
    rules.Rule("documents", "DIGITS", "WARNING", regex=r".*[0-9]{12,}.*", none_of=("token",), message="A long run of digits"),
]
SCAN = f"""{L}, hits AS (
  SELECT doc_id, line_no, 'SECRET' AS rule_id, 'CRITICAL' AS severity FROM l WHERE contains(text, 'token = "')
  UNION ALL SELECT doc_id, line_no, 'LICENCE', 'INFO' FROM l WHERE contains(text, 'License') OR contains(text, 'CC BY')
  UNION ALL SELECT doc_id, line_no, 'EMAIL', 'WARNING' FROM l WHERE regexp_matches(text, '[a-z]+@[a-z]+\\.[a-z]+')
  UNION ALL SELECT doc_id, line_no, 'DIGITS', 'WARNING' FROM l WHERE regexp_matches(text, '[0-9]{{12,}}') AND NOT contains(text, 'token'))"""


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(lines(spark, sf_dir), PACK, skip_comments=False)


@query(f"WITH {SCAN} SELECT doc_id, line_no, rule_id, severity FROM hits")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a pack on every line in one pass."""
    return _scan(spark, sf_dir).select("doc_id", "line_no", "rule_id", "severity")


@query(f"WITH {SCAN} SELECT severity, rule_id, count(*) AS n, count(DISTINCT doc_id) AS documents FROM hits GROUP BY ALL")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity and rule."""
    return _scan(spark, sf_dir).groupBy("severity", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(f"WITH {SCAN} SELECT doc_id, line_no, rule_id, severity FROM hits WHERE severity <> 'INFO' ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, rule_id, doc_id, line_no LIMIT 20")
def rule_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty worst findings."""
    found = _scan(spark, sf_dir).where("severity <> 'INFO'").select("doc_id", "line_no", "rule_id", "severity")
    return rank.top(found, 20, rules.severity_order("severity"), F.asc("rule_id"), F.asc("doc_id"), F.asc("line_no"))


LAYERS = [("core", "ECON*"), ("edge", "SM*"), ("promo", "*MO")]


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECON%' THEN 'core' WHEN p_type LIKE 'SM%' THEN 'edge' WHEN p_type LIKE '%MO' THEN 'promo' ELSE 'none' END AS layer FROM part")
def layer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first layer whose name pattern matches."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_layer(F.col("p_type"), LAYERS).alias("layer"))


@query("""SELECT p_partkey, d AS denied FROM part, (VALUES ('bolt'), ('gear')) AS t(d) WHERE contains(p_name, d) AND p_type LIKE 'ECON%'""")
def check_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a layer that hold a denied name; the rule's names are a constant array, not a join."""
    core = table(spark, sf_dir, "part").where(rules.first_layer(F.col("p_type"), LAYERS) == "core")
    return core.select("p_partkey", F.explode(rules.denied(F.col("p_name"), ["bolt", "gear"])).alias("denied"))


@query("""WITH e AS (SELECT event_type, count(*) AS samples FROM events GROUP BY event_type), t AS (SELECT count(*) AS n FROM events)
SELECT event_type AS method, samples, floor(1000.0 * samples / n + 0.5) / 10 AS pct FROM e, t ORDER BY samples DESC, method LIMIT 20""")
def profile_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each kind and their percent to one decimal."""
    return profile.hot(table(spark, sf_dir, "events").select(F.col("event_type").alias("method")), 20)


@query("SELECT user_id, count(*) AS pauses, sum((value * 1000000)::BIGINT // 1000)::BIGINT AS total_ms, max((value * 1000000)::BIGINT // 1000)::BIGINT AS max_ms, (sum((value * 1000000)::BIGINT // 1000) // count(*))::BIGINT AS avg_ms FROM events WHERE event_type = 'error' AND value >= 0 GROUP BY user_id")
def profile_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses: count, total, longest and whole mean."""
    paused = table(spark, sf_dir, "events").where("event_type = 'error' AND value >= 0").select("user_id", F.floor(F.round(F.col("value") * 1_000_000) / 1000).cast("long").alias("ms"))
    return profile.pauses(paused, ["user_id"])


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY event_type")
def profile_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind."""
    return table(spark, sf_dir, "events").where("value > 20").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT b.user_id AS class_name, b.n - coalesce(a.n, 0) AS growth FROM b LEFT JOIN a USING (user_id) WHERE b.n - coalesce(a.n, 0) >= 2""")
def heap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of counts: what grew by at least two."""
    events = table(spark, sf_dir, "events").withColumn("class_name", F.col("user_id"))
    count = lambda odd: events.where(F.col("event_id") % 2 == odd).groupBy("class_name").agg(F.count("*").alias("instances"), F.lit(0).alias("bytes"))
    return profile.heap_growth(count(0), count(1), least=2).select("class_name", "growth")


@query("SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: w[1:1]) AS parts, p_name AS simple FROM part")
def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar name functions."""
    parts = table(spark, sf_dir, "part")
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    return parts.select("p_partkey", F.split(scalars.abbreviate_package(dotted), r"\.").alias("parts"), F.concat(scalars.package_of(dotted), F.lit(" "), scalars.simple_name(dotted)).alias("simple"))
