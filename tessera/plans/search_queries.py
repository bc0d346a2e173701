"""Searches, lookups and incremental comparisons on the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import diff, grams, rank, text
from ..operators.cut import kept, shared_dir
from ..session import table
from ..sources import line_index
from .bindings import L, lines
from .registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table; counts come from file footers."""
    out = None
    for name in TABLES:
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT count(*) AS n, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(*) FILTER (p_size > 25) AS large FROM part")
def overview_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass with conditional and distinct counts."""
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') ORDER BY p_partkey LIMIT 50")
def classes_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a prefix, the first fifty."""
    return rank.top(table(spark, sf_dir, "part").where(F.startswith(F.col("p_name"), F.lit("red"))).select("p_partkey", "p_name"), 50, F.asc("p_partkey"))


@query(f"""WITH {L}, h AS (SELECT doc_id, line_no, least(nullif(strpos(text, 'License'), 0), nullif(strpos(text, 'token'), 0)) AS hit FROM l)
SELECT doc_id, line_no, hit FROM h WHERE hit IS NOT NULL""")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with either of two terms and the earliest place of one."""
    return text.search(lines(spark, sf_dir), "License|token").select("doc_id", "line_no", F.col("hit").cast("long").alias("hit"))


@query(f"""WITH {L}, h AS (SELECT doc_id, line_no FROM l WHERE contains(text, 'License')), s AS (SELECT DISTINCT doc_id, (line_no - 1) // 5 AS b FROM l)
SELECT h.doc_id, h.line_no, 'block' || s.b AS name FROM h LEFT JOIN s ON s.doc_id = h.doc_id AND h.line_no BETWEEN s.b * 5 + 1 AND s.b * 5 + 5""")
def search_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of five lines around each hit, by a range join on document and line."""
    all_lines = lines(spark, sf_dir)
    spans = all_lines.select("doc_id", F.floor((F.col("line_no") - 1) / 5).alias("b")).distinct()
    spans = spans.select("doc_id", (F.col("b") * 5 + 1).alias("start_line"), (F.col("b") * 5 + 5).alias("end_line"), F.concat(F.lit("block"), F.col("b")).alias("name"))
    hits = text.search(all_lines, "License").select("doc_id", "line_no")
    return text.enclose(hits, spans, "doc_id", "line_no", "name")


@query("""SELECT page_id, count(*) AS comments, sum(length(c))::BIGINT AS chars
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS c FROM pages) GROUP BY page_id""")
def comment_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of each page and their length."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(text.comments_in_markup("html")).alias("c"))
    return found.groupBy("page_id").agg(F.count("*").alias("comments"), F.sum(F.length("c")).alias("chars"))


FIND = (("red", "crimson"), ("bolt", "screw", "gear"), ("small", "tiny"))


@query("""WITH s AS (SELECT p_partkey, p_name,
  greatest(CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%crimson%' THEN 5 ELSE 0 END, CASE WHEN lower(p_type) LIKE '%red%' OR lower(p_type) LIKE '%crimson%' THEN 3 ELSE 0 END) AS a,
  greatest(CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%screw%' OR p_name LIKE '%gear%' THEN 5 ELSE 0 END, CASE WHEN lower(p_type) LIKE '%bolt%' OR lower(p_type) LIKE '%screw%' OR lower(p_type) LIKE '%gear%' THEN 3 ELSE 0 END) AS b,
  greatest(CASE WHEN p_name LIKE '%small%' OR p_name LIKE '%tiny%' THEN 5 ELSE 0 END, CASE WHEN lower(p_type) LIKE '%small%' OR lower(p_type) LIKE '%tiny%' THEN 3 ELSE 0 END) AS c FROM part)
SELECT p_partkey, p_name, (a + b + c)::BIGINT AS score FROM s WHERE (a > 0)::INT + (b > 0)::INT + (c > 0)::INT >= 2 ORDER BY score DESC, p_partkey LIMIT 15""")
def find_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by how many concepts (groups of synonyms) their name and type mention."""
    scored = text.concept_scores(table(spark, sf_dir, "part"), {"p_name": 5, "p_type": 3}, [list(c) for c in FIND])
    return rank.top(scored.select("p_partkey", "p_name", F.col("score").cast("long").alias("score")), 15, F.desc("score"), F.asc("p_partkey"))


@query("""SELECT p_partkey, sum(CASE WHEN contains(lower(p_name), k) THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_type), k) THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_brand), k) THEN 2 ELSE 0 END)::BIGINT AS score
FROM part, (VALUES ('small'), ('gear'), ('brand#1')) AS w(k) GROUP BY p_partkey HAVING score > 0 ORDER BY score DESC, p_partkey LIMIT 15""")
def scope_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by weighted keyword hits in three fields."""
    words = ["small", "gear", "brand#1"]
    hit = lambda c, w, n: F.when(F.contains(F.lower(c), F.lit(w)), n).otherwise(0)
    score = sum((hit(c, w, n) for w in words for c, n in (("p_name", 5), ("p_type", 3), ("p_brand", 2))), F.lit(0)).cast("long")
    return rank.top(table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score > 0"), 15, F.desc("score"), F.asc("p_partkey"))


@query("""WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), w AS (SELECT * FROM (VALUES ('bolts'), ('wiget'), ('rd'), ('gears')) AS t(wanted)),
s AS (SELECT wanted, name, greatest(CASE WHEN levenshtein(name, wanted) = 0 THEN 100 WHEN levenshtein(name, wanted) <= 3 THEN 80 - 10 * levenshtein(name, wanted) ELSE 0 END,
  CASE WHEN starts_with(name, wanted) OR starts_with(wanted, name) THEN 60 ELSE 0 END, CASE WHEN contains(name, wanted) OR contains(wanted, name) THEN 40 ELSE 0 END)::BIGINT AS score FROM n, w)
SELECT wanted, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY score DESC, name)::BIGINT AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def fuzzy_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best existing words for misspelt ones."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    asked = spark.createDataFrame([("bolts",), ("wiget",), ("rd",), ("gears",)], "wanted string")
    return text.suggest(names, asked).select("wanted", "name", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH old AS (SELECT s_suppkey AS key, sha256(s_nationkey::VARCHAR) AS h FROM supplier), new AS (SELECT c_custkey AS key, sha256(c_nationkey::VARCHAR) AS h FROM customer)
SELECT coalesce(old.key, new.key) AS key, CASE WHEN old.key IS NULL THEN 'added' WHEN new.key IS NULL THEN 'deleted' WHEN old.h <> new.h THEN 'modified' ELSE 'same' END AS status FROM old FULL JOIN new ON old.key = new.key""")
def diff_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole tables as snapshots of one: keys and nations of suppliers, then of customers, by content hash."""
    snapshot = lambda name, key, content: table(spark, sf_dir, name).select(F.col(key).alias("key"), F.sha2(F.col(content).cast("string"), 256).alias("content_hash"))
    return diff.compare(snapshot("supplier", "s_suppkey", "s_nationkey"), snapshot("customer", "c_custkey", "c_nationkey"), "key").select("key", "status")


@query("""WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS h FROM documents)
SELECT CASE WHEN EXISTS (SELECT 1 FROM old WHERE old.doc_id = new.doc_id AND old.h = new.h) THEN 'reused' ELSE 'parsed' END AS status, count(*) AS n FROM new GROUP BY 1""")
def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an incremental build takes over and how many it works on again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    new = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    reused, parsed = diff.split_reusable(old, new, "doc_id")
    return reused.agg(F.count("*").alias("n")).select(F.lit("reused").alias("status"), "n").unionAll(parsed.agg(F.count("*").alias("n")).select(F.lit("parsed").alias("status"), "n"))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM conversations""")
def last_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn above each turn."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(before).alias("above"))


@query(f"""WITH {L}, f AS (SELECT doc_id, line_no, contains(text, 'License') AS opens, contains(text, '.') AS closes FROM l),
w AS (SELECT *, coalesce(bool_or(closes) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS closed FROM f)
SELECT doc_id, line_no FROM w WHERE opens AND NOT closed""")
def lookahead_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a flag that no closing mark follows within three lines."""
    ahead = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, 3)
    flagged = lines(spark, sf_dir).select("doc_id", "line_no", F.contains("text", F.lit("License")).alias("opens"), F.contains("text", F.lit(".")).alias("closes"))
    return flagged.withColumn("closed", F.coalesce(F.bool_or("closes").over(ahead), F.lit(False))).where("opens AND NOT closed").select("doc_id", "line_no")


@query("SELECT a.label, b.label AS other, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1 GROUP BY ALL")
def annotation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurrence counts of neighbouring labels."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", "label"), e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("label").alias("other"))
    return a.join(b, "vec_id").groupBy("label", "other").agg(F.count("*").alias("n"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' ELSE 'PATCH' END AS verb,
  CASE WHEN regexp_extract(url, '^https?://[^/]+/?([^?]*)', 1) = '' THEN '/' ELSE '/' || regexp_extract(url, '^https?://[^/]+/?([^?]*)', 1) END AS path FROM pages""")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verb and combined path of each page address."""
    from ..functions.scalars import combine_path

    verb = F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE", "PATCH"))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", verb.alias("verb"), combine_path(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/?([^?]*)", 1)).alias("path"))


@query("""SELECT 'error' AS kind, count(*) AS n, list_sort(list(event_id ORDER BY event_id)[1:10]) AS sample FROM events WHERE event_type = 'error'
UNION ALL SELECT 'purchase', count(*), list_sort(list(event_id ORDER BY event_id)[1:10]) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'urgent', count(*), list_sort(list(o_orderkey ORDER BY o_orderkey)[1:10]) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of entries, each with its count and its first ten. The sample is a top-k, the count an aggregate."""
    events, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    kinds = [("error", events.where("event_type = 'error'").select(F.col("event_id").alias("id"))), ("purchase", events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"))), ("urgent", orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id")))]
    out = None
    for kind, ids in kinds:
        count = ids.agg(F.count("*").alias("n"))
        sample = ids.orderBy("id").limit(10).agg(F.array_sort(F.collect_list("id")).alias("sample"))
        one = count.crossJoin(sample).select(F.lit(kind).alias("kind"), "n", "sample")  # two single rows
        out = one if out is None else out.unionAll(one)
    return out


_INDEXED: dict[tuple[str, str], str] = {}  # by application and folder


def line_store(spark: SparkSession, sf_dir: str) -> str:
    """An index of all lines of documents in the shared folder, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED:
        path = f"{shared_dir(spark).rstrip('/')}/tessera-lines-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        line_index.build(lines(spark, sf_dir), path, "doc_id")
        _INDEXED[key] = path
    return _INDEXED[key]


@query(f"""WITH {L}, h AS (SELECT doc_id, line_no, least(nullif(strpos(text, 'MIT License'), 0), nullif(strpos(text, 'Apache License'), 0)) AS hit FROM l)
SELECT doc_id, line_no, hit FROM h WHERE hit IS NOT NULL""")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with either of two phrases, by postings of three-character runs and an exact test."""
    found = line_index.search(spark, line_store(spark, sf_dir), "MIT License|Apache License")
    return found.select(F.col("key").cast("long").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.col("hit").cast("long").alias("hit"))


@query(f"""WITH {L}, c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM l)
SELECT (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM l WHERE contains(text, 'Creative Commons')) AS hits, true AS few""")
def search_indexed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, those that hold a phrase, and whether the index had less than a quarter of them tested for it."""
    path = line_store(spark, sf_dir)
    total = spark.read.schema(line_index.LINES).parquet(f"{path}/lines").agg(F.count("*").alias("lines"))
    tested = line_index.candidates(spark, path, "Creative Commons")
    counted = tested.agg(F.count("*").alias("tested"), F.count_if(F.contains("text", F.lit("Creative Commons"))).alias("hits"))
    return total.crossJoin(counted).select("lines", "hits", (F.col("tested") < 0.25 * F.col("lines")).alias("few"))  # single rows


_WORDS = """n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS wanted FROM benchmark)"""


def _words(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias(column)).distinct()


@query(f"WITH {_WORDS} SELECT name, wanted, levenshtein(name, wanted)::INTEGER AS edits FROM n, w WHERE length(name) >= 9 AND length(wanted) >= 9 AND abs(length(name) - length(wanted)) <= 3 AND levenshtein(name, wanted) <= 3")
def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of nine letters or more of documents within three edits of such words of benchmark texts, by an equi-join of segments."""
    return grams.near(_words(spark, sf_dir, "documents", "name").where("length(name) >= 9"), _words(spark, sf_dir, "benchmark", "wanted").where("length(wanted) >= 9"))


@query(f"WITH {_WORDS} SELECT name, wanted FROM n, w WHERE length(wanted) >= 3 AND contains(name, wanted)")
def containing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that hold a word of benchmark texts, by the rarest run of three letters."""
    return grams.containing(_words(spark, sf_dir, "documents", "name"), _words(spark, sf_dir, "benchmark", "wanted").where("length(wanted) >= 3"))


@query(f"""WITH {_WORDS}, s AS (SELECT wanted, name, greatest(CASE WHEN levenshtein(name, wanted) = 0 THEN 100 WHEN levenshtein(name, wanted) <= 3 THEN 80 - 10 * levenshtein(name, wanted) ELSE 0 END,
  CASE WHEN starts_with(name, wanted) OR starts_with(wanted, name) THEN 60 ELSE 0 END, CASE WHEN contains(name, wanted) OR contains(wanted, name) THEN 40 ELSE 0 END)::BIGINT AS score FROM n, w)
SELECT wanted, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY score DESC, name)::BIGINT AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def suggest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five words of documents that come closest to each word of benchmark texts."""
    found = text.suggest(kept(_words(spark, sf_dir, "documents", "name"), "words"), kept(_words(spark, sf_dir, "benchmark", "wanted"), "words"))
    return found.select("wanted", "name", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))
