"""Source trees as fact tables.

Files are read whole, hashed and parsed in one pass; a file's facts are one nested row, from which
the flat tables are views. A file that cannot be parsed is a row with an error, not a failed task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.java import parse
from ..functions.scalars import erase, glob_pattern, simple_name
from ..operators.text import lines_of

ANNOTATION = "struct<name:string,attrs:map<string,string>>"
PARAM = "struct<type:string,name:string>"
METHOD = f"struct<name:string,signature:string,return_type:string,start_line:int,end_line:int,modifiers:array<string>,params:array<{PARAM}>,throws:array<string>,type_params:array<string>,annotations:array<{ANNOTATION}>,is_constructor:boolean,has_body:boolean,javadoc:string,max_nesting:int,used_names:array<string>>"
FIELD = "struct<name:string,type:string,modifiers:array<string>,line:int>"
TYPE = f"struct<name:string,kind:string,start_line:int,end_line:int,modifiers:array<string>,annotations:array<{ANNOTATION}>,super_class:string,interfaces:array<string>,fields:array<{FIELD}>,methods:array<{METHOD}>,outer:string>"
EDGE = "struct<caller_class:string,caller_method:string,caller_arity:int,callee_class:string,callee_method:string,line:int,arg_count:int>"
STATEMENT = "struct<class_name:string,method:string,kind:string,line:int,detail:string>"
INVOCATION = "struct<class_name:string,method:string,callee:string,line:int,literals:array<string>>"
FACTS = f"path string, content_hash string, mtime_ms long, content string, package string, imports array<string>, types array<{TYPE}>, edges array<{EDGE}>, statements array<{STATEMENT}>, invocations array<{INVOCATION}>, comment_lines array<int>, loop_lines array<int>, error string"
TEST_PATHS = ("/test/", "/testFixtures/")


def _found(spark: SparkSession, paths: list[str], suffix: str = ".java", excludes: list[str] | None = None, no_test: bool = False) -> DataFrame | None:
    """The binary files under paths, with `uri` and `path`; None where none of the paths exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [r for r in paths if (p := jvm.org.apache.hadoop.fs.Path(r)).getFileSystem(conf).exists(p)]
    if not paths:
        return None
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(paths)
    found = found.withColumn("uri", F.col("path")).withColumn("path", F.regexp_replace("path", "^file:", ""))
    for glob in excludes or []:
        found = found.where(~F.col("path").rlike(glob_pattern(f"**{glob}**")))
    for part in TEST_PATHS if no_test else ():
        found = found.where(~F.contains("path", F.lit(part)))
    return found


FILES = "path string, content_hash string, mtime_ms long, content string"


def _contents(found: DataFrame) -> DataFrame:
    return found.select("path", F.sha2("content", 256).alias("content_hash"), F.unix_millis("modificationTime").alias("mtime_ms"), F.decode("content", "UTF-8").alias("content"), "length")


def scan_files(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """path, content_hash, mtime_ms and content of the files under the roots. A missing root has no files.
    Options: suffix, excludes (globs), no_test."""
    found = _found(spark, roots, **options)
    return spark.createDataFrame([], FILES) if found is None else _contents(found).drop("length")


def listing(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """path, mtime_ms, length and uri of the files under the roots; no content is read."""
    found = _found(spark, roots, **options)
    if found is None:
        return spark.createDataFrame([], "path string, mtime_ms long, length long, uri string")
    return found.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), "length", "uri")


FEW_FILES = 10_000  # files up to which they are opened by name


def read_files(spark: SparkSession, roots: list[str], wanted: DataFrame, **options) -> DataFrame:
    """scan_files() with length, of the wanted files alone (path, uri)."""
    uris = [r["uri"] for r in wanted.select("uri").limit(FEW_FILES + 1).collect()]
    if not uris:
        return spark.createDataFrame([], f"{FILES}, length long")
    if len(uris) > FEW_FILES:
        return _contents(_found(spark, roots, **options).join(wanted.select("path"), "path", "left_semi"))
    literal = lambda uri: "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in uri)
    found = spark.read.format("binaryFile").load([literal(u) for u in uris])
    return _contents(found.withColumn("path", F.regexp_replace("path", "^file:", "")))


def extract(files: DataFrame) -> DataFrame:
    """The facts of each file (schema FACTS). Null and empty contents have no types."""
    spark = files.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], FACTS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = {"package": "", "imports": [], "types": [], "edges": [], "statements": [], "invocations": [], "comment_lines": [], "loop_lines": [], "error": None}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for row in batch.slice(at, 64).to_pylist():
                    content = row["content"] or ""
                    hashed = row["content_hash"] or hashlib.sha256(content.encode()).hexdigest()
                    try:
                        facts = parse(content)
                        for t in facts["types"]:
                            for owner in (t, *t["methods"]):
                                owner["annotations"] = [{"name": a["name"], "attrs": [*a["attrs"].items()]} for a in owner["annotations"]]
                    except Exception as problem:  # one odd file must not fail a task; it is reported as a row
                        facts = {"error": f"{type(problem).__name__}: {problem}"}
                    rows.append(empty | {"path": row["path"], "content_hash": hashed, "mtime_ms": row["mtime_ms"], "content": content} | facts)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content_hash", "mtime_ms", "content").mapInArrow(run, FACTS)


class Code:
    """The flat tables of a facts table. All are lazy views; cache `facts` when asking much.

    With the files that the facts follow from, `texts` (lines without what parsing tells) reads those."""

    def __init__(self, facts: DataFrame, files: DataFrame | None = None):
        self.facts = facts
        self.files = files
        self.sources = (facts if files is None else files).select("path", F.coalesce("content", F.lit("")).alias("content"))
        self.spark = facts.sparkSession
        typed = facts.select("path", "package", "imports", F.explode("types").alias("t"))
        fqn = F.when(F.col("package") == "", F.col("t.name")).otherwise(F.concat("package", F.lit("."), "t.name"))
        loc = lambda x: (F.col(f"{x}.end_line") - F.col(f"{x}.start_line") + 1).alias("loc")
        wide = typed.select("path", "package", "imports", "t", fqn.alias("fqn"))
        is_test = F.col("t.name").rlike("(Test|Tests|IT)$") | F.exists("t.methods", lambda m: F.exists(m["annotations"], lambda a: a["name"] == "Test"))
        self.types = wide.select(
            "path", "package", "fqn", F.col("t.name").alias("name"), F.col("t.kind").alias("kind"), F.col("t.start_line").alias("start_line"), F.col("t.end_line").alias("end_line"), loc("t"),
            (F.col("t.kind") == "interface").alias("is_interface"), F.array_contains("t.modifiers", "abstract").alias("is_abstract"), F.col("t.modifiers").alias("modifiers"),
            F.col("t.super_class").alias("super_class"), F.col("t.interfaces").alias("interfaces"), F.col("t.annotations").alias("annotations"), "imports",
            F.size("t.methods").alias("n_methods"), F.size("t.fields").alias("n_fields"), F.col("t.outer").alias("outer"), is_test.alias("is_test"),
        )
        m = wide.select("path", "package", "fqn", F.col("t.name").alias("class_name"), F.col("t.kind").alias("class_kind"), F.explode("t.methods").alias("m"))
        self.methods = m.select("path", "package", "fqn", "class_name", "class_kind", "m.*", loc("m"), F.size("m.params").alias("param_count"), F.greatest(F.lit(1), F.floor((F.col("m.end_line") - F.col("m.start_line") + 1) / 5)).cast("int").alias("complexity"))
        self.fields = wide.select("path", "package", "fqn", F.col("t.name").alias("class_name"), F.explode("t.fields").alias("f")).select("path", "package", "fqn", "class_name", "f.*")
        self.imports = wide.select("path", "fqn", F.col("t.name").alias("class_name"), F.explode("imports").alias("import")).select("*", F.substring_index("import", ".", -1).alias("simple"), F.endswith("import", F.lit(".*")).alias("is_wildcard"))
        on_types = self.types.select(F.lit("class").alias("owner_kind"), F.col("name").alias("owner"), F.col("name").alias("class_name"), "path", F.col("start_line").alias("line"), F.explode("annotations").alias("a"))
        on_methods = self.methods.select(F.lit("method").alias("owner_kind"), F.col("name").alias("owner"), "class_name", "path", F.col("start_line").alias("line"), F.explode("annotations").alias("a"))
        self.annotations = on_types.unionAll(on_methods).select("owner_kind", "owner", "class_name", "path", "line", F.col("a.name").alias("name"), F.col("a.attrs").alias("attrs"))
        self.raw_edges = facts.select("path", F.explode("edges").alias("e")).select("path", "e.*")
        self.statements = facts.select("path", F.explode("statements").alias("s")).select("path", "s.*")
        self.invocations = facts.select("path", F.explode("invocations").alias("v")).select("path", "v.*")
        self.lines = self._noted(facts)
        self.texts = lines_of(self.sources).select("path", "line_no", "text")
        self.errors = facts.where("error IS NOT NULL").select("path", "error")

    def lines_of_files(self, words: tuple[str, ...]) -> DataFrame:
        """The lines of the files that hold any of the words, whole files of them."""
        holds = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("content", w))
        return self._noted(self.facts.where(holds))

    def lines_told(self, told: Column) -> DataFrame:
        """The lines that some facts of their file stand for: a row for each struct of the array `told` with a line in
        line_no, its other fields beside the columns of `lines`. No join: text and facts stand in one row."""
        facts = self.facts.withColumn("__told", told).where(F.size("__told") > 0)
        met = self._noted(facts, "__told").withColumn("__told", F.explode(F.filter("__told", lambda x: x["line_no"] == F.col("line_no"))))
        others = [f.name for f in met.schema["__told"].dataType if f.name != "line_no"]
        return met.select(*self.lines.columns, *(f"__told.{c}" for c in others))

    def narrowed(self, holds: Column) -> Code:
        """The same of the files whose content passes a test."""
        if self.files is None:
            return Code(self.facts.where(holds))
        files = self.files.where(holds)
        return Code(extract(files), files)

    @staticmethod
    def _noted(facts: DataFrame, *also: str) -> DataFrame:
        noted = lambda c: F.array_contains(c, F.col("line_no"))
        return lines_of(facts, also=("comment_lines", "loop_lines", *also)).select("path", "line_no", "text", noted("comment_lines").alias("in_comment"), noted("loop_lines").alias("in_loop"), *also)

    def types_of(self, simple: str) -> DataFrame:
        return self.types.where(F.col("name") == simple)

    def methods_of(self, simple: str) -> DataFrame:
        return self.methods.where(F.col("class_name") == simple)

    def fields_of(self, simple: str) -> DataFrame:
        return self.fields.where(F.col("class_name") == simple)

    def children_of(self, simple: str) -> DataFrame:
        """relation (subclass or implementor), name and path of the types that extend or implement one, type arguments erased."""
        is_it = lambda c: simple_name(erase(c)) == simple
        down = self.types.where(is_it("super_class")).select(F.lit("subclass").alias("relation"), "name", "path")
        return down.unionAll(self.types.select("name", "path", F.explode("interfaces").alias("i")).where(is_it("i")).select(F.lit("implementor"), "name", "path"))

    def by_name(self, name: str) -> DataFrame:
        """Types of a simple or qualified name."""
        found = self.types_of(name.rpartition(".")[2])
        return found.where(F.col("fqn") == name) if "." in name else found


def read(spark: SparkSession, roots: list[str], **options) -> Code:
    return Code(extract(scan_files(spark, roots, **options)))
