"""Stored code bases: facts, flat tables clustered by name, and resolved call edges that are kept up to date.

A store is a log of versions over segments (versions). Each refresh adds one segment with the facts of new and changed
files and tombs for what it replaces; a segment's flat tables are clustered by the name that look-ups use (clustered),
so a question about a class opens the files that may hold it.

Edges are a maintained view. Every edge is stored with the names it was resolved through, and `uses` lists the places
(calls of one line) by such a name. A refresh finds the names whose meaning differs between the old and the new facts of
the touched files, looks up the places that used one, and resolves those and the calls of the touched files anew,
against the members and methods of the names that occur in them. All other edges stay as they are written.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import erase, simple_name
from ..operators import calls
from . import clustered, versions
from .code import FACTS, Code, extract, listing, read_files
from .versions import Conflict, exists

MOST_SEGMENTS = 8  # a version with more is folded into one segment
TASK_FILES = 1_000  # that one task parses, about
ATTEMPTS = 5  # at a version, where other writers come first
SEEN = "path string, content_hash string, mtime_ms long, length long"
TOUCHED = "path string"


def parents(code: Code) -> DataFrame:
    """parent (simple name), relation (subclass or implementor), name and path of each type."""
    up = code.types.where("super_class <> ''").select(simple_name(erase("super_class")).alias("parent"), F.lit("subclass").alias("relation"), "name", "path")
    faces = code.types.select(F.explode("interfaces").alias("i"), "name", "path").select(simple_name(erase("i")), F.lit("implementor"), "name", "path")
    return up.unionAll(faces)


def with_place(edges: DataFrame) -> DataFrame:
    return edges.withColumn("place", F.xxhash64(*calls.PLACE))


#: The flat tables of a segment: the column that they are clustered by, and how they follow from facts.
TABLES = {
    "types": ("name", lambda code: code.types),
    "methods": ("class_name", lambda code: code.methods),
    "fields": ("class_name", lambda code: code.fields),
    "imports": ("class_name", lambda code: code.imports),
    "parents": ("parent", parents),
    "members": ("member", lambda code: calls.members_by_path(code)),
    "declared": ("name", lambda code: code.methods.select("class_name", "name", "param_count", "path").distinct()),
}
#: Tables of edges. Tombs of a place kill rows of the last two only.
EDGE_TABLES = {
    "raw": ("path", "path string, caller_class string, caller_method string, caller_arity int, callee_class string, callee_method string, line int, arg_count int, at long"),
    "edges": ("callee_class", "caller_class string, caller_method string, caller_arity int, callee_class string, callee_method string, callee_arity int, line int, path string, place long"),
    "uses": ("key", "key string, path string, place long"),
}


class Store:
    """One version of a store, the newest by default. `opened` lists the files that look-ups have asked for."""

    def __init__(self, spark: SparkSession, path: str, number: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.number, self.parts = versions.segments(spark, self.path, number)
        self.opened: list[tuple[str, str, int]] = []

    @cached_property
    def dead(self) -> DataFrame | None:
        return versions.tombs(self.spark, self.path, self.parts)

    @cached_property
    def schemas(self) -> dict:
        none = Code(self.spark.createDataFrame([], FACTS))
        return {name: build(none).schema for name, (_, build) in TABLES.items()} | {name: schema for name, (_, schema) in EDGE_TABLES.items()} | {"facts": FACTS}

    def table(self, name: str, names: DataFrame | str | None = None) -> DataFrame:
        """The live rows of a table. With `names` (one, or a column `key` of some), at least those whose
        clustering column is among them; the caller filters."""
        narrow = isinstance(names, str) or (names is not None and names.limit(clustered.MANY_KEYS + 1).count() <= clustered.MANY_KEYS)
        out = None
        for i, segment in enumerate(self.parts):
            if name not in segment["tables"]:
                continue
            at, files = f"{self.path}/{segment['id']}/{name}", None
            if narrow:
                found = clustered.candidates(self.spark, at, names)
                self.opened += [(name, f, size) for f, size in found]
                files = [f for f, _ in found]
                if not files:
                    continue
            part = clustered.lookup(self.spark, at, self.schemas[name], files).withColumn("__segment", F.lit(i))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return versions.alive(out, self.dead)

    def seen(self) -> DataFrame:
        """path, content_hash, mtime_ms and length of each live file, as last looked at."""
        out = None
        for i, segment in enumerate(self.parts):
            if "seen" in segment["tables"]:
                part = self.spark.read.schema(SEEN).parquet(f"{self.path}/{segment['id']}/seen").withColumn("__segment", F.lit(i))
                out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], SEEN)
        live = versions.alive(out.withColumn("__at", F.col("__segment")), self.dead)
        return live.groupBy("path").agg(F.max_by(F.struct("content_hash", "mtime_ms", "length"), "__at").alias("s")).select("path", "s.*")

    def newest(self, name: str) -> DataFrame:
        """The rows of a table that the last refresh has written."""
        last = self.parts[-1]
        at = f"{self.path}/{last['id']}/{name}"
        return clustered.lookup(self.spark, at, self.schemas[name], None if name in last["tables"] else [])

    def bytes(self) -> int:
        """Bytes of all segments of the version."""
        total = 0
        for segment in self.parts:
            at, fs = versions._filesystem(self.spark, f"{self.path}/{segment['id']}")
            total += fs.getContentSummary(at).getLength()
        return total


class StoredCode(Code):
    """The tables of a stored version; look-ups by class go by the zone maps. `edges` are the stored ones."""

    def __init__(self, store: Store):
        super().__init__(store.table("facts"))
        self.store = store
        self.types, self.methods, self.fields, self.imports = (store.table(t) for t in ("types", "methods", "fields", "imports"))
        self.edges = store.table("edges").drop("place")

    def types_of(self, simple: str) -> DataFrame:
        return self.store.table("types", simple).where(F.col("name") == simple)

    def methods_of(self, simple: str) -> DataFrame:
        return self.store.table("methods", simple).where(F.col("class_name") == simple)

    def fields_of(self, simple: str) -> DataFrame:
        return self.store.table("fields", simple).where(F.col("class_name") == simple)

    def children_of(self, simple: str) -> DataFrame:
        return self.store.table("parents", simple).where(F.col("parent") == simple).drop("parent")

    def calls_to(self, simple: str) -> DataFrame:
        return self.store.table("edges", simple).where(F.col("callee_class") == simple).drop("place")


def open_code(spark: SparkSession, path: str) -> StoredCode:
    return StoredCode(Store(spark, path))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored facts; nothing is stored at a new path. A folder without versions is read as a table of facts."""
    store = Store(spark, path)
    return store.table("facts") if store.number or not exists(spark, path) else spark.read.schema(FACTS).parquet(path)


def _write_edges(store: Store, at: str, fresh: Code, touched: DataFrame, invokers: list[dict] | None) -> list[str]:
    """Write raw, edges and uses of the touched files and of the places that used a name that has changed, and the
    tombs of those places; returns the names of the tables. touched: path, of all replaced and deleted files."""
    spark = store.spark
    own = with_place(calls.raw_edges(fresh, invokers)).withColumnRenamed("place", "at")
    clustered.write(own.select([c.name for c in T._parse_datatype_string(EDGE_TABLES["raw"][1])]), "path", f"{at}/raw")
    raw = spark.read.schema(EDGE_TABLES["raw"][1]).parquet(f"{at}/raw")
    members, declared, tables = calls.members_by_path(fresh), fresh.methods.select("class_name", "name", "param_count", "path"), []
    if store.parts:
        paths = touched.select(F.col("path").alias("key"))
        before = Code(store.table("facts", paths).join(touched, "path", "left_semi"))
        changed = calls.changed_names(before, fresh)
        changed.write.parquet(f"{at}/_changed")
        changed = spark.read.schema("key string").parquet(f"{at}/_changed")
        again = store.table("uses", changed).join(changed, "key", "left_semi").join(touched, "path", "left_anti")
        again.select("path", "place").distinct().write.parquet(f"{at}/_again")
        again = spark.read.schema("path string, place long").parquet(f"{at}/_again")
        others = store.table("raw", again.select(F.col("path").alias("key"))).join(again.withColumnRenamed("place", "at"), ["path", "at"], "left_semi")
        raw = raw.unionByName(others)
        again.write.mode("append").parquet(f"{at}/tombs")
        tables.append("tombs")
        # What the calls can meet: methods of the names they call, members of the names on their way.
        called = raw.select(F.col("callee_method").alias("key")).distinct()
        way = raw.select(F.explode(F.regexp_extract_all("callee_class", F.lit(r"\?(?:field|ret):([^?]*)"), 1)).alias("name")).distinct()
        way = way.select(F.explode(F.array("name", F.concat("name", F.lit("()")))).alias("key")).unionAll(called.select(F.concat("key", F.lit("()"))))
        kept = lambda name, keys, column: store.table(name, keys).join(keys.withColumnRenamed("key", column), column, "left_semi").join(touched, "path", "left_anti")
        members = members.unionByName(kept("members", way.distinct(), "member"))
        declared = declared.unionByName(kept("declared", called, "name"))
    found = with_place(calls.resolve_raw(raw.drop("at"), members.drop("path"), declared.drop("path").distinct(), trace=True))
    found.write.parquet(f"{at}/_resolved")
    found = spark.read.schema(found.schema).parquet(f"{at}/_resolved")
    uses = found.select(F.explode("uses").alias("key"), "path", "place").distinct()
    clustered.write_all([(found.drop("uses"), "callee_class", f"{at}/edges"), (uses, "key", f"{at}/uses")])
    return [*tables, "raw", "edges", "uses"]


def apply(spark: SparkSession, files: DataFrame, path: str, listed: DataFrame | None = None, invokers: list[dict] | None = None) -> dict[str, int]:
    """Commit a version in which `files` (path, content_hash, mtime_ms, content) have their new state and files that are
    not in `listed` (path; None: nothing is deleted) are gone. Returns how many files were reused, parsed and deleted.

    Files with the hash that is stored are not parsed. Without any change no version is written, so a batch that is
    run again does nothing. Where another writer commits first, the work is done anew on its version."""
    for _ in range(ATTEMPTS):
        try:
            return _apply(spark, files, path, listed, invokers)
        except Conflict:
            continue
    raise Conflict(f"{path}: other writers came first {ATTEMPTS} times")


def _apply(spark: SparkSession, files: DataFrame, path: str, listed: DataFrame | None, invokers: list[dict] | None) -> dict[str, int]:
    store, segment = Store(spark, path), versions.new_segment()
    at = f"{store.path}/{segment}"
    length = F.col("length") if "length" in files.columns else F.octet_length("content").cast("long")
    files = files.withColumn("content_hash", F.coalesce("content_hash", F.sha2("content", 256), F.lit(""))).withColumn("length", F.coalesce(length, F.lit(0)))
    known = store.seen()
    asked = files.select("path", "content_hash", "mtime_ms", "length").dropDuplicates(["path"])
    met = asked.join(known.select("path", F.col("content_hash").alias("__hash"), F.col("mtime_ms").alias("__at"), F.col("length").alias("__length")), "path", "left")
    looked = met.where(~(F.col("__hash").eqNullSafe(F.col("content_hash")) & F.col("__at").eqNullSafe(F.col("mtime_ms")) & F.col("__length").eqNullSafe(F.col("length"))))
    looked.select("path", "content_hash", "mtime_ms", "length", F.col("__hash").alias("was")).write.parquet(f"{at}/seen")
    looked = spark.read.schema(f"{SEEN}, was string").parquet(f"{at}/seen")
    parsed = looked.where("NOT was <=> content_hash")
    gone = known.join(listed.select("path"), "path", "left_anti") if listed is not None else known.limit(0)
    gone.select("path").write.parquet(f"{at}/_gone")
    gone = spark.read.schema(TOUCHED).parquet(f"{at}/_gone")
    counts = looked.agg(F.count("*").alias("looked"), F.count_if(F.expr("NOT was <=> content_hash")).alias("parsed"), F.count_if(F.expr("was <> content_hash")).alias("replaced")).first()
    total, deleted = known.count(), gone.count()
    result = {"reused": total - counts["replaced"] - deleted, "parsed": counts["parsed"], "deleted": deleted}
    if not counts["looked"] and not deleted and store.number:
        versions.delete(spark, at)
        return result
    tables = ["seen"]
    if counts["parsed"] or deleted or not store.number:
        touched = parsed.where("was IS NOT NULL").select("path").unionAll(gone)
        if counts["replaced"] or deleted:
            touched.select("path", F.lit(None).cast("long").alias("place")).write.parquet(f"{at}/tombs")
            tables.append("tombs")
        open_files = files.join(parsed.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
        # A number is given, else adaptive execution makes a few tasks of the short texts, however long their parsing takes.
        open_files = open_files.repartition(-(-counts["parsed"] // TASK_FILES) or 1, "path").dropDuplicates(["path"])
        extract(open_files).write.parquet(f"{at}/_facts")
        clustered.write(spark.read.schema(FACTS).parquet(f"{at}/_facts"), "path", f"{at}/facts")
        fresh = Code(spark.read.schema(FACTS).parquet(f"{at}/facts"))
        tables += ["facts", *_write_flat(fresh, at)]
        tables += _write_edges(store, at, fresh, touched, invokers)
    for scratch in ("_gone", "_facts", "_changed", "_again", "_resolved"):
        versions.delete(spark, f"{at}/{scratch}")
    parts = [*store.parts, {"id": segment, "tables": sorted(set(tables))}]
    versions.commit(spark, store.path, store.number + 1, parts)
    if len(parts) > MOST_SEGMENTS:
        compact(spark, path)
    return result


def _write_flat(code: Code, at: str) -> list[str]:
    clustered.write_all([(build(code).where(F.col(column).isNotNull()), column, f"{at}/{name}") for name, (column, build) in TABLES.items()])
    return [*TABLES]


def compact(spark: SparkSession, path: str) -> None:
    """Fold all segments of the newest version into one. If another writer commits first, its version stays."""
    store, segment = Store(spark, path), versions.new_segment()
    at = f"{store.path}/{segment}"
    store.seen().write.parquet(f"{at}/seen")
    clustered.write_all([(store.table(name), column, f"{at}/{name}") for name, (column, _) in ({"facts": ("path", None)} | TABLES | EDGE_TABLES).items()])
    try:
        versions.commit(spark, store.path, store.number + 1, [{"id": segment, "tables": ["seen", "facts", *TABLES, *EDGE_TABLES]}])
    except Conflict:
        versions.delete(spark, at)


def _status(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "status string, n long")


def refresh(spark: SparkSession, files: DataFrame, path: str, invokers: list[dict] | None = None) -> DataFrame:
    """Bring a store up to a listing of all files with their contents: unchanged ones (by hash) are taken over, changed
    and new ones parsed, missing ones dropped. Returns status and n (reused, parsed, deleted)."""
    return _status(spark, apply(spark, files, path, files.select("path"), invokers))


def refresh_roots(spark: SparkSession, roots: list[str], path: str, invokers: list[dict] | None = None, **options) -> DataFrame:
    """refresh() from folders. Files are first compared by path, time and length; contents are read and hashed only
    of those that differ in one of them."""
    found = listing(spark, roots, **options)
    known = Store(spark, path).seen()
    differ = found.join(known, ["path", "mtime_ms", "length"], "left_anti").select("path", "uri")
    return _status(spark, apply(spark, read_files(spark, roots, differ, **options), path, found.select("path"), invokers))


def put(spark: SparkSession, facts: DataFrame, path: str, invokers: list[dict] | None = None) -> DataFrame:
    """Store given facts as the whole content of the next version."""
    return refresh(spark, facts.select("path", "content_hash", "mtime_ms", "content"), path, invokers)


def write_json(facts: DataFrame, path: str) -> None:
    """The facts as JSON lines, for other programs."""
    facts.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Facts written by write_json(); the schema is given, so nothing is inferred and unused columns are not parsed."""
    return spark.read.schema(FACTS).json(path)


def entries_with(facts: DataFrame, word: str) -> DataFrame:
    """path of files where a type, member, annotation, import or signature holds a word, in any case."""
    has = lambda c: F.contains(F.lower(c), F.lit(word.lower()))
    in_method = lambda m: has(m["name"]) | has(m["signature"]) | F.exists(m["annotations"], lambda a: has(a["name"]))
    in_type = lambda t: has(t["name"]) | F.exists(t["annotations"], lambda a: has(a["name"])) | F.exists(t["methods"], in_method) | F.exists(t["fields"], lambda f: has(f["name"]) | has(f["type"]))
    return facts.where(F.exists("imports", has) | F.exists("types", in_type)).select("path")
