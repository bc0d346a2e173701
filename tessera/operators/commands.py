"""The command catalogue: structural questions about a code base, each a DataFrame.

COMMANDS maps a command's name to a function of a CodeBase and its arguments. Listings end with a
total order; limits are parameters whose defaults are those of the compact output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.code import Code
from . import calls, diff, graph, packs, rank, rules, text
from .cut import wide

COMMANDS: dict[str, Callable[..., DataFrame]] = {}


def command(name: str) -> Callable:
    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        COMMANDS[name] = fn
        return fn

    return register


class CodeBase:
    """Fact tables with the tables that are derived from them and the project's settings."""

    def __init__(self, code: Code, config: dict | None = None):
        self.code, self.config = code, config or {}
        self.spark = code.spark

    @cached_property
    def edges(self) -> DataFrame:
        """Resolved calls: the stored ones of a stored code base, else resolved once a session."""
        stored = getattr(self.code, "edges", None)
        return stored if stored is not None else calls.resolve(self.code, self.config.get("invokers")).cache()

    def calls_to(self, simple: str) -> DataFrame:
        stored = getattr(self.code, "calls_to", None)
        return stored(simple) if stored else self.edges.where(F.col("callee_class") == simple)

    @cached_property
    def graph(self) -> DataFrame:
        return calls.as_graph(self.edges)

    def targets(self, ref: str) -> DataFrame:
        """Methods meant by `[[pkg.]Class.]method[(T1, T2)]`: class_name, name, param_count, node."""
        cls, method, arity = parse_reference(ref)
        declared = self.code.methods.select("class_name", "name", "param_count")
        called = self.edges.select(F.col("callee_class").alias("class_name"), F.col("callee_method").alias("name"), F.col("callee_arity").alias("param_count"))
        found = declared.unionAll(called).where(F.col("name") == method).distinct()
        if cls:
            found = found.where(F.col("class_name") == cls)
        if arity is not None:
            found = found.where(F.col("param_count").isin(arity, -1))
        return found.withColumn("node", calls.node("class_name", "name", "param_count"))


def parse_reference(ref: str) -> tuple[str, str, int | None]:
    """Simple class (or nothing), method and number of parameters (None: any)."""
    head, paren, rest = ref.partition("(")
    arity = None
    if paren:
        inner, depth, parts = rest.rstrip(")"), 0, 0
        for c in inner:
            depth += (c == "<") - (c == ">")
            parts += c == "," and depth == 0
        arity = parts + 1 if inner.strip() else 0
    cls, _, method = head.strip().rpartition(".")
    return cls.rpartition(".")[2], method, arity


def _split_node(column: str = "node") -> tuple[Column, Column]:
    plain = F.substring_index(column, "/", 1)
    return F.substring_index(plain, ".", 1), F.substring_index(plain, ".", -1)


def _of_class(base: CodeBase, name: str) -> DataFrame:
    return base.code.by_name(name)


def _external(base: CodeBase, callee: str | None = None) -> DataFrame:
    """Calls between different known classes, or those to one."""
    return (base.calls_to(callee) if callee else base.edges).where("callee_class <> '?' AND caller_class <> callee_class")


# Navigation


@command("overview")
def overview(base: CodeBase) -> DataFrame:
    t = base.code.types.agg(F.countDistinct("path").alias("files"), F.count("*").alias("types"), F.count_if("is_interface").alias("interfaces"), F.sum("n_methods").alias("methods"), F.countDistinct("package").alias("packages"))
    big = rank.top(base.code.types.where("NOT is_interface").select("fqn", "n_methods"), 10, F.desc("n_methods"), F.asc("fqn"))
    return t.crossJoin(big.agg(F.collect_list(F.struct("fqn", "n_methods")).alias("largest")))  # two single rows


@command("classes")
def classes(base: CodeBase, package: str = "", limit: int = 50) -> DataFrame:
    """Types of a package; when there are more than `limit`, those constructed most."""
    found = base.code.types.where(F.startswith("package", F.lit(package))).select("name", "fqn", "kind", "path", "n_methods")
    made = base.edges.where("callee_class = callee_method").groupBy(F.col("callee_class").alias("name")).agg(F.count("*").alias("constructed"))
    found = found.join(made, "name", "left").fillna(0, ["constructed"])
    return rank.with_total(found, limit, F.desc("constructed"), F.asc("fqn"), F.asc("path"))


@command("summary")
def summary(base: CodeBase, name: str, limit: int = 20) -> DataFrame:
    simple = name.rpartition(".")[2]
    calls_in = base.calls_to(simple).groupBy(F.col("callee_class").alias("class_name"), F.col("callee_method").alias("name")).agg(F.count("*").alias("callers"))
    own = base.code.methods_of(simple).where(F.col("fqn" if "." in name else "class_name") == name).join(calls_in, ["class_name", "name"], "left").fillna(0, ["callers"])
    shown = F.when(F.array_contains("modifiers", "public"), 0).when(F.array_contains("modifiers", "protected"), 1).when(F.array_contains("modifiers", "private"), 3).otherwise(2)
    return rank.with_total(own.select("class_name", "name", "signature", "start_line", "callers", shown.alias("visibility")), limit, F.asc("visibility"), F.desc("callers"), F.asc("name"), F.asc("start_line"))


@command("mini")
def mini(base: CodeBase, name: str) -> DataFrame:
    """Five key methods by external calling classes, three fields, and who calls."""
    outside = _external(base, name)
    callers = outside.groupBy(F.col("callee_method").alias("name")).agg(F.countDistinct("caller_class").alias("n"))
    key = rank.top(base.code.methods_of(name).join(callers, "name", "left").fillna(0, ["n"]), 5, F.desc("n"), F.desc("loc"), F.asc("name"), F.asc("start_line"))
    methods = key.agg(F.collect_list(F.struct("name", "signature")).alias("methods"))
    fields = rank.top(base.code.fields_of(name).where(~F.col("type").isin(list(packs.COMMON_TYPES))).select("name", "type", "line"), 3, F.asc("line"), F.asc("name")).agg(F.collect_list(F.struct("name", "type")).alias("fields"))
    by = outside.agg(F.array_sort(F.collect_set("caller_class")).alias("called_by"))
    return methods.crossJoin(fields).crossJoin(by)  # single rows


@command("read")
def read(base: CodeBase, ref: str, max_chars: int = 25_000, preview: int = 100) -> DataFrame:
    """The source of a class or of a method (`Class.method`), in full or, beyond max_chars, its first lines."""
    cls, _, method = ref.partition("(")[0].rpartition(".")
    spans = base.code.types.where(F.col("name") == ref).select("path", "start_line", "end_line", F.lit("").alias("method"))
    if cls:
        spans = spans.unionAll(base.code.methods.where((F.col("class_name") == cls.rpartition(".")[2]) & (F.col("name") == method)).select("path", "start_line", "end_line", "signature"))
    lines = base.code.lines.join(spans, "path").where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    body = lines.groupBy("path", "start_line", "end_line", "method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("source"))
    return body.withColumn("truncated", F.length("source") > max_chars).withColumn("source", F.when(F.col("truncated"), F.substring_index("source", "\n", preview)).otherwise(F.col("source")))


@command("hierarchy")
def hierarchy(base: CodeBase, name: str) -> DataFrame:
    """relation and name: super class, interfaces, subclasses and implementors, type arguments erased."""
    own = _of_class(base, name)
    up = own.where("super_class <> ''").select(F.lit("super").alias("relation"), scalars.erase("super_class").alias("name"))
    up = up.unionAll(own.select(F.lit("interface"), F.explode("interfaces").alias("i")).select("interface", scalars.erase("i")))
    down = base.code.children_of(name.rpartition(".")[2]).select("relation", "name")
    return up.unionAll(down).distinct()


@command("implements")
def implements(base: CodeBase, name: str) -> DataFrame:
    exploded = base.code.types.select("name", "fqn", "path", F.explode("interfaces").alias("i"))
    return exploded.where(scalars.simple_name(scalars.erase("i")) == name).select("name", "fqn", "path").distinct()


@command("deps")
def deps(base: CodeBase, name: str, full: bool = False) -> DataFrame:
    """kind and dependency: imports, field types, constructor parameter types."""
    own = _of_class(base, name)
    imports = own.select(F.lit("import").alias("kind"), F.explode("imports").alias("dependency"))
    if not full:
        imports = imports.where(~F.col("dependency").rlike(packs.HIDDEN_IMPORTS))
    simple = name.rpartition(".")[2]
    fields = base.code.fields_of(simple).select(F.lit("field"), "type")
    made = base.code.methods_of(simple).where("is_constructor").select(F.lit("constructor"), F.explode("params.type").alias("t")).select("constructor", scalars.erase("t"))
    return imports.unionAll(fields).unionAll(made).distinct()


def _pairs(base: CodeBase) -> DataFrame:
    """class_name and used: types of fields and of constructor parameters."""
    fields = base.code.fields.select("class_name", scalars.simple_name("type").alias("used"))
    made = base.code.methods.where("is_constructor").select("class_name", F.explode("params.type").alias("t")).select("class_name", scalars.simple_name(scalars.erase("t")).alias("used"))
    return fields.unionAll(made).distinct()


@command("related")
def related(base: CodeBase, name: str, limit: int = 15) -> DataFrame:
    """Score: 3 for a field's type, 2 for each call either way, 1 for the same package."""
    e = _external(base)
    same = base.code.types.join(_of_class(base, name).select("package").distinct(), "package", "left_semi").where(F.col("name") != name)
    rows = base.code.fields.where(F.col("class_name") == name).select(scalars.simple_name("type").alias("name"), F.lit(3).alias("w"), F.lit("field").alias("reason"))
    rows = rows.unionAll(e.where(F.col("callee_class") == name).select("caller_class", F.lit(2), F.lit("caller")))
    rows = rows.unionAll(e.where(F.col("caller_class") == name).select("callee_class", F.lit(2), F.lit("callee")))
    rows = rows.unionAll(same.select("name", F.lit(1), F.lit("package"))).where(~F.col("name").isin(list(packs.COMMON_TYPES)))
    return rank.top(rows.groupBy("name").agg(F.sum("w").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons")), limit, F.desc("score"), F.asc("name"))


@command("similar")
def similar(base: CodeBase, name: str, least: float = 0.3) -> DataFrame:
    """0.7 of the Jaccard similarity of method names, 0.3 of the share of common interfaces."""
    items = base.code.methods.where("NOT is_constructor").select(F.col("class_name").alias("owner"), F.col("name").alias("item"))
    target = base.spark.createDataFrame([(name,)], "owner string")
    pairs = rank.jaccard_pairs(items, target).select("b", "jaccard")
    faces = base.code.types.select(F.col("name").alias("b"), F.transform("interfaces", lambda i: F.substring_index(i, "<", 1)).alias("faces"))
    own = faces.where(F.col("b") == name).select(F.col("faces").alias("mine")).limit(1)
    joined = faces.where(F.col("b") != name).join(pairs, "b", "left").crossJoin(F.broadcast(own))  # one row
    most = F.greatest(F.size("faces"), F.size("mine"))
    share = F.when(most > 0, F.size(F.array_intersect("faces", "mine")) / most).otherwise(0.0)
    mixed = 0.7 * F.coalesce("jaccard", F.lit(0.0)) + 0.3 * share
    return joined.where(mixed >= least).select(F.col("b").alias("name"), F.round(100 * mixed).cast("int").alias("score")).orderBy(F.desc("score"), "name")


@command("explain")
def explain(base: CodeBase, name: str) -> DataFrame:
    own = _of_class(base, name)
    callers = base.edges.join(base.code.methods.where(F.col("class_name") == name).select(F.col("name").alias("callee_method")).distinct(), "callee_method", "left_semi").agg(F.countDistinct("caller_class")).scalar()
    line = F.concat_ws(" ", F.lit("The"), "kind", "fqn", F.lit("has"), F.col("n_methods").cast("string"), F.lit("methods and"), F.col("n_fields").cast("string"), F.lit("fields; methods of these names are called from"), F.col("callers_by_name").cast("string"), F.lit("classes."))
    return own.withColumn("callers_by_name", callers).select("fqn", line.alias("text"))


@command("map")
def map_(base: CodeBase, budget: int = 2000) -> DataFrame:
    """Classes by external calling classes, with three short signatures each, within a budget of tokens (a quarter of the characters)."""
    used = _external(base).groupBy(F.col("callee_class").alias("class_name")).agg(F.countDistinct("caller_class").alias("callers"))
    short = base.code.methods.select("class_name", "signature", F.row_number().over(W.partitionBy("class_name").orderBy(F.length("signature"), "signature", "start_line")).alias("k")).where("k <= 3")
    short = short.groupBy("class_name").agg(F.array_sort(F.collect_list("signature")).alias("signatures"))
    named = base.code.types.select(F.col("name").alias("class_name")).distinct().join(used, "class_name", "left").join(short, "class_name", "left").fillna(0, ["callers"])
    cost = F.ceil((F.length("class_name") + F.coalesce(F.length(F.array_join("signatures", " ")), F.lit(0)) + 1) / 4)
    return rank.within_budget(named.withColumn("cost", cost), "cost", budget, F.desc("callers"), F.asc("class_name"))


@command("contract")
def contract(base: CodeBase, name: str) -> DataFrame:
    return base.code.methods_of(name).select("name", "signature", "return_type", "params", "throws", "annotations", "javadoc")


@command("context")
def context(base: CodeBase, name: str) -> DataFrame:
    """Everything about one class in one row."""
    one = lambda df, alias: df.agg(F.collect_list(F.struct(*df.columns)).alias(alias))
    out = one(contract(base, name).select("name", "signature"), "methods")
    for alias, df in (("deps", deps(base, name)), ("hierarchy", hierarchy(base, name)), ("smells", smells(base).where(F.col("class_name") == name)), ("source", read(base, name).select("source"))):
        out = out.crossJoin(one(df, alias))  # single rows
    layers = base.config.get("layers")
    layer = rules.first_layer(F.lit(name), [(x["name"], x["glob"]) for x in layers]) if layers else F.lit("none")
    by_name = base.edges.groupBy("callee_method").agg(F.countDistinct("caller_class").alias("callers"))
    counted = base.code.methods.where(F.col("class_name") == name).select("name").distinct().join(by_name, F.col("name") == F.col("callee_method"), "left").select("name", F.coalesce("callers", F.lit(0)).alias("callers"))
    return out.crossJoin(one(counted, "callers_by_name")).withColumn("layer", layer)


SHOWN_CALLS = 5  # of a method's callers and callees in a document; the others are counted


def _listed(pairs: DataFrame, label: str, place: int) -> DataFrame:
    """class_name, name, place and text: the first SHOWN_CALLS of `other` of each method, and how many more there are."""
    pairs = pairs.distinct()
    total = pairs.groupBy("class_name", "name").agg(F.count("*").alias("__n"))
    first = rank.top_within(pairs, ["class_name", "name"], SHOWN_CALLS, F.asc("other")).groupBy("class_name", "name").agg(F.array_sort(F.collect_list("other")).alias("__first"))
    more = F.when(F.col("__n") > SHOWN_CALLS, F.concat(F.lit(" and "), (F.col("__n") - SHOWN_CALLS).cast("string"), F.lit(" more"))).otherwise("")
    return first.join(total, ["class_name", "name"]).select("class_name", "name", F.lit(place).alias("sub"), F.concat(F.lit(f"- {label}: "), F.array_join("__first", ", "), more).alias("text"))


def documents(base: CodeBase, only: DataFrame | None = None) -> DataFrame:
    """fqn, path and a Markdown document of every class, or of those in `only` (fqn), all at once.

    Types, members, calls, imports and smells become lines with a section and a place, and one grouping by class puts each
    document together. Calls are cut to the first few a method before they are grouped, so a class that everybody calls
    is no larger than its own code."""
    kept = lambda df: df if only is None else df.join(only.select("fqn").distinct(), "fqn", "left_semi")
    types, methods = kept(base.code.types), kept(base.code.methods)
    entry = lambda df, section, place, text_, sub=F.lit(0): df.select("fqn", "path", F.lit(section).alias("section"), F.col(place).cast("long").alias("place") if isinstance(place, str) else place.cast("long").alias("place"), sub.alias("sub"), text_.alias("text"))
    code_ = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    no = F.lit(0)
    faces = F.array_join(F.transform("interfaces", code_), ", ")
    out = entry(types, 0, no, F.concat(F.lit("# "), "name"))
    out = out.unionAll(entry(types.where("package <> ''"), 1, no, F.concat(F.lit("**Package:** "), code_(F.col("package")))))
    out = out.unionAll(entry(types.where("super_class <> ''"), 2, no, F.concat(F.lit("**Extends:** "), code_(F.col("super_class")))))
    out = out.unionAll(entry(types.where(F.size("interfaces") > 0), 3, no, F.concat(F.lit("**Implements:** "), faces)))
    out = out.unionAll(entry(types.where(F.size("annotations") > 0), 4, no, F.concat(F.lit("**Annotations:** "), F.array_join(F.col("annotations.name"), ", "))))
    out = out.unionAll(entry(types.where("n_methods > 0"), 5, no, F.lit("## Methods")))
    out = out.unionAll(entry(methods, 6, "start_line", F.concat(F.lit("### "), "signature")))
    out = out.unionAll(entry(methods.where(F.size("annotations") > 0), 6, "start_line", F.concat(F.lit("- annotations: "), F.array_join(F.transform("annotations", lambda a: F.concat(F.lit("@"), a["name"])), ", ")), F.lit(1)))
    at = methods.select("fqn", "path", "class_name", "name", "start_line")
    dotted = lambda c, m: F.concat_ws(".", c, m).alias("other")
    known = base.edges.where("callee_class <> '?'")
    by = _listed(known.select(F.col("callee_class").alias("class_name"), F.col("callee_method").alias("name"), dotted("caller_class", "caller_method")), "called by", 2)
    to = _listed(known.select(F.col("caller_class").alias("class_name"), F.col("caller_method").alias("name"), dotted("callee_class", "callee_method")), "calls", 3)
    out = out.unionAll(entry(at.join(by.unionAll(to), ["class_name", "name"]), 6, "start_line", F.col("text"), F.col("sub")))
    imports = types.where(F.size("imports") > 0)
    out = out.unionAll(entry(imports, 7, no, F.lit("## Imports")))
    out = out.unionAll(entry(imports.select("fqn", "path", F.explode(F.array_sort(F.array_distinct("imports"))).alias("i")), 8, no, F.concat(F.lit("- "), "i")))
    found = smells(base).select("path", "class_name", F.col("line").alias("__line"), "rule_id", "severity").join(types.select("path", F.col("name").alias("class_name"), "fqn"), ["path", "class_name"])
    out = out.unionAll(entry(found.select("fqn", "path").distinct(), 9, no, F.lit("## Smells")))
    out = out.unionAll(entry(found, 10, "__line", F.concat(F.lit("- line "), F.col("__line").cast("string"), F.lit(": "), "rule_id", F.lit(" ("), "severity", F.lit(")"))))
    lines = F.array_sort(F.collect_list(F.struct("section", "place", "sub", "text")))
    return out.groupBy("fqn", "path").agg(F.array_join(F.transform(lines, lambda e: e["text"]), "\n").alias("markdown"))


@command("document")
def document(base: CodeBase, name: str = "") -> DataFrame:
    """Markdown documents of the classes of a name, simple or qualified, or of all classes."""
    return documents(base, base.code.by_name(name).select("fqn") if name else None)


#: Words that tell what a task is about, strongest first.
INTENTS = {"fix": ("fix", "bug", "error", "crash", "broken", "fail", "issue"), "feature": ("add", "new", "create", "implement", "support"), "change": ("change", "rename", "move", "refactor", "update", "replace"), "explore": ("how", "where", "what", "find", "explain", "understand")}
STEPS = {"fix": (("read", 800), ("callers", 300), ("test-for", 200), ("smells", 200)), "feature": (("summary", 300), ("similar", 200), ("deps", 200), ("style", 150)), "change": (("impact", 400), ("callers", 300), ("breaking-changes", 200), ("test-for", 200)), "explore": (("overview", 200), ("mini", 150), ("related", 200), ("explain", 100))}


@command("context-for")
def context_for(base: CodeBase, task: str, budget: int = 1200) -> DataFrame:
    """Steps for a task described in words: the intent with most of its words (the stronger one of equals), and
    the longest beginning of its plan within the budget."""
    import re

    words = set(re.findall(r"[a-z]+", task.lower()))
    intent = max(INTENTS, key=lambda k: (len(words & set(INTENTS[k])), -list(INTENTS).index(k)))
    names = re.findall(r"\b[A-Z]\w+(?:\.\w+)?", task)
    rows = [(i, intent, step, n, cost) for i, (step, cost) in enumerate(STEPS[intent]) for n in names or [""]]
    plan = base.spark.createDataFrame(rows, "place int, intent string, step string, target string, cost int")
    return rank.within_budget(plan, "cost", budget, F.asc("place"), F.asc("target"))


@command("stats")
def stats(base: CodeBase, name: str) -> DataFrame:
    parents = base.code.types.where("super_class <> ''").groupBy(F.col("name").alias("node")).agg(F.min(scalars.simple_name(scalars.erase("super_class"))).alias("parent"))
    depth = graph.chain_depth(parents).where(F.col("node") == name).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("inheritance_depth"))
    size = base.code.methods.where(F.col("class_name") == name).agg(F.count("*").alias("methods"), F.coalesce(F.sum(1 + F.floor(F.col("loc") / 10)), F.lit(0)).alias("estimate"))
    coupled = _pairs(base).where(F.col("class_name") == name).agg(F.count("*").alias("coupling"))
    loc = _of_class(base, name).agg(F.max("loc").alias("loc"))
    return loc.crossJoin(size).crossJoin(coupled).crossJoin(depth)  # single rows


@command("verify")
def verify(base: CodeBase, name: str, spec: DataFrame) -> DataFrame:
    """Differences between a class and its specification (sources.spec): kind, method, detail."""
    wanted = spec.where(F.col("class_name") == name)
    real = base.code.methods.where((F.col("class_name") == name) & ~F.col("is_constructor")).select(F.col("name").alias("r_name"), F.col("throws").alias("r_throws"), F.transform("annotations", lambda a: a["name"]).alias("r_annotations"))
    both = wanted.join(real, wanted["name"] == real["r_name"], "full")
    missing = both.where("r_name IS NULL").select(F.lit("missing_method").alias("kind"), F.col("name").alias("method"), F.lit("").alias("detail"))
    extra = both.where("name IS NULL").select(F.lit("undocumented_method"), "r_name", F.lit(""))
    lost = lambda kind, c: both.where("name IS NOT NULL AND r_name IS NOT NULL").select(F.lit(kind), "name", F.explode(F.array_except(c, f"r_{c}")))
    return missing.unionAll(extra).unionAll(lost("missing_throws", "throws")).unionAll(lost("missing_annotation", "annotations")).distinct()


@command("checklist")
def checklist(base: CodeBase, ref: str) -> DataFrame:
    """Who has to be looked at when a method changes: external callers and where they call."""
    t = base.targets(ref).select(F.col("class_name").alias("callee_class"), F.col("name").alias("callee_method")).distinct()
    return base.edges.join(t, ["callee_class", "callee_method"], "left_semi").where("caller_class <> callee_class").select("caller_class", "caller_method", "path", "line").distinct()


@command("checklist-steps")
def checklist_steps(base: CodeBase, ref: str, task: str = "") -> DataFrame:
    """step, action, location and description of a change of a method: the edit, an import where the task asks for a null
    check, its callers one by one where it renames or changes the signature, else to be looked at, and the tests.
    Beyond ten callers only their number and that of their packages is given. No rows for an unknown method."""
    wanted = task.lower()
    target = base.targets(ref).select("class_name").agg(F.min("class_name").alias("class_name")).where("class_name IS NOT NULL")
    file = target.join(base.code.types.select(F.col("name").alias("class_name"), "path"), "class_name", "left").agg(F.max("class_name").alias("class_name"), F.min("path").alias("path")).where("class_name IS NOT NULL")
    file = file.select("class_name", F.coalesce("path", F.concat("class_name", F.lit(".java"))).alias("location"))
    row = lambda df, order, action, location, text_: df.select(F.lit(order).alias("__order"), F.lit(action).alias("action"), location.alias("location"), text_.alias("description"))
    steps = row(file, 0, "edit", F.col("location"), F.lit(f"Change {ref}" + (f": {task}" if task else "")))
    if "null check" in wanted or "requirenonnull" in wanted:
        steps = steps.unionAll(row(file, 1, "add-import", F.col("location"), F.lit("Import java.util.Objects if it is missing")))
    found = checklist(base, ref).where("caller_class <> '?'").select("caller_class", "path", "line").distinct()
    found = found.select("path", F.concat(F.col("caller_class"), F.lit(" ("), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(")")).alias("at")).distinct()
    for word, text_ in (("rename", "Call it by the new name"), ("parameter|signature", "Call it with the new signature")):
        if any(w in wanted for w in word.split("|")):
            steps = steps.unionAll(row(found, 2, "update-caller", F.col("at"), F.lit(text_)))
    if "rename" not in wanted and "parameter" not in wanted:
        owners = found.join(base.code.types.select("path", "package").distinct(), "path", "left")
        total = owners.agg(F.countDistinct("at").alias("n"), F.countDistinct("package").alias("packages")).where("n > 0")
        first = rank.top(found.select("at").distinct(), 10, F.asc("at")).agg(F.array_join(F.array_sort(F.collect_list("at")), ", ").alias("listed"))
        few = F.col("n") <= 10
        location = F.when(few, F.col("listed")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" callers")))
        text_ = F.when(few, F.concat(F.lit("Look at "), F.col("n").cast("string"), F.lit(" caller(s)"))).otherwise(F.concat(F.lit("Look at callers in "), F.col("packages").cast("string"), F.lit(" package(s)")))
        steps = steps.unionAll(row(total.crossJoin(first), 3, "check-callers", location, text_))  # single rows
    steps = steps.unionAll(row(file, 4, "test", F.lit("tests"), F.lit("Run the tests")))
    ordered = rank.numbered(steps, "__order", "location", "description")
    return ordered.select("step", "action", "location", "description")


# Call graph


@command("callers")
def callers(base: CodeBase, ref: str) -> DataFrame:
    """Direct callers; without any, calls of the same name and a fitting number of arguments on unknown classes."""
    t = base.targets(ref)
    direct = graph.neighbours(base.graph, t.select("node"), incoming=True).select("src", "dst", "line")
    wanted = t.select(F.col("name").alias("callee_method"), F.col("param_count").alias("__n")).distinct().where(~F.col("callee_method").isin(list(packs.OBJECT_METHODS)))
    loose = base.edges.where("callee_class = '?'").join(wanted, "callee_method").where("callee_arity = __n OR callee_arity = -1 OR __n = -1")
    loose = calls.as_graph(loose.drop("__n").distinct())
    has = direct.limit(1).select(F.lit(True).alias("__has"))
    fallback = loose.join(has, F.lit(True), "left_anti")
    return direct.unionAll(fallback)


@command("callees")
def callees(base: CodeBase, ref: str) -> DataFrame:
    return graph.neighbours(base.graph, base.targets(ref).select("node")).select("src", "dst", "line")


@command("call-chain")
def call_chain(base: CodeBase, ref: str, max_edges: int = graph.MAX_CHAIN, stop_methods: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Chains of calls from a method that nothing calls, or from a stop method, to the one that is meant: all, or the
    `first` by length, then names."""
    globs = stop_methods if stop_methods is not None else base.config.get("chain_stop_methods") or []
    stop = None
    if globs:
        nodes = base.graph.select(F.col("src").alias("node")).distinct()
        _, method = _split_node()
        stop = nodes.where(F.exists(F.array(*(F.lit(scalars.name_pattern(g)) for g in globs)), lambda p: F.regexp_like(method, p) | F.regexp_like(F.substring_index("node", "/", 1), p)))
    found = graph.chains_to_roots(base.graph, base.targets(ref).select("node"), max_edges, stop, first)
    return found.select(F.array_join(F.transform("chain", lambda n: F.substring_index(n, "/", 1)), " -> ").alias("chain"), "depth").distinct()


@command("impact")
def impact(base: CodeBase, ref: str, levels: int = graph.MAX_LEVELS) -> DataFrame:
    """Affected classes with the fewest steps, and the risk by direct calling classes."""
    targets = base.targets(ref).select("node")
    reached = graph.closure(base.graph, targets, incoming=True, max_levels=levels)
    cls, _ = _split_node()
    affected = reached.where("depth > 0").groupBy(cls.alias("class_name")).agg(F.min("depth").alias("depth")).where("class_name <> '?'")
    direct = affected.where("depth = 1").agg(F.count("*")).scalar()
    return affected.withColumn("direct", direct).withColumn("risk", graph.risk("direct", 3, 10)).orderBy("class_name")


@command("test-for")
def test_for(base: CodeBase, ref: str, levels: int = graph.MAX_LEVELS) -> DataFrame:
    """Test classes for a method: by name, by calls (nearer is surer) and by import."""
    tests = base.code.types.where("is_test").select(F.col("name").alias("test")).distinct()
    t = base.targets(ref)
    owner = t.select("class_name").distinct()
    named = tests.withColumn("class_name", F.regexp_replace("test", "(Test|Tests|IT)$", "")).where("class_name <> test").join(owner, "class_name").select("test", F.lit("high").alias("confidence"), F.lit(0).alias("depth"))
    cls, _ = _split_node()
    stop = base.graph.select(F.col("src").alias("node")).distinct().withColumn("test", cls).join(tests, "test", "left_semi").select("node")
    reached = graph.closure(base.graph, t.select("node"), incoming=True, max_levels=levels, stop=stop).where("depth > 0").withColumn("test", cls).join(tests, "test", "left_semi")
    called = reached.groupBy("test").agg(F.min("depth").alias("depth")).select("test", F.when(F.col("depth") == 1, "high").when(F.col("depth") == 2, "medium").otherwise("low").alias("confidence"), "depth")
    imported = base.code.imports.join(owner, F.col("simple") == owner["class_name"], "left_semi").select(F.col("class_name").alias("test")).join(tests, "test", "left_semi").distinct().select("test", F.lit("medium"), F.lit(99))
    ranked = named.unionAll(called).unionAll(imported).withColumn("__order", F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("confidence")))
    return rank.top_within(ranked, ["test"], 1, F.asc("__order"), F.asc("depth")).select("test", "confidence", "depth").orderBy("confidence", "depth", "test")


test_for.__test__ = False


@command("flow")
def flow(base: CodeBase, ref: str, levels: int = 10) -> DataFrame:
    """What a method reaches, each method once, as a walk that follows calls by line would meet them: depth, class_name,
    method, layer (the project's, else by suffix, else `other`), is_dao, and in `crosses` the two layers of a call
    from one known layer to another. `place` holds the lines walked and orders the rows."""
    walked = graph.first_paths(base.graph, base.targets(ref).select("node"), levels)
    cls, method = _split_node()
    caller = F.substring_index(F.substring_index("caller", "/", 1), ".", 1)
    steps = walked.select((F.size("path") - 1).alias("depth"), cls.alias("class_name"), method.alias("method"), caller.alias("__caller"), F.slice("path.line", 2, levels + 1).alias("place"), "path")
    layers = _with_layer(base).groupBy("name").agg(F.min(F.nullif("layer", F.lit("none"))).alias("__layer"))
    dao = daos(base).select(F.col("name").alias("class_name"), F.lit(True).alias("is_dao")).distinct()
    layer = lambda c, known: F.coalesce(known, *(F.when(F.endswith(c, F.lit(s)), s) for s in packs.LAYER_SUFFIXES), F.lit("other"))
    own, above = layers.withColumnsRenamed({"name": "class_name", "__layer": "__own"}), layers.withColumnsRenamed({"name": "__caller", "__layer": "__above"})
    marked = steps.join(own, "class_name", "left").join(above, "__caller", "left").join(dao, "class_name", "left").fillna(False, ["is_dao"])
    marked = marked.withColumns({"layer": layer("class_name", F.col("__own")), "__from": layer("__caller", F.col("__above"))})
    crosses = F.when((F.col("__from") != F.col("layer")) & (F.col("__from") != "other") & (F.col("layer") != "other"), F.concat("__from", F.lit(" -> "), "layer"))
    return marked.orderBy("path").select("depth", "class_name", "method", "layer", "is_dao", crosses.alias("crosses"), "place")


@command("daos")
def daos(base: CodeBase) -> DataFrame:
    """Types that reach a database, by their own name, their super class or an interface."""
    above = scalars.simple_name(scalars.erase(F.coalesce("super_class", F.lit(""))))
    by_interface = F.exists("interfaces", lambda i: scalars.simple_name(scalars.erase(i)).rlike("|".join(packs.DAO_INTERFACES)))
    return base.code.types.where(F.col("name").rlike(f"({'|'.join(packs.DAO_NAMES)})$") | above.rlike("|".join(packs.DAO_SUPERS)) | by_interface).select("name", "fqn", "path").orderBy("fqn", "path")


@command("signatures")
def signatures(base: CodeBase) -> DataFrame:
    """key and params: of `Class.method` those of its first declaration, of `Class.method/n` those of the last with n parameters."""
    params = F.concat(F.lit("("), F.array_join("params.type", ", "), F.lit(")"))
    m = base.code.methods.select("class_name", "name", "param_count", params.alias("params"), F.struct("path", "start_line").alias("at"))
    first = m.groupBy(F.concat_ws(".", "class_name", "name").alias("key")).agg(F.min_by("params", "at").alias("params"))
    return first.unionAll(m.groupBy(calls.node("class_name", "name", "param_count").alias("key")).agg(F.max_by("params", "at").alias("params")))


@command("target")
def target(base: CodeBase, ref: str) -> DataFrame:
    """status (found, ambiguous or missing) of a reference to a method, and the methods it may mean. It is ambiguous
    where no parameters are given and several classes, or overloads with different numbers of them, fit."""
    _, _, arity = parse_reference(ref)
    shown = base.targets(ref).join(signatures(base).withColumnRenamed("key", "node"), "node", "left")
    name = F.coalesce(F.concat("class_name", F.lit("."), "name", "params"), scalars.display_name("class_name", "name", "param_count"))
    seen = shown.agg(F.countDistinct("class_name").alias("n"), F.countDistinct(F.when(F.col("param_count") >= 0, F.col("param_count"))).alias("overloads"), F.array_sort(F.collect_set(name)).alias("candidates"))
    several = F.lit(arity is None) & ((F.col("n") > 1) | (F.col("overloads") > 1))
    return seen.select(F.lit(ref).alias("ref"), F.when(F.col("n") == 0, "missing").when(several, "ambiguous").otherwise("found").alias("status"), "candidates")


@command("locate")
def locate(base: CodeBase, name: str) -> DataFrame:
    """kind (file, class or method), status and paths of what a name means: a file's name with or without its ending,
    else a class, else a method."""
    base_name = F.substring_index("path", "/", -1)
    files = base.code.facts.where(base_name.isin(name, f"{name}.java")).select(F.lit(0).alias("order"), F.lit("file").alias("kind"), "path")
    types = _of_class(base, name).select(F.lit(1), F.lit("class"), "path")
    methods = base.code.methods.where(F.col("name") == name).select(F.lit(2), F.lit("method"), "path")
    found = files.unionAll(types).unionAll(methods).groupBy("order", "kind").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    best = found.agg(F.min_by(F.struct("kind", "paths"), "order").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.size("b.paths") > 1, "ambiguous").otherwise("found")
    return best.select(F.lit(name).alias("name"), status.alias("status"), "b.kind", "b.paths")


@command("qualify")
def qualify(base: CodeBase, name: str) -> DataFrame:
    """The qualified names of the types of a class's fields and results."""
    erased = lambda c: scalars.erase(c).alias("type")
    uses = base.code.fields.where(F.col("class_name") == name).select("fqn", erased("type")).unionAll(base.code.methods.where((F.col("class_name") == name) & ~F.col("return_type").isin("void", "")).select("fqn", erased("return_type")))
    return calls.qualify(base.code, uses).orderBy("fqn", "type")


@command("breaking-changes")
def breaking_changes(base: CodeBase, name: str) -> DataFrame:
    """Children of a type, the methods each overrides, and the risk by their number."""
    children = hierarchy(base, name).where("relation IN ('subclass', 'implementor')").select(F.col("name").alias("child"), "relation")
    own = base.code.methods.where((F.col("class_name") == name) & ~F.col("is_constructor")).select("name", "param_count").distinct()
    over = base.code.methods.join(own, ["name", "param_count"], "left_semi").groupBy(F.col("class_name").alias("child")).agg(F.array_sort(F.collect_set("name")).alias("overrides"))
    total = children.agg(F.count("*")).scalar()
    return children.join(over, "child", "left").withColumn("children", total).withColumn("risk", graph.risk("children", 3, 10))


@command("diff-impact")
def diff_impact(base: CodeBase, changed: DataFrame, levels: int = graph.MAX_LEVELS) -> DataFrame:
    """What changed files (column path) affect: classes by steps, which of them are tests to run, risk by direct calls."""
    touched = base.code.types.join(changed.select("path").distinct(), "path", "left_semi").select("name").distinct()
    src_cls, dst_cls = F.substring_index(F.substring_index("src", "/", 1), ".", 1), F.substring_index(F.substring_index("dst", "/", 1), ".", 1)
    seeds = base.graph.withColumn("name", dst_cls).join(touched, "name", "left_semi").select(F.col("dst").alias("node")).distinct()
    reached = graph.closure(base.graph, seeds, incoming=True, max_levels=levels)
    direct = base.graph.withColumn("name", dst_cls).join(touched, "name", "left_semi").where(src_cls != dst_cls).agg(F.count("*")).scalar()
    cls, _ = _split_node()
    affected = reached.groupBy(cls.alias("name")).agg(F.min("depth").alias("depth")).join(touched, "name", "left_anti")
    tests = base.code.types.where("is_test").select("name", F.lit(True).alias("is_test")).distinct()
    affected = affected.join(tests, "name", "left").fillna(False, ["is_test"])
    return affected.withColumn("direct", direct).withColumn("risk", graph.risk("direct", 5, 20))


# Search


@command("search")
def search(base: CodeBase, pattern: str, limit: int = 30) -> DataFrame:
    """Lines with any of the terms, whether in a comment, and the innermost type and method around them."""
    hits = text.search(base.code.lines.select("path", "line_no", "text", "in_comment"), pattern)
    hits = text.enclose(hits, base.code.types.select("path", "start_line", "end_line", F.col("name").alias("class_name")), "path", "line_no", "class_name")
    hits = text.enclose(hits, base.code.methods.select("path", "start_line", "end_line", F.col("name").alias("method")), "path", "line_no", "method")
    return rank.with_total(hits, limit, F.asc("path"), F.asc("line_no"))


@command("find")
def find(base: CodeBase, concepts: str | list[list[str]], limit: int = 15) -> DataFrame:
    """Types whose names (5) or methods (3) mention concepts: the words of a question, taken with their
    synonyms, or lists of synonyms."""
    names = base.code.methods.groupBy("fqn").agg(F.array_join(F.collect_set("name"), " ").alias("method_names"))
    items = base.code.types.select("fqn", "name").join(names, "fqn", "left").fillna("", ["method_names"])
    if isinstance(concepts, str):
        scored = text.first_synonym_scores(items, "fqn", "method_names", text.concepts_of(concepts, packs.SYNONYMS))
        return rank.top(scored.select("fqn", "concepts", "score"), limit, F.desc("score"), F.asc("fqn"))
    scored = text.concept_scores(items, {"fqn": 5, "method_names": 3}, concepts)
    return rank.top(scored.select("fqn", "concepts", "score"), limit, F.desc("score"), F.asc("fqn"))


@command("method")
def method(base: CodeBase, ref: str, limit: int = 30) -> DataFrame:
    """Methods of a name, of one class and with exactly the listed parameter types if those are given, each place once,
    with the number of all and whether some were left out."""
    cls, name, arity = parse_reference(ref)
    found = base.code.methods.where(F.col("name") == name)
    if cls:
        found = found.where(F.col("class_name") == cls)
    if arity is not None:
        _, parts = ref.rstrip(") ").split("(", 1), []
        for piece in _[1].split(","):  # commas inside type arguments do not part types
            if parts and parts[-1].count("<") > parts[-1].count(">"):
                parts[-1] += "," + piece
            elif piece.strip():
                parts.append(piece)
        asked = F.array(*(F.lit("".join(p.split())) for p in parts)).cast("array<string>")
        found = found.where(F.transform("params.type", lambda t: F.regexp_replace(t, r"\s", "")) == asked)
    found = found.select("path", "class_name", "name", "signature", "start_line", "end_line").dropDuplicates(["class_name", "name", "start_line", "path"])
    return rank.with_total(found, limit, F.asc("path"), F.asc("start_line"), F.asc("class_name"))


@command("scope")
def scope(base: CodeBase, words: str, limit: int = 15) -> DataFrame:
    """Types by keywords in class name (5), methods (3 each), fields (2 each) and package (1)."""
    keys = [w.lower() for w in words.replace(",", " ").split()]
    hits = lambda c: sum((F.when(F.contains(F.lower(c), F.lit(k)), 1).otherwise(0) for k in keys), F.lit(0))
    rows = base.code.types.select("fqn", (5 * hits("name") + hits("package")).alias("w"))
    rows = rows.unionAll(base.code.methods.select("fqn", 3 * hits("name"))).unionAll(base.code.fields.select("fqn", 2 * F.greatest(hits("name"), hits("type"))))
    return rank.top(rows.groupBy("fqn").agg(F.sum("w").alias("score")).where("score > 0"), limit, F.desc("score"), F.asc("fqn"))


@command("unused")
def unused(base: CodeBase) -> DataFrame:
    """kind and name: methods nobody calls, types nobody refers to, interfaces nobody implements."""
    called = base.edges.select(F.col("callee_class").alias("class_name"), F.col("callee_method").alias("name")).distinct()
    lone = base.code.methods.where("name <> 'main' AND NOT is_constructor").join(called, ["class_name", "name"], "left_anti").select(F.lit("method").alias("kind"), F.concat_ws(".", "class_name", "name").alias("name"))
    used = base.code.imports.select(F.col("simple").alias("name")).unionAll(_pairs(base).select("used")).distinct()
    types = base.code.types.where("name <> 'App'").join(used, "name", "left_anti").select(F.lit("class"), "name")
    done = base.code.types.select(F.explode("interfaces").alias("i")).select(scalars.simple_name(scalars.erase("i")).alias("name")).distinct()
    faces = base.code.types.where("is_interface").join(done, "name", "left_anti").select(F.lit("interface"), "name")
    return lone.unionAll(types).unionAll(faces).distinct()


@command("annotations")
def annotations(base: CodeBase, name: str, limit: int = 30) -> DataFrame:
    return rank.with_total(base.code.annotations.where(F.col("name") == name), limit, F.asc("path"), F.asc("line"), F.asc("owner"))


@command("co-annotations")
def co_annotations(base: CodeBase, name: str, limit: int = 10) -> DataFrame:
    """Annotations that stand beside one."""
    a = base.code.annotations.select("owner_kind", "owner", "class_name", "line", "name")
    keys = ["owner_kind", "owner", "class_name", "line"]
    beside = a.where(F.col("name") != name).join(a.where(F.col("name") == name).select(*keys), keys, "left_semi")
    return rank.top(beside.groupBy("name").agg(F.count("*").alias("n")), limit, F.desc("n"), F.asc("name"))


@command("imports")
def imports(base: CodeBase, name: str) -> DataFrame:
    """Who depends on a class: by import, else field, else constructor parameter."""
    rows = base.code.imports.where(F.col("simple") == name).select("class_name", F.lit(1).alias("k"), F.lit("import").alias("relation"))
    rows = rows.unionAll(base.code.fields.where(scalars.simple_name("type") == name).select("class_name", F.lit(2), F.lit("field")))
    made = base.code.methods.where("is_constructor").select("class_name", F.explode("params.type").alias("t")).where(scalars.simple_name(scalars.erase("t")) == name)
    rows = rows.unionAll(made.select("class_name", F.lit(3), F.lit("constructor"))).where(F.col("class_name") != name)
    return rows.groupBy("class_name").agg(F.min_by("relation", "k").alias("relation")).orderBy("class_name")


@command("validate")
def validate(base: CodeBase, refs: str) -> DataFrame:
    """For each reference (parted by `;`): found, ambiguous or missing, with the five best names instead."""
    rows = [(r.strip(), *parse_reference(r.strip())) for r in refs.split(";") if r.strip()]
    asked = base.spark.createDataFrame(rows, "ref string, cls string, wanted string, arity int")
    m = base.code.methods.select(F.col("class_name"), F.col("name"), "param_count").distinct()
    fits = asked.join(m, asked["wanted"] == m["name"], "left").where("cls = '' OR class_name = cls OR class_name IS NULL").where("arity IS NULL OR param_count = arity OR param_count IS NULL")
    counted = fits.groupBy("ref").agg(F.count("name").alias("n"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when((F.col("n") > 1) & F.col("arity").isNull(), "ambiguous").otherwise("found")
    better = text.suggest(base.code.methods.select("name"), asked.select("wanted")).groupBy("wanted").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("suggestions"))
    return asked.join(counted, "ref", "left").withColumn("status", status).join(better, "wanted", "left").select("ref", "status", F.when(F.col("status") == "missing", F.col("suggestions")).alias("suggestions"))


@command("type-check")
def type_check(base: CodeBase, ref: str) -> DataFrame:
    """The return type of a method and whether it can be used as a value."""
    cls, method, _ = parse_reference(ref)
    own = base.code.methods.where(F.col("class_name") == cls)
    near = own.where(F.levenshtein("name", F.lit(method), 3) > 0).agg(F.array_sort(F.collect_set("name")).alias("near"))
    exact = rank.top(own.where(F.col("name") == method).select("class_name", "name", "return_type", "signature", "start_line"), 1, F.asc("start_line"))
    return near.join(exact, F.lit(True), "left").select(F.lit(ref).alias("ref"), "return_type", (F.col("return_type") == "void").alias("is_void"), F.when(F.col("name").isNull(), F.col("near")).alias("near"))


@command("resolve")
def resolve(base: CodeBase, ref: str) -> DataFrame:
    """`[Class.]variable.method` to the type of the field and the signature of the method."""
    *cls, var, method = ref.split(".")
    fields = base.code.fields.where(F.col("name") == var)
    if cls:
        fields = fields.where(F.col("class_name") == cls[-1])
    owners = fields.select("class_name", scalars.simple_name("type").alias("type"))
    if var == "this" and cls:
        owners = base.spark.createDataFrame([(cls[-1], cls[-1])], "class_name string, type string")
    m = base.code.methods.where(F.col("name") == method).select(F.col("class_name").alias("type"), "signature")
    return owners.join(m, "type", "left").select("class_name", "type", "signature").distinct()


# Rules


def _smell(rule: str, severity: str, message: str) -> list[Column]:
    return [F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message")]


@command("smells")
def smells(base: CodeBase) -> DataFrame:
    """path, class_name, method, line, rule_id, severity, message of every smell."""
    kinds = {
        "switch_without_default": ("SWITCH_WITHOUT_DEFAULT", "WARNING", "A switch without a default"), "empty_if": ("EMPTY_IF_BODY", "WARNING", "A branch that does nothing"), "deep_nesting": ("DEEP_NESTING", "WARNING", "More than four levels of nesting"),
        "catch_empty": ("EMPTY_CATCH_BLOCK", "WARNING", "A catch that does nothing"), "catch_log": ("SILENT_CATCH", "WARNING", "A catch that only logs"), "catch_continue": ("SILENT_CATCH_CONTINUE", "WARNING", "A catch that only goes on"),
        "catch_return_default": ("SILENT_CATCH_RETURN_DEFAULT", "WARNING", "A catch that returns a default"), "catch_return": ("SILENT_CATCH_RETURN", "INFO", "A catch that returns"), "catch_print": ("CATCH_PRINT_STACKTRACE", "WARNING", "A catch that prints the stack"),
    }
    s = base.code.statements
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[i])]), F.col("kind"))
    place = ["path", "class_name", "method", "line"]
    out = s.where(F.col("kind").isin(list(kinds))).select(*place, pick(0).alias("rule_id"), pick(1).alias("severity"), pick(2).alias("message"))
    generic = s.where((F.col("kind") == "catch") & F.arrays_overlap(F.split("detail", r"\|"), F.array(*map(F.lit, packs.GENERIC_EXCEPTIONS))))
    out = out.unionAll(generic.select(*place, *_smell("CATCH_GENERIC_EXCEPTION", "WARNING", "A catch of every exception")))
    numbers = s.where((F.col("kind") == "number") & ~F.col("detail").isin(list(packs.BENIGN_NUMBERS)))
    out = out.unionAll(numbers.select(*place, *_smell("MAGIC_NUMBER", "INFO", "A number without a name")))
    m = base.code.methods.where("class_kind IN ('class', 'interface')").withColumnsRenamed({"name": "method", "start_line": "line"})
    out = out.unionAll(m.where(F.col("loc") > packs.MAX_METHOD).select(*place, *_smell("METHOD_TOO_LONG", "INFO", "A long method")))
    out = out.unionAll(m.where(F.col("param_count") > packs.MAX_PARAMS).select(*place, *_smell("TOO_MANY_PARAMETERS", "INFO", "Many parameters")))
    idle = m.where("has_body AND NOT exists(annotations, a -> a.name = 'Override')").withColumn("p", F.explode(F.array_except("params.name", "used_names")))
    return out.unionAll(idle.select(*place, *_smell("UNUSED_PARAMETER", "INFO", "A parameter that is not used")))


def summarise(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return found.groupBy(*(keys or ["severity", "rule_id"])).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *(keys or ["severity", "rule_id"]))


@command("smells-all")
def smells_all(base: CodeBase) -> DataFrame:
    return summarise(smells(base))


@command("smells-trend")
def smells_trend(base: CodeBase, changed: DataFrame) -> DataFrame:
    """Smells by rule in all files and in changed ones (column path), and what that says."""
    marked = smells(base).join(changed.select("path", F.lit(True).alias("is_changed")).distinct(), "path", "left")
    counted = marked.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("is_changed").alias("n_changed"))
    total = counted.agg(F.coalesce(F.sum("n_changed"), F.lit(0))).scalar()
    return counted.withColumn("trend", F.when(total == 0, "clean").otherwise("needs-attention")).orderBy(F.desc("n_changed"), F.desc("n"), "rule_id")


def _located(base: CodeBase, found: DataFrame, within: Code | None = None) -> DataFrame:
    return text.enclose(found, (within or base.code).types.select("path", "start_line", "end_line", F.col("name").alias("class_name")), "path", "line_no", "class_name")


@command("perf")
def perf(base: CodeBase, deep: int = 0, index: bool = True) -> DataFrame:
    """Rules on lines in loops and on whole classes; with deep, also in methods called from loops up to so many calls
    away, each with a shortest call path from the method with the loop to the method of the line. With index, also long
    methods and those that very many call, which facts tell without the source: what is said of a method whose text is not there."""
    found = _on_lines(base)
    if index:
        found = found.unionAll(_from_facts(base).select(*found.columns))
    found = found.withColumn("call_path", F.lit(None).cast("array<string>"))
    return found.unionAll(_deep(base, deep).select(*found.columns)) if deep else found


def _on_lines(base: CodeBase) -> DataFrame:
    """What the text of lines and files tells."""
    lines = base.code.lines
    looped = rules.scan(lines.where("in_loop"), packs.PERFORMANCE).withColumn("scope", F.lit("loop"))
    whole = rules.scan(lines, packs.STRUCTURAL).withColumn("scope", F.lit("class"))
    ahead = W.partitionBy("path").orderBy("line_no")
    flagged = base.code.lines_of_files(("createStatement(", "prepareStatement(")).withColumn("try_near", F.bool_or(F.contains("text", F.lit("try ("))).over(ahead.rowsBetween(-3, 0))).withColumn("closed", F.coalesce(F.bool_or(F.contains("text", F.lit(".close()")) | F.contains("text", F.lit("} finally"))).over(ahead.rowsBetween(1, 29)), F.lit(False)))
    leak = flagged.where("NOT try_near AND NOT closed AND text RLIKE '(createStatement|prepareStatement)\\\\('").select(*lines.columns, F.lit("CURSOR_LEAK").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit("").alias("category"), F.lit("A statement that is not closed").alias("message"), F.lit("class").alias("scope"))
    blocked = base.code.lines_of_files(("ActionListener", "actionPerformed", "MouseListener")).withColumn("slow", F.coalesce(F.bool_or(F.col("text").rlike(r"executeQuery\(|new File\(|Thread\.sleep")).over(ahead.rowsBetween(1, 49)), F.lit(False))).where("slow AND text RLIKE 'ActionListener|actionPerformed|MouseListener'")
    edt = blocked.select(*lines.columns, F.lit("EDT_BLOCKING").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit("").alias("category"), F.lit("Slow work in a listener").alias("message"), F.lit("class").alias("scope"))
    held = base.code.lines_of_files(("ThreadLocal",))
    local = held.groupBy("path").agg(F.min(F.when(F.contains("text", F.lit("ThreadLocal")), F.col("line_no"))).alias("at"), F.bool_or(F.contains("text", F.lit(".remove()"))).alias("removed")).where("at IS NOT NULL AND NOT removed").select("path", F.col("at").alias("line_no"))
    held = held.join(wide(local), ["path", "line_no"], "left_semi").select(*lines.columns, F.lit("THREADLOCAL_LEAK").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit("").alias("category"), F.lit("A thread's value that is not removed").alias("message"), F.lit("file").alias("scope"))
    return looped.unionAll(whole).unionAll(leak).unionAll(edt).unionAll(held)


def _is_long(start: str) -> Column:
    span = F.col("end_line") - F.col(start)
    return (span > packs.LARGE_METHOD) & (span < packs.IMPLAUSIBLE_METHOD)


def _long(base: CodeBase) -> DataFrame:
    own = base.code.methods.where(_is_long("start_line"))
    return own.select("path", F.col("start_line").alias("line_no"), F.lit("LARGE_METHOD").alias("rule_id"), F.lit("A long method").alias("message")).distinct()


def _from_facts(base: CodeBase) -> DataFrame:
    """Long methods and those that many methods call, at their first lines."""
    of = lambda t, m: F.struct(m["start_line"].alias("line_no"), m["end_line"].alias("end_line"), t["name"].alias("callee_class"), m["name"].alias("callee_method"))
    own = base.code.lines_told(F.flatten(F.transform("types", lambda t: F.transform(t["methods"], lambda m: of(t, m)))))
    often = base.edges.groupBy("callee_class", "callee_method").agg(F.countDistinct("caller_class", "caller_method", "caller_arity").alias("n")).where(F.col("n") > packs.HOT_METHOD)
    hot = own.join(wide(often), ["callee_class", "callee_method"], "left_semi")
    told = lambda df, rule, message: df.select(*base.code.lines.columns, F.lit(rule).alias("rule_id"), F.lit(message).alias("message"))
    found = told(own.where(_is_long("line_no")), "LARGE_METHOD", "A long method").unionAll(told(hot, "HOT_METHOD", "A method that very many methods call"))
    return found.distinct().withColumns({"severity": F.lit("INFO"), "category": F.lit(""), "scope": F.lit("index")})


def _deep(base: CodeBase, levels: int) -> DataFrame:
    """Hits in methods that calls in loops reach, each rule once for a method, with the calls that lead there; always critical."""
    in_loop = base.code.facts.select("path", F.explode("loop_lines").alias("line"))
    called = base.edges.join(wide(in_loop), ["path", "line"], "left_semi")
    caller, callee = calls.node("caller_class", "caller_method", "caller_arity"), calls.node("callee_class", "callee_method", "callee_arity")
    reached = graph.witnesses(base.graph, called.select(callee.alias("node"), F.array(caller, callee).alias("path")).distinct(), max(0, levels - 1))
    reached = reached.withColumnRenamed("path", "call_path")
    spans = base.code.methods.select("path", "start_line", "end_line", calls.node("class_name", "name", "param_count").alias("node")).join(wide(reached), "node")
    searching = F.transform(F.filter("statements", lambda s: s["kind"] == "linear_scan"), lambda s: F.struct(s["line"].alias("line_no")))
    scans = base.code.lines_told(F.array_distinct(searching)).withColumns({"rule_id": F.lit("LINEAR_SCAN"), "severity": F.lit("CRITICAL"), "category": F.lit(""), "message": F.lit("A loop that looks for one thing")})
    listed = rules.scan(base.code.lines, packs.PERFORMANCE)
    hits = listed.unionAll(scans.select(*listed.columns)).alias("h").join(wide(spans.alias("s")), (F.col("h.path") == F.col("s.path")) & F.col("h.line_no").between(F.col("s.start_line"), F.col("s.end_line"))).select("h.*", "s.node", "s.call_path")
    first = rank.top_within(hits, ["node", "rule_id"], 1, F.asc("line_no"))
    return first.withColumn("severity", F.lit("CRITICAL")).withColumn("scope", F.concat(F.lit("called from a loop: "), F.col("node")))


@command("security")
def security(base: CodeBase) -> DataFrame:
    """Hits with the class around them; of files that are not parsed yet only those with a hit are."""
    within = base.code.narrowed(rules.in_some_line("content", packs.SECURITY))
    return _located(base, rules.scan(base.code.texts, packs.SECURITY), within).select("path", "class_name", "line_no", "rule_id", "severity", "message")


@command("migrate")
def migrate(base: CodeBase, target: int = 17) -> DataFrame:
    return rules.scan(base.code.texts, packs.MIGRATION, target).select("path", "line_no", "rule_id", "category", "message")


@command("compat")
def compat(base: CodeBase, target: int = 17) -> DataFrame:
    return rules.scan(base.code.texts, packs.COMPATIBILITY, target).select("path", "line_no", "rule_id", "message")


@command("todo")
def todo(base: CodeBase, limit: int = 50) -> DataFrame:
    """Marks in comment lines, the first in order of each line, and the method below which they stand."""
    mark = F.coalesce(*(F.when(F.contains("text", F.lit(m)), m) for m in packs.MARKERS))
    found = base.code.lines.where((F.col("in_comment") | F.contains("text", F.lit("//"))) & mark.isNotNull()).withColumn("mark", mark)
    found = found.where("in_comment OR instr(text, '//') < instr(text, mark)")
    found = text.enclose(found.select("path", "line_no", "mark", F.trim(F.regexp_replace("text", r"^\s*(//|/\*+|\*)\s*", "")).alias("text")), base.code.methods.select("path", "start_line", "end_line", F.col("name").alias("method")), "path", "line_no", "method")
    return rank.with_total(found, limit, F.array_position(F.array(*map(F.lit, packs.MARKERS)), F.col("mark")).asc(), F.asc("path"), F.asc("line_no"))


@command("lint")
def lint(base: CodeBase, name: str = "") -> DataFrame:
    """kind, class_name and detail. For one class: unknown field types and hidden methods nobody calls; for
    all: shared mutable fields, very large classes, long and stringly parameter lists."""
    c = base.code
    if name:
        known = c.types.select(F.col("name").alias("type")).unionAll(c.imports.select("simple")).distinct()
        odd = c.fields.where((F.col("class_name") == name) & ~F.col("type").isin(list(packs.COMMON_TYPES))).join(known, "type", "left_anti").select(F.lit("unknown_type").alias("kind"), "class_name", F.col("type").alias("detail"))
        called = base.edges.select(F.col("callee_class").alias("class_name"), F.col("callee_method").alias("name")).distinct()
        idle = c.methods.where((F.col("class_name") == name) & ~F.col("is_constructor") & ~F.array_contains("modifiers", "public")).join(called, ["class_name", "name"], "left_anti").select(F.lit("uncalled_method"), "class_name", "name")
        return odd.unionAll(idle).distinct()
    real = lambda df, col: df.where(~F.col(col).rlike("(Test|Tests|IT)$"))
    shared = real(c.fields, "class_name").where(F.array_contains("modifiers", "static") & ~F.array_contains("modifiers", "final")).select(F.lit("mutable_static").alias("kind"), "class_name", F.col("name").alias("detail"))
    god = real(c.types, "name").where((F.col("loc") > packs.GOD_LOC) | (F.col("n_methods") > packs.GOD_METHODS)).select(F.lit("god_class"), "name", F.col("loc").cast("string"))
    m = real(c.methods, "class_name")
    long = m.where(F.col("param_count") > packs.MAX_PARAMS).select(F.lit("long_parameters"), "class_name", "name")
    strings = m.where(F.size(F.filter("params.type", lambda t: t == "String")) >= 3).select(F.lit("string_parameters"), "class_name", "name")
    return shared.unionAll(god).unionAll(long).unionAll(strings)


# Aggregations


@command("hotspots")
def hotspots(base: CodeBase, limit: int = 30) -> DataFrame:
    """Classes by calls from outside, the classes that import them, and whether a test class is named after them."""
    counted = _external(base).groupBy(F.col("callee_class").alias("name")).agg(F.count("*").alias("callers"))
    known = base.code.types.where("NOT is_test").select("name").distinct().join(counted, "name")
    tested = base.code.types.where("is_test").select(F.regexp_replace("name", "(Test|Tests|IT)$", "").alias("name"), F.lit(True).alias("tested")).distinct()
    imported = base.code.imports.groupBy(F.col("simple").alias("name")).agg(F.countDistinct("fqn").alias("imported_by"))
    return rank.top(known.join(tested, "name", "left").join(imported, "name", "left").fillna(False, ["tested"]).fillna(0, ["imported_by"]), limit, F.desc("callers"), F.asc("name"))


TEST_NAME = "(Tests|Test|IT)$"


@command("test-coverage")
def test_coverage(base: CodeBase) -> DataFrame:
    """Test classes and other classes by name, how many of those have a test named after them, and their share in percent."""
    names = base.code.types.select("name").distinct().withColumn("is_test", F.col("name").rlike(TEST_NAME))
    tested = names.where("is_test").select(F.regexp_replace("name", TEST_NAME, "").alias("name"), F.lit(True).alias("tested")).distinct()
    counted = names.join(tested, "name", "left").agg(F.count_if(F.col("is_test")).alias("test_classes"), F.count_if(~F.col("is_test")).alias("production_classes"), F.count_if(F.col("tested") & ~F.col("is_test")).alias("tested_by_name"))
    share = F.when(F.col("production_classes") > 0, F.floor(100 * F.col("tested_by_name") / F.col("production_classes"))).otherwise(0)
    return counted.withColumn("percent", share.cast("long"))


@command("untested")
def untested(base: CodeBase, limit: int = 10) -> DataFrame:
    """Classes that others call most among those without a test named after them."""
    counted = _external(base).groupBy(F.col("callee_class").alias("name")).agg(F.count("*").alias("callers"))
    names = base.code.types.select("name").distinct()
    tested = names.where(F.col("name").rlike(TEST_NAME)).select(F.regexp_replace("name", TEST_NAME, "").alias("name"))
    return rank.top(names.where(~F.col("name").rlike(TEST_NAME)).join(tested, "name", "left_anti").join(counted, "name"), limit, F.desc("callers"), F.asc("name"))


@command("packages")
def packages(base: CodeBase, limit: int = 30) -> DataFrame:
    """Types, methods and internal dependencies of each package, and those it has a cycle with."""
    sized = base.code.types.groupBy("package").agg(F.count("*").alias("classes"), F.sum("n_methods").alias("methods"))
    uses = base.code.imports.where("NOT is_wildcard").select("fqn", scalars.package_of("import").alias("dst"))
    own = base.code.types.select("fqn", F.col("package").alias("src"))
    edges = uses.join(own, "fqn").where("src <> dst").join(sized.select(F.col("package").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    out = edges.groupBy(F.col("src").alias("package")).agg(F.count("*").alias("dependencies"))
    cycles = graph.two_cycles(edges)
    both = cycles.select(F.col("a").alias("package"), F.col("b").alias("other")).unionAll(cycles.select("b", "a")).groupBy("package").agg(F.array_sort(F.collect_set("other")).alias("cycles"))
    return rank.top(sized.join(out, "package", "left").join(both, "package", "left").fillna(0, ["dependencies"]), limit, F.desc("classes"), F.asc("package"))


@command("complexity")
def complexity(base: CodeBase, name: str) -> DataFrame:
    fan_out = base.edges.where(F.col("caller_class") == name).groupBy(F.col("caller_method").alias("name")).agg(F.countDistinct("callee_class", "callee_method").alias("fan_out"))
    fan_in = base.edges.where(F.col("callee_class") == name).groupBy(F.col("callee_method").alias("name")).agg(F.countDistinct("caller_class", "caller_method").alias("fan_in"))
    m = base.code.methods.where(F.col("class_name") == name).select("name", "signature", "loc", "complexity").join(fan_out, "name", "left").join(fan_in, "name", "left").fillna(0, ["fan_in", "fan_out"])
    both = F.col("fan_in") + F.col("fan_out")
    return m.withColumn("coupling", F.when(both > 30, "high").when(both > 10, "medium").otherwise("low")).orderBy(F.desc("loc"), "signature")


@command("complexity-all")
def complexity_all(base: CodeBase, limit: int = 30) -> DataFrame:
    return rank.top(base.code.methods.select("fqn", "signature", "loc", "complexity"), limit, F.desc("loc"), F.desc("complexity"), F.asc("fqn"), F.asc("signature"))


@command("patterns")
def patterns(base: CodeBase, limit: int = 5) -> DataFrame:
    """kind, name, n: loggers, injection, class suffixes, method prefixes and annotations most used, how nothing is
    handled, and exceptions of the project's own."""
    c = base.code
    logger = F.coalesce(*(F.when(F.startswith("import", F.lit(p)), p) for p in packs.LOGGERS))
    rows = c.imports.select("path", "import").distinct().withColumn("name", logger).where("name IS NOT NULL").select(F.lit("logging").alias("kind"), "name")
    rows = rows.unionAll(c.annotations.where(F.col("name").isin(list(packs.INJECTIONS))).select(F.lit("injection"), "name"))
    rows = rows.unionAll(c.types.select(F.lit("class_suffix"), scalars.class_suffix("name").alias("name")).where("name IS NOT NULL"))
    rows = rows.unionAll(c.methods.select(F.lit("method_prefix"), F.regexp_extract("name", "^([a-z]+)", 1).alias("name")).where(F.col("name").isin(list(packs.PREFIXES))))
    rows = rows.unionAll(c.annotations.select(F.lit("annotation"), "name"))
    rows = rows.unionAll(c.methods.where(F.startswith("return_type", F.lit("Optional"))).select(F.lit("null_handling"), F.lit("Optional")))
    rows = rows.unionAll(c.raw_edges.where("callee_method = 'requireNonNull'").select(F.lit("null_handling"), F.col("callee_method")))
    rows = rows.unionAll(c.types.where(F.contains("super_class", F.lit("Exception"))).select(F.lit("error_handling"), F.lit("custom exception")))
    return rank.top_within(rows.groupBy("kind", "name").agg(F.count("*").alias("n")), ["kind"], limit, F.desc("n"), F.asc("name")).orderBy("kind", "rank")


@command("layer-chains")
def layer_chains(base: CodeBase, limit: int = 5) -> DataFrame:
    """Sets of layer suffixes that two or more base names have in common."""
    suffix = F.coalesce(*(F.when(F.endswith("name", F.lit(s)), s) for s in packs.LAYER_SUFFIXES))
    named = base.code.types.select("name", suffix.alias("suffix")).where("suffix IS NOT NULL").withColumn("stem", F.expr("left(name, length(name) - length(suffix))")).where("stem <> ''")
    sets = named.groupBy("stem").agg(F.array_sort(F.collect_set("suffix")).alias("layers")).where("size(layers) >= 2")
    return rank.top(sets.groupBy("layers").agg(F.count("*").alias("n")).where("n >= 2"), limit, F.desc("n"), F.asc("layers"))


@command("style")
def style(base: CodeBase) -> DataFrame:
    """The majority habit of each kind."""
    found = patterns(base, 4)
    return found.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("habits"))


@command("debt")
def debt(base: CodeBase, limit: int = 20) -> DataFrame:
    """Debt score of each class, capped at 100, with the mean grade."""
    count = lambda df, alias: df.groupBy("class_name").agg(F.count("*").alias(alias))
    slow = _on_lines(base).select("path", "line_no", "rule_id").unionAll(_long(base).select("path", "line_no", "rule_id"))
    slow = count(_located(base, slow), "perf")  # methods that very many call are among the callers below
    in_calls = _external(base).groupBy(F.col("callee_class").alias("class_name")).agg(F.count("*").alias("callers"))
    tested = base.code.types.where("is_test").select(F.regexp_replace("name", "(Test|Tests|IT)$", "").alias("class_name"), F.lit(0).alias("untested")).distinct()
    t = base.code.types.where("NOT is_test").select(F.col("name").alias("class_name"), "fqn", "n_methods", "loc")
    for other in (count(smells(base), "smells"), slow, in_calls, tested):
        t = t.join(other, "class_name", "left")
    t = t.fillna(0, ["smells", "perf", "callers"]).fillna(15, ["untested"])
    score = 2 * F.col("smells") + F.least("n_methods", F.lit(30)) + 5 * F.col("perf") + F.least("callers", F.lit(50)) + F.col("untested") + F.floor(F.greatest(F.lit(0), F.col("loc") - 500) / 10)
    scored = t.select("fqn", F.least(F.lit(100), score).cast("int").alias("score"))
    mean = scored.agg(F.floor(F.avg("score")).cast("int")).scalar()
    return rank.top(scored, limit, F.desc("score"), F.asc("fqn")).withColumn("mean", mean).withColumn("grade", rank.grade(F.col("mean")))


#: Endings of names and the layers that they tell, and marks of frameworks in annotations or super classes.
LAYERS = {"Controller": "controller", "Service": "service", "Dao": "dao", "DAO": "dao", "Repository": "repository", "Mapper": "mapper", "DTO": "dto", "Dto": "dto", "Entity": "entity", "Config": "config", "Configuration": "config", "Filter": "filter", "Interceptor": "interceptor", "Listener": "listener"}
STACK = {"Spring": ("Controller", "Service", "Component"), "EJB": ("Stateless", "Stateful", "EJB"), "JPA": ("Entity", "Table")}
SWING = ("JPanel", "JFrame")
LEAST_INJECTED = 5  # classes with constructor parameters beyond which that is the convention


@command("tour")
def tour(base: CodeBase, limit: int = 10) -> DataFrame:
    """kind, name and n: sizes, where to begin reading, layers by names, conventions and frameworks by annotations."""
    t, none = base.code.types, F.lit(None).cast("long").alias("n")
    sizes = t.agg(F.countDistinct("path").alias("files"), F.count_if(~F.col("is_interface")).alias("classes"), F.count_if(F.col("is_interface")).alias("interfaces"), F.sum("n_methods").cast("long").alias("methods"), F.countDistinct(F.when(F.col("package") != "", F.col("package"))).alias("packages"))
    out = sizes.select(F.explode(F.array(*(F.struct(F.lit("size").alias("kind"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in sizes.columns))).alias("r")).select("r.*")
    mains = base.code.methods.where("name = 'main' AND array_contains(modifiers, 'static') AND array_contains(modifiers, 'public')").select(F.lit("main"), F.concat("fqn", F.lit(".main")).alias("name"), none).distinct()
    web = rank.top(t.where("name LIKE '%Controller'").select(F.lit("controller"), F.col("fqn").alias("name"), none), limit, F.asc("name"))
    core = hotspots(base, limit).select(F.lit("core"), "name", F.col("callers").alias("n"))
    layer = F.coalesce(*(F.when(F.endswith("name", F.lit(end)), F.lit(name)) for end, name in LAYERS.items()))
    layers = t.select(layer.alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("layer"), "name", "n")
    noted = lambda marks: F.exists("annotations", lambda a: _any_of(a["name"], marks))
    made = base.code.methods.where("is_constructor AND param_count > 0").agg(F.countDistinct("fqn").alias("n"))
    injection = made.select(F.lit("convention"), F.concat(F.lit("injection: "), F.when(F.col("n") > LEAST_INJECTED, "constructor").otherwise("unknown")).alias("name"), none)
    logging = t.agg(F.count_if(noted(("Slf4j",))).alias("n")).select(F.lit("convention"), F.concat(F.lit("logging: "), F.when(F.col("n") > 0, "slf4j").otherwise("unknown")).alias("name"), none)
    used = t.agg(*(F.bool_or(noted(marks)).alias(name) for name, marks in STACK.items()), F.bool_or(_any_of(F.col("name"), SWING) | F.contains("super_class", F.lit(SWING[0]))).alias("Swing"))
    stack = used.select(F.explode(F.array(*(F.when(F.col(c), F.lit(c)) for c in used.columns))).alias("name")).where("name IS NOT NULL").select(F.lit("stack"), "name", none)
    for part in (mains, web, core, layers, injection, logging, stack):
        out = out.unionAll(part)
    return out


def _any_of(text_: Column, marks: tuple[str, ...]) -> Column:
    out = F.contains(text_, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(text_, F.lit(m))
    return out


@command("api")
def api(base: CodeBase, package: str = "") -> DataFrame:
    """Public types outside tests and internals, with their public methods."""
    t = base.code.types.where(F.array_contains("modifiers", "public") & ~F.col("is_test") & F.startswith("package", F.lit(package)) & ~F.col("package").rlike(r"(^|\.)(internal|impl)(\.|$)"))
    m = base.code.methods.where("array_contains(modifiers, 'public') AND NOT is_constructor").groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct("signature", F.exists("annotations", lambda a: a["name"] == "Deprecated").alias("deprecated")))).alias("methods"))
    return t.select("package", "fqn", "kind").join(m, "fqn", "left").orderBy("package", "fqn")


@command("snippet")
def snippet(base: CodeBase, suffix: str) -> DataFrame:
    """The most representative class with a suffix: annotated, called and rich, with its public shape."""
    used = _external(base).groupBy(F.col("callee_class").alias("name")).agg(F.count("*").alias("callers"))
    found = base.code.types.where(F.endswith("name", F.lit(suffix)) & ~F.col("is_test")).join(used, "name", "left").fillna(0, ["callers"])
    best = rank.top(found, 1, F.desc(F.size("annotations")), F.desc("callers"), F.desc("n_methods"), F.asc("fqn")).select("fqn", "kind", "annotations")
    shape = base.code.methods.where("array_contains(modifiers, 'public')").groupBy("fqn").agg(F.array_sort(F.collect_list("signature")).alias("signatures"))
    return best.join(shape, "fqn", "left")


#: What a scaffold of each pattern holds.
SCAFFOLDS = {"service": "public class {0}Service {{\n}}\n", "controller": "public class {0}Controller {{\n}}\n", "repository": "public interface {0}Repository {{\n}}\n", "test": "class {0}Test {{\n}}\n", "record": "public record {0}() {{\n}}\n", "exception": "public class {0}Exception extends RuntimeException {{\n}}\n"}


@command("scaffold")
def scaffold(base: CodeBase, pattern: str, name: str) -> DataFrame:
    """A new source from a template, in the package where most such classes are."""
    home = base.code.types.where(F.lower("name").endswith(pattern)).groupBy("package").agg(F.count("*").alias("n"))
    best = rank.top(home, 1, F.desc("n"), F.asc("package")).select("package")
    seed = base.spark.createDataFrame([(SCAFFOLDS[pattern].format(name),)], "body string")
    return seed.join(best, F.lit(True), "left").select(F.concat(F.when(F.coalesce("package", F.lit("")) != "", F.concat(F.lit("package "), "package", F.lit(";\n\n"))).otherwise(""), "body").alias("source"))


@command("doc")
def doc(base: CodeBase, name: str) -> DataFrame:
    """Drafts of documentation from method names."""
    words = scalars.humanise("name")
    verb = F.regexp_extract("name", "^([a-z]+)", 1)
    rest = F.trim(F.regexp_replace(words, "^[a-z]+ ?", ""))
    lead = F.when(verb.isin("get", "find", "load", "read"), "Returns the ").when(verb == "set", "Sets the ").when(verb.isin("is", "has", "can"), "Whether it is ").when(verb.isin("create", "build", "make", "new"), "Makes a new ").when(verb.isin("delete", "remove"), "Removes the ").otherwise(F.concat(F.initcap(verb), F.lit("s ")))
    return base.code.methods.where((F.col("class_name") == name) & (F.col("javadoc") == "") & ~F.col("is_constructor")).select("signature", F.trim(F.concat(lead, rest)).alias("draft"))


# Architecture


def _with_layer(base: CodeBase) -> DataFrame:
    layers = base.config.get("layers") or []
    out = None
    for layer in layers:
        test = F.col("name").rlike(scalars.name_pattern(layer["glob"])) | F.col("fqn").rlike(scalars.name_pattern(layer["glob"]))
        if layer.get("annotations"):
            test = test | F.arrays_overlap("annotations.name", F.array(*map(F.lit, layer["annotations"])))
        out = F.when(test, layer["name"]) if out is None else out.when(test, layer["name"])
    return base.code.types.withColumn("layer", F.lit("none") if out is None else out.otherwise("none"))


@command("layer")
def layer(base: CodeBase, name: str) -> DataFrame:
    return _with_layer(base).where(F.col("layer") == name).select("fqn", "path").orderBy("fqn")


@command("check")
def check(base: CodeBase, rule_id: str | None = None) -> DataFrame:
    """rule_id, fqn and detail of each break of the project's rules, and of the built-in one on internals."""
    t = _with_layer(base)
    out = base.code.imports.where("import LIKE '%.internal.%'").select(F.lit("internal-import").alias("rule_id"), "fqn", F.col("import").alias("detail"))
    for rule in base.config.get("rules") or []:
        own = t.where(F.col("layer") == (rule.get("from") or rule.get("layer")))
        names = rule.get("deny_import") or []
        if names:
            out = out.unionAll(own.select(F.lit(rule["id"]), "fqn", F.explode("imports").alias("i")).where(F.size(rules.denied(F.col("i"), names)) > 0).select(F.lit(rule["id"]), "fqn", "i"))
            typed = base.code.fields.join(own.select("fqn"), "fqn", "left_semi").where(F.col("type").isin(names))
            out = out.unionAll(typed.select(F.lit(rule["id"]), "fqn", "type"))
        if rule.get("deny_annotation"):
            out = out.unionAll(own.select(F.lit(rule["id"]), "fqn", F.explode("annotations.name").alias("a")).where(F.col("a").isin(rule["deny_annotation"])).select(F.lit(rule["id"]), "fqn", "a"))
        if rule.get("require") == "constructor-injection":
            given = base.code.methods.where("is_constructor AND param_count > 0").select("fqn").distinct()
            out = out.unionAll(own.where("NOT is_interface AND n_fields > 0").join(given, "fqn", "left_anti").select(F.lit(rule["id"]), "fqn", F.lit("no constructor parameters")))
    out = out.distinct()
    return out.where(F.col("rule_id") == rule_id) if rule_id else out


@command("drift")
def drift(base: CodeBase) -> DataFrame:
    return check(base).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


@command("endpoints")
def endpoints(base: CodeBase) -> DataFrame:
    """verb, path, class_name, method of mapped methods."""
    value = lambda a: F.coalesce(F.element_at(a, "value"), F.element_at(a, "path"))
    mapped = base.code.methods.select("class_name", F.col("name").alias("method"), F.explode("annotations").alias("a")).where(F.col("a.name").isin(list(packs.VERBS)))
    roots = base.code.annotations.where("owner_kind = 'class' AND name = 'RequestMapping'").groupBy("class_name").agg(F.min(value(F.col("attrs"))).alias("root"))
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), '"', "")
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in packs.VERBS.items() for x in kv]), F.col("a.name"))
    joined = mapped.join(roots, "class_name", "left")
    return joined.select(verb.alias("verb"), scalars.combine_path(clean(F.col("root")), clean(value(F.col("a.attrs")))).alias("path"), "class_name", "method").orderBy("path", "verb", "class_name", "method")


@command("entry-points")
def entry_points(base: CodeBase, package: str = "") -> DataFrame:
    """kind, fqn, method: rest, main, scheduled and listener methods."""
    m = base.code.methods.where(F.startswith("package", F.lit(package)))
    has = lambda names: F.exists("annotations", lambda a: a["name"].isin(list(names)))
    out = m.where(has(packs.REST)).select(F.lit("rest").alias("kind"), "fqn", F.col("name").alias("method"))
    out = out.unionAll(m.where("name = 'main' AND array_contains(modifiers, 'static') AND param_count <= 1").select(F.lit("main"), "fqn", "name"))
    out = out.unionAll(m.where(has(packs.SCHEDULED)).select(F.lit("scheduled"), "fqn", "name"))
    faces = base.code.types.where(F.exists("interfaces", lambda i: F.substring_index(i, "<", 1).rlike("(Listener|Handler|Consumer)$"))).select("fqn")
    by_type = m.join(faces, "fqn", "left_semi").where(F.col("name").rlike("^(on[A-Z].*|handle.*|process.*|accept|receive.*)$"))
    return out.unionAll(m.where(has(packs.LISTENERS)).select(F.lit("listener"), "fqn", "name")).unionAll(by_type.select(F.lit("listener"), "fqn", "name")).distinct()


# Snapshots, files and runtime


@command("diff")
def diff_(base: CodeBase, previous: DataFrame) -> DataFrame:
    """path and status against an earlier facts or files table, unchanged files left out."""
    now = base.code.facts.select("path", "content_hash")
    return diff.compare(previous.select("path", "content_hash"), now, "path").where("status <> 'same'").orderBy("path")


@command("changed")
def changed(base: CodeBase, repository: str, ref: str = "HEAD") -> DataFrame:
    from ..sources.git import changed_files

    return changed_files(base.spark, repository, ref)


@command("history")
def history(base: CodeBase, repository: str, path: str) -> DataFrame:
    """Commits, authors, last date and five messages of a file."""
    from ..sources.git import log

    rows = log(base.spark, repository, path)
    recent = rows.orderBy(F.desc("at"), "commit").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.unix_timestamp("at").alias("t"), "message"))), lambda x: x["message"]).alias("messages"))
    return rows.agg(F.count("*").alias("commits"), F.array_sort(F.collect_set("author")).alias("authors"), F.max("at").alias("last")).crossJoin(recent)  # single rows


@command("index")
def index(base: CodeBase, path: str) -> DataFrame:
    """Store the facts as the next version of a store, with flat tables and resolved edges, and count what is stored."""
    from ..sources import store

    store.put(base.spark, base.code.facts, path, base.config.get("invokers"))
    return dump(CodeBase(Code(store.load(base.spark, path))))


@command("dump")
def dump(base: CodeBase) -> DataFrame:
    return base.code.facts.agg(F.count("*").alias("files"), F.sum(F.size("types")).alias("types"), F.sum(F.size("edges")).alias("edges"), F.sum(F.length("content")).alias("chars"), F.count("error").alias("errors"))


@command("batch")
def batch(base: CodeBase, requests: list[tuple[str, dict]]) -> DataFrame:
    """Several commands in one result: place, command and each row as JSON. Nothing runs before the result does."""
    out = None
    for place, (name, arguments) in enumerate(requests):
        df = COMMANDS[name](base, **arguments)
        rows = df.select(F.lit(place).alias("place"), F.lit(name).alias("command"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = rows if out is None else out.unionAll(rows)
    return out if out is not None else base.spark.createDataFrame([], "place int, command string, row string")


@command("profile")
def profile_(base: CodeBase, recording: DataFrame, section: str = "hot", top: int = 20) -> DataFrame:
    from . import profile

    return profile.summaries(profile.events_of(recording), top)[section]


@command("correlate")
def correlate(base: CodeBase, recording: DataFrame, top: int = 20) -> DataFrame:
    """The methods sampled most, the files of their classes (by simple name) and the smells found there; null
    where nothing confirms a method."""
    from . import profile

    hot = profile.summaries(profile.events_of(recording), top)["hot"].withColumn("class_name", F.element_at(F.split(F.substring_index("method", ".", -2), "[.$]"), 1))
    files = base.code.types.select(F.col("name").alias("class_name"), "path").distinct()
    found = smells(base).groupBy("path").agg(F.array_sort(F.collect_set("rule_id")).alias("smells"))
    joined = hot.join(files, "class_name", "left").join(found, "path", "left")
    return joined.select("method", "samples", "pct", "path", "smells", F.col("smells").isNotNull().alias("confirmed")).orderBy(F.desc("samples"), "method", "path")


@command("heap-analyze")
def heap_analyze(base: CodeBase, before: DataFrame, after: DataFrame, least: int = 10) -> DataFrame:
    from . import profile

    return profile.heap_growth(before, after, least).orderBy(F.desc("byte_growth"), "class_name")


def project(df: DataFrame, fields: str) -> DataFrame:
    """Only the listed columns, in their order; unknown names are ignored."""
    return df.select(*[f.strip() for f in fields.split(",") if f.strip() in df.columns])
