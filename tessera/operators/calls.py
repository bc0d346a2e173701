"""Raw call edges to resolved ones, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import erase, package_of, simple_name
from ..sources.code import Code
from .cut import wide
from .resolve import resolve_markers

#: Suffixes taken from a caller's name before a reflective target is built.
CALLER_SUFFIXES = ("Controller", "Action", "Servlet", "Handler", "Listener", "Command")


def members_by_path(code: Code) -> DataFrame:
    """owner, member, type and path: fields by name, methods by name and `()`; void methods have none."""
    fields = code.fields.select(F.col("class_name").alias("owner"), F.col("name").alias("member"), simple_name(erase("type")).alias("type"), "path")
    returns = code.methods.where("NOT is_constructor AND return_type NOT IN ('void', '')")
    return fields.unionAll(returns.select(F.col("class_name").alias("owner"), F.concat("name", F.lit("()")).alias("member"), simple_name(erase("return_type")).alias("type"), "path"))


def members(code: Code) -> DataFrame:
    return members_by_path(code).drop("path")


def reflective_edges(code: Code, invokers: list[dict]) -> DataFrame:
    """Edges of configured invoker calls: {method, target_arg, prefix}. The literal at target_arg, with a
    capital, follows the prefix and the caller's class without its suffix."""
    out = None
    for rule in invokers:
        base = F.regexp_replace("class_name", f"({'|'.join(rule.get('caller_suffixes') or CALLER_SUFFIXES)})$", "")
        literal = F.element_at("literals", rule.get("target_arg", 0) + 1)
        target = F.concat(F.lit(rule.get("prefix", "")), base)
        rows = code.invocations.where((F.col("callee") == rule["method"]) & (F.size("literals") > rule.get("target_arg", 0)) & literal.isNotNull())
        rows = rows.select("path", F.col("class_name").alias("caller_class"), F.col("method").alias("caller_method"), F.lit(-1).alias("caller_arity"), target.alias("callee_class"), literal.alias("callee_method"), "line", F.lit(-1).alias("arg_count"))
        out = rows if out is None else out.unionAll(rows)
    return out if out is not None else code.raw_edges.limit(0)


PLACE = ["path", "caller_class", "caller_method", "caller_arity", "line"]  # calls of one place are resolved together


def _by_results(edges: DataFrame, known_members: DataFrame, declared: DataFrame, trace: bool) -> DataFrame:
    """Calls on unknown classes that stand on a line with a known call whose result declares their method go to
    the class of that result; the first by name of several."""
    results = known_members.where(F.endswith("member", F.lit("()"))).select(F.col("owner").alias("callee_class"), F.expr("left(member, length(member) - 2)").alias("callee_method"), F.col("type").alias("__result")).distinct()
    mates = edges.where("callee_class <> '?'")
    known = mates.join(wide(results), ["callee_class", "callee_method"]).select(*PLACE, "__result").distinct()
    fits = declared.select(F.col("class_name").alias("__result"), F.col("name").alias("callee_method")).distinct()
    asked = edges.where("callee_class = '?'").select(*PLACE, "callee_method").distinct()
    found = asked.join(wide(known), PLACE).join(wide(fits), ["__result", "callee_method"], "left_semi").groupBy(*PLACE, "callee_method").agg(F.min("__result").alias("__result"))
    looked = edges.join(wide(found), [*PLACE, "callee_method"], "left")
    chosen = F.when(F.col("callee_class") == "?", F.coalesce("__result", F.lit("?"))).otherwise(F.col("callee_class"))
    if trace:
        through = mates.groupBy(*PLACE).agg(F.collect_set(F.concat("callee_class", F.lit("."), "callee_method", F.lit("()"))).alias("__mates"))  # calls of one line
        looked = looked.join(wide(through), PLACE, "left")
        more = F.when(F.col("callee_class") == "?", F.concat(F.coalesce("__mates", F.array().cast("array<string>")), F.array(F.concat(F.lit("*."), "callee_method")))).otherwise(F.array().cast("array<string>"))
        looked = looked.withColumn("uses", F.concat("uses", more))
    return looked.withColumn("callee_class", chosen).select(*edges.columns)


def qualify(code: Code, uses: DataFrame) -> DataFrame:
    """uses (fqn of a class, simple type named in it) with `qualified`: by an import of that name, else the first of
    a package imported whole, else of its own package, else the only type of that name, else as it stands."""
    asked = uses.select("fqn", "type").distinct()
    imports = code.imports.select("fqn", "import", "simple", "is_wildcard").distinct()
    named = imports.where("NOT is_wildcard").groupBy("fqn", F.col("simple").alias("type")).agg(F.min("import").alias("__named"))
    whole = imports.where("is_wildcard").select("fqn", package_of("import").alias("__package"), F.lit(True).alias("__whole")).distinct()
    known = code.types.select(F.col("name").alias("type"), F.col("fqn").alias("__known"), F.col("package").alias("__package")).distinct()
    met = asked.join(known, "type", "left").join(whole, ["fqn", "__package"], "left")
    pick = lambda test: F.min(F.when(test, F.col("__known")))
    ways = met.groupBy("fqn", "type").agg(pick(F.col("__whole")).alias("__wild"), pick(F.col("__package") == package_of("fqn")).alias("__own"), F.when(F.countDistinct("__known") == 1, F.min("__known")).alias("__only"))
    best = F.when(F.instr("type", ".") > 0, F.col("type")).otherwise(F.coalesce("__named", "__wild", "__own", "__only", "type"))
    return ways.join(named, ["fqn", "type"], "left").select("fqn", "type", best.alias("qualified"))


def declarations(code: Code) -> DataFrame:
    return code.methods.select("class_name", "name", "param_count").distinct()


def raw_edges(code: Code, invokers: list[dict] | None = None) -> DataFrame:
    return code.raw_edges.unionByName(reflective_edges(code, invokers)) if invokers else code.raw_edges


def resolve(code: Code, invokers: list[dict] | None = None) -> DataFrame:
    """Distinct caller_class, caller_method, caller_arity, callee_class, callee_method, callee_arity, line, path.

    Markers are resolved against declared members; a call on an unknown class goes to the result of a call on the
    same line that declares its method, else to the one class that does, if there is exactly one, else stays `?`. The arity is that of a declared overload
    with as many parameters as arguments, else of the smallest declared one, else -1."""
    return resolve_raw(raw_edges(code, invokers), members(code), declarations(code))


def resolve_raw(raw: DataFrame, known_members: DataFrame, declared: DataFrame, trace: bool = False) -> DataFrame:
    """resolve() of some raw edges against the members and declared methods of a code base.

    With `trace`, `uses` lists the names that each edge was resolved through, found or not: `Owner.member` for a member
    on its way or a result of a call on its line, `*.method` where all classes that declare the method count,
    `Class.method#` for the arity. An edge can change only if its raw form, one of these or a call of its place does."""
    if trace:
        raw = raw.withColumn("uses", F.array().cast("array<string>"))
    marked = raw.where(F.instr("callee_class", "?") > 1)
    plain = raw.where(F.instr("callee_class", "?") <= 1)
    distinct = marked.select("callee_class").distinct().select("callee_class", F.substring_index("callee_class", "?", 1).alias("owner"), F.regexp_extract("callee_class", r"^[^?]*(\?.*)$", 1).alias("marker"))
    known = resolve_markers(distinct, known_members, trace=trace).select("callee_class", F.col("type").alias("__type"), *([F.col("trace").alias("__trace")] if trace else []))
    looked = marked.join(wide(known), "callee_class", "left").withColumn("callee_class", F.coalesce("__type", F.lit("?")))
    if trace:
        looked = looked.withColumn("uses", F.coalesce("__trace", "uses"))
    edges = plain.unionByName(looked.select(*plain.columns))
    edges = _by_results(edges, known_members, declared, trace)
    owners = declared.groupBy(F.col("name").alias("callee_method")).agg(F.countDistinct("class_name").alias("__n"), F.min("class_name").alias("__only")).where("__n = 1").drop("__n")
    edges = edges.join(wide(owners), "callee_method", "left").withColumn("callee_class", F.when((F.col("callee_class") == "?") & F.col("__only").isNotNull(), F.col("__only")).otherwise(F.col("callee_class"))).drop("__only")
    arities = declared.groupBy(F.col("class_name").alias("callee_class"), F.col("name").alias("callee_method")).agg(F.collect_set("param_count").alias("__arities"))
    edges = edges.join(wide(arities), ["callee_class", "callee_method"], "left")
    arity = F.when(F.array_contains("__arities", F.col("arg_count")), F.col("arg_count")).otherwise(F.coalesce(F.array_min("__arities"), F.lit(-1)))
    out = edges.select("caller_class", "caller_method", "caller_arity", "callee_class", "callee_method", arity.alias("callee_arity"), "line", "path", *([F.concat("uses", F.array(F.concat("callee_class", F.lit("."), "callee_method", F.lit("#")))).alias("uses")] if trace else []))
    return out.distinct() if not trace else out.groupBy([c for c in out.columns if c != "uses"]).agg(F.array_distinct(F.flatten(F.collect_set("uses"))).alias("uses"))


def changed_names(old: Code, new: Code) -> DataFrame:
    """key: the names, as in `uses`, whose meaning differs between two states of some files."""
    one, two = members(old), members(new)
    differ = one.exceptAll(two).unionAll(two.exceptAll(one)).select(F.concat_ws(".", "owner", "member").alias("key"))
    one, two = declarations(old), declarations(new)
    declared = one.exceptAll(two).unionAll(two.exceptAll(one))
    named = declared.select(F.explode(F.array(F.concat(F.lit("*."), "name"), F.concat("class_name", F.lit("."), "name", F.lit("#")))).alias("key"))
    return differ.unionAll(named).distinct()


def node(cls: str, method: str, arity: str):
    return F.concat_ws("/", F.concat_ws(".", cls, method), F.col(arity).cast("string"))


def as_graph(edges: DataFrame) -> DataFrame:
    """src and dst named `Class.method/arity`, and line."""
    return edges.select(node("caller_class", "caller_method", "caller_arity").alias("src"), node("callee_class", "callee_method", "callee_arity").alias("dst"), "line")
