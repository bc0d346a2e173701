"""Commands by name: one request at a time or a line protocol, with validation and timing."""

from __future__ import annotations

import inspect
import json
import re
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.commands import COMMANDS, CodeBase, project

#: The most edits between a name and the one suggested for it.
MAX_EDITS = 3
_IDENTIFIER = re.compile(r"[\w$.<>\[\],?() *:/#;|-]*")


def edits(a: str, b: str) -> int:
    """Levenshtein distance of two short names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def closest(name: str, known: Iterable[str]) -> str | None:
    """The known name with the fewest edits, if they are few; the first by name of equals."""
    best = min(((edits(name, k), k) for k in known), default=(MAX_EDITS + 1, ""))
    return best[1] if best[0] <= MAX_EDITS else None


def closest_class(base: CodeBase, name: str) -> DataFrame:
    """The class whose name has the fewest edits, fewer than four, from a wrong one."""
    near = base.code.types.select("name", F.levenshtein("name", F.lit(name), MAX_EDITS).alias("edits")).where("edits >= 0")
    return near.groupBy().agg(F.min_by("name", F.struct("edits", "name")).alias("name")).where("name IS NOT NULL")


def resolve_class(base: CodeBase, name: str) -> DataFrame:
    """status (found, ambiguous or missing) and the sorted candidates: by qualified name, else by simple name."""
    exact, simple = F.col("fqn") == name, F.col("name") == name.rpartition(".")[2]
    seen = base.code.types.agg(F.array_sort(F.collect_set(F.when(exact, F.col("fqn")))).alias("exact"), F.array_sort(F.collect_set(F.when(simple, F.col("fqn")))).alias("simple"))
    chosen = F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("simple"))
    status = F.when(F.size("candidates") == 0, "missing").when(F.size("candidates") == 1, "found").otherwise("ambiguous")
    return seen.select(chosen.alias("candidates")).select(status.alias("status"), "candidates")


def check_input(text: str) -> str | None:
    """What is wrong with an argument: control characters, a path that climbs, or characters no name has."""
    if any(ord(c) < 32 for c in text):
        return "control characters"
    if ".." in text.split("/"):
        return "a path may not climb"
    return None if _IDENTIFIER.fullmatch(text) else "unexpected characters"


def answer(base: CodeBase, name: str, arguments: dict | None = None, fields: str = "", limit: int = 1000) -> dict:
    """The rows of a command as plain values (at most `limit`, with `truncated`), or an error, and the time taken."""
    began = time.perf_counter()
    fn = COMMANDS.get(name)
    if fn is None:
        near = closest(name, COMMANDS)
        return {"error": f"unknown command {name}" + (f", did you mean {near}?" if near else "")}
    arguments = arguments or {}
    for value in arguments.values():
        if isinstance(value, str) and (problem := check_input(value)) and name not in ("search", "context-for"):
            return {"error": problem}
    try:
        inspect.signature(fn).bind(base, **arguments)
    except TypeError as problem:
        return {"error": str(problem)}
    df = fn(base, **arguments)
    df = project(df, fields) if fields else df
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).limit(limit + 1).collect()]
    return {"command": name, "rows": rows[:limit], "truncated": len(rows) > limit, "elapsed_ms": round(1000 * (time.perf_counter() - began))}


def serve(base: CodeBase, lines: Iterable[str], say: Callable[[str], None]) -> int:
    """Answer requests `{"command": ..., "arg": ...}` or `{"command": ..., "args": {...}}`, one a line, until
    `quit` or `exit`. A bad line gets an error and does not end the loop. Returns how many were answered."""
    count = 0
    for line in lines:
        line = line.strip()
        if line in ("quit", "exit"):
            break
        if not line:
            continue
        count += 1
        try:
            request = json.loads(line)
            name = request["command"]
            arguments = dict(request.get("args") or {})
            if "arg" in request and name in COMMANDS:
                first = [*inspect.signature(COMMANDS[name]).parameters][1:2]
                arguments |= dict.fromkeys(first, request["arg"])
            out = answer(base, name, arguments, request.get("fields", ""))
        except (ValueError, KeyError, TypeError, AttributeError) as problem:
            out = {"error": f"{type(problem).__name__}: {problem}"}
        say(json.dumps(out))
    return count


#: What is worth asking after a command; `{0}` stands for its first argument.
HINTS = {
    "overview": ("packages", "hotspots", "entry-points"), "summary": ("read {0}", "callers {0}", "related {0}"), "callers": ("call-chain {0}", "impact {0}", "test-for {0}"),
    "impact": ("test-for {0}", "breaking-changes {0}"), "search": ("find", "scope"), "smells": ("smells-all", "debt"), "hierarchy": ("implements {0}", "breaking-changes {0}"), "unused": ("lint", "api"),
}


def hints(name: str, argument: str = "") -> list[str]:
    """Commands that often follow."""
    return [h.format(argument).strip() for h in HINTS.get(name, ())]


def watch(spark, roots: list[str], facts_path: str, lines: Iterable[str], say: Callable[[str], None], config: dict | None = None) -> int:
    """serve() over stored facts that are brought up to the files before each request: folders are listed
    anew every time, so new files are seen; only those with a new time or length are read, only changed ones parsed."""
    from ..sources.store import open_code, refresh_roots

    count = 0
    for line in lines:
        if line.strip() in ("quit", "exit"):
            break
        refresh_roots(spark, roots, facts_path, (config or {}).get("invokers"))
        count += serve(CodeBase(open_code(spark, facts_path), config), [line], say)
    return count
