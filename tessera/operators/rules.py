"""Rule packs as data and one plan that evaluates them.

A rule is a set of literal tests and at most one regular expression on a line. A pack becomes one
array expression, so all rules are evaluated in a single pass over the lines, in generated
code, without a join; only lines that some rule matches leave the scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import name_pattern

#: Severities from worst to least.
SEVERITIES = ("CRITICAL", "ERROR", "WARNING", "INFO")


class Rule(NamedTuple):
    pack: str
    rule_id: str
    severity: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    also_any: tuple[str, ...] = ()
    regex: str = ""
    either: bool = False  # the literals or the expression, instead of both
    fold: bool = False  # any_of is tested on the lower-case line
    since: int = 0  # the language version from which the rule applies
    category: str = ""
    message: str = ""


def holds(rule: Rule, line: Column) -> Column:
    """Whether a line matches."""
    has = lambda words, text=line: [F.contains(text, F.lit(w)) for w in words]
    every = []
    if rule.any_of:
        every.append(_any(has(rule.any_of, F.lower(line) if rule.fold else line)))
    if rule.also_any:
        every.append(_any(has(rule.also_any)))
    every += has(rule.all_of)
    every += [~c for c in has(rule.none_of)]
    literal = _all(every) if every else None
    if not rule.regex:
        return literal if literal is not None else F.lit(False)
    matched = line.rlike(f"^(?:{rule.regex})$")
    if literal is None:
        return matched
    return literal | matched if rule.either else literal & matched


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


COMMENT = r"^(//|\*|/\*)"


def _trimmed(line: Column) -> Column:
    return F.trim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))  # plain searches: an optimiser may write it into every test of a line


def in_some_line(content: str, pack: list[Rule], target: int | None = None, skip_comments: bool = True) -> Column:
    """Whether scan() finds something in a line of a whole text."""
    chosen = [r for r in pack if target is None or r.since <= target]
    hit = lambda line: _any([holds(r, line) for r in chosen]) & (~line.rlike(COMMENT) if skip_comments else F.lit(True))
    return F.exists(F.transform(F.split(content, "\n"), _trimmed), hit) if chosen else F.lit(False)


def scan(lines: DataFrame, pack: list[Rule], target: int | None = None, skip_comments: bool = True, text: str = "text") -> DataFrame:
    """Columns of lines and rule_id, severity, category and message of each match.

    Lines are trimmed; with skip_comments those that begin like a comment are left out. With a target
    only rules that apply to that version count."""
    chosen = [r for r in pack if target is None or r.since <= target]
    trimmed = _trimmed(F.col(text))
    told = [F.when(holds(r, F.col("__line")), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.message).alias("message"))) for r in chosen]
    if not told:
        return lines.select("*", *(F.lit("").alias(c) for c in ("rule_id", "severity", "category", "message"))).limit(0)
    marked = lines.withColumn("__line", trimmed)
    if skip_comments:
        marked = marked.where(~F.col("__line").rlike(COMMENT))
    found = marked.withColumn("__hits", F.array_compact(F.array(*told))).where(F.size("__hits") > 0)
    return found.withColumn("__hit", F.explode("__hits")).select(*(F.col(c) for c in lines.columns), "__hit.*")


def severity_order(column: str) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(column)).asc()


def first_layer(name: Column, layers: list[tuple[str, str]], other: str = "none") -> Column:
    """The name of the first layer, in the given order, whose pattern matches."""
    out = None
    for layer, glob in layers:
        test = name.rlike(name_pattern(glob))
        out = F.when(test, layer) if out is None else out.when(test, layer)
    return F.lit(other) if out is None else out.otherwise(other)


def denied(name: Column, names: list[str]) -> Column:
    """Which denied names a text holds."""
    return F.filter(F.array(*map(F.lit, names)), lambda d: F.contains(name, d))
