"""Scalar expressions; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_name(name: str | Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(_c(name), ".", -1)


def package_of(name: str | Column) -> Column:
    """What precedes the last dot, or nothing."""
    return F.when(F.instr(_c(name), ".") == 0, "").otherwise(F.regexp_replace(_c(name), r"\.[^.]*$", ""))


def erase(type_name: str | Column) -> Column:
    """A type without its type arguments and array brackets."""
    return F.regexp_replace(F.regexp_replace(_c(type_name), "<.*", ""), r"\[\]|\.\.\.", "")


def glob_pattern(glob: str) -> str:
    """`**` is any text, `*` any text without a slash or dot-free of meaning; the rest is literal."""
    out = []
    for piece in re.split(r"(\*\*|\*)", glob):
        out.append(".*" if piece == "**" else "[^/]*" if piece == "*" else re.escape(piece))
    return "^" + "".join(out) + "$"


def name_pattern(glob: str) -> str:
    """A glob on names, where `*` is any text."""
    return "^" + ".*".join(re.escape(x) for x in glob.split("*")) + "$"


def complexity(loc: str | Column) -> Column:
    """An estimate from length: a fifth of the lines, at least 1."""
    return F.greatest(F.lit(1), F.floor(_c(loc) / 5)).cast("int")


def combine_path(base: Column, rest: Column) -> Column:
    """Two parts of a path with one slash before each that is not empty; `/` for nothing."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    joined = F.concat(F.when(clean(base) != "", F.concat(F.lit("/"), clean(base))).otherwise(""), F.when(F.regexp_replace(rest, "^/+", "") != "", F.concat(F.lit("/"), F.regexp_replace(rest, "^/+", ""))).otherwise(""))
    return F.when(joined == "", "/").otherwise(joined)


def humanise(name: str | Column) -> Column:
    """camelCase to lower-case words."""
    return F.lower(F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1 $2"))


def abbreviate_package(name: str | Column) -> Column:
    """The first letter of each part of a package."""
    return F.array_join(F.transform(F.split(_c(name), r"\."), lambda p: F.substring(p, 1, 1)), ".")


def camel_words(name: str | Column) -> Column:
    """The capitalised words of a name."""
    return F.regexp_extract_all(_c(name), F.lit("([A-Z][a-z0-9]*)"), 1)


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def age_bucket(days: str | Column) -> Column:
    """Whole years, months or days since, as text."""
    d = _c(days)
    return F.when(d > 365, F.concat(F.floor(d / 365).cast("string"), F.lit("y"))).when(d > 30, F.concat(F.floor(d / 30).cast("string"), F.lit("mo"))).otherwise(F.concat(d.cast("string"), F.lit("d")))


#: The longest suffix of two words.
LONGEST_SUFFIX = 20


def class_suffix(name: str | Column) -> Column:
    """The last word of a camel-case name, with the word before it where that is letters only and both are short;
    null for a name of one word or a last word of one letter."""
    words = F.split(F.regexp_replace(_c(name), "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "|"), r"\|")
    last, before = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    both = F.concat(before, last)
    return F.when((F.size(words) < 2) | (F.length(last) < 2), None).when((F.size(words) > 2) & before.rlike("^[A-Za-z]+$") & (F.length(both) <= LONGEST_SUFFIX), both).otherwise(last)


def display_name(cls: str | Column, method: str | Column, arity: str | Column) -> Column:
    """`Class.method()`, with the number of parameters where one is known."""
    n = _c(arity)
    return F.concat(_c(cls), F.lit("."), _c(method), F.when(n > 1, F.concat(F.lit("("), n.cast("string"), F.lit(" params)"))).when(n == 1, "(1 param)").otherwise("()"))


#: Words and library calls that a reading of calls from a line leaves out.
NOT_CALLED = (
    "System.out", "System.err", "System.in", "if", "for", "while", "switch", "catch", "return", "throw", "new", "super",
    "String.format", "String.valueOf", "Integer.parseInt", "Long.parseLong", "Objects.requireNonNull", "Optional.of", "Optional.empty", "Optional.ofNullable",
    "List.of", "List.copyOf", "Set.of", "Set.copyOf", "Map.of", "Map.entry", "Collections.emptyList", "Collections.emptyMap", "Collections.unmodifiableMap",
    "Math.max", "Math.min", "Arrays.asList",
)


def calls_in(line: str | Column) -> Column:
    """Calls written in a line, by patterns alone: `a.b`, then bare names as `this.name`."""
    left_out = F.array(*map(F.lit, NOT_CALLED))
    kept = lambda pattern, wanted: F.filter(F.regexp_extract_all(_c(line), F.lit(pattern), 1), lambda c: ~F.array_contains(left_out, c) & c.rlike(wanted))
    bare = F.transform(kept(r"(?<![.\w])(\w+)\s*\(", "^[^A-Z]."), lambda c: F.concat(F.lit("this."), c))
    return F.concat(kept(r"(\w+\.\w+)\s*\(", r"^\w*[^\d.]"), bare)
