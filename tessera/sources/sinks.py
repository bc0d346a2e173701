"""Results as JSON rows, Markdown and Mermaid text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, in column `json`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A table of the first rows, for people; `limit` bounds what comes to the driver."""
    rows = df.limit(limit).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(cell(v) for v in r)} |" for r in rows])


def text_table(df: DataFrame, limit: int = 100) -> str:
    """The first rows in aligned columns, for a terminal; `limit` bounds what comes to the driver."""
    rows = [df.columns, *([str("" if v is None else v).replace("\n", " ") for v in r] for r in df.limit(limit).collect())]
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return "\n".join("  ".join(cell.ljust(w) for cell, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def _id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9]", "_")


def mermaid_sequence(chains: DataFrame, chain: str = "chain") -> DataFrame:
    """A sequence diagram of each chain `A.a -> B.b`, in column `diagram`."""
    parts = F.split(chain, " -> ")
    cls = lambda c: F.substring_index(c, ".", 1)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("  "), cls(F.element_at(parts, i)), F.lit("->>"), cls(F.element_at(parts, i + 1)), F.lit(": "), F.substring_index(F.element_at(parts, i + 1), ".", -1)))
    body = F.when(F.size(parts) > 1, F.concat(F.lit("\n"), F.array_join(steps, "\n"))).otherwise("")
    return chains.withColumn("diagram", F.concat(F.lit("sequenceDiagram"), body))


def mermaid_flowchart(edges: DataFrame) -> DataFrame:
    """Flowchart lines of an edge table: one row an edge, in column `line`, under a `flowchart` heading."""
    return edges.select("src", "dst").distinct().select(F.concat(F.lit("  "), _id(F.col("src")), F.lit('["'), "src", F.lit('"] --> '), _id(F.col("dst")), F.lit('["'), "dst", F.lit('"]')).alias("line"))
