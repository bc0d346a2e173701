"""Class specifications from Markdown."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "class_name string, name string, signature string, throws array<string>, annotations array<string>"


def parse_spec(text: str) -> list[tuple]:
    """`# Class` opens a class, `### signature` or a bullet with a signature in backticks a method; below it
    bullets name what it throws and its annotations."""
    rows, cls, now = [], "", None
    for line in text.splitlines():
        line = line.strip()
        head = re.match(r"#\s+(?:Class:?\s*)?`?(\w+)`?\s*$", line)
        method = re.match(r"###\s+`?(.+?)`?\s*$", line) or re.match(r"[-*]\s+`([^`]*\([^`]*\)[^`]*)`\s*$", line)
        if head:
            cls = head[1]
        elif method:
            name = re.search(r"(\w+)\s*\(", method[1])
            now = (cls, name[1] if name else method[1].split()[-1], method[1], [], [])
            rows.append(now)
        elif now and (said := re.match(r"[-*]\s+(?:\*\*)?throws:?(?:\*\*)?:?\s*(.+)$", line, re.I)):
            now[3].extend(re.findall(r"\w+", said[1]))
        elif now and re.match(r"[-*]\s", line):
            now[4].extend(re.findall(r"@(\w+)", line))
    return rows


def read_spec(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_spec(text), SCHEMA)
