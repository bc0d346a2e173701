"""Methods cut from source text by bracket matching, for text that need not parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_HIDDEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?', re.S)
_NOT_DECLARED = frozenset("new return else throw case assert yield".split())  # words after which a name with brackets is a call
_TAIL = re.compile(r"\s*(?:throws\s+[\w.,\s@<>]+?)?\s*\{")
_WORD_BEFORE = re.compile(r"([\w$]+|[>\]])\s*$")


def masked(text: str) -> str:
    """The text with comments and literals blanked, at the same places."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def bodies(text: str, name: str) -> list[tuple[int, int]]:
    """Where each method or constructor of a name that has a body begins (with its annotations) and ends.

    Depths are prefix sums over the brackets; a body ends where the depth first returns to that before it, and at the
    end of the text where it never does."""
    code = masked(text)
    raw = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = lambda up, down: np.cumsum((raw == ord(up)).astype(np.int32) - (raw == ord(down)).astype(np.int32))
    braces, rounds = sums("{", "}"), sums("(", ")")
    out = []
    for m in re.finditer(rf"(?<![\w$.]){re.escape(name)}\s*\(", code):
        before = _WORD_BEFORE.search(code, 0, m.start())
        opened = m.end() - 1
        closing = np.flatnonzero(rounds[opened:] == rounds[opened] - 1)
        tail = _TAIL.match(code, opened + int(closing[0]) + 1) if len(closing) else None
        if tail is None or (before and before[1] in _NOT_DECLARED):
            continue
        body = tail.end() - 1
        ended = np.flatnonzero(braces[body:] == braces[body] - 1)
        end = body + int(ended[0]) + 1 if len(ended) else len(code)
        outside = rounds[opened] - 1
        marks = np.flatnonzero(((raw[: m.start()] == ord(";")) | (raw[: m.start()] == ord("{")) | (raw[: m.start()] == ord("}"))) & (rounds[: m.start()] == outside))
        start = int(marks[-1]) + 1 if len(marks) else 0
        start += len(code[start:]) - len(code[start:].lstrip())
        out.append((start, end))
    return out


def extract_methods(files: DataFrame, name: str) -> DataFrame:
    """path, start_line, end_line and source of every method of a name in files (path, content); null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content and name in content:
                    rows += [(path, content.count("\n", 0, a) + 1, content.count("\n", 0, z) + 1, content[a:z]) for a, z in bodies(content, name)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["path", "start_line", "end_line", "source"])

    return files.select("path", "content").mapInArrow(run, "path string, start_line int, end_line int, source string")
