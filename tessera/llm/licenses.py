"""License scans: ordered signature rules behind a keyword prefilter.

A text is normalised to lower-case words. One Aho-Corasick pass finds which keywords
occur; only rules of those keywords run. Their matches are taken in the order of
priority, then length, then place, and a match that lies inside the interval of one
taken before is suppressed, so "gnu lesser general public license version 3" yields one
label and not those of the shorter names in it. Base phrases are found beside the rules
and never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_batches, texts
from .license_rules import RULES

#: Phrases (as words) and their labels that a scanner looks for unless it is given others.
PHRASES = {"mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Those of the query.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Bytes to words: A-Z become a-z; digits, a-z and all bytes of non-ASCII letters stay; others part words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_GAP = r"[^ ]+(?: [^ ]+){0,5}?"  # only 0x20 parts words: as Latin-1, bytes 0x85 and 0xA0 of other letters would be white space


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def parse_rules(lines: str = RULES) -> list[Rule]:
    """Rules in the order of the text; a heading sets priority and confidence for those below."""
    rules, priority, confidence = [], 0, 0.0
    for line in filter(None, map(str.strip, lines.splitlines())):
        if line.startswith("#"):
            _, level, trust, *_ = line.split()
            priority, confidence = int(level), float(trust)
            continue
        label, keywords, pattern = (x.strip() for x in line.split("|", 2))
        body = pattern.replace("~", _GAP)
        rules.append(Rule(f"r{len(rules):03d}", label, priority, confidence, tuple(k.strip() for k in keywords.split(",")), re.compile(rf"(?<![^ ])(?:{body})(?![^ ])")))
    return rules


class Detection(NamedTuple):
    label: str
    rule: str
    start_word: int
    end_word: int  # exclusive
    priority: int
    confidence: float


class Scanner:
    """Compiled rules; scan(text) gives the number of words and the detections of one text."""

    def __init__(self, lines: str = RULES, base: dict[str, str] | None = None):
        self.base = PHRASES if base is None else base
        self.gated: dict[str, list[Rule]] = {}
        for rule in parse_rules(lines):
            for keyword in rule.keywords:
                self.gated.setdefault(keyword, []).append(rule)
        self.gate = ahocorasick.Automaton()
        for keyword in self.gated.keys() | self.base.keys():
            self.gate.add_word(keyword, keyword)
        self.gate.make_automaton()

    def scan(self, text: str) -> tuple[int, list[Detection]]:
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        line = b" ".join(words).decode("latin-1")
        present = {keyword for _, keyword in self.gate.iter(line)}
        if not present:
            return len(words), []
        blanks = _blanks(line)
        found = [*self._places(line, blanks, present & self.base.keys())]
        tried = {rule.name: rule for keyword in sorted(present & self.gated.keys()) for rule in self.gated[keyword]}  # once each
        found += self._resolve([m for rule in tried.values() for m in self._matches(line, blanks, rule)])
        return len(words), found

    def _places(self, line: str, blanks: list[int], phrases: set[str]) -> Iterator[Detection]:
        padded = f" {line} "  # a blank before a phrase stands in it where the phrase stands in the line
        for phrase in sorted(phrases):
            at = padded.find(f" {phrase} ")
            while at >= 0:
                start = bisect_left(blanks, at)
                yield Detection(self.base[phrase], "base", start, start + phrase.count(" ") + 1, 100, 1.0)
                at = padded.find(f" {phrase} ", at + 1)

    @staticmethod
    def _matches(line: str, blanks: list[int], rule: Rule) -> Iterator[Detection]:
        for match in rule.pattern.finditer(line):
            start = bisect_left(blanks, match.start())
            yield Detection(rule.label, rule.name, start, start + match[0].count(" ") + 1, rule.priority, rule.confidence)

    @staticmethod
    def _resolve(matches: list[Detection]) -> list[Detection]:
        """Without those inside one of higher standing. A Fenwick tree over the starts keeps the
        farthest end of those taken, so a text with many matches costs n log n."""
        starts = {s: i + 1 for i, s in enumerate(sorted({m.start_word for m in matches}))}
        farthest = [0] * (len(starts) + 1)
        taken = []
        for match in sorted(matches, key=lambda m: (-m.priority, m.start_word - m.end_word, m.start_word, m.rule)):
            at, end = starts[match.start_word], 0
            while at:
                end, at = max(end, farthest[at]), at & (at - 1)
            if end < match.end_word:
                taken.append(match)
                at = starts[match.start_word]
                while at < len(farthest):
                    farthest[at] = max(farthest[at], match.end_word)
                    at += at & -at
        return sorted(taken, key=lambda m: (m.start_word, m.end_word, m.rule))


def _blanks(line: str) -> list[int]:
    """Places of all blanks: the number of those before a place is the number of its word."""
    return np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20).tolist()


_COMPILED: dict[tuple, Scanner] = {}


def _scanner(lines: str, base: dict[str, str]) -> Scanner:
    key = (lines, *sorted(base.items()))
    if key not in _COMPILED:
        _COMPILED[key] = Scanner(lines, base)
    return _COMPILED[key]


DETECTION = "struct<label:string,rule:string,start_word:bigint,end_word:bigint,priority:int,confidence:double>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: str = RULES, base: dict[str, str] = PHRASES) -> DataFrame:
    """Scan every whole text.

    Returns id_col, n_words long and detections array<struct<label, rule, start_word,
    end_word, priority, confidence>>, base phrases first (rule "base"). Null and empty texts
    have no words and no detections; repeated rows are scanned each; other columns are not
    read. A map without a shuffle.
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules, base)
        for batch in text_batches(batches, 1):
            counts, found = [], []
            for text in texts(batch, 1):
                n, detections = scanner.scan(text)
                counts.append(n)
                found.append([d._asdict() for d in detections])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=[id_col, "n_words", "detections"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key_type}, n_words long, detections array<{DETECTION}>")
