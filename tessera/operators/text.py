"""Lines, searches and fuzzy matches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import enclose  # noqa: F401  (part of this module's interface)

#: Words that a concept search ignores.
STOP_WORDS = ("the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "it", "this", "that", "do", "does")

#: The weights of a fuzzy suggestion.
SAME_NAME, NEAR_NAME, PER_EDIT, PREFIX, INSIDE, MAX_EDITS = 100, 80, 10, 60, 40, 3


def lines_of(files: DataFrame, content: str = "content", key: str = "path", also: tuple[str, ...] = ()) -> DataFrame:
    """key, line_no (from 1) and text of every line, with the columns `also` of its file."""
    split = files.where(F.col(content).isNotNull()).select(key, *also, F.posexplode(F.split(content, "\n")).alias("__at", "text"))
    return split.select(key, (F.col("__at") + 1).cast("int").alias("line_no"), "text", *also)


def first_hit(text: str | Column, terms: list[str]) -> Column:
    """The earliest place (from 1) of any term, 0 without one. Literal and case-sensitive."""
    text = F.col(text) if isinstance(text, str) else text
    places = [F.nullif(F.instr(text, t), F.lit(0)) for t in terms]
    return F.coalesce(places[0] if len(places) == 1 else F.least(*places), F.lit(0))


def search(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that hold any of the terms that `|` parts, with the earliest place in `hit`."""
    return lines.withColumn("hit", first_hit("text", [t for t in pattern.split("|") if t])).where("hit > 0")


def stem(word: Column) -> Column:
    """Without a plural, -ing or -ed ending, if three letters are left."""
    return F.when((F.length(word) > 5) & word.endswith("ing"), F.regexp_replace(word, "ing$", "")).when((F.length(word) > 4) & word.endswith("es"), F.regexp_replace(word, "es$", "")).when((F.length(word) > 4) & word.endswith("ed"), F.regexp_replace(word, "ed$", "")).when((F.length(word) > 3) & word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)


def concepts_of(words: str, groups: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """The words of a question that are not stop words, each with the group it is in, as it stands or without an
    ending; a word of no group stands for itself."""
    asked = [w for w in re.split(r"[\s,.:;!?]+", words.lower()) if len(w) >= 2 and w not in STOP_WORDS]
    by_word = {w: group for group in reversed(groups.values()) for w in group} | groups
    out = {}
    for word in asked:
        forms = [word, *(word[: -len(end)] for end in ("s", "es", "ing", "ed") if word.endswith(end))]
        out[word] = list(next((by_word[f] for f in forms if f in by_word), (word,)))
    return out


def first_synonym_scores(items: DataFrame, name: str, members: str, concepts: dict[str, list[str]]) -> DataFrame:
    """Items with score and the concepts they mention: a concept counts 5 if its first synonym that is met stands in
    the name, 3 if in the members; at least min(2, concepts) must be met."""
    met = [F.coalesce(*(F.when(F.contains(F.lower(name), F.lit(w)), 5).when(F.contains(F.lower(members), F.lit(w)), 3) for w in words), F.lit(0)) for words in concepts.values()]
    if not met:
        return items.limit(0).withColumns({"concepts": F.array().cast("array<string>"), "score": F.lit(0)})
    named = F.filter(F.array(*(F.when(m > 0, w) for m, w in zip(met, concepts, strict=True))), lambda c: c.isNotNull())
    return items.withColumns({"concepts": named, "score": sum(met[1:], met[0])}).where(F.size("concepts") >= min(2, len(concepts)))


def concept_scores(items: DataFrame, fields: dict[str, int], concepts: list[list[str]], k: int = 15) -> DataFrame:
    """Items by the concepts they mention: for each concept the best weight of a field that holds one of
    its synonyms, summed; at least min(2, concepts) must be met. Columns of items plus concepts and score."""
    met = [F.greatest(*(F.when(F.greatest(*(F.instr(F.lower(f), w) for w in words)) > 0, weight).otherwise(0) if len(words) > 1 else F.when(F.instr(F.lower(f), words[0]) > 0, weight).otherwise(0) for f, weight in fields.items()), F.lit(0)) for words in concepts]
    scored = items.withColumn("concepts", sum((F.when(m > 0, 1).otherwise(0) for m in met), F.lit(0))).withColumn("score", sum(met, F.lit(0)))
    return scored.where(F.col("concepts") >= min(2, len(concepts)))


def fuzzy_score(name: Column, wanted: Column) -> Column:
    """How well a name would do for a wanted one; 0 if not at all."""
    edits = F.levenshtein(name, wanted, MAX_EDITS)
    close = F.when(edits == 0, SAME_NAME).when(edits > 0, NEAR_NAME - PER_EDIT * edits).otherwise(0)
    low, want = F.lower(name), F.lower(wanted)
    return F.greatest(close, F.when(low.startswith(want) | want.startswith(low), PREFIX).otherwise(0), F.when((F.instr(low, want) > 0) | (F.instr(want, low) > 0), INSIDE).otherwise(0))


def suggest(names: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """The k best existing names for each wanted one: wanted, name, score, rank. Empty strings have none and are none.

    Candidates come by equi-joins (grams): few edits, and either string within the other."""
    from . import grams
    from .rank import top_within

    asked, known = wanted.select("wanted").where("wanted <> ''").distinct(), names.select("name").where("name <> ''").distinct()
    swapped = grams.containing(asked.withColumnRenamed("wanted", "name"), known.withColumnRenamed("name", "wanted")).select(F.col("wanted").alias("name"), F.col("name").alias("wanted"))
    best = lambda pairs: top_within(pairs, ["wanted"], k, F.desc("score"), F.asc("name"))
    scored = lambda pairs: best(pairs.select("name", "wanted").withColumn("score", fuzzy_score(F.col("name"), F.col("wanted"))).where("score > 0")).drop("rank")
    # Each source has a pair once, so the best of each suffice; only these are shuffled.
    found = scored(grams.near(known, asked)).unionByName(scored(grams.containing(known, asked))).unionByName(scored(swapped))
    return best(found.distinct())


def comments_in_markup(html: str | Column) -> Column:
    """The texts between `<!--` and `-->`."""
    return F.regexp_extract_all(html, F.lit(r"<!--((?s:.*?))-->"), 1)
