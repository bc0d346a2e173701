import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grams, spans, text


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def words():
    draw = random.Random(2)
    short = ["".join(draw.choices("abé", k=n)) for n in range(0, 9) for _ in range(8)]
    long = ["".join(draw.choices("abcdeAB", k=draw.randrange(9, 16))) for _ in range(60)]
    bent = []
    for w in long:
        letters = list(w)
        for _ in range(draw.randrange(1, 5)):
            at = draw.randrange(len(letters))
            match draw.randrange(3):
                case 0:
                    letters[at] = draw.choice("abcde")
                case 1:
                    del letters[at]
                case _:
                    letters.insert(at, draw.choice("abcde"))
        bent.append("".join(letters))
    return sorted({*short, *long}), sorted({*short[::3], *bent, *(w[2:7] for w in long), "zzz", "a", "AB"})


def frames(spark, words):
    names, wanted = words
    return spark.createDataFrame([(w,) for w in [*names, names[3], None]], "name string"), spark.createDataFrame([(w,) for w in [*wanted, wanted[1], None]], "wanted string")


def test_near_equals_brute_force(spark, words):
    names, wanted = words
    got = {(r.name, r.wanted): r.edits for r in grams.near(*frames(spark, words)).collect()}
    assert got == {(n, w): d for n in names for w in wanted if (d := distance(n, w)) <= 3}


def test_containing_equals_brute_force(spark, words):
    names, wanted = words
    got = sorted((r.name, r.wanted) for r in grams.containing(*frames(spark, words)).collect())
    assert got == sorted((n, w) for n in names for w in wanted if n and w and w.lower() in n.lower())
    none = spark.createDataFrame([], "wanted string")
    assert grams.containing(frames(spark, words)[0], none).collect() == []


def test_suggestions_equal_scoring_all_pairs_without_a_nested_loop(spark, words):
    names, wanted = words
    found = text.suggest(*frames(spark, words))
    pairs = spark.createDataFrame([(n, w) for n in names for w in wanted if n and w], "name string, wanted string")
    scored = pairs.withColumn("score", text.fuzzy_score(F.col("name"), F.col("wanted"))).where("score > 0").collect()
    best = {}
    for r in sorted(scored, key=lambda r: (-r.score, r.name)):
        best.setdefault(r.wanted, []).append((r.name, r.score))
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.wanted, []).append((r.name, r.score))
    assert got == {w: top[:5] for w, top in best.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain(points, laid):
    out = []
    for key, line in points:
        around = [(a, -z, n) for k, a, z, n in laid if k == key and line is not None and a <= line <= z]
        out.append((key, line, max(around)[2] if around else None))
    return out


@pytest.mark.parametrize("stretch", [7, 4096])
def test_sweep_equals_brute_force_nested_crossing_and_odd(spark, stretch):
    draw = random.Random(4)
    laid = [(draw.choice("ab"), a := draw.randrange(60), a + draw.randrange(25), f"s{draw.randrange(9)}") for _ in range(60)] + [("a", 0, 90, "whole"), ("a", 5, 5, "x"), ("a", 5, 5, "y"), ("c", 3, 3, "z"), ("a", -4, -1, "below")]
    points = [(draw.choice("abcd"), draw.randrange(-6, 100)) for _ in range(300)] + [(None, 3), ("a", None), ("a", 5), ("a", 5)]
    rows = spark.createDataFrame([(k, line, i) for i, (k, line) in enumerate(points)], "path string, line int, __key int").repartition(3)
    frame = spark.createDataFrame([*laid, (None, 1, 9, "n"), ("a", None, 9, "n"), ("a", 9, 1, "back"), ("a", 1, 99, None)], "path string, start_line int, end_line int, name string")
    got = spans.enclose(rows, frame, "path", "line", "name", stretch)
    assert got.columns == ["path", "line", "__key", "name"]
    assert sorted(((r.path, r.line, r.name) for r in got.collect()), key=str) == sorted(plain(points, laid), key=str)
    assert spans.enclose(rows, frame.limit(0), "path", "line", "name").where("name IS NOT NULL").count() == 0
    assert spans.enclose(rows.limit(0), frame, "path", "line", "name").collect() == []


def test_sweep_is_linear_in_a_large_file(spark):
    methods = spark.range(5000).select(F.lit("f").alias("path"), (F.col("id") * 20 + 2).alias("start_line"), (F.col("id") * 20 + 15).alias("end_line"), F.concat(F.lit("m"), F.col("id")).alias("name"))
    whole = spark.createDataFrame([("f", 1, 100_100, "class")], methods.schema)
    points = spark.range(1, 100_001).select(F.lit("f").alias("path"), F.col("id").alias("line"))
    began = time.perf_counter()
    got = spans.enclose(points, methods.unionAll(whole), "path", "line", "name").groupBy(F.col("name") == "class").count().collect()
    assert {r[0]: r[1] for r in got} == {True: 30_000, False: 70_000} and time.perf_counter() - began < 20
    at, who = spans.innermost(np.arange(0, 10**5), np.arange(0, 10**5)[::-1] + 10**5)
    assert len(at) <= 2 * 10**5 and len(who) == len(at)


def test_indexed_search_equals_the_scan(spark, tmp_path, monkeypatch):
    from tessera.plans.bindings import lines
    from tessera.sources import clustered, line_index

    monkeypatch.setattr(clustered, "LEAST_ROWS", 500)
    docs = lines(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame([(-1, 1, "a😀bc ab"), (-1, 2, "x\ty|z"), (-1, 3, ""), (-1, 4, None), (None, 1, "License")], "doc_id long, line_no long, text string"))
    line_index.build(docs, str(tmp_path / "i"), "doc_id")
    scanned = docs.where("doc_id IS NOT NULL").withColumn("key", F.col("doc_id").cast("string"))
    for pattern in ("License|token", "License", "the", "no such line", "a😀b", "ab", "|License|", "\ty", "Licens|xyzzyx|MIT"):
        got, want = (sorted((r.key, r.line_no, r.hit) for r in found.collect()) for found in (line_index.search(spark, str(tmp_path / "i"), pattern), text.search(scanned, pattern)))
        assert got == want, pattern
    assert line_index.search(spark, str(tmp_path / "i"), "|").collect() == []
    total, tested = docs.count(), line_index.candidates(spark, str(tmp_path / "i"), "MIT License").count()
    assert 0 < tested < total / 3


def test_likeness_is_dealt_over_all_partitions_and_only_the_best_of_each_source_are_shuffled(spark, words):
    names, wanted = frames(spark, words)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [key" in plan(grams.near(names, wanted))
    assert plan(text.suggest(names, wanted)).count("WindowGroupLimit [") == 4
