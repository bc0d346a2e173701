import itertools
import random

import pytest

from tessera.operators import graph


def chains(edges, target, limit, stop=()):
    into = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    out, open_paths = set(), [(target,)]
    for _ in range(limit):
        grown = [(a, *p) for p in open_paths for a in into.get(p[0], ()) if a not in p]
        out |= {p for p in grown if p[0] not in into or p[0] in stop}
        open_paths = [p for p in grown if p[0] in into and p[0] not in stop]
    return out


@pytest.mark.parametrize("prune", [0, 10_000])
def test_chains_equal_brute_force_with_cycles(spark, monkeypatch, prune):
    monkeypatch.setattr(graph, "PRUNE_AT", prune)
    draw = random.Random(9)
    edges = sorted({(f"n{draw.randrange(12)}", f"n{draw.randrange(2, 12)}") for _ in range(24)} | {("r", "n3"), ("n0", "n0"), ("a", "b"), ("b", "a"), ("a", "n4")})
    table, seed = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n5",)], "node string")
    got = graph.chains_to_roots(table, seed, 6)
    want = chains(edges, "n5", 6)
    assert {tuple(r.chain) for r in got.collect()} == want and len(want) > 3
    stops = spark.createDataFrame([("n7",), ("n2",)], "node string")
    assert {tuple(r.chain) for r in graph.chains_to_roots(table, seed, 6, stops).collect()} == chains(edges, "n5", 6, ("n7", "n2"))
    first = [(r.depth, tuple(r.chain)) for r in graph.chains_to_roots(table, seed, 6, first=3).collect()]
    assert sorted(first) == sorted((len(c) - 1, c) for c in want)[:3]


def test_places_without_an_end_are_left(spark, monkeypatch):
    monkeypatch.setattr(graph, "PRUNE_AT", 50)
    ring = [f"c{i}" for i in range(11)]  # calls one another and the target; nothing else enters
    edges = [*itertools.permutations(ring, 2), ("c0", "t"), ("root", "x"), ("x", "y"), ("y", "t"), ("z", "y")]
    table, seed = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("t",)], "node string")
    assert {tuple(r.chain) for r in graph.chains_to_roots(table, seed).collect()} == {("root", "x", "y", "t"), ("z", "y", "t")}
