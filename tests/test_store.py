"""Stores: versions, tombs, look-ups by zone map, and resolved edges that follow the files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import calls, commands
from tessera.sources import clustered, store, versions
from tessera.sources import code as source
from tessera.streaming import refresh

SCHEMA = "path string, content_hash string, mtime_ms long, content string"


def files(spark, contents, at=0):
    return spark.createDataFrame([(path, None, at, text) for path, text in contents.items()], SCHEMA)


def stored_edges(spark, path):
    return sorted(map(tuple, store.open_code(spark, path).edges.select("caller_class", "caller_method", "caller_arity", "callee_class", "callee_method", "callee_arity", "line", "path").collect()))


def full_edges(spark, contents):
    return sorted(map(tuple, calls.resolve(source.Code(source.extract(files(spark, contents)))).collect()))


A = "class A { B b; void go() { b.next().run(1); b.size(); other(); } C make() { return null; } }"
B = "class B { C next() { return null; } int size() { return 0; } }"
C = "class C { void run(int n) { } }"
D = "class D { A a; void use() { a.make().run(2); lone(); } }"


def written(spark, path):
    """Places of edges that the newest segment holds."""
    newest = store.Store(spark, path).parts[-1]
    return spark.read.parquet(f"{path}/{newest['id']}/edges").select("path", "line").distinct().count() if "edges" in newest["tables"] else 0


def test_stored_edges_follow_what_they_were_resolved_through(spark, tmp_path):
    path, now = str(tmp_path / "s"), {"A.java": A, "B.java": B, "C.java": C, "D.java": D, **{f"F{i}.java": f"class F{i} {{ F{i} f; void m{i}() {{ f.m{i}(); }} }}" for i in range(30)}}
    steps = [
        {},  # the first version
        {"B.java": B.replace("C next", "D next")},  # a result on the way of A's chain
        {"C.java": C.replace("int n", "int n, int k")},  # an arity
        {"E.java": "class E { void lone() { } void other() { } }"},  # the only class that declares a name
        {"G.java": "class G { void lone() { } }"},  # no longer the only one
        {"A.java": A.replace("C make", "B make")},  # a mate's result; B does not declare run
        {"B.java": None},  # a deleted owner
        {"B.java": B, "G.java": None, "C.java": C},
    ]
    for k, step in enumerate(steps):
        now = {p: t for p, t in (now | step).items() if t is not None}
        counts = {r.status: r.n for r in store.refresh(spark, files(spark, now), path).collect()}
        assert stored_edges(spark, path) == full_edges(spark, now), k
        if k:
            assert counts["reused"] >= 30 and written(spark, path) <= 6, (k, counts)
    assert store.Store(spark, path).number >= len(steps)


def test_random_edits_equal_a_full_resolve(spark, tmp_path):
    draw, path, now = random.Random(3), str(tmp_path / "s"), {}
    for round_ in range(3):
        for i in draw.sample(range(8), 3):
            t, m, k = (draw.randrange(8) for _ in range(3))
            now[f"T{i}.java"] = f"class T{i} {{ T{t} f; T{k} g{m}() {{ return f.g{k}(); }} void h{i}(int a) {{\n f.g{m}().h{k}(1);\n g{m}().f.g{t}();\n x.h{t}(2); g{k}();\n }} }}"
        if round_ == 2:
            now.pop(sorted(now)[0])
        store.refresh(spark, files(spark, now), path)
        assert stored_edges(spark, path) == full_edges(spark, now), round_


def test_segments_fold_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_SEGMENTS", 2)
    path, now = str(tmp_path / "s"), {}
    for i in range(4):
        now |= {f"K{i}.java": f"class K{i} {{ K{i + 1} k; void a() {{ k.a(); }} }}", "B.java": B.replace("size", f"size{i}")}
        store.refresh(spark, files(spark, now), path)
        assert len(store.Store(spark, path).parts) <= 2
        assert sorted(r.path for r in store.load(spark, path).collect()) == sorted(now)
        assert stored_edges(spark, path) == full_edges(spark, now)
    named = {s["id"] for n in versions.numbers(spark, path) for s in versions.segments(spark, path, n)[1]}
    assert {n for n in os.listdir(path) if n.startswith("s-")} == named and len(versions.numbers(spark, path)) <= 2


def test_nothing_new_writes_no_version(spark, tmp_path):
    path, now = str(tmp_path / "s"), {"A.java": A, "B.java": B}
    store.refresh(spark, files(spark, now), path)
    assert {r.status: r.n for r in store.refresh(spark, files(spark, now), path).collect()} == {"reused": 2}
    assert store.Store(spark, path).number == 1
    store.refresh(spark, files(spark, now, at=5), path)  # a new time alone: noted, not parsed
    assert store.Store(spark, path).parts[-1]["tables"] == ["seen"]
    store.refresh(spark, files(spark, now, at=5), path)
    assert store.Store(spark, path).number == 2


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    path = str(tmp_path / "s")
    store.refresh(spark, files(spark, {"A.java": A}), path)
    first = store.Store(spark, path)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, first.number, first.parts)
    real, raced = versions.commit, []

    def late(*arguments):
        if not raced:  # another writer is faster once
            raced.append(1)
            store.apply(spark, files(spark, {"B.java": B}), path)
        real(*arguments)

    versions.commit = late
    try:
        store.apply(spark, files(spark, {"C.java": C}), path)
    finally:
        versions.commit = real
    assert sorted(r.path for r in store.load(spark, path).collect()) == ["A.java", "B.java", "C.java"]
    assert stored_edges(spark, path) == full_edges(spark, {"A.java": A, "B.java": B, "C.java": C})


def test_stream_keeps_new_changed_replayed_and_deleted_files(spark, tmp_path):
    tree, path = tmp_path / "tree", str(tmp_path / "s")
    tree.mkdir()
    (tree / "A.java").write_text(A)
    store.refresh_roots(spark, [str(tree)], path)
    (tree / "B.java").write_text(B)
    run = lambda progress: refresh.refresh_stream(refresh.file_stream(spark, str(tree)), path, str(tmp_path / progress), str(tree)).awaitTermination()
    names = lambda: sorted(t.name for t in store.open_code(spark, path).types.collect())
    run("one")
    assert names() == ["A", "B"] and store.Store(spark, path).number == 2
    run("two")  # all files again, as after a lost checkpoint: nothing is written
    assert store.Store(spark, path).number == 2
    (tree / "A.java").unlink()
    (tree / "C.java").write_text(C)
    run("one")
    assert names() == ["B", "C"]
    (tree / "C.java").unlink()
    assert refresh.sweep(spark, str(tree), path) == {"reused": 1, "parsed": 0, "deleted": 1} and names() == ["B"]
    (tree / "B.java").write_text(B.replace("size", "length"))
    os.utime(tree / "B.java", (2_000_000_000, 2_000_000_000))
    run("three")
    assert "length" in {m.name for m in store.open_code(spark, path).methods.collect()} and names() == ["B"]


def test_index_command_keeps_versions_and_may_read_its_own_path(spark, tmp_path):
    path = str(tmp_path / "s")
    base = commands.CodeBase(source.Code(source.extract(files(spark, {"A.java": A, "B.java": B}))))
    assert commands.index(base, path).first().files == 2
    assert commands.index(commands.CodeBase(store.open_code(spark, path)), path).first().files == 2
    assert store.Store(spark, path).number == 1


def test_files_are_read_only_where_time_or_length_differ(spark, tmp_path):
    tree, path = tmp_path / "tree", str(tmp_path / "s")
    tree.mkdir()
    for i in range(4):
        (tree / f"F{i} [x] {{é}}.java").write_text(f"class F{i} {{ }}")
    counts = lambda: {r.status: r.n for r in store.refresh_roots(spark, [str(tree)], path).collect()}
    assert counts() == {"parsed": 4} and counts() == {"reused": 4}
    (tree / "F1 [x] {é}.java").write_text("class F1 { int x; }")
    assert counts() == {"reused": 3, "parsed": 1}
    (tree / "F2 [x] {é}.java").unlink()
    assert counts() == {"reused": 3, "deleted": 1}


def test_look_ups_open_few_files_and_answer_as_the_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "LEAST_ROWS", 50)
    path = str(tmp_path / "s")
    now = {f"T{i}.java": f"package p{i % 7}; class T{i} extends T{i * 7 % 400} implements I{i % 9} {{ T{(i * 3) % 400} f; void a{i}() {{ f.a{(i * 3) % 400}(); }} int b() {{ return 1; }} }}" for i in range(400)}
    store.refresh(spark, files(spark, now), path)
    plain, kept = commands.CodeBase(source.Code(source.extract(files(spark, now)))), store.open_code(spark, path)
    base = commands.CodeBase(kept)
    for name in ("T7", "T399", "T0", "Nowhere"):
        for command in ("summary", "hierarchy", "deps", "contract", "mini"):
            if command == "mini" and name == "Nowhere":
                continue
            got, want = (sorted(map(str, commands.COMMANDS[command](b, name).collect())) for b in (base, plain))
            assert got == want, (command, name)
    kept.store.opened.clear()
    commands.summary(base, "T7").collect()
    commands.hierarchy(base, "T7").collect()
    sizes = {}
    for table in ("methods", "edges", "types", "parents"):
        zones = clustered.zones(spark, f"{path}/{kept.store.parts[0]['id']}/{table}").select("file").distinct().count()
        sizes[table] = (len({f for t, f, _ in kept.store.opened if t == table}), zones)
    assert all(opened <= 2 < zones for opened, zones in sizes.values()), sizes


def test_zone_map_never_misses_and_seldom_passes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).select(F.concat(F.lit("n"), (F.col("id") * 7919 % 20_000).cast("string")).alias("name"), "id")
    rows = rows.unionAll(spark.range(5000).select(F.lit("hot"), "id"))
    clustered.write(rows, "name", path)
    for name in ("n0", "n19999", "n77", "hot"):
        found = clustered.lookup(spark, path, rows.schema, [f for f, _ in clustered.candidates(spark, path, name)])
        assert found.where(F.col("name") == name).count() == rows.where(F.col("name") == name).count() > 0
    absent = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit("x")).alias("key"))
    zones = clustered.zones(spark, path)
    passed = zones.join(absent, clustered._may_hold(F.col("key"))).count()
    assert passed <= 30
    clustered.write(rows.limit(0), "name", str(tmp_path / "none"))
    assert clustered.candidates(spark, str(tmp_path / "none"), "n1") == []


def test_parsing_is_dealt_by_the_number_of_files(spark, tmp_path, monkeypatch):
    parts, path = [], str(tmp_path / "s")
    monkeypatch.setattr(store, "TASK_FILES", 20)
    monkeypatch.setattr(store, "extract", lambda rows: parts.append(rows.rdd.getNumPartitions()) or source.extract(rows))
    now = {f"F{i}.java": f"class F{i} {{ }}" for i in range(50)}
    store.refresh(spark, files(spark, now), path)
    store.refresh(spark, files(spark, now | {"F1.java": "class F1 { int n; }"}), path)
    assert parts == [3, 1] and store.open_code(spark, path).types.count() == 50
