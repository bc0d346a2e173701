import json
import subprocess

from tessera.operators import profile as reports
from tessera.operators import rules, text
from tessera.operators.packs import COMPATIBILITY, MIGRATION, PERFORMANCE, SECURITY, STRUCTURAL
from tessera.sources import code, config, git, profile, store

LINES = {
    "SQL_INJECTION": 'String q = "SELECT a FROM t WHERE b = " + c;', "PATH_TRAVERSAL": "new File(request.getName())", "JNDI_INJECTION": "ctx.lookup(name)", "XXE": "DocumentBuilderFactory.newInstance()",
    "INSECURE_DESERIALIZATION": "in.readObject()", "WEAK_CRYPTO": 'getInstance("MD5")', "HARDCODED_SECRET": 'String apiKey = "abc";', "INSECURE_RANDOM": "new Random()", "OPEN_REDIRECT": "r.sendRedirect(url)", "LDAP_INJECTION": 'c.search("(uid=" + u)',
}


def scan(spark, pack, lines, target=None):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, text string")
    return {(r.n, r.rule_id) for r in rules.scan(df, pack, target).collect()}


def test_every_security_rule_fires_and_clean_lines_do_not(spark):
    found = scan(spark, SECURITY, [*LINES.values(), '// String password = "x";', 'String password = "test";', "int x = 1;"])
    assert {rule for _, rule in found} == set(LINES) and all(n < len(LINES) for n, _ in found)


def test_packs_have_their_sizes_and_versions_filter(spark):
    assert [len(p) for p in (PERFORMANCE, STRUCTURAL, SECURITY, MIGRATION, COMPATIBILITY)] == [18, 6, 10, 33, 13]
    lines = ["import javax.xml.bind.JAXB;", "f.setAccessible(true);", "Optional x = y.isPresent() ? y.get() : z;", "s.trim()"]
    assert scan(spark, COMPATIBILITY, lines, 9) == {(0, "JAXB")}
    assert scan(spark, COMPATIBILITY, lines, 17) == {(0, "JAXB"), (1, "ILLEGAL_ACCESS")}
    assert (3, "STRING_STRIP") in scan(spark, MIGRATION, lines, 17) and (3, "STRING_STRIP") not in scan(spark, MIGRATION, lines, 8)


def test_innermost_span_wins_and_points_without_one_stay(spark):
    points = spark.createDataFrame([("a", 5), ("a", 5), ("a", 50), ("b", 1)], "path string, line_no int")
    spans = spark.createDataFrame([("a", 1, 20, "outer"), ("a", 4, 6, "inner")], "path string, start_line int, end_line int, name string")
    got = sorted((r.path, r.line_no, r.name) for r in text.enclose(points, spans, "path", "line_no", "name").collect() if r.name) + [r.name for r in text.enclose(points, spans, "path", "line_no", "name").collect() if not r.name]
    assert got == [("a", 5, "inner"), ("a", 5, "inner"), None, None]


def test_recording_and_histogram(spark, tmp_path):
    event = lambda kind, **values: {"type": kind, "values": values}
    stack = {"frames": [{"method": {"type": {"name": "com/acme/A"}, "name": "run"}}]}
    events = [event("jdk.ExecutionSample", stackTrace=stack)] * 3 + [event("jdk.GarbageCollection", duration=5_400_000), event("jdk.GarbageCollection", duration=2_000_000), event("jdk.JavaExceptionThrow", thrownClass={"name": "E"}), event("jdk.ObjectAllocationInNewTLAB", objectClass={"name": "B"}, tlabSize=10), event("jdk.FileRead", path="x", bytesRead=1)]
    (tmp_path / "r.json").write_text(json.dumps({"recording": {"events": events}}))
    parts = reports.summaries(reports.events_of(profile.read_recording(spark, str(tmp_path / "r.json"))))
    assert [tuple(r) for r in parts["hot"].collect()] == [("com.acme.A.run", 3, 100.0)]
    gc = parts["gc"].first()
    assert (gc.pauses, gc.total_ms, gc.max_ms, gc.avg_ms) == (2, 7, 5, 3)
    assert parts["exceptions"].first().n == 1 and parts["allocations"].first().bytes == 10 and parts["io"].first().n == 1
    for name, n in (("one", 10), ("two", 35)):
        (tmp_path / f"{name}.txt").write_text(f" num  #instances  #bytes  class name\n-----\n   1:  {n}  {n * 16}  com.acme.A\n   2:  5  80  [B\nTotal 15\n")
    before, after = (profile.read_histogram(spark, str(tmp_path / f"{n}.txt")) for n in ("one", "two"))
    assert [(r.class_name, r.growth, r.byte_growth) for r in reports.heap_growth(before, after).collect()] == [("com.acme.A", 25, 400)]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "A.java").write_text("class A {\n}\n")
    run("add", "-A")
    run("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "first")
    (tmp_path / "A.java").write_text("class A {\n int x;\n}\n")
    (tmp_path / "B.java").write_text("class B {}")
    assert [r.path for r in git.changed_files(spark, str(tmp_path)).collect()] == ["A.java", "B.java"]
    assert [(r.author, r.message) for r in git.log(spark, str(tmp_path), "A.java").collect()] == [("n", "first")]
    assert git.blame(spark, str(tmp_path), "A.java").count() == 3
    assert git.changed_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_config_defaults_and_json_store(spark, tmp_path):
    assert config.read_config("")["java_version"] == 17
    files = spark.createDataFrame([("A.java", None, 0, "import x.Y;\n@Mark class A { int f; void g() { h(); } }"), ("B.java", None, 0, None)], "path string, content_hash string, mtime_ms long, content string")
    store.write_json(code.extract(files), str(tmp_path / "json"))
    facts = store.read_json(spark, str(tmp_path / "json"))
    assert facts.count() == 2 and code.Code(facts).methods.first().name == "g"
    assert [r.path for r in store.entries_with(facts, "mark").collect()] == ["A.java"] and store.entries_with(facts, "zzz").count() == 0
