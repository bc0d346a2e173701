import os

from tessera.sources import brackets, code

ROOT = os.path.join(os.path.dirname(__file__), "fixtures", "shop")

TEXT = '''class A {
    @Mark({1, 2}) @Say("} {")
    public <T> List<T> go(Map<String, T> m, int n) throws X, y.Z {
        String s = "}"; char c = '}'; // }
        /* } */ if (n > 0) { go(m, n - 1); }
        return new A() { void go() { } }.go();
    }
    int go;
    abstract void go(int a);
    void stop() { other.go(m); A a = new go() { }; if (go(1)) { } }
    go() { }
'''


def cut(text, name):
    return [text[a:z] for a, z in brackets.bodies(text, name)]


def test_bodies_of_text_that_does_not_parse():
    found = cut(TEXT, "go")
    assert found[0].startswith("@Mark({1, 2})") and found[0].endswith(".go();\n    }") and found[1:] == ["void go() { }", "go() { }"]
    assert cut(TEXT[: TEXT.index("return")], "go")[0].rstrip().endswith("}") and cut("}}} void f( {", "f") == [] and cut("", "f") == [] and cut("void f() {", "f") == ["void f() {"]
    assert cut('void f() { String s = """\n } " }\n"""; }', "f") == ['void f() { String s = """\n } " }\n"""; }']


def test_spans_equal_the_parser_s(spark):
    files = code.scan_files(spark, [ROOT])
    parsed = code.Code(code.extract(files)).methods.where("has_body")
    names = {r.name for r in parsed.select("name").distinct().collect()}
    for name in sorted(names):
        want = sorted((r.path, r.start_line, r.end_line) for r in parsed.where(parsed["name"] == name).collect())
        assert sorted((r.path, r.start_line, r.end_line) for r in brackets.extract_methods(files, name).collect()) == want, name
