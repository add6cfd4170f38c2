"""Symbols of source files, and graph analyses over scanned trees."""

import pytest

from quarry.operators import graph, near_duplicates, reports
from quarry.sources import files, symbols


def tree(spark, tmp_path, content):
    for name, body in content.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    rows = files.scan(spark, str(tmp_path))
    return graph.build(rows.where("content_type like 'source/%'"))


def short(path):
    return "/".join(path.split("/")[-2:])


PACKAGES = {
    "a/a.go": 'package a\n\nimport (\n\t"fmt"\n\t"strings"\n)\n\ntype Widget struct{}\n\nfunc Alpha() { fmt.Println(strings.ToUpper("x")) }\n',
    "b/b.go": 'package b\n\nimport "fmt"\n\ntype Gadget struct{}\n\nfunc Alpha() {}\nfunc Beta()  { fmt.Println("b") }\n',
    "c/c.go": "package c\n\nfunc Gamma() {}\n",
}


def test_graph_of_a_scanned_tree(spark, tmp_path):
    g = tree(spark, tmp_path, PACKAGES)
    assert g["files"].count() == 3
    importers = lambda m, mode: sorted(short(r.path) for r in graph.imported_by(g["imports"], m, mode).collect())
    assert importers("fmt", "exact") == ["a/a.go", "b/b.go"] and importers("str", "prefix") == ["a/a.go"] and importers("^(fmt|strings)$", "regex") == ["a/a.go", "b/b.go"]
    assert sorted((r.kind, short(r.path)) for r in graph.find_definition(g["defs"], "Alpha").collect()) == [("function", "a/a.go"), ("function", "b/b.go")]
    assert [(r.module, r.importers) for r in graph.import_hubs(g["imports"]).collect()] == [("fmt", 2), ("strings", 1)]
    assert [(r.symbol, r.files) for r in graph.duplicate_definitions(g["defs"]).collect()] == [("Alpha", 2)]
    assert sorted(r.caller for r in graph.who_calls(g["calls"], "Println").collect()) == ["Alpha", "Beta"]
    totals = {r.measure: r.value for r in graph.overview(g).collect()}
    assert totals["definitions"] == 6 and totals["imports"] == 3 and totals["language:go"] == 3


def test_impact_of_scanned_calls(spark, tmp_path):
    g = tree(spark, tmp_path, {"a.go": "package p\n\nfunc leaf() {}\nfunc mid() { leaf() }\nfunc top() { mid() }\nfunc unrelated() { other() }\nfunc other() {}\nfunc recA() { recB() }\nfunc recB() { recA() }\n"})
    by = lambda symbol, depth=0: {r.symbol: r.depth for r in graph.impact(g["calls"], symbol, depth).collect()}
    assert by("leaf") == {"mid": 1, "top": 2} and by("leaf", 1) == {"mid": 1} and by("recA") == {"recB": 1}
    assert [r.path for r in graph.call_path(g["calls"], "top", "leaf").collect()] == ["top > mid > leaf"]
    assert {(r.relation, r.symbol, r.depth) for r in graph.trace(g["calls"], "mid").collect()} == {("caller", "top", 1), ("callee", "leaf", 1), ("dependent", "top", 1)}


def test_call_path_of_any_length(spark):
    calls = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(80)], "caller string, callee string")
    assert graph.call_path(calls, "n000", "n080").first().path.count(">") == 80


DEAD = {
    "cmd/main.go": "package main\n\nfunc main() { used() }\nfunc init() {}\nfunc used() {}\nfunc runCmd() {}\n\ntype ServeCmd struct{}\ntype TestData struct{}\n",
    "cmd/x_test.go": "package main\n\nfunc TestIt() {}\nfunc Tester() {}\nfunc BenchmarkX() {}\n",
    "cmd/y.go": "package main\n\nfunc TestAway() {}\n",
    "py/m.py": "def main():\n    pass\n\n\nclass Task:\n    def run(self):\n        return helper()\n\n\ndef helper():\n    pass\n",
    "doc/a.sql": "CREATE TABLE t (a int);\n",
}


def test_dead_code_exemptions(spark, tmp_path):
    g = tree(spark, tmp_path, DEAD)
    rows = graph.dead_code(g["defs"], g["refs"]).collect()
    assert {(short(r.path), r.symbol) for r in rows} == {("cmd/main.go", "runCmd"), ("cmd/main.go", "TestData"), ("cmd/x_test.go", "Tester"), ("cmd/y.go", "TestAway"), ("py/m.py", "main"), ("py/m.py", "Task"), ("py/m.py", "run")}
    assert {r.owner for r in rows if r.symbol == "run"} == {"Task"}


def test_test_gaps_leave_handlers_out(spark, tmp_path):
    g = tree(
        spark,
        tmp_path,
        {
            "p/a.go": "package p\n\ntype Doer interface {\n\tDo(x int) error\n}\n\nfunc Covered() {}\nfunc Open() {}\nfunc handler() {}\nfunc (t T) Do(x int) error { return nil }\nfunc wire() { register(handler) }\n",
            "p/b.go": "package p\n\nfunc Lone() {}\n",
            "p/a_test.go": "package p\n\nfunc TestCovered() { Covered() }\n",
        },
    )
    from pyspark.sql import functions as F

    rows = graph.test_gaps(g["defs"], g["refs"], F.col("path").endswith("_test.go"), g["boundary"]).collect()
    assert [(short(r.path), r.total, r.untested, list(r.untested_functions)) for r in rows] == [("p/b.go", 1, 1, ["Lone"]), ("p/a.go", 3, 2, ["Open", "wire"])]


def test_unused_exports_exemptions(spark, tmp_path):
    g = tree(
        spark,
        tmp_path,
        {
            "p/a.go": "package p\n\ntype In struct{}\ntype Local struct{ n int }\ntype Shared struct{}\n\nfunc Used() {}\nfunc Outside() {}\nfunc Never() {}\nfunc ForTests() {}\nfunc Twice() {}\n\nfunc handle(in In) { Used(); Twice(); ForTests() }\nfunc wire(l Local) { add(handle); Outside() }\n\ntype Doer interface {\n\tDo()\n}\n\nfunc (l Local) Do() {}\nfunc call(d Doer) { d.Do() }\n",
            "p/a_test.go": "package p_test\n\nfunc TestIt() { p.ForTests() }\n",
            "q/b.go": "package q\n\nfunc Twice() {}\nfunc b(s p.Shared) { p.Outside(); Twice() }\n",
        },
    )
    rows = graph.unused_exports(g["defs"], g["refs"], g["boundary"]).collect()
    assert {(r.kind, r.symbol) for r in rows} == {("type", "Local"), ("function", "Used"), ("type", "Doer")} and {short(r.package) for r in rows} == {short(f"{tmp_path}/p")}


def test_references_have_lines_and_kinds(spark, tmp_path):
    g = tree(
        spark,
        tmp_path,
        {
            "a.go": "package p\n\nvar x Widget\n\nfunc use(w *Widget) []Widget {\n\tregister(Build)\n\treturn []Widget{Build()}\n}\n",
            "b.py": "class Widget:\n    pass\n\n\ndef make(w: Widget) -> Widget:\n    f(Widget)\n    return Widget()\n",
            "c.js": "function go() {\n  return new Widget()\n}\n",
        },
    )
    found = lambda *a: [(r.path.rsplit("/", 1)[-1], r.line, r.kind) for r in graph.references(g, *a).collect()]
    assert found("Build") == [("a.go", 6, "value"), ("a.go", 7, "call")]
    assert found("Widget") == [("a.go", 3, "type"), ("a.go", 5, "type"), ("a.go", 7, "type"), ("b.py", 5, "type"), ("b.py", 6, "value"), ("b.py", 7, "call"), ("c.js", 2, "call"), ("c.js", 2, "type")]
    assert found("Widget", "call") == [("b.py", 7, "call"), ("c.js", 2, "call")]


def test_duplicate_functions_of_a_tree(spark, tmp_path):
    body = "".join(f"    value_{i} = compute(value_{i - 1}, step_{i % 5}) + offset_{i % 3}\n" for i in range(1, 30))
    content = {"a.py": f"def first(x):\n{body}    return value_29\n\n\ndef tiny():\n    return 1\n", "b.py": f"import os\n\n\ndef second(x):\n{body}    return value_29\n"}
    for name, text in content.items():
        (tmp_path / name).write_text(text)
    rows = files.scan(spark, str(tmp_path))
    found = near_duplicates.duplicate_functions(symbols.function_bodies(rows, symbols.symbols(rows.where("language = 'python'")))).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in found) == ["a.py#first", "b.py#second"] and {r.members for r in found} == {2}


def test_complexity_of_a_tree(spark, tmp_path):
    g = tree(spark, tmp_path, {"a.go": "package p\n\nfunc f(a int) {\n\tif a > 1 && a < 3 || a == 7 {\n\t\tfor i := range a {\n\t\t}\n\t}\n\tswitch a {\n\tcase 1:\n\tdefault:\n\t}\n}\n\nfunc g() {}\n"})
    rows = reports.complexity(g["spans"]).collect()
    assert [(r.function, r.complexity, r.start_line, r.end_line) for r in rows] == [("f", 6, 3, 12), ("g", 1, 14, 14)]


@pytest.mark.parametrize("text", ["", "func", "func (", "func f(", "type", "type (", "package", "import (", "func f() {", "var x = {{{", "\x00\xff", "/* open", 'x := "open', "func (a b) c(d, e f) (g, h) {}"])
def test_broken_go_is_read_as_far_as_it_goes(text):
    assert set(symbols.extract(text, "go")) == set(symbols.extract("", "go"))
    assert symbols.extract("def f(:", "python")["defs"] == []


def test_go_details():
    found = symbols.go("package p\n\nimport m \"x/y\"\n\nvar (\n\ta Alpha\n\tb = Beta{1}\n)\n\nfunc Map[K comparable, V any](in map[K]V, f func(V) Out) <-chan *pkg.Thing {\n\tx := Gen[int](1)\n\ty, ok := z.(Iface)\n\ts := `raw ) } \" text`\n\treturn nil // func no() {}\n}\n")
    assert found["functions"] == ["Map"] and found["imports"] == ["x/y"]
    types = {u["symbol"] for u in found["uses"] if u["kind"] == "type"}
    assert {"Alpha", "Beta", "V", "K", "Out", "Thing", "Iface"} <= types and "pkg" not in types
    assert [c["callee"] for c in found["calls"]] == ["Gen"] and found["spans"][0]["end_line"] == 15


def test_symbols_are_held_a_slice_at_a_time():
    """Of a batch of 3,000 files, rows of symbols come 1,024 at a time, all and in order."""
    import pandas as pd

    bodies = [f"package p\n\nfunc F{i}() {{\n\tG{i}()\n}}\n" for i in range(3000)]
    bodies[5] = None
    pdf = pd.DataFrame({"path": [f"f{i}" for i in range(3000)], "language": "go", "body": bodies}, index=range(2, 3002))
    found = list(symbols._run(iter([pdf])))
    assert [len(x) for x in found] == [1024, 1024, 952]
    assert [(p, n) for x in found for p, n in zip(x["path"], x["functions"])] == [(f"f{i}", [] if i == 5 else [f"F{i}"]) for i in range(3000)]
