import json

import pytest
from pyspark.sql import functions as F

from codelode.sources import exchange, files, outline


def test_scan(spark, tmp_path):
    for p, t in {"src/main.py": "x = 1\n", "src/a.rs": "fn f() {}", "node_modules/x.js": "1", ".git/y.py": "2", "lib.min.js": "3", "notes.txt": "4", "one.go": "package a"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/main.py", "src/a.rs", "one.go"}
    assert (rows["src/main.py"].line_count, rows["src/a.rs"].line_count, rows["one.go"].line_count) == (1, 1, 1)
    assert rows["src/a.rs"].language == "rust" and len(rows["src/a.rs"].sha256) == 64
    assert files.scan(spark, str(tmp_path), max_files=1).count() == 1


def test_ignore_and_guard():
    assert files.parse_ignore_file("# x\n\nbuild/\n*.log\n") == ["build", "*.log"]
    assert files.safe_path("/r", "a/../b") == "/r/b"
    with pytest.raises(ValueError):
        files.safe_path("/r", "a/../../b")


def test_export_and_import(spark):
    notes = spark.createDataFrame([("a", 10.0), ("b", 1.0)], "content string, expires_at double")
    acts = spark.createDataFrame([("t", 5.0)], "target string, ts double")
    qs = spark.createDataFrame([("q", 5.0)], "query_text string, logged_at double")
    lines = exchange.export_state(notes, acts, qs, 5.0, "m")
    assert json.loads(lines.first().value)["kind"] == "manifest"
    assert [r.content for r in exchange.read_state(lines, "decision", "content string, expires_at double").collect()] == ["a"]
    assert exchange.read_state(lines.limit(0), "query", "query_text string").count() == 0


def test_manifests(spark):
    m = spark.createDataFrame(
        [
            ("p", "requirements.txt", "# c\nrequests[x]>=2\nnumpy\n"), ("p", "pyproject.toml", '[project]\ndependencies = [\n "pandas>=2",\n "numpy",\n]\n'),
            ("p", "package.json", '{"dependencies": {"left": "1"}, "devDependencies": {"jest": "2"}}'), ("p", "Cargo.toml", '[dependencies]\nserde = "1"\n[dev]\nx = "1"\n'), ("q", "other.txt", "x"), ("q", "package.json", None),
        ],
        "project string, path string, text string",
    )
    got = [(r.name, r.ecosystem) for r in exchange.manifest_dependencies(m).orderBy("pos").collect()]
    assert got == [("requests", "PyPI"), ("numpy", "PyPI"), ("pandas", "PyPI"), ("left", "npm"), ("jest", "npm"), ("serde", "crates.io")]


def test_occurrences(spark, tmp_path):
    doc = {"documents": [{"relative_path": "a.py", "occurrences": [{"symbol": "f", "symbol_roles": 1, "range": [2, 0, 3]}, {"symbol": "f", "range": [9, 0, 3]}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in exchange.occurrences(spark, str(tmp_path / "i.json")).orderBy("line").collect()] == [("a.py", "f", True, 3), ("a.py", "f", False, 10)]


def test_registry():
    projects, warnings = exchange.project_registry('[[projects]]\nname = "a"\nroot = "/a"\n[[projects]]\nname = "b"\n[[clusters]]\nname = "c"\nprojects = ["a"]\n')
    assert projects == [{"name": "a", "root": "/a", "languages": [], "clusters": ["c"]}] and len(warnings) == 1


SOURCES = {
    "python": ('import os, sys as s\nfrom a.b import c as d, e\n\n@dec\nclass A:\n    """Doc."""\n    def f(self):\n        """Inner."""\n        def nested(): pass\n\ndef _g(x):\n    return 1\n', {("m.A", "class"), ("m.A.f", "method"), ("m._g", "function")}),
    "rust": ("use std::fs;\n/// Adds.\npub fn add(a: i32) -> i32 {\n    a\n}\nstruct P { x: i32 }\nimpl P {\n    fn new() -> P { P { x: 1 } }\n}\n", {("m::add", "function"), ("m::P", "class"), ("m::P::new", "method")}),
    "typescript": ("import { a, b } from './x';\n/** Doc */\nexport class K {\n  run(x: number): void {\n    if (x) { go(); }\n  }\n}\nexport const f = (x) => x;\ninterface I { a: string }\nfunction g() {}\n", {("m.K", "class"), ("m.K.run", "method"), ("m.f", "function"), ("m.I", "class"), ("m.g", "function")}),
    "go": ('package x\nimport (\n\t"fmt"\n)\n// Does.\nfunc Do(a int) int {\n\treturn a\n}\ntype T struct {\n\ta int\n}\nfunc (t *T) run() {\n}\n', {("m.Do", "function"), ("m.T", "class"), ("m.T.run", "method")}),
    "java": ("import a.b.C;\npublic class K {\n    private int x;\n    public K(int x) {\n        this.x = x;\n    }\n    protected String run(int a) {\n        return null;\n    }\n}\n", {("m.K", "class"), ("m.K.x", "function"), ("m.K.K", "method"), ("m.K.run", "method")}),
    "c": ("#include <stdio.h>\nstruct P {\n    int x;\n};\nstatic int f(int a) {\n    return a;\n}\n", {("m.P", "class"), ("m.f", "function")}),
    "ruby": ("require 'set'\nclass A\n  def f(x)\n    x\n  end\nend\n", {("m::A", "class"), ("m::A::f", "method")}),
    "php": ("<?php\nuse A\\B;\nclass K {\n  private function f() { return 1; }\n}\nfunction g() {}\n", {("m\\K", "class"), ("m\\K\\f", "method"), ("m\\g", "function")}),
    "kotlin": ("import a.b\nclass K {\n  fun f(x: Int): Int { return x }\n}\nfun g() {}\n", {("m.K", "class"), ("m.K.f", "method"), ("m.g", "function")}),
    "swift": ("import Foo\nstruct K {\n  func f() {}\n}\nprotocol P {}\n", {("m.K", "class"), ("m.K.f", "method"), ("m.P", "class")}),
    "zig": ('const std = @import("std");\npub fn f() void {}\nconst P = struct {\n  x: i32,\n};\n', {("m.f", "function"), ("m.P", "class")}),
    "rust modules": ("mod a;\npub mod b {\n    pub fn f() {}\n}\n", {("m::a", "module"), ("m::b", "module"), ("m::b::f", "method")}),
    "c declarations": ("typedef unsigned long size;\nint f(int a);\nstatic void g(void) {\n    h(1);\n}\n", {("m.size", "class"), ("m.f", "function"), ("m.g", "function")}),
    "php namespace": ("<?php\nnamespace A\\B;\nfunction g() {}\n", {("m\\A\\B", "module"), ("m\\g", "function")}),
    "typescript fields": ("class K {\n  private size: number = 1;\n  run() {\n    return 1;\n  }\n}\n", {("m.K", "class"), ("m.K.size", "function"), ("m.K.run", "method")}),
    "solidity": ("contract C {\n  event E(uint a);\n  function f() public {}\n}\n", {("m.C", "class"), ("m.C.E", "method"), ("m.C.f", "method")}),
}


@pytest.mark.parametrize("language", SOURCES)
def test_outline(language):
    text, want = SOURCES[language]
    language = language.split()[0]
    o = outline.outline(text, language, f"d/m.{language}")
    assert {(s["qualified"], s["kind"]) for s in o.symbols} == want and not o.errors


def test_outline_details(spark):
    o = outline.outline(SOURCES["python"][0], "python", "m.py")
    by = {s["name"]: s for s in o.symbols}
    assert by["A"]["docstring"] == "Doc." and by["A"]["decorators"] == "@dec" and by["_g"]["visibility"] == "private" and by["f"]["line_end"] == 9
    assert [(i["module"], i["names"]) for i in o.imports] == [("os", []), ("sys", []), ("a.b", ["c", "e"])]
    df = spark.createDataFrame([(1, "a.py", "python", "def f(:\n  pass\ndef g():\n  pass\n"), (2, "b.x", "cobol", "x"), (3, None, None, None)], "file_id long, path string, language string, source_text string")
    p = outline.parse(df)
    assert {r.file_id: r.errors for r in p.collect()}[2] == ["unsupported language: cobol"]
    assert outline.symbols_of(p).filter(F.col("name") == "g").count() == 1
    assert outline.parse(df.limit(0)).count() == 0


def test_a_text_that_takes_too_long_is_an_error_row(spark, tmp_path):
    (tmp_path / "slow.py").write_text("LANGUAGE = 'slow'\ndef extract(text, path):\n    while True: pass\n")
    (tmp_path / "words.py").write_text("LANGUAGE = 'words'\ndef extract(text, path):\n    return [{'name': w, 'kind': 'function', 'extra': 1} for w in text.split()], []\n")
    (tmp_path / "broken.py").write_text("def (")
    (tmp_path / "nothing.py").write_text("LANGUAGE = 'x'\n")
    extractors, skipped = outline.load_extractors(str(tmp_path))
    assert sorted(extractors) == ["slow", "words"] and len(skipped) == 2
    assert outline.outline_of("a b", "slow", "x", extractors, 0.2).errors == ["took longer than 0.2 seconds"]
    df = spark.createDataFrame([(1, "a", "words", "f g"), (2, "b.py", "python", "def h():\n    pass\n")], "file_id long, path string, language string, source_text string")
    out = {r.file_id: r for r in outline.parse(df, {"words": extractors["words"]}).collect()}
    assert [s.name for s in out[1].symbols] == ["f", "g"] and [s.name for s in out[2].symbols] == ["h"]


def test_roots_and_languages():
    for bad in ("/home/me", "/home", "/", "/x/node_modules", "/usr/lib/a", "/etc/a"):
        with pytest.raises(ValueError):
            files.check_root(bad, "/home/me")
    assert files.check_root("/home/me/project", "/home/me") == "/home/me/project" and files.check_root("/srv/etc/a", "/home/me")
    assert files.known_languages(["python", "cobol"], ["words"]) == ["python", "words"] and "zig" in files.known_languages([])
