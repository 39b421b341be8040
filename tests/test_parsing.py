import pytest

from lodestone.languages import language_for_extension, languages_table, supported_extensions
from lodestone.operators.build import _Scopes, import_candidates
from lodestone.parsing import parse_file, parse_files
from lodestone.parsing.facts import unquoted


def found(language, source):
    facts = parse_file(language, source)
    return (
        {(d["name"], d["kind"], d["startLine"], d["endLine"]) for d in facts["definitions"]},
        {(r["name"], r["receiver"], bool(r["isNew"])) for r in facts["references"]},
        [i["raw"] for i in facts["imports"]],
        {(b["name"], b["type"]) for b in facts["typeBindings"]},
    )


def test_typescript():
    source = """import def, { a as b } from "./x"
import './side'
export * from '../y'
export { z } from './z'
const re = /fn\\(a\\)/g, text = `call(${inner(1)}) ${`deep ${low()}`}`
export default async function main<T>(svc: Service, n: number, opt: Opt = make()): Promise<void> {
  const w = new Widget(), q: Queue = build()
  svc.run(); this.x(); a.b.c(); foo().bar(); q?.push(1)
  if (n) { while (go()) {} }
  return new ns.Thing()
}
function* gen() { yield one() }
abstract class Base<T> extends Root {
  private readonly cache = new Map<string, number>()
  static count: number = 0
  #hidden = 1
  name?: string
  handler = async (x: Item) => { this.use(x) }
  constructor(private db: Db) { super() }
  get size(): number { return this.cache.size }
  abstract todo(): void
  async *walk(): AsyncGenerator<number> { yield 1 }
}
interface Shape { area(): number }
type Id = string | number
export const enum Color { Red }
const arrow = (x: number): number => x + 1
const short = x => twice(x)
let expr = function () { return 1 }
const obj = { method(a) { return a }, prop: 1 }
// ghost()
/* ghost() */ const s = "ghost()"
"""
    defs, refs, imports, binds = found("typescript", source)
    names = {(n, k) for n, k, *_ in defs}
    assert names == {
        ("main", "function"), ("gen", "function"), ("Base", "class"), ("cache", "field"), ("count", "field"), ("name", "field"), ("handler", "field"), ("constructor", "method"), ("size", "method"), ("walk", "method"),
        ("Shape", "interface"), ("Id", "type"), ("Color", "enum"), ("arrow", "function"), ("short", "function"), ("expr", "function"), ("method", "method"),
    }
    assert {("main", "function", 6, 11), ("Base", "class", 13, 23), ("gen", "function", 12, 12), ("walk", "method", 22, 22)} <= defs
    calls = {(n, r) for n, r, new in refs if not new}
    assert calls == {("inner", None), ("low", None), ("make", None), ("build", None), ("run", "svc"), ("x", "this"), ("c", None), ("foo", None), ("bar", None), ("push", "q"), ("go", None), ("one", None), ("use", "this"), ("twice", None)}
    assert {n for n, _, new in refs if new} == {"Widget", "Map"}
    assert imports == ["./x", "./side", "../y", "./z"]
    assert binds == {("svc", "Service"), ("opt", "Opt"), ("w", "Widget"), ("q", "Queue"), ("x", "Item"), ("db", "Db")}


def test_javascript():
    defs, refs, imports, binds = found("javascript", "class A { f() { g() } field = 1\n static h() {} }\nconst { q } = require('x')\nexport default class B {}\nconst C = class D { m() {} }\nx = a / b / c(1)\n")
    assert {(n, k) for n, k, *_ in defs} == {("A", "class"), ("f", "method"), ("field", "field"), ("h", "method"), ("B", "class"), ("m", "method")}
    assert {n for n, *_ in refs} == {"g", "require", "c"} and binds == set()


def test_python():
    source = "import os, a.b as c\nfrom . import x\nfrom ..pkg.mod import y\nfrom z import w\n\n@dec\nclass K(Base):\n    async def m(self, é: Kind, d: Other = None, *, kw: Third):\n        v = Make()\n        é.run(); self.go(); a.b.c(); f()()\n\nübung = lambda: call()\n"
    defs, refs, imports, binds = found("python", source)
    assert defs == {("K", "class", 7, 10), ("m", "function", 8, 10)}
    assert {(n, r) for n, r, _ in refs} == {("Make", None), ("run", None), ("go", "self"), ("c", None), ("f", None), ("call", None)}
    assert sorted(imports) == sorted(["z", ".", "..pkg.mod", "os", "a.b"]) and binds == {("é", "Kind"), ("kw", "Third"), ("v", "Make")}
    facts = parse_file("python", source)
    assert all(source[r["startIndex"] :].startswith(r["name"]) for r in facts["references"])


def test_broken_python_still_gives_facts():
    defs, refs, imports, _ = found("python", "import a.b\ndef f(:\n    g(1)\n    x.h('k(')  # m()\nclass C\n    def d(self):\n        pass\n\nz()\n")
    assert defs == {("f", "function", 2, 4), ("C", "class", 5, 7), ("d", "function", 6, 7)}
    assert {("g", None, False), ("h", "x", False), ("z", None, False)} <= refs and imports == ["a.b"]


def test_go():
    source = 'package a\nimport (\n\t"fmt"\n\tm "net/http"\n)\nimport "os"\ntype T struct {\n\tx int\n}\ntype (\n\tA = int\n\tB interface{ F() }\n)\nfunc Plain[K any](k K) (int, error) {\n\treturn run(`raw(`), nil\n}\nfunc (t *T) Method(f func() int) { t.x.go1(); t.Stop(); fmt.Println("x"); go helper() }\n'
    defs, refs, imports, _ = found("go", source)
    assert {(n, k) for n, k, *_ in defs} == {("T", "type"), ("A", "type"), ("B", "type"), ("Plain", "function"), ("Method", "method")}
    assert ("Plain", "function", 14, 16) in defs and ("T", "type", 7, 9) in defs
    assert {(n, r) for n, r, _ in refs} == {("run", None), ("go1", None), ("Stop", "t"), ("Println", "fmt"), ("helper", None)}
    assert imports == ["fmt", "net/http", "os"]


def test_java():
    source = 'package p;\nimport java.util.List;\nimport static a.B.c;\n@Ann("x")\npublic final class K<T> extends Base {\n  private int n = make();\n  K(int a) { super(a); }\n  @Override\n  public List<String> get(int i) throws E { return this.find(i).map(x -> f(x)); }\n  abstract void none();\n  enum Color { RED(1), BLUE; Color(int i) {} }\n  interface I { int m(); }\n  record P(int x) {}\n  void go() { new Widget(1); w.run(); if (x) { call(); } String s = """\n ghost() """; }\n}\n'
    defs, refs, imports, _ = found("java", source)
    names = {(n, k) for n, k, *_ in defs}
    assert {("K", "class"), ("K", "method"), ("get", "method"), ("none", "method"), ("Color", "enum"), ("Color", "method"), ("I", "interface"), ("m", "method"), ("P", "class"), ("go", "method")} == names
    assert {("make", None, False), ("find", "this", False), ("map", None, False), ("f", None, False), ("Widget", None, True), ("run", "w", False), ("call", None, False)} <= refs and not {"ghost", "super"} & {n for n, *_ in refs}
    assert imports == ["java.util.List", "a.B.c"]


def test_csharp():
    source = 'using System;\nusing A.B.C;\nnamespace N {\n  public record R(int X);\n  public delegate int Handler(string s);\n  struct S { }\n  enum E { A, B }\n  interface I { void M(); int P { get; } }\n  public class K : Base {\n    public int Count { get; set; } = 3;\n    public string Name => Make();\n    public K(int a) : base(a) { }\n    public static T Get<T>(int x) where T : new() => Find(x);\n    private void Go() { var w = new Widget(); w.Run(); this.Stop(); a.b.Deep(); var s = @"ghost()"; foreach (var x in Items()) { } }\n  }\n}\n'
    defs, refs, imports, _ = found("csharp", source)
    names = {(n, k) for n, k, *_ in defs}
    assert names == {("R", "class"), ("Handler", "type"), ("S", "class"), ("E", "enum"), ("I", "interface"), ("M", "method"), ("P", "field"), ("K", "class"), ("Count", "field"), ("Name", "field"), ("K", "method"), ("Get", "method"), ("Go", "method")}
    assert {("Make", None, False), ("Find", None, False), ("Widget", None, True), ("Run", "w", False), ("Stop", "this", False), ("Deep", None, False), ("Items", None, False)} <= refs and "ghost" not in {n for n, *_ in refs}
    assert imports == ["System", "A.B.C"]


def test_rust():
    source = "use std::io;\npub(crate) struct P<'a> { x: &'a str }\nstruct U(i32);\nenum E { A }\npub trait T { fn sig(&self); fn body(&self) { self.sig() } }\ntype Al = Vec<u8>;\nimpl T for U { type Item = u8; fn sig(&self) { A::make(); x.run(); x.y.z(); println!(\"{}\", ghost(1)); let c = 'c'; free() } }\n"
    defs, refs, *_ = found("rust", source)
    assert {(n, k) for n, k, *_ in defs} == {("P", "class"), ("U", "class"), ("E", "enum"), ("T", "interface"), ("Al", "type"), ("Item", "type"), ("body", "function"), ("sig", "function")}
    assert {(n, r) for n, r, _ in refs} >= {("sig", "self"), ("make", None), ("run", "x"), ("z", None), ("free", None)} and not {"ghost", "println"} & {n for n, *_ in refs}


@pytest.mark.parametrize("language", ["javascript", "typescript", "tsx", "python", "go", "csharp", "java", "rust"])
def test_nothing_breaks_the_parsers(language):
    for source in ("", "\x00", "}", "{", "((((", "class", "function", "'", "`${", "/", "fn", "type (", "def f(", "new", "import", "a < b > (c)", "﻿class A {", "class A { x", "func (", "é" * 10, "/* open", '"""'):
        facts = parse_file(language, source)
        assert set(facts) == {"definitions", "references", "imports", "typeBindings"}


def test_imports_of_paths():
    esm = lambda path, raw: import_candidates("esm-relative", path, raw)
    assert esm("src/a.ts", "./b")[:2] == ["src/b", "src/b.ts"] and len(esm("a.ts", "./b")) == 17 and esm("a.ts", "react") == []
    assert "src/index.ts" in esm("src/x/a.ts", "..") and "lib/index.js" in esm("a.ts", "./lib/") and "index.ts" in esm("a.ts", ".")
    py = lambda path, raw: import_candidates("python", path, raw)
    assert py("p/q/a.py", ".core") == ["p/q/core.py", "p/q/core/__init__.py"] and py("p/q/a.py", "..x.y") == ["p/x/y.py", "p/x/y/__init__.py"]
    assert py("p/a.py", ".") == ["p.py", "p/__init__.py"] and py("a.py", "m.n") == ["m/n.py", "m/n/__init__.py"] and import_candidates("none", "a.go", "fmt") == []


def test_scopes():
    import random

    draw = random.Random(1)
    for _ in range(200):
        spans = [(a := draw.randrange(30), a + draw.randrange(12), str(k)) for k in range(draw.randrange(12))]
        scopes = _Scopes(spans)
        for place in range(45):
            inside = [(s, -k, i) for k, (s, e, i) in enumerate(spans) if s <= place <= e]
            assert scopes.at(place) == (max(inside)[2] if inside else None)


def test_tables(spark):
    assert language_for_extension(".PY").id == "python" and language_for_extension(".md") is None and len(supported_extensions()) == 14
    assert languages_table(spark).count() == 14 and unquoted('"x') == "x" and unquoted("' a '") == "a"
    rows = [("a.py", b"def f(): g()", 1), ("b.md", b"x", 2), ("c.ts", None, 3), ("d.rs", b"\xff fn x() {}", 4)]
    found = {r.path: r for r in parse_files(spark.createDataFrame(rows, "path string, content binary, definitions int")).collect()}
    assert found["b.md"].facts is None and found["c.ts"].facts.definitions == [] and found["d.rs"].facts.definitions[0].name == "x" and found["a.py"].definitions == 1


def test_lists_of_any_length():
    names = ", ".join(f"name{k}" for k in range(3000))
    defs, refs, imports, _ = found("typescript", f"import {{ {names} }} from './many'\nexport {{ {names} }} from './out'\nimport type {{ T }} from './t'\nexport {{ name1 }}\nfoo('x')\n")
    assert imports == ["./many", "./t", "./out"]
    arguments = ", ".join(f"A{k}<B{k}>" for k in range(400))
    _, refs, _, _ = found("typescript", f"function f() {{ make<{arguments}>(1); a < b; c(2) }}")
    assert {("make", None, False), ("c", None, False)} <= refs
    flat = "const flags = [" + ", ".join(f"a{k} < b{k}" for k in range(20_000)) + "]\nfunction g() { done() }"
    defs, refs, _, _ = found("typescript", flat)  # one pass, however many comparisons
    assert ("g", "function", 2, 2) in defs and ("done", None, False) in refs
