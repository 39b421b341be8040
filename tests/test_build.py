import pytest

from lodestone.errors import ToolkitError
from lodestone.operators.store import build_code_graph

SAMPLE = {
    "Till.java": "public class Till {\n    int close() {\n        return count(12);\n    }\n\n    int count(int coins) {\n        return coins * 2;\n    }\n}\n",
    "Ledger.cs": "namespace Books\n{\n    public class Ledger\n    {\n        public int Post(int amount)\n        {\n            return Rounded(amount) - 1;\n        }\n\n        private int Rounded(int amount)\n        {\n            return amount / 5;\n        }\n    }\n}\n",
    "mail.py": 'def signed(text):\n    return text + " - the shop"\n\n\nclass Letter:\n    def body(self):\n        return signed("dear all")\n',
    "scale.rs": "fn grams(x: i32) -> i32 {\n    x * 1000\n}\n\npub fn weigh() -> i32 {\n    grams(2)\n}\n\nstruct Pan;\n",
    "desk.ts": "import { price, Label } from './stock'\n\nexport function sell(): number {\n  const tag = new Label()\n  tag.print()\n  return price(3)\n}\n",
    "stock.ts": "export function price(n: number): number {\n  return n * 7\n}\n\nexport class Label {\n  print(): string {\n    return 'seven'\n  }\n}\n",
}


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def build(spark, folder, files, **options):
    return build_code_graph(spark, write(folder, files), **options)


def short(i):
    return i.split("#")[-1].split("@")[0] if i.startswith("sym:") else i[5:]


def calls(graph):
    return {(short(r.src), short(r.dst)): (r.confidence, r.call_kind, r.line, r.receiver_type) for r in graph.edges().where("kind = 'calls'").collect()}


def test_sample_tree(spark, tmp_path):
    graph = build(spark, tmp_path, SAMPLE)
    symbols = {(r.path, r.name): (r.symbol_kind, r.start_line, r.end_line) for r in graph.symbols().collect()}
    assert symbols == {
        ("Till.java", "Till"): ("class", 1, 9), ("Till.java", "close"): ("method", 2, 4), ("Till.java", "count"): ("method", 6, 8),
        ("Ledger.cs", "Ledger"): ("class", 3, 14), ("Ledger.cs", "Post"): ("method", 5, 8), ("Ledger.cs", "Rounded"): ("method", 10, 13),
        ("mail.py", "signed"): ("function", 1, 2), ("mail.py", "body"): ("function", 6, 7), ("mail.py", "Letter"): ("class", 5, 7),
        ("scale.rs", "grams"): ("function", 1, 3), ("scale.rs", "weigh"): ("function", 5, 7), ("scale.rs", "Pan"): ("class", 9, 9),
        ("desk.ts", "sell"): ("function", 3, 7), ("stock.ts", "price"): ("function", 1, 3), ("stock.ts", "Label"): ("class", 5, 9), ("stock.ts", "print"): ("method", 6, 8),
    }
    assert calls(graph) == {
        ("close", "count"): (1.0, "call", 3, None), ("Post", "Rounded"): (1.0, "call", 7, None), ("body", "signed"): (1.0, "call", 7, None), ("weigh", "grams"): (1.0, "call", 6, None),
        ("sell", "Label"): (0.8, "new", 4, None), ("sell", "print"): (0.8, "call", 5, "Label"), ("sell", "price"): (0.8, "call", 6, None),
    }
    kinds = {r.kind: r["count"] for r in graph.edges().groupBy("kind").count().collect()}
    assert kinds == {"contains": 16, "imports": 1, "references": 7, "calls": 7} and graph.nodes().count() == 22
    assert [(r.src, r.dst) for r in graph.edges().where("kind = 'imports'").collect()] == [("file:desk.ts", "file:stock.ts")]


@pytest.mark.parametrize(
    "files, expected",
    [
        ({"a.ts": "function c() {}\nfunction b() { c() }\nfunction a() { b() }"}, {("b", "c"): 1.0, ("a", "b"): 1.0}),
        ({"a.ts": "class K {\n  helper() {}\n  run() { this.helper() }\n}"}, {("run", "helper"): 1.0}),
        ({"util.ts": "export function helper() {}", "main.ts": "import { helper } from './util'\nfunction run() { helper() }"}, {("run", "helper"): 0.8}),
        ({"a.ts": "export function dup() {}", "b.ts": "export function dup() {}", "c.ts": "function run() { dup() }"}, {}),
        ({"a.py": "def shared():\n    pass", "b.ts": "function run() { shared() }"}, {}),
        ({"a.ts": "class A { go() {} }", "b.ts": "class B { go() {} }", "c.ts": "function run(x: any) { x.go() }"}, {}),
        ({"a.ts": "class A { go() {} }", "c.ts": "function run(x: any) { x.go() }"}, {("run", "go"): 0.5}),
        ({"a.ts": "class A { static make() {} }", "c.ts": "function run() { A.make() }"}, {("run", "make"): 0.8}),
        ({"a.py": "class K:\n    def m(self):\n        self.n()\n    def n(self):\n        pass"}, {}),
        ({"a.py": "class K:\n    pass\ndef f():\n    K()"}, {("f", "K"): 1.0}),
        ({"a.go": "package a\ntype T struct{}\nfunc (t T) Run() { t.Stop() }\nfunc (t *T) Stop() {}"}, {("Run", "Stop"): 0.5}),
        ({"a.ts": "function a(x) { foo().bar() }\nfunction bar() {}"}, {("a", "bar"): 1.0}),
        ({"a.ts": "function f() { f(); f() }"}, {}),
    ],
)
def test_call_rules(spark, tmp_path, files, expected):
    assert {k: v[0] for k, v in calls(build(spark, tmp_path, files)).items()} == expected


def test_calls_add_up(spark, tmp_path):
    graph = build(spark, tmp_path, {"a.ts": "class W {}\nfunction run() {\n  make()\n  make()\n  make()\n}\nfunction make() { return new W() }"})
    row = graph.edges().where("kind = 'calls' and call_count = 3").first()
    assert (short(row.src), short(row.dst), row.line, row.call_kind) == ("run", "make", 3, "call")


def test_impact_and_confidence(spark, tmp_path):
    graph = build(spark, tmp_path, {"u.ts": "export function c() {}", "m.ts": "import { c } from './u'\nfunction b() { c() }\nfunction a() { b() }"})
    found = graph.impact("c").groups().orderBy("depth").collect()
    assert [[short(n.id) for n in r.nodes] for r in found] == [["b"], ["a"]]
    assert graph.impact("c", min_confidence=0.9).rows.count() == 0
    assert graph.impact("c", min_confidence=0.8).rows.count() == 2
    cut = graph.impact("c", max_nodes=1)
    assert cut.truncated and cut.rows.count() == 1 and not graph.impact("c").truncated
    assert graph.impact("nothing").rows.count() == 0


def test_scan_options(spark, tmp_path):
    files = {"README.md": "# x", "a.ts": "function a() {}", "b.py": "def b(): pass", "node_modules/x.ts": "function hidden() {}", "deep/__init__.py": "def top(): pass", "deep/_private.py": "def low(): pass"}
    root = write(tmp_path, files)
    names = lambda g: {r.name for r in g.symbols().collect()}
    assert names(build_code_graph(spark, root)) == {"a", "b", "top", "low"}
    assert names(build_code_graph(spark, root, languages=["python"])) == {"b", "top", "low"}
    assert names(build_code_graph(spark, root, ignore=["deep"])) == {"a", "b"}
    assert "hidden" in names(build_code_graph(spark, root, replace_ignore=True))
    assert names(build_code_graph(spark, root, max_file_bytes=5)) == set()
    with pytest.raises(ToolkitError) as e:
        build_code_graph(spark, root + "/nowhere")
    assert e.value.code == "CODEGRAPH_DIR_NOT_FOUND"
    with pytest.raises(ToolkitError) as e:
        build_code_graph(spark, root + "/a.ts")
    assert e.value.code == "CODEGRAPH_NOT_A_DIRECTORY"
    with pytest.raises(ToolkitError):
        build_code_graph(spark, root, cancelled=lambda: True)


def test_python_package_imports(spark, tmp_path):
    graph = build(spark, tmp_path, {"pkg/__init__.py": "from .core import core\n", "pkg/core.py": "def core():\n    pass\n", "run.py": "from pkg.core import core\nimport pkg\ncore()\n"})
    found = {(r.src, r.dst) for r in graph.edges().where("kind = 'imports'").collect()}
    assert found == {("file:pkg/__init__.py", "file:pkg/core.py"), ("file:run.py", "file:pkg/core.py"), ("file:run.py", "file:pkg/__init__.py")}
    assert calls(graph)[("run.py", "core")][0] == 0.8


def test_candidates_as_expressions(spark):
    import random

    from pyspark.sql import functions as F

    from lodestone.operators.build import candidates_column, import_candidates

    draw, cases = random.Random(2), []
    for _ in range(600):
        path = "/".join(draw.choice(("a", "b", "lib", "src")) for _ in range(draw.randint(0, 3)))
        path = f"{path}/x.ts" if path else "x.ts"
        raw = draw.choice(("./", "../", "../../", "../../../", "", ".", "..")) + "/".join(draw.choice(("m", "n", "..", ".", "o.p")) for _ in range(draw.randint(0, 3))) + draw.choice(("", "", "/"))
        cases.append(("esm-relative", path, raw))
        cases.append(("python", path, "." * draw.randint(0, 4) + ".".join(draw.choice("mno") for _ in range(draw.randint(0, 3)))))
    cases.append(("none", "a.go", "fmt"))
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, style string, path string, raw string")
    found = {r.k: r.c for r in frame.select("k", candidates_column(F.col("style"), F.col("path"), F.col("raw")).alias("c")).collect()}
    for k, case in enumerate(cases):
        assert (found[k] or []) == import_candidates(*case), case
