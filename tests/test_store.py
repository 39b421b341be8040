import json
import os

import pytest
from test_build import write

from lodestone.errors import ToolkitError
from lodestone.operators.graph import CodeGraph
from lodestone.operators.retrieval import answer_context
from lodestone.operators.store import BUCKETS, BuildStats, ParquetStore, StoreMeta, build_code_graph, config_hash, global_index_name, list_indexes, load_code_graph
from lodestone.operators.tools import graph_capability
from lodestone.runtime import Runtime, collect_tools
from lodestone.sources.tree import scan, with_content
from lodestone.streaming.watch import Served

FILES = {"a.ts": "import { b } from './b'\nexport function a() { b() }\n", "b.ts": "export function b() {}\n"}


def rows(graph):
    return sorted(map(tuple, graph.nodes().drop("ord").collect()), key=str), sorted(map(tuple, graph.edges().drop("ord").collect()), key=str)


def test_incremental_builds(spark, tmp_path):
    root, store = write(tmp_path / "src", FILES), ParquetStore(spark, str(tmp_path / "index"))
    stats = []

    def build(**options):
        graph = build_code_graph(spark, root, store=store, on_stats=stats.append, **options)
        return graph, stats[-1]

    first, now = build()
    assert now == BuildStats(2, 2, 0, 0)
    assert rows(load_code_graph(store)) == rows(first)
    assert build()[1] == BuildStats(2, 0, 2, 0)
    (tmp_path / "src/a.ts").write_text("import { b } from './b'\nexport function a() { b(); c() }\nfunction c() {}\n")
    graph, now = build(persist_graph=False)
    assert now == BuildStats(2, 1, 1, 0)
    assert rows(graph) == rows(build_code_graph(spark, root)) and rows(load_code_graph(store)) == rows(first)
    os.utime(tmp_path / "src/a.ts", (1, 1))
    assert build()[1] == BuildStats(2, 0, 2, 0)
    assert {r.path: r.mtimeMs for r in store.file_stamps().collect()}["a.ts"] == 1000.0
    (tmp_path / "src/b.ts").unlink()
    graph, now = build()
    assert now == BuildStats(1, 0, 1, 1)
    assert rows(graph) == rows(build_code_graph(spark, root)) == rows(load_code_graph(store))
    assert build(languages=["typescript"])[1].parsed == 1
    assert store.status().first().files == 1 and store.vacuum() > 0 and load_code_graph(store) is not None


def test_commit_is_atomic_and_versions_are_checked(spark, tmp_path, monkeypatch):
    store = ParquetStore(spark, str(tmp_path))
    assert store.meta() is None and store.load_graph() is None and store.files().count() == 0
    meta = StoreMeta(3, "p", "c", "r")
    facts = ([], [], [], [])
    put = lambda *paths: spark.createDataFrame([(p, "python", "h", 1.0, 2, facts) for p in paths], store.files().schema)
    store.commit(meta, put("a", "b"), reset=True)
    store.commit(meta, put("b", "c"), spark.createDataFrame([("a",)], "path string"))
    assert sorted(r.path for r in store.file_hashes().collect()) == ["b", "c"] and store.meta() == meta
    assert [r.path for r in store.get_facts(spark.createDataFrame([("c",), ("z",)], "path string")).collect()] == ["c"]
    monkeypatch.setattr(store, "_point", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        store.commit(meta, put("d"))
    monkeypatch.undo()
    assert sorted(r.path for r in store.files().collect()) == ["b", "c"]
    before = store.version()
    ParquetStore(spark, str(tmp_path)).commit(meta, put("e"))
    with pytest.raises(ToolkitError) as e:  # both began from the same version
        store.commit(meta, put("f"), expected=before)
    assert e.value.code == "CODEGRAPH_INDEX_CONFLICT" and sorted(r.path for r in store.files().collect()) == ["b", "c", "e"]
    (tmp_path / f"_CURRENT-{store.version() + 1:012d}").write_text("0123\n{half a")  # a writer died here
    assert sorted(r.path for r in store.files().collect()) == ["b", "c", "e"]
    store.commit(meta, put("g"))
    assert sorted(r.path for r in store.files().collect()) == ["b", "c", "e", "g"]
    store.commit(StoreMeta(2, "p", "c", "r"))
    assert store.meta() is None and store.files().count() == 0
    (tmp_path / "other").mkdir()
    (tmp_path / "other/_CURRENT-000000000001").write_text("{broken")
    with pytest.raises(ToolkitError) as e:
        ParquetStore(spark, str(tmp_path / "other"))
    assert e.value.code == "CODEGRAPH_INDEX_UNREADABLE"


def test_a_commit_writes_only_the_buckets_it_changes(spark, tmp_path):
    store, meta = ParquetStore(spark, str(tmp_path)), StoreMeta(3, "p", "c", "r")
    put = lambda paths, h: spark.createDataFrame([(p, "python", h, 1.0, 2, None) for p in paths], store.files().schema)
    store.commit(meta, put([f"f{k}" for k in range(300)], "old"), reset=True)
    first = dict(store._current()["files"])
    store.commit(meta, put(["f7"], "new"), spark.createDataFrame([("f9",)], "path string"))
    then = dict(store._current()["files"])
    assert len(first) == len(then) == BUCKETS and sum(first[k] != then[k] for k in first) in (1, 2)
    found = {r.path: r.hash for r in store.file_hashes().collect()}
    assert len(found) == 299 and found["f7"] == "new" and "f9" not in found and found["f8"] == "old"
    assert store.vacuum() == 0 and len(store._pointers()) == 1 and store.files().count() == 299


def test_cancelled_while_files_are_parsed(spark, tmp_path, monkeypatch):
    root = write(tmp_path / "src", {f"m{k}.py": "def f():\n    pass\n" for k in range(4)})
    store, calls = ParquetStore(spark, str(tmp_path / "index")), iter([False] * 3)
    with pytest.raises(ToolkitError) as e:
        build_code_graph(spark, root, store=store, cancelled=lambda: next(calls, True))
    assert e.value.code == "CODEGRAPH_ABORTED" and store.meta() is None
    assert build_code_graph(spark, root, cancelled=lambda: False).files().count() == 4


def test_a_tree_listed_by_the_tasks_is_the_same(spark, tmp_path):
    root = write(tmp_path, {f"d{k}/e{j}/f{i}.py": "x" * i for k in range(4) for j in range(3) for i in range(2)} | {"top.ts": "", "d1/node_modules/z.ts": ""})
    whole = [tuple(r) for r in scan(spark, root).collect()]
    assert sorted(map(tuple, scan(spark, root, folders_at_once=1).collect())) == sorted(map(tuple, scan(spark, root, folders_at_once=0).collect())) == whole
    assert len(whole) == 25 and [r[0] for r in whole] == list(range(25)) and [r[1] for r in whole] == sorted(r[1] for r in whole)


def test_lists_indexes(spark, tmp_path):
    assert list_indexes(spark, str(tmp_path / "none")).count() == 0
    for name in ("b.index", "a.index"):
        ParquetStore(spark, str(tmp_path / name))
    (tmp_path / "notes").mkdir()
    assert [(r.name, r.files, r.config_hash) for r in list_indexes(spark, str(tmp_path)).collect()] == [("a.index", 0, None), ("b.index", 0, None)]


def test_names_of_configurations():
    assert config_hash(["b", "a"], 5) == config_hash(["a", "b"], 5) != config_hash(None, 5)
    assert global_index_name("/x") == global_index_name("/x") != global_index_name("/y")


def test_tools_over_a_served_graph(spark, tmp_path):
    root = write(tmp_path, FILES | {"tests/t.ts": "import { a } from '../a'\nfunction checkA() { a() }\n"})
    served = Served(build_code_graph(spark, root))
    runtime = Runtime(collect_tools([graph_capability(served)]), spark=spark)
    ask = lambda tool, **given: runtime.execute_tool(f"codegraph_{tool}", given)
    names = lambda df: [r.name for r in df.collect()]
    assert names(ask("search_symbols", name="A")) == ["a", "checkA"] and len(names(ask("search_symbols", limit=1))) == 1
    assert names(ask("find_definition", name="b")) == ["b"] and names(ask("find_references", symbol="b")) == ["a"]
    assert names(ask("callers", symbol="b")) == ["a"] and names(ask("callees", symbol="a")) == ["b"] and names(ask("callers", symbol="b", minConfidence=0.9)) == []
    assert [(r.depth, [n.name for n in r.nodes], r.truncated) for r in ask("impact", symbol="b").orderBy("depth").collect()] == [(1, ["a"], False), (2, ["checkA"], False)]
    assert names(ask("affected", symbol="b")) == []  # the path begins with tests/: no slash before it
    summary = ask("file_summary", path="a.ts").first()
    assert len(summary.symbols) == 1 and summary.imports == ["file:b.ts"] and ask("file_summary", path="none").count() == 0
    assert {r.id for r in ask("neighbors", id="file:a.ts", edgeKinds=["imports"]).collect()} == {"file:b.ts", "file:tests/t.ts"}
    assert names(ask("relevant_context", seeds=["b"], kind="symbol", limit=2))[0] == "b"
    with pytest.raises(ToolkitError) as e:
        ask("search_symbols", kind="nonsense")
    assert e.value.code == "TOOL_INPUT_INVALID"
    assert names(ask("search_symbols", limit=-1)) == ["a", "b"] and names(ask("search_symbols", limit=-9)) == []  # the last ones go
    again = CodeGraph.from_json(spark, served().to_json())
    assert rows(again) == rows(served()) and json.loads(again.to_json()) == json.loads(served().to_json())
    contents = with_content(scan(spark, root), root).select("path", "content")
    text = answer_context(served(), contents, "What does checkA do?")
    assert "tests/t.ts:2-2 — checkA (function)\nfunction checkA() { a() }" in text
    (tmp_path / "c.ts").write_text("export function fresh() {}")
    served.swap(build_code_graph(spark, root))
    assert names(ask("find_definition", name="fresh")) == ["fresh"]
