import io
import json

import pytest
from test_build import write

from lodestone import __main__ as cli
from lodestone.errors import ToolkitError
from lodestone.operators.graph import CodeGraph
from lodestone.runtime import Runtime, Tool
from lodestone.serving import MOST_ROWS, Server, plain, remote_tools

TOOLS = [Tool("add", lambda x, _: x["a"] + x["b"], "Adds.", {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "number"}, "b": {"type": "number"}}}), Tool("fails", lambda *_: 1 / 0)]
FILES = {"a.ts": "import { b } from './b'\nexport function a() { b() }\n", "b.ts": "export function b() {}\n"}


def talk(server, *messages):
    out = io.StringIO()
    server.serve([m if isinstance(m, str) else json.dumps(m) + "\n" for m in messages], out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def ask(method, key=1, **params):
    return {"jsonrpc": "2.0", "id": key, "method": method, "params": params}


def test_messages():
    server = Server(Runtime(TOOLS))
    first, ping, told, sums, bad, failed, none, unknown, params, broken, text = talk(
        server, ask("initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, "\n", ask("ping", 2), ask("tools/list"), ask("tools/call", name="add", arguments={"a": 1, "b": 2}), ask("tools/call", name="add", arguments={"a": 1}),
        ask("tools/call", name="fails"), ask("tools/call", name="nothing"), ask("no/such"), ask("tools/call"), "{broken\n", "3\n",
    )
    assert first["result"]["serverInfo"]["name"] == "lodestone" and ping == {"jsonrpc": "2.0", "id": 2, "result": {}}
    assert [t["name"] for t in told["result"]["tools"]] == ["add", "fails"] and told["result"]["tools"][0]["inputSchema"]["required"] == ["a", "b"]
    assert sums["result"] == {"content": [{"type": "text", "text": "3"}]}
    assert [m["result"]["isError"] for m in (bad, failed, none)] == [True] * 3 and failed["result"]["content"][0]["text"].startswith("TOOL_EXECUTION_FAILED")
    assert [m["error"]["code"] for m in (unknown, params, broken, text)] == [-32601, -32602, -32700, -32700]


def test_remote_tools_are_tools_of_this_side():
    server = Server(Runtime(TOOLS))
    here = Runtime(remote_tools(lambda m: json.loads(json.dumps(server.handle(m))), prefix="far_"))
    assert here.execute_tool("far_add", {"a": 2, "b": 5}) == "7"
    for tool, given, code in (("far_fails", {}, "TOOL_EXECUTION_FAILED"), ("far_add", {"a": "x", "b": 1}, "TOOL_INPUT_INVALID"), ("fails", {}, "TOOL_NOT_FOUND")):
        with pytest.raises(ToolkitError) as e:
            here.execute_tool(tool, given)
        assert e.value.code == code
    with pytest.raises(ToolkitError):
        remote_tools(lambda m: {"error": {"message": "away"}})


def test_tables_are_told_up_to_a_number_of_rows(spark):
    assert plain(spark.range(3)) == {"rows": [{"id": 0}, {"id": 1}, {"id": 2}], "more": False}
    many = plain(spark.range(MOST_ROWS + 5))
    assert len(many["rows"]) == MOST_ROWS and many["more"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    root, index = write(tmp_path / "src", FILES), str(tmp_path / "all/one.index")
    run = lambda *words: (cli.main(list(words)), capsys.readouterr().out)
    assert run("build", root, "--json", str(tmp_path / "g.json"), "--json-lines", str(tmp_path / "lines"))[0] == 0
    read = CodeGraph.from_json(spark, (tmp_path / "g.json").read_text())
    assert read.nodes().count() == 4 and CodeGraph.read_json(spark, str(tmp_path / "lines")).edges().count() == read.edges().count()
    assert json.loads(run("sync", root, index)[1])["parsed"] == 2
    (tmp_path / "src/c.ts").write_text("function c() {}")
    assert {k: v for k, v in json.loads(run("sync", root, index)[1]).items() if k in ("parsed", "reused", "from", "to")} == {"parsed": 1, "reused": 2, "from": 1, "to": 2}
    assert [json.loads(line)["files"] for line in run("list", str(tmp_path / "all"))[1].splitlines()] == [3]
    assert json.loads(run("status", index)[1])["files"] == 3
    assert json.loads(run("ask", index, "find_definition", "name=c")[1])["file"] == "c.ts"
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(ask("tools/call", name="codegraph_callers", arguments={"symbol": "b"})) + "\n"))
    code, said = run("serve", index)
    assert code == 0 and json.loads(json.loads(said)["result"]["content"][0]["text"])["rows"][0]["name"] == "a"
    assert run("ask", str(tmp_path / "none.index"), "callers", "symbol=b")[0] == 1
