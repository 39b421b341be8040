import threading
import time

import pytest

from lodestone.errors import ToolkitError
from lodestone.functions.messages import bearer_token, from_content, scopes_of, to_content
from lodestone.functions.validate import canonical, type_of, validate_column, validate_input
from lodestone.runtime import Capability, Context, MemoryCache, MemoryTrace, Runtime, Tool, ToolRegistry, Workflow, collect_tools, replay_cache, scope_guardrail
from lodestone.streaming.watch import Debouncer, Watcher

HELLO = Tool("hello", lambda given, ctx: f"hi {given['name']}", "Greets.", {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]})


def boom(given, ctx):
    raise RuntimeError("no")


def kinds(trace):
    return [e["type"] for e in trace.events]


def test_lifecycle_and_codes():
    trace = MemoryTrace()
    runtime = Runtime([HELLO, Tool("boom", boom)], trace=trace)
    assert runtime.execute_tool("hello", {"name": "x"}, run_id="r") == "hi x"
    assert kinds(trace) == ["runtime:start", "tool:start", "tool:end", "runtime:end"]
    for tool, given, code, events in [("none", {}, "TOOL_NOT_FOUND", ["runtime:start", "runtime:error"]), ("hello", {}, "TOOL_INPUT_INVALID", ["runtime:start", "runtime:error"]), ("boom", {}, "TOOL_EXECUTION_FAILED", ["runtime:start", "tool:start", "tool:error", "runtime:error"])]:
        trace.events.clear()
        with pytest.raises(ToolkitError) as e:
            runtime.execute_tool(tool, given)
        assert e.value.code == code and kinds(trace) == events
    assert isinstance(e.value.__cause__, RuntimeError)


def test_guardrails_by_scope():
    trace = MemoryTrace()
    runtime = Runtime([HELLO, Tool("drop", lambda g, c: "done")], [scope_guardrail({"drop": ["admin", "ops"]})], trace=trace)
    assert runtime.execute_tool("hello", {"name": "y"}) == "hi y"
    with pytest.raises(ToolkitError) as e:
        runtime.execute_tool("drop", None, context={"metadata": {"auth": {"scopes": ["ops"]}}})
    assert e.value.code == "GUARDRAIL_BLOCKED" and "missing scope(s): admin" in str(e.value)
    assert kinds(trace)[-3:] == ["runtime:start", "guardrail:blocked", "runtime:error"]
    assert runtime.execute_tool("drop", None, context={"metadata": {"auth": {"scopes": ["ops", "admin"]}}}) == "done"


def test_time_limit_and_abort(spark):
    seen = []

    def slow(given, ctx):
        seen.append(ctx.cancelled.wait(10))

    runtime = Runtime([Tool("slow", slow), Tool("query", lambda g, c: spark.range(4, numPartitions=4).foreach(lambda r: __import__("time").sleep(20)))], timeout_ms=60, spark=spark)
    began = time.time()
    with pytest.raises(ToolkitError) as e:
        runtime.execute_tool("slow")
    assert e.value.code == "TOOL_TIMEOUT" and time.time() - began < 5
    with pytest.raises(ToolkitError) as e:
        runtime.execute_tool("query", timeout_ms=1500)
    assert e.value.code == "TOOL_TIMEOUT"
    stop = threading.Event()
    stop.set()
    with pytest.raises(ToolkitError) as e:
        runtime.execute_tool("slow", cancelled=stop)
    assert e.value.code == "TOOL_ABORTED"
    time.sleep(0.2)
    assert seen == [True]


def test_context_is_frozen_and_merges():
    given = {"a": {"b": [1]}}
    c = Context(variables=given, metadata={"x": 1}, history=[1])
    given["a"]["b"].append(2)
    assert c.variables["a"]["b"] == (1,)
    with pytest.raises(TypeError):
        c.variables["a"]["c"] = 1
    d = c.merge(variables={"z": 2}, metadata={"x": 3}, history=[5])
    assert dict(d.metadata) == {"x": 3} and set(d.variables) == {"a", "z"} and d.history == (5,) and dict(c.metadata) == {"x": 1}


def test_registry_capabilities_workflow():
    registry = ToolRegistry([HELLO])
    with pytest.raises(ValueError):
        registry.register(HELLO)
    assert registry.get("hello") is HELLO and registry.get("x") is None and HELLO.descriptor()["name"] == "hello"
    assert collect_tools([Capability("a", (HELLO,))]) == [HELLO]
    with pytest.raises(ToolkitError) as e:
        collect_tools([Capability("a", (HELLO,)), Capability("b", (HELLO,))])
    assert e.value.code == "CAPABILITY_TOOL_CONFLICT"
    flow = Workflow("w").step("one", lambda p, r: 1).step("two", lambda p, r: p + 1).step("all", lambda p, r: r)
    assert flow.run() == [1, 2, [1, 2]]
    with pytest.raises(ToolkitError) as e:
        flow.step("bad", lambda p, r: 1 / 0).run()
    assert e.value.code == "WORKFLOW_STEP_FAILED"


def test_cache_order_and_time():
    now = [0]
    cache = MemoryCache(2, 1000, lambda: now[0])
    cache.set("a", 1)
    cache.set("b", 2)
    assert cache.get("a") == 1
    cache.set("c", 3)
    assert not cache.has("b") and cache.has("a")
    cache.set("d", 4)
    assert not cache.has("a")  # a test for presence is no use of it
    now[0] = 1000
    assert cache.get("d") is None
    cache.set("e", 5)
    cache.delete("e")
    assert cache.get("e") is None
    cache.set("f", 1)
    cache.clear()
    assert not cache.has("f")


def test_replay(spark):
    ops = [("x", 1, "set", "a", "1", 0.0), ("x", 2, "set", "b", "2", 1.0), ("x", 3, "get", "a", None, 2.0), ("x", 4, "set", "c", "3", 3.0), ("x", 5, "has", "b", None, 4.0), ("x", 6, "get", "a", None, 2000.0), ("y", 1, "get", "a", None, 0.0)]
    frame = spark.createDataFrame(ops, "cache string, seq long, op string, key string, value string, at_ms double")
    found = {(r.cache, r.seq): r.result for r in replay_cache(frame, 2, 1000).collect()}
    assert [found["x", k] for k in range(1, 7)] == [None, None, "1", None, "false", None] and found["y", 1] is None


SCHEMA = {"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "role": {"enum": ["admin", "user"]}, "tags": {"type": "array", "items": {"type": ["string", "null"]}}}, "required": ["name"], "additionalProperties": False}


@pytest.mark.parametrize(
    "value, errors",
    [
        ({"name": "x", "age": 3.0, "role": "user", "tags": ["a", None]}, []),
        ({"age": 1.5, "role": "boss", "more": 1}, [("/name", "missing required property"), ("/age", "expected type integer, got number"), ("/role", "value is not one of the allowed enum values"), ("/more", "additional property is not allowed")]),
        ([], [("", "expected type object, got array")]),
        ({"name": "x", "tags": ["a", 3]}, [("/tags/1", "expected type string | null, got integer")]),
    ],
)
def test_schema(spark, value, errors):
    import json

    assert [(e["path"], e["message"]) for e in validate_input(SCHEMA, value)["errors"]] == errors
    frame = spark.createDataFrame([(json.dumps(value),), (None,), ("{",)], "v string")
    rows = frame.select(validate_column(frame.v, SCHEMA).alias("r")).collect()
    assert rows[0].r.valid == (not errors) and [(e.path, e.message) for e in rows[0].r.errors] == errors
    assert not rows[1].r.valid and not rows[2].r.valid


def test_json_details():
    assert validate_input({"additionalProperties": {"type": "number"}}, {"a": 1, "b": "x"})["errors"][0]["path"] == "/b"
    assert type_of(True) == "boolean" and type_of(2.0) == "integer" and type_of(2.5) == "number" and type_of(None) == "null"
    assert canonical({"b": 1.0, "a": [2]}) == '{"b":1,"a":[2]}'
    assert not validate_input({"enum": [{"a": 1, "b": 2}]}, {"b": 2, "a": 1})["valid"]


def test_messages():
    assert to_content("x") == [{"type": "text", "text": "x"}] and '\n  "a": 1' in to_content({"a": 1})[0]["text"]
    assert from_content({"content": to_content("x")}) == "x"
    assert from_content({"content": [], "structuredContent": {"a": 1}}) == {"a": 1}
    assert from_content({"content": [{"type": "image"}]}) == [{"type": "image"}]
    with pytest.raises(ToolkitError):
        from_content({"isError": True, "content": to_content("bad")})
    assert bearer_token("bearer abc") == "abc" and bearer_token("Basic x") is None and bearer_token(None) is None
    assert scopes_of({"scope": "a  b"}) == ["a", "b"] and scopes_of({"scopes": ["x", 1]}) == ["x"] and scopes_of({}) == []


def test_debouncer():
    runs, errors, gate = [], [], threading.Event()

    def flush():
        runs.append(time.time())
        if len(runs) == 1:
            gate.wait(2)
        if len(runs) == 2:
            raise RuntimeError("x")

    d = Debouncer(30, flush, errors.append)
    for _ in range(5):
        d.trigger()
    time.sleep(0.15)
    assert len(runs) == 1
    for _ in range(3):
        d.trigger()
        time.sleep(0.05)
    gate.set()
    time.sleep(0.3)
    assert len(runs) == 2 and len(errors) == 1
    d.trigger()
    d.cancel()
    time.sleep(0.1)
    assert len(runs) == 2


@pytest.mark.parametrize("notices", [True, False])
def test_watcher(tmp_path, monkeypatch, notices):
    from lodestone.streaming import watch

    listed, plain = [], watch.walk
    monkeypatch.setattr(watch, "walk", lambda *a, **k: listed.append(1) or plain(*a, **k))
    if not notices:
        monkeypatch.setattr(watch.FolderEvents, "_watch", lambda self: (_ for _ in ()).throw(OSError("too many")))
    flushed = threading.Event()
    w = Watcher(str(tmp_path), flushed.set, quiet_ms=20, poll_ms=20)
    assert w.started and (w.events is not None) == notices
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.ts").write_text("x")
    assert not flushed.wait(0.4)
    assert (len(listed) <= 3) == notices  # without notices the tree is listed again and again
    (tmp_path / "deep").mkdir()
    time.sleep(0.1)
    (tmp_path / "deep" / "a.ts").write_text("function a() {}")
    assert flushed.wait(3)
    flushed.clear()
    (tmp_path / "deep" / "a.ts").unlink()
    assert flushed.wait(3)
    w.close()
    assert not Watcher(str(tmp_path / "none"), flushed.set).started
