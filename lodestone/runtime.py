"""Tools behind a guarded and traced runtime: registry, validation, guardrails, time limits, events; contexts,
capabilities, workflows and a small cache."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ToolkitError
from lodestone.functions.validate import validate_input

TRACE = "type string, timestamp long, runId string, data map<string,string>"


def frozen(value):
    """The value with every list a tuple and every dict read-only, all the way down."""
    if isinstance(value, Mapping):
        return MappingProxyType({k: frozen(v) for k, v in value.items()})
    return tuple(map(frozen, value)) if isinstance(value, (list, tuple)) else value


@dataclass(frozen=True)
class Context:
    """What a run may see: read-only, and merged rather than changed."""

    history: tuple = ()
    documents: tuple = ()
    variables: Mapping[str, Any] = field(default_factory=dict)
    metadata: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("history", "documents", "variables", "metadata"):
            object.__setattr__(self, name, frozen(getattr(self, name)))

    def merge(self, **more) -> Context:
        """Variables and metadata are merged key by key, history and documents replaced."""
        for name in ("variables", "metadata"):
            if name in more:
                more[name] = {**getattr(self, name), **(more[name] or {})}
        return replace(self, **more)


@dataclass(frozen=True)
class Tool:
    id: str
    execute: Callable[[Any, ToolContext], Any]
    description: str = ""
    input: Mapping | None = None

    def descriptor(self) -> dict:
        """What a remote caller is told: name, description and an input schema, an empty object's where there is none."""
        return {"name": self.id, "description": self.description, "inputSchema": dict(self.input or {"type": "object", "properties": {}})}


@dataclass(frozen=True)
class ToolContext:
    data: Context
    cancelled: threading.Event


class ToolRegistry:
    """Tools by id. Those given at the start may replace each other; registering a known id is an error."""

    def __init__(self, tools: Iterable[Tool] = ()):
        self._tools = {t.id: t for t in tools}

    def register(self, tool: Tool) -> None:
        if tool.id in self._tools:
            raise ValueError(f"tool already registered: {tool.id}")
        self._tools[tool.id] = tool

    def get(self, tool_id: str) -> Tool | None:
        return self._tools.get(tool_id)

    def list(self) -> list[Tool]:
        return list(self._tools.values())


@dataclass(frozen=True)
class Verdict:
    allowed: bool
    reason: str | None = None


@dataclass(frozen=True)
class Guardrail:
    id: str
    check: Callable[[Any, str, Context], Verdict]


def scope_guardrail(required: Mapping[str, list[str]], id: str = "scope-authorization") -> Guardrail:
    """Lets a tool run if the caller's ``metadata.auth.scopes`` hold all that it needs; tools not named need none."""

    def check(_input, tool_id: str, data: Context) -> Verdict:
        have = set((data.metadata.get("auth") or {}).get("scopes") or ())
        missing = [s for s in required.get(tool_id) or () if s not in have]
        return Verdict(False, f"missing scope(s): {', '.join(missing)}") if missing else Verdict(True)

    return Guardrail(id, check)


@dataclass(frozen=True)
class Capability:
    id: str
    tools: tuple[Tool, ...]
    description: str = ""


def collect_tools(capabilities: Iterable[Capability]) -> list[Tool]:
    owners: dict[str, str] = {}
    for c in capabilities:
        for t in c.tools:
            if t.id in owners:
                raise ToolkitError("CAPABILITY_TOOL_CONFLICT", f'tool id "{t.id}" is in both "{owners[t.id]}" and "{c.id}"')
            owners[t.id] = c.id
    return [t for c in capabilities for t in c.tools]


class MemoryTrace:
    """Keeps events, and shows them as a DataFrame for the span fold."""

    def __init__(self):
        self.events: list[dict] = []

    def emit(self, event: dict) -> None:
        self.events.append(event)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(e["type"], e["timestamp"], e["runId"], {k: str(v) for k, v in e.get("data", {}).items() if v is not None}) for e in self.events]
        return spark.createDataFrame(rows, TRACE)


class Runtime:
    """Runs tools: lookup, validation, guardrails, then execution under a time limit; every step is an event."""

    def __init__(self, tools: Iterable[Tool] = (), guardrails: Iterable[Guardrail] = (), context: Context | None = None, trace=None, timeout_ms: float | None = None, spark: SparkSession | None = None):
        self.tools = {t.id: t for t in tools}
        self.guardrails, self.context, self.trace, self.timeout_ms, self.spark = list(guardrails), context or Context(), trace, timeout_ms, spark

    def execute_tool(self, tool_id: str, input: Any = None, run_id: str | None = None, context: Mapping | None = None, cancelled: threading.Event | None = None, timeout_ms: float | None = None):
        run_id = run_id or str(uuid.uuid4())
        data = self.context.merge(**context) if context else self.context

        def tell(kind: str, **more) -> None:
            if self.trace is not None:
                self.trace.emit({"type": kind, "timestamp": int(time.time() * 1000), "runId": run_id, "data": {"toolId": tool_id, **more}})

        def refuse(code: str, message: str, **more):
            tell("runtime:error", code=code, **more)
            raise ToolkitError(code, message)

        tell("runtime:start")
        tool = self.tools.get(tool_id)
        if tool is None:
            refuse("TOOL_NOT_FOUND", f"no such tool: {tool_id}")
        if tool.input is not None and not (found := validate_input(dict(tool.input), input))["valid"]:
            detail = "; ".join(f"{e['path'] or '(root)'}: {e['message']}" for e in found["errors"])
            refuse("TOOL_INPUT_INVALID", f"invalid input for {tool_id}: {detail}", errors=found["errors"])
        for g in self.guardrails:
            verdict = g.check(input, tool_id, data)
            if not verdict.allowed:
                tell("guardrail:blocked", guardrailId=g.id, reason=verdict.reason)
                refuse("GUARDRAIL_BLOCKED", f"blocked by guardrail {g.id}" + (f" ({verdict.reason})" if verdict.reason else ""))
        tell("tool:start")
        try:
            output = self._run(tool, input, data, cancelled, self.timeout_ms if timeout_ms is None else timeout_ms)
        except Exception as cause:
            control = isinstance(cause, ToolkitError) and cause.code in ("TOOL_TIMEOUT", "TOOL_ABORTED")
            code = cause.code if control else "TOOL_EXECUTION_FAILED"
            tell("tool:error", cause=cause)
            tell("runtime:error", code=code)
            if control:
                raise
            raise ToolkitError(code, f"tool failed: {tool_id}", cause) from cause
        tell("tool:end")
        tell("runtime:end")
        return output

    def _run(self, tool: Tool, input, data: Context, cancelled: threading.Event | None, timeout_ms: float | None):
        """The tool in a thread of its own, whose Spark jobs carry a tag by which they are stopped."""
        stop, done, tag = threading.Event(), threading.Event(), f"tool-{uuid.uuid4().hex}"
        result: dict[str, Any] = {}
        if cancelled is not None and cancelled.is_set():
            raise ToolkitError("TOOL_ABORTED", f"aborted: {tool.id}")

        def work():
            try:
                if self.spark is not None:
                    self.spark.sparkContext.addJobTag(tag)
                result["output"] = tool.execute(input, ToolContext(data, stop))
            except BaseException as error:  # handed to the caller's thread
                result["error"] = error
            finally:
                done.set()

        threading.Thread(target=work, daemon=True).start()
        end = None if timeout_ms is None else time.monotonic() + timeout_ms / 1000
        while not done.wait(0.005 if cancelled is not None or end is not None else None):
            code = "TOOL_ABORTED" if cancelled is not None and cancelled.is_set() else "TOOL_TIMEOUT" if end is not None and time.monotonic() >= end else None
            if code:
                stop.set()
                if self.spark is not None:
                    self.spark.sparkContext.cancelJobsWithTag(tag)
                raise ToolkitError(code, f"{'aborted' if code == 'TOOL_ABORTED' else f'timed out after {timeout_ms} ms'}: {tool.id}")
        if "error" in result:
            raise result["error"]
        return result["output"]


@dataclass(frozen=True)
class Step:
    id: str
    run: Callable[[Any, list], Any]


@dataclass(frozen=True)
class Workflow:
    """Steps in order; each gets the result before and all results so far."""

    id: str
    steps: tuple[Step, ...] = ()

    def step(self, id: str, run: Callable[[Any, list], Any]) -> Workflow:
        return Workflow(self.id, (*self.steps, Step(id, run)))

    def run(self) -> list:
        results: list = []
        for s in self.steps:
            try:
                results.append(s.run(results[-1] if results else None, list(results)))
            except Exception as cause:
                raise ToolkitError("WORKFLOW_STEP_FAILED", f"step failed: {self.id} -> {s.id}", cause) from cause
        return results


class MemoryCache:
    """Least recently used entries go first beyond ``max_size``; entries end ``ttl_ms`` after they were set."""

    def __init__(self, max_size: int | None = None, ttl_ms: float | None = None, clock: Callable[[], float] = lambda: time.time() * 1000):
        self.max_size, self.ttl_ms, self.clock = max_size, ttl_ms, clock
        self._entries: OrderedDict[Any, tuple[Any, float]] = OrderedDict()

    def _fresh(self, key) -> bool:
        if key in self._entries and self._entries[key][1] <= self.clock():
            del self._entries[key]
        return key in self._entries

    def get(self, key):
        if not self._fresh(key):
            return None
        self._entries.move_to_end(key)
        return self._entries[key][0]

    def has(self, key) -> bool:
        return self._fresh(key)

    def set(self, key, value) -> None:
        self._entries.pop(key, None)
        self._entries[key] = (value, float("inf") if self.ttl_ms is None else self.clock() + self.ttl_ms)
        if self.max_size is not None and len(self._entries) > self.max_size:
            self._entries.popitem(last=False)

    def delete(self, key) -> None:
        self._entries.pop(key, None)

    def clear(self) -> None:
        self._entries.clear()


def replay_cache(ops: DataFrame, max_size: int | None = None, ttl_ms: float | None = None) -> DataFrame:
    """What each operation of a log ``ops(cache, seq, op, key, value, at_ms)`` finds: rows (cache, seq, op, key, result).

    A cache's log is one sequence, so one task replays it, in order and batch by batch: rows are sorted by Spark, which
    spills, and a task holds one cache's entries, at most ``max_size``, and one batch.
    """
    import pyarrow as pa

    def run(batches):
        now, name, cache = [0.0], None, None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if cache is None or r["cache"] != name:
                    name, cache = r["cache"], MemoryCache(max_size, ttl_ms, lambda: now[0])
                now[0] = r["at_ms"]
                op, key, result = r["op"], r["key"], None
                if op == "get":
                    result = cache.get(key)
                elif op == "has":
                    result = str(cache.has(key)).lower()
                elif op == "set":
                    cache.set(key, r["value"])
                elif op == "delete":
                    cache.delete(key)
                elif op == "clear":
                    cache.clear()
                else:
                    raise ValueError(f"no such operation: {op}")
                found.append(result)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cache", "seq", "op", "key")), pa.array(found, pa.string())], ["cache", "seq", "op", "key", "result"])

    rows = ops.select(*(F.col(c).cast(t).alias(c) for c, t in (("cache", "string"), ("seq", "long"), ("op", "string"), ("key", "string"), ("value", "string"), ("at_ms", "double"))))
    ordered = rows.repartition("cache").sortWithinPartitions("cache", "seq")
    return ordered.mapInArrow(run, "cache string, seq long, op string, key string, result string")
