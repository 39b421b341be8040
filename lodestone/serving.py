"""Tools for remote callers: messages in JSON-RPC, one a line, over any pair of text streams."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import ToolkitError
from lodestone.functions.messages import to_content
from lodestone.runtime import Runtime, Tool

#: Fixed values of the protocol.
PROTOCOL, NO_METHOD, BAD_MESSAGE, BAD_PARAMS = "2024-11-05", -32601, -32700, -32602
#: Rows of a tool's table that an answer carries; the tools have limits of their own.
MOST_ROWS = 1000


def plain(output):
    """A tool's output as JSON values; a table as its rows, of which MOST_ROWS at most are told, and whether there are more."""
    if not isinstance(output, DataFrame):
        return output
    rows = [json.loads(r[0]) for r in output.limit(MOST_ROWS + 1).select(F.to_json(F.struct("*"))).collect()]
    return {"rows": rows[:MOST_ROWS], "more": len(rows) > MOST_ROWS}


class Server:
    """Answers initialize, ping, tools/list and tools/call for the tools of a runtime."""

    def __init__(self, runtime: Runtime, name: str = "lodestone", version: str = "1"):
        self.runtime, self.name, self.version = runtime, name, version

    def handle(self, message: dict) -> dict | None:
        """The answer to a message; None for a notification. A tool's failure is a result marked as an error."""
        if "id" not in message:
            return None
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": self.version}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [t.descriptor() for t in self.runtime.tools.values()]}
        elif method == "tools/call":
            if not isinstance(params.get("name"), str):
                return self._error(message["id"], BAD_PARAMS, "a tool's name is needed")
            result = self._called(params["name"], params.get("arguments"))
        else:
            return self._error(message["id"], NO_METHOD, f"no such method: {method}")
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    def _called(self, tool: str, given) -> dict:
        try:
            return {"content": to_content(plain(self.runtime.execute_tool(tool, {} if given is None else given)))}
        except ToolkitError as error:
            return {"content": to_content(f"{error.code}: {error.message}"), "isError": True}

    @staticmethod
    def _error(key, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        """Answers each line until there are no more."""
        for line in lines:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
                answer = self.handle(message) if isinstance(message, dict) else self._error(None, BAD_MESSAGE, "a message is an object")
            except ValueError:
                answer = self._error(None, BAD_MESSAGE, "not a JSON text")
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                out.flush()


def remote_tools(call, prefix: str = "") -> list[Tool]:
    """The tools that a server tells of, as tools of this side. ``call`` takes a message and gives the answer, by whatever
    way the messages go; results come back as ``from_content`` reads them."""
    from lodestone.functions.messages import from_content

    def ask(method: str, **params):
        answer = call({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
        if "error" in answer:
            raise ToolkitError("MCP_TOOL_ERROR", answer["error"]["message"])
        return answer["result"]

    def tool(told: dict) -> Tool:
        return Tool(f"{prefix}{told['name']}", lambda given, _context: from_content(ask("tools/call", name=told["name"], arguments=given)), told.get("description", ""), told.get("inputSchema"))

    return [tool(t) for t in ask("tools/list")["tools"]]
