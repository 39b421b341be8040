"""Schemas of the property graph and of what it is made from, and the constants of the model."""

from __future__ import annotations

#: Nodes: files (kind ``file``: path, language) and symbols (kind ``symbol``). ``ord`` is the insertion order.
NODES = "id string, kind string, name string, symbol_kind string, path string, language string, start_line int, end_line int, ord long"
#: Edges; everything between ``kind`` and ``ord`` is null but for calls.
EDGES = "src string, dst string, kind string, confidence double, call_kind string, receiver_type string, call_count long, line int, ord long"

SYMBOL_KINDS = ("function", "method", "class", "interface", "type", "enum", "field", "variable")
EDGE_KINDS = ("contains", "imports", "references", "calls")

_DEFINITION = "struct<name:string,kind:string,startLine:int,endLine:int,startIndex:int,endIndex:int>"
_REFERENCE = "struct<name:string,startIndex:int,line:int,receiver:string,isNew:boolean>"
FACTS_TYPE = f"struct<definitions:array<{_DEFINITION}>,references:array<{_REFERENCE}>,imports:array<struct<raw:string>>,typeBindings:array<struct<name:string,type:string>>>"
FILES = f"path string, language string, hash string, mtimeMs double, size long, facts {FACTS_TYPE}"

#: Confidence of a call edge: proved in place, proved across files, only candidate of its name.
EXACT, HIGH, MEDIUM = 1.0, 0.8, 0.5
