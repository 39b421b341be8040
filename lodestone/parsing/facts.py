"""From source text to facts, one file at a time, and the operator that does it for a table of files."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.languages import Language, language_of

_FACTS = pa.struct(
    [
        ("definitions", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), *((n, pa.int32()) for n in ("startLine", "endLine", "startIndex", "endIndex"))]))),
        ("references", pa.list_(pa.struct([("name", pa.string()), ("startIndex", pa.int32()), ("line", pa.int32()), ("receiver", pa.string()), ("isNew", pa.bool_())]))),
        ("imports", pa.list_(pa.struct([("raw", pa.string())]))),
        ("typeBindings", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
    ]
)


@dataclass
class Facts:
    """Facts with the rank of the pattern that found them; ``table`` gives them by rank, then position."""

    definitions: list = field(default_factory=list)
    references: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    bindings: list = field(default_factory=list)

    def define(self, rank: int, name: str, kind: str, start: int, end: int, first_line: int, last_line: int) -> None:
        self.definitions.append((rank, start, {"name": name, "kind": kind, "startLine": first_line, "endLine": last_line, "startIndex": start, "endIndex": end}))

    def refer(self, rank: int, name: str, start: int, line: int, receiver: str | None = None, is_new: bool = False) -> None:
        self.references.append((rank, start, {"name": name, "startIndex": start, "line": line, "receiver": receiver, "isNew": is_new or None}))

    def take(self, rank: int, raw: str, start: int) -> None:
        raw = unquoted(raw)
        if raw:
            self.imports.append((rank, start, {"raw": raw}))

    def bind(self, rank: int, name: str, kind: str, start: int) -> None:
        self.bindings.append((rank, start, {"name": name, "type": kind}))

    def table(self) -> dict[str, list[dict]]:
        by_place = lambda rows: [r for *_, r in sorted(rows, key=lambda x: x[:2])]
        return {"definitions": by_place(self.definitions), "references": by_place(self.references), "imports": by_place(self.imports), "typeBindings": by_place(self.bindings)}


def unquoted(raw: str) -> str:
    """Without one quote at either end, and without blanks round what is left."""
    quotes = "\"'`"
    raw = raw[1:] if raw[:1] in quotes and raw else raw
    raw = raw[:-1] if raw[-1:] in quotes and raw else raw
    return raw.strip()


def parse_file(language: Language | str, source: str) -> dict[str, list[dict]]:
    from lodestone.parsing import braces, python_source

    name = language if isinstance(language, str) else language.id
    facts = Facts()
    if name == "python":
        python_source.read(source, facts)
    else:
        braces.read(source, name, facts)
    return facts.table()


def parse_files(files: DataFrame) -> DataFrame:
    """``files(path, ..., content)`` with facts in place of content; content is binary UTF-8, broken bytes replaced.

    Files of other languages have null facts. One pass in Arrow batches, no shuffle.
    """
    from lodestone.schema import FACTS_TYPE

    names = [c for c in files.columns if c != "content"]
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}

    def run(batches):
        for batch in batches:
            facts = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                language = language_of(path)
                facts.append(None if language is None else parse_file(language, (content or b"").decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(facts, _FACTS)], [*names, "facts"])

    return files.select(*names, "content").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"facts {FACTS_TYPE}"]))
