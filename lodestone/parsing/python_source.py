"""Facts of Python sources through ``ast``; of sources that it refuses, through lines and indentation."""

from __future__ import annotations

import ast
import re
import warnings
from itertools import accumulate

from lodestone.parsing.facts import Facts


def read(source: str, facts: Facts) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        _lines(source, facts)
        return
    rows = source.splitlines(keepends=True) if "\f" not in source and "\x1c" not in source else re.split(r"(?<=\n)", source)
    begins = [0, *accumulate(map(len, rows))]

    def at(line: int, column: int) -> int:
        """Character offset of a line and its column in UTF-8 bytes."""
        row = rows[line - 1] if line <= len(rows) else ""
        return begins[line - 1] + (column if row.isascii() else len(row.encode()[:column].decode("utf-8", "ignore")))

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            facts.define(int(is_class), node.name, "class" if is_class else "function", at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), node.lineno, node.end_lineno)
            if not is_class:
                _parameters(node.args, facts, at)
        elif isinstance(node, ast.Lambda):
            _parameters(node.args, facts, at)
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                facts.refer(0, node.func.id, at(node.func.lineno, node.func.col_offset), node.func.lineno)
            elif isinstance(node.func, ast.Attribute):
                end = at(node.func.end_lineno, node.func.end_col_offset) - len(node.func.attr)
                owner = node.func.value.id if isinstance(node.func.value, ast.Name) else None
                facts.refer(1, node.func.attr, end, node.func.end_lineno, owner if owner and re.fullmatch(r"[A-Za-z_$][\w$]*", owner) else None)
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            if isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
                facts.bind(0, node.targets[0].id, node.value.func.id, at(node.lineno, node.col_offset))
        elif isinstance(node, ast.ImportFrom):
            facts.take(1 if node.level else 0, "." * node.level + (node.module or ""), at(node.lineno, node.col_offset))
        elif isinstance(node, ast.Import):
            for name in node.names:
                facts.take(3 if name.asname else 2, name.name, at(node.lineno, node.col_offset))


def _parameters(args: ast.arguments, facts: Facts, at) -> None:
    plain = [*args.posonlyargs, *args.args]
    typed = plain[: len(plain) - len(args.defaults)] + [a for a, d in zip(args.kwonlyargs, args.kw_defaults) if d is None]
    for a in typed:
        if isinstance(a.annotation, ast.Name):
            facts.bind(1, a.arg, a.annotation.id, at(a.lineno, a.col_offset))


_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.MULTILINE)
_CALL = re.compile(r"(?:(\w+|[)\]])\.)?\b([A-Za-z_]\w*)\s*\(")
_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import|import[ \t]+([\w.]+))", re.MULTILINE)
_HIDDEN = re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.DOTALL)
_NO_CALL = {"if", "elif", "while", "for", "return", "and", "or", "not", "in", "is", "with", "assert", "lambda", "yield", "del", "print", "except", "raise", "def", "class", "await", "else", "import", "from"} - {"print"}


def _lines(source: str, facts: Facts) -> None:
    bare = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    line_of = lambda k: bare.count("\n", 0, k) + 1
    heads = set()
    for m in _HEAD.finditer(bare):
        depth, start = len(m[1].expandtabs()), m.end(1)
        heads.add(m.start(3))
        end = k = m.end()
        while (k := bare.find("\n", k)) >= 0:
            row = bare[k + 1 : e if (e := bare.find("\n", k + 1)) >= 0 else len(bare)]
            if row.strip():
                if len(row) - len(row.lstrip()) <= depth:
                    break
                end = k + 1 + len(row.rstrip())
            k += 1
        facts.define(int(m[2] == "class"), m[3], "class" if m[2] == "class" else "function", start, end, line_of(start), line_of(end))
    for m in _CALL.finditer(bare):
        if m[2] not in _NO_CALL and m.start(2) not in heads:
            owner = m[1] if m[1] and re.fullmatch(r"[A-Za-z_]\w*", m[1]) and bare[max(0, m.start(1) - 1) : m.start(1)] != "." else None
            facts.refer(int(bool(m[1])), m[2], m.start(2), line_of(m.start(2)), owner)
    for m in _IMPORT.finditer(bare):
        facts.take(0, m[1] or m[2], m.start())
