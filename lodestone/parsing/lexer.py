"""Tokens of brace languages."""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_MARKS = re.compile(r"\?\.|=>|::|->|\.\.\.|&&|\|\||\?\?|[=!<>]=+|[-+*/%&|^]=|\+\+|--|.", re.DOTALL)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: After one of these words a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


@dataclass(frozen=True)
class Token:
    kind: str  # word, number, string, mark
    text: str
    start: int
    end: int
    line: int


class Tokens(list):
    """Tokens with ``pair``: the index of the bracket that closes (or opens) each bracket."""

    def __init__(self, found: list[Token]):
        super().__init__(found)
        self.pair, stack = {}, []
        for k, t in enumerate(found):
            if t.kind != "mark":
                continue
            if t.text in _OPEN:
                stack.append(k)
            elif t.text in _CLOSE:
                while stack and _OPEN[found[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    self.pair[k] = stack[-1]
                    self.pair[stack.pop()] = k

    def text(self, k: int) -> str:
        """The text of token ``k`` unless it is a string; empty outside."""
        return self[k].text if 0 <= k < len(self) and self[k].kind != "string" else ""

    def word(self, k: int) -> bool:
        return 0 <= k < len(self) and self[k].kind == "word"

    def close(self, k: int) -> int:
        return self.pair.get(k, len(self) - 1)


def _string_end(source: str, start: int, quote: str, lines: bool) -> int:
    k = start
    while k < len(source):
        if source[k] == "\\":
            k += 2
        elif source[k] == quote:
            return k + 1
        elif source[k] == "\n" and not lines:
            return k
        else:
            k += 1
    return len(source)


def _regex_end(source: str, start: int) -> int | None:
    k, inside = start + 1, False
    while k < len(source) and source[k] != "\n":
        if source[k] == "\\":
            k += 1
        elif source[k] == "[":
            inside = True
        elif source[k] == "]":
            inside = False
        elif source[k] == "/" and not inside:
            return _WORD.match(source, k + 1).end() if _WORD.match(source, k + 1) else k + 1
        k += 1
    return None


def lex(source: str, language: str) -> Tokens:
    js, rust, go, cs, java = language in ("javascript", "typescript", "tsx"), language == "rust", language == "go", language == "csharp", language == "java"
    out: list[Token] = []
    k, line, n, templates = 0, 1, len(source), []

    def add(kind: str, end: int) -> None:
        nonlocal k, line
        out.append(Token(kind, source[k:end], k, end, line))
        line += source.count("\n", k, end)
        k = end

    while k < n:
        c = source[k]
        if c in " \t\r\f\v\n﻿":
            line += c == "\n"
            k += 1
        elif source.startswith("//", k):
            k = end if (end := source.find("\n", k)) >= 0 else n
        elif source.startswith("/*", k):
            depth, end = 1, k + 2
            while depth and end < n:
                if source.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                elif rust and source.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                else:
                    end += 1
            line += source.count("\n", k, end)
            k = end
        elif rust and (m := re.compile(r'b?r(#*)"').match(source, k)):
            end = source.find('"' + m[1], m.end())
            add("string", end + 1 + len(m[1]) if end >= 0 else n)
        elif java and source.startswith('"""', k) or cs and source.startswith('"""', k):
            end = source.find('"""', k + 3)
            add("string", end + 3 if end >= 0 else n)
        elif cs and (m := re.compile(r'\$?@\$?"').match(source, k)):
            end = m.end()
            while (end := source.find('"', end)) >= 0 and source.startswith('""', end):
                end += 2
            add("string", end + 1 if end >= 0 else n)
        elif rust and c == "'" and not re.compile(r"'(\\.[^']*|[^'\\])'", re.DOTALL).match(source, k):
            k += 1  # a lifetime
        elif c in "\"'":
            add("string", _string_end(source, k + 1, c, False))
        elif c == "`" and (js or go):
            if go:
                end = source.find("`", k + 1)
                add("string", end + 1 if end >= 0 else n)
            else:
                add("string", _template_part(source, k + 1))
                if source[k - 2 : k] == "${":
                    templates.append(0)
        elif js and templates and c in "{}":
            if c == "}" and templates[-1] == 0:
                templates.pop()
                add("string", _template_part(source, k + 1))
                if source[k - 2 : k] == "${":
                    templates.append(0)
            else:
                templates[-1] += 1 if c == "{" else -1
                add("mark", k + 1)
        elif js and c == "/" and _regex_may_begin(out) and (end := _regex_end(source, k)):
            add("string", end)
        elif m := _WORD.match(source, k):
            add("word", m.end())
        elif m := _NUMBER.match(source, k):
            add("number", m.end())
        else:
            add("mark", _MARKS.match(source, k).end())
    return Tokens(out)


def _template_part(source: str, k: int) -> int:
    """Behind the text of a template up to its end or the next ``${``."""
    while k < len(source):
        if source[k] == "\\":
            k += 2
        elif source[k] == "`":
            return k + 1
        elif source.startswith("${", k):
            return k + 2
        else:
            k += 1
    return len(source)


def _regex_may_begin(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    return last.kind == "mark" and last.text not in (")", "]", "}", "++", "--") or last.kind == "word" and last.text in _BEFORE_REGEX
