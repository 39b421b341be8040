"""Facts of brace languages, from tokens."""

from __future__ import annotations

import re
from functools import cached_property

from lodestone.parsing.facts import Facts
from lodestone.parsing.lexer import Tokens, lex

_SIMPLE = re.compile(r"[A-Za-z_$][\w$]*")

#: Words that a bracket may follow without a call being made.
_SHARED = {"if", "for", "while", "switch", "return", "else", "do", "case", "default", "new", "in", "as", "const"}
#: Words that a bracket and a block follow without a method being meant.
_BLOCKS = {"if", "for", "while", "switch", "catch", "function", "with"}
_SCRIPT_WORDS = _SHARED | {"catch", "typeof", "await", "function", "with", "super", "import", "of", "delete", "void", "throw", "yield", "async", "instanceof", "var", "let", "this"}
_CONTROL = {
    "javascript": _SCRIPT_WORDS,
    "typescript": _SCRIPT_WORDS,
    "tsx": _SCRIPT_WORDS,
    "go": _SHARED | {"func", "go", "defer", "select", "range", "var", "type", "import", "struct", "interface", "map", "chan"},
    "rust": _SHARED | {"match", "loop", "fn", "where", "let", "ref", "mut", "move", "await", "pub"},
    "java": _SHARED | {"catch", "synchronized", "try", "super", "this", "throw", "assert", "instanceof"},
    "csharp": _SHARED | {"catch", "foreach", "lock", "using", "fixed", "nameof", "sizeof", "typeof", "checked", "unchecked", "when", "await", "throw", "is", "and", "or", "not", "var", "base", "this", "stackalloc", "async"},
}
_MODIFIERS = {"public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "virtual", "override", "async", "readonly", "partial", "extern", "unsafe", "new", "native", "synchronized", "default", "strictfp", "transient", "volatile", "declare", "accessor", "get", "set", "required", "file", "ref", "pub", "const"}
#: Type names of TypeScript that are no user's type.
_PLAIN_TYPES = {"any", "boolean", "never", "number", "object", "string", "symbol", "undefined", "unknown", "void", "null", "bigint", "true", "false", "this"}


class _Reader:
    def __init__(self, source: str, language: str, facts: Facts):
        self.t: Tokens = lex(source, language)
        self.source, self.language, self.facts = source, language, facts
        self.control = _CONTROL[language]
        self.declared: set[int] = set()  # tokens that name a declaration: no calls

    def line_at(self, token: int) -> int:
        t = self.t[token]
        return t.line + t.text.count("\n")

    def define(self, rank: int, name: int, kind: str, first: int, last: int) -> None:
        last = min(last, len(self.t) - 1)
        self.declared.add(name)
        self.facts.define(rank, self.t[name].text, kind, self.t[first].start, self.t[last].end, self.t[first].line, self.line_at(last))

    def back_over(self, k: int, words: set[str]) -> int:
        """The first of the words in ``words`` that stand before ``k`` in a row."""
        while self.t.word(k - 1) and self.t.text(k - 1) in words:
            k -= 1
        return k

    def body(self, k: int) -> int:
        """The first ``{`` or ``;`` from ``k`` on, over closed brackets; the last token if there is none."""
        while k < len(self.t):
            mark = self.t.text(k) if self.t[k].kind == "mark" else ""
            if mark in ("{", ";"):
                return k
            if mark in ("(", "["):
                k = self.t.close(k)
            elif mark == "}":
                return k - 1
            k += 1
        return len(self.t) - 1

    def block_end(self, k: int) -> int:
        k = self.body(k)
        return self.t.close(k) if self.t.text(k) == "{" else k

    @cached_property
    def _angles(self) -> dict[int, int]:
        """The end of each ``<`` that encloses type arguments, however many; a mark that can't be inside ends the open ones."""
        ends, opened = {}, []
        for k in range(len(self.t)):
            mark = self.t.text(k)
            if mark == "<":
                opened.append(k)
            elif mark and set(mark) == {">"}:
                for _ in mark[: len(opened)]:
                    ends[opened.pop()] = k
            elif opened and mark in (";", "{", "}", ")", "&&", "||"):
                opened.clear()
        return ends

    def angle_end(self, k: int) -> int:
        """Behind type arguments that begin at ``k``, or ``k`` where there are none."""
        return self._angles[k] + 1 if k in self._angles else k

    def receiver(self, dot: int) -> str | None:
        """The word before the dot, if that is the whole expression there."""
        if self.t.word(dot - 1) and self.t.text(dot - 2) not in (".", "?.", "::", "->") and _SIMPLE.fullmatch(self.t[dot - 1].text):
            return self.t[dot - 1].text
        return None

    def calls(self, dots: tuple[str, ...], bare_dots: tuple[str, ...] = (), skip_macros: bool = False, new: bool = True, type_arguments: bool = True) -> None:
        """All ``name(``: bare, after a dot, or after ``new``."""
        k = 0
        while k < len(self.t):
            if skip_macros and self.t.word(k) and self.t.text(k + 1) == "!" and self.t.text(k + 2) in ("(", "[", "{"):
                k = self.t.close(k + 2)
            elif new and self.t.text(k) == "new" and self.t.word(k + 1) and self.t.text(k - 1) not in (".", "?."):
                self._new(k + 1)
                self.declared.add(k + 1)
                j = k + 1
                while self.t.text(j + 1) in (".", "::") and self.t.word(j + 2):
                    j += 2
                    self.declared.add(j)
            elif self.t.word(k) and k not in self.declared and self._called(k, type_arguments):
                before, t = self.t.text(k - 1), self.t[k]
                if before in dots:
                    self.facts.refer(1, t.text, t.start, t.line, self.receiver(k - 1))
                elif before in bare_dots or t.text not in self.control and before not in ("function", "@", "#"):
                    self.facts.refer(0, t.text, t.start, t.line)
            k += 1

    def _called(self, k: int, type_arguments: bool) -> bool:
        after = self.t.text(k + 1)
        if after == "(":
            return True
        if self.language == "rust" and after == "::" and self.t.text(k + 2) == "<":
            return False  # a generic function: no plain name in call position
        if type_arguments and after == "<" and self.language in ("typescript", "tsx"):
            end = self.angle_end(k + 1)
            return end > k + 1 and self.t.text(end) == "("
        if self.language in ("javascript", "typescript", "tsx") and after == "?." and self.t.text(k + 2) == "(":
            return True
        return False

    def _new(self, k: int) -> None:
        after = self.t.text(k + 1)
        whole = after not in (".", "::") and not (self.language in ("java", "csharp") and (after == "[" or after == "<"))
        if whole and (self.language not in ("java", "csharp") or after in ("(", "{")):
            self.facts.refer(2, self.t[k].text, self.t[k].start, self.t[k].line, None, True)


class _Script(_Reader):
    """JavaScript, TypeScript and TSX."""

    def statement(self, k: int) -> bool:
        """Whether a declaration may begin at ``k``."""
        if k <= 0:
            return True
        before = self.t[k - 1]
        if before.kind == "mark":
            return before.text in (";", "{", "}", ")") or before.line < self.t[k].line and before.text in ("]",)
        return before.text in ("export", "default", "declare", "else") or before.kind != "mark" and before.line < self.t[k].line and before.text not in ("return", "=", "await", "yield")

    def read(self) -> None:
        t = self.t
        self.expression_classes()
        for k in range(len(t)):
            if t[k].kind != "word":
                continue
            word = t[k].text
            if t.text(k - 1) in (".", "?.") or t.text(k + 1) == ":" and word != "default":
                continue
            if word == "function":
                self.function(k)
            elif word == "class" and t.word(k + 1) and t.text(k + 1) not in ("extends", "implements"):
                first = k - 1 if t.text(k - 1) == "abstract" else k
                if self.statement(first):
                    self.define(4 if first < k else 2, k + 1, "class", first, self.block_end(k + 2))
            elif self.language != "javascript" and t.word(k + 1) and self.statement(k if t.text(k - 1) != "const" else k - 1):
                if word == "interface":
                    last = self.block_end(k + 2)
                    self.define(5, k + 1, "interface", k, last)
                    self.declared.update(j for j in range(k + 2, last) if t.word(j) and t.text(j + 1) in ("(", "<"))
                elif word == "enum":
                    self.define(7, k + 1, "enum", k - 1 if t.text(k - 1) == "const" else k, self.block_end(k + 2))
                elif word == "type" and (t.text(k + 2) in ("=", "<")):
                    self.define(6, k + 1, "type", k, self.value_end(k + 2))
            if word in ("const", "let", "var") and word == t.text(k):
                self.declarators(k + 1)
            elif word in ("import", "export") and self.statement(k):
                self.module(k, word)
        self.members()
        self.parameters()
        self.calls((".", "?."))

    def expression_classes(self) -> None:
        self.class_bodies = {}
        for k in range(len(self.t)):
            if self.t.text(k) == "class" and self.t[k].kind == "word" and self.t.text(k - 1) not in (".", "?.") and self.t.text(k + 1) not in (":", "=", ",", ")"):
                open_at = self.body(k + 1)
                if self.t.text(open_at) == "{":
                    self.class_bodies[open_at] = self.t.close(open_at)

    def function(self, k: int) -> None:
        name = k + 2 if self.t.text(k + 1) == "*" else k + 1
        first = k - 1 if self.t.text(k - 1) == "async" else k
        if self.t.word(name) and self.t.text(name + 1) in ("(", "<"):
            if self.statement(first):
                at = self.body(name + 1)
                if self.t.text(at) == "{":
                    self.define(1 if name == k + 2 else 0, name, "function", first, self.t.close(at))
            self.declared.add(name)

    def value_end(self, k: int) -> int:
        """The last token of the expression or type that goes on from ``k``."""
        start = k
        while k < len(self.t):
            mark = self.t.text(k) if self.t[k].kind == "mark" else ""
            if mark in ("(", "[", "{"):
                k = self.t.close(k)
            elif mark == "<" and self.language != "javascript" and (end := self.angle_end(k)) > k and self.t.text(end) in ("(", ";", ")", ",", "=", "{", "["):
                k = end - 1
            elif mark in (";", ",", ")", "]", "}"):
                return k - 1
            elif k > start and self.t[k].line > self.line_at(k - 1) and self.t[k].kind != "mark" and self.t.text(k - 1) not in ("=", "=>", "|", "&", "+", "-", "*", "/", "?", ":", "&&", "||", "??", "(", "<", ".", "?."):
                return k - 1
            k += 1
        return len(self.t) - 1

    def declarators(self, k: int) -> None:
        """``name [: type] = value`` in a row."""
        t = self.t
        while t.word(k):
            at = k + 1
            if t.text(at) == ":":
                if t.word(at + 1) and t.text(at + 2) in ("=", ";", ",", "") and t.text(at + 1) not in _PLAIN_TYPES:
                    self.facts.bind(3, t[k].text, t[at + 1].text, t[k].start)
                while at < len(t) and t.text(at) not in ("=", ";", ",", ")") and not (t.word(at) and t.text(at) in ("of", "in")):
                    at = t.close(at) + 1 if t.text(at) in ("(", "[", "{") else at + 1
            if t.text(at) != "=":
                return
            value = at + 1
            if t.text(value) == "new" and t.word(value + 1) and t.text(value + 2) not in (".", "["):
                self.facts.bind(0, t[k].text, t[value + 1].text, t[k].start)
            end = self.function_value(value)
            if end is not None:
                self.define(12 if t.text(value + (t.text(value) == "async")) == "function" else 11, k, "function", k, end)
                at = end + 1
            else:
                at = self.value_end(value) + 1
            if t.text(at) != ",":
                return
            k = at + 1

    def function_value(self, k: int) -> int | None:
        """The last token of an arrow function or function expression at ``k``."""
        t = self.t
        k += t.text(k) == "async" and t.text(k + 1) != "=>"
        if t.text(k) == "function":
            at = self.body(k + 1)
            return t.close(at) if t.text(at) == "{" and t.text(k + 1) != "*" else None
        head = self.angle_end(k)
        if t.text(head) == "(":
            head = t.close(head) + 1
            if t.text(head) == ":":
                while head < len(t) and t.text(head) not in ("=>", ";", ","):
                    head = t.close(head) + 1 if t.text(head) in ("(", "[", "{") else head + 1
        elif t.word(head):
            head += 1
        if t.text(head) != "=>":
            return None
        return t.close(head + 1) if t.text(head + 1) == "{" else self.value_end(head + 1)

    def module(self, k: int, word: str) -> None:
        t = self.t
        if word == "import" and t.text(k + 1) in ("(", "."):
            return
        j = k + 1
        while j < len(t):
            if t.text(j) == "{" and t[j].kind == "mark":  # a list of names, however long
                j = t.close(j) + 1
                if t.text(j) != "from":
                    return
            if t[j].kind == "string":
                if t.text(j - 1) == "from" or word == "import" and j == k + 1:
                    self.facts.take(0 if word == "import" else 1, t[j].text, t[j].start)
                return
            if t.text(j) in (";", "=", "(") or word == "export" and t.word(j) and t.text(j) in ("const", "let", "var", "function", "class", "interface", "type", "enum", "default", "abstract", "async", "declare") and t.text(j + 1) not in ("{", "*") and j == k + 1:
                return
            j += 1

    def members(self) -> None:
        """Methods of classes and object literals, fields of classes."""
        t = self.t
        for k in range(len(t)):
            if t.word(k) and k not in self.declared and t.text(k - 1) not in (".", "?.", "function", "new", "=>"):
                after = self.angle_end(k + 1) if self.language != "javascript" else k + 1
                if t.text(after) == "(" and t[k].text not in _BLOCKS:
                    self.method(k, after)
        for open_at, close_at in self.class_bodies.items():
            k = open_at + 1
            while k < close_at:
                k = self.member(k, close_at)

    def method(self, k: int, open_at: int) -> None:
        t, close = self.t, self.t.close(open_at)
        at = close + 1
        if t.text(at) == ":" and self.language != "javascript" and self.enclosing_class(k):
            depth_end = at + 1
            while depth_end < len(t) and t.text(depth_end) not in (";", "}", ","):
                if t.text(depth_end) == "{" and t.text(depth_end - 1) not in (":", "|", "&", "<", ",", "=>", "("):
                    break
                if t[depth_end].kind == "word" and t[depth_end].line > self.line_at(depth_end - 1) and t.text(depth_end - 1) not in (":", "|", "&", "<", ",", "=>"):
                    break
                depth_end = t.close(depth_end) + 1 if t.text(depth_end) in ("(", "[", "{") else depth_end + 1
            at = depth_end
        if t.text(at) != "{":
            return
        first = self.back_over(k - (t.text(k - 1) in ("*",)), _MODIFIERS)
        before = t[first - 1] if first else None
        if before is None or before.kind == "mark" and before.text in ("{", "}", ",", ";", ")") or before.kind != "mark" and before.line < t[first].line:
            self.define(8, k, "method", first, t.close(at))

    def enclosing_class(self, k: int) -> bool:
        return any(a < k < b for a, b in self.class_bodies.items())

    def member(self, k: int, close_at: int) -> int:
        """Over one member of a class body; a field is a definition."""
        t = self.t
        while k < close_at and t.text(k) == "@":  # a decorator
            k += 2
            while t.text(k) == ".":
                k += 2
            if t.text(k) == "(":
                k = t.close(k) + 1
        first = k
        while k < close_at and t.word(k) and t[k].text in _MODIFIERS and t.text(k + 1) not in ("=", ";", "(", ":", "?", "!", "}") and t.text(k + 1) != "":
            k += 1
        name, k = k, k + 1
        if t.text(name) in (";", ","):
            return name + 1
        if t.text(name) in ("#", "*", "["):
            k = t.close(name) + 1 if t.text(name) == "[" else name + 2
        at = self.angle_end(k) if self.language != "javascript" else k
        if t.text(at) == "(":
            if t[name].kind == "word":
                self.declared.add(name)
            end = t.close(at)
            body = end + 1
            while body < close_at and t.text(body) not in ("{", ";") and not (t[body].line > t[body - 1].line and t.text(body) not in (":", "|", "&")):
                body = t.close(body) + 1 if t.text(body) in ("(", "[") or t.text(body) == "{" and t.text(body - 1) in (":", "|", "&", "<") else body + 1
            return t.close(body) + 1 if t.text(body) == "{" else body + (t.text(body) == ";")
        if t.text(name) == "static" and t.text(k) == "{":
            return t.close(k) + 1
        if t.text(k) in ("?", "!"):
            k += 1
        end = k - 1
        if t.text(k) == ":":
            k += 1
            while k < close_at and t.text(k) not in ("=", ";") and not (t[k].line > t[k - 1].line and t[k].kind == "word"):
                k = t.close(k) + 1 if t.text(k) in ("(", "[", "{") else k + 1
            end = k - 1
        if t.text(k) == "=":
            value = self.function_value(k + 1)
            end = value if value is not None else self.value_end(k + 1)
        if t[name].kind == "word" and t.text(name - 1) != "#":
            self.define(9, name, "field", first, end)
        return max(end + 1, name + 1) + (t.text(end + 1) == ";")

    def parameters(self) -> None:
        """``name: Type`` in parameter lists."""
        t = self.t
        if self.language == "javascript":
            return
        for open_at, close_at in t.pair.items():
            if t.text(open_at) != "(" or not self.is_list(open_at, close_at):
                continue
            k = open_at + 1
            while k < close_at:
                k = self.back_free(k)
                if t.word(k) and t.text(k + 1) == ":" and t.word(k + 2) and t.text(k + 3) in (",", ")", "=") and t.text(k + 2) not in _PLAIN_TYPES:
                    self.facts.bind(2, t[k].text, t[k + 2].text, t[k].start)
                while k < close_at and t.text(k) != ",":
                    k = t.close(k) + 1 if t.text(k) in ("(", "[", "{") else k + 1
                k += 1

    def back_free(self, k: int) -> int:
        while self.t.word(k) and self.t[k].text in _MODIFIERS and self.t.word(k + 1):
            k += 1
        return k

    def is_list(self, open_at: int, close_at: int) -> bool:
        return self.t.text(close_at + 1) in ("{", "=>", ":") and self.t.text(open_at - 1) not in ("if", "for", "while", "switch", "catch")


class _Go(_Reader):
    def read(self) -> None:
        t = self.t
        for k in range(len(t)):
            word = t.text(k) if t.word(k) else ""
            if word == "interface" and t.text(k + 1) == "{":
                self.declared.update(j for j in range(k + 2, t.close(k + 1)) if t.word(j) and t.text(j + 1) == "(")
            if word == "func":
                method = t.text(k + 1) == "("
                name = t.close(k + 1) + 1 if method else k + 1
                if t.word(name) and t.text(name + 1) in ("(", "["):
                    self.define(1 if method else 0, name, "method" if method else "function", k, self.signature_end(name))
            elif word == "type" and t.text(k - 1) != ".":
                if t.text(k + 1) == "(":
                    self.group(k)
                elif t.word(k + 1):
                    self.define(2, k + 1, "type", k, self.line_end(k + 2))
            elif word == "import":
                last = t.close(k + 1) if t.text(k + 1) == "(" else k + 2
                for j in range(k + 1, min(last + 1, len(t))):
                    if t[j].kind == "string" and t[j].text[:1] == '"':
                        self.facts.take(0, t[j].text, t[j].start)
        self.calls((".",), new=False)

    def line_end(self, k: int) -> int:
        while k < len(self.t):
            if self.t.text(k) in ("(", "[", "{"):
                k = self.t.close(k)
            if k + 1 >= len(self.t) or self.t[k + 1].line > self.line_at(k) or self.t.text(k + 1) in (";", ")"):
                return k
            k += 1
        return len(self.t) - 1

    def signature_end(self, name: int) -> int:
        """The end of a function: its body is the brace that ends its line of results."""
        k = name + 1
        while k < len(self.t):
            if self.t.text(k) == "{" and self.t.text(k - 1) not in ("interface", "struct"):
                return self.t.close(k)
            if self.t.text(k) in ("(", "[", "{"):
                k = self.t.close(k)
            if k + 1 < len(self.t) and self.t[k + 1].line > self.line_at(k) and self.t.text(k + 1) != "{":
                return k
            k += 1
        return len(self.t) - 1

    def group(self, k: int) -> None:
        close, j = self.t.close(k + 1), k + 2
        while j < close:
            if self.t.word(j):
                self.define(2, j, "type", k, close)
            j = self.line_end(j + 1) + 1 if j + 1 < close else close


class _Rust(_Reader):
    _KINDS = {"struct": (1, "class"), "enum": (2, "enum"), "union": (3, "class"), "trait": (4, "interface"), "type": (5, "type")}

    def read(self) -> None:
        t = self.t
        for k in range(len(t)):
            if not t.word(k) or not t.word(k + 1) or t.text(k - 1) in (".", "::"):
                continue
            word = t[k].text
            if word == "fn":
                at = self.body(k + 2)
                self.declared.add(k + 1)
                if t.text(at) == "{":
                    self.define(0, k + 1, "function", self.visible(self.back_over(k, {"async", "unsafe", "const", "extern", "default"})), t.close(at))
            elif word in self._KINDS and (word != "union" or t.text(k + 2) in ("{", "<")):
                rank, kind = self._KINDS[word]
                at = self.body(k + 2)
                if word == "type" and "=" not in [t.text(j) for j in range(k + 2, at + 1)]:
                    continue
                end = t.close(at) if t.text(at) == "{" else at
                if word == "struct" and t.text(at) != "{" and t.text(at) != ";":
                    continue
                self.define(rank, k + 1, kind, self.visible(self.back_over(k, {"unsafe"})), end)
        self.calls((".",), ("::",), skip_macros=True, new=False)

    def visible(self, k: int) -> int:
        if self.t.text(k - 1) == "pub":
            return k - 1
        if self.t.text(k - 1) == ")" and self.t.text(self.t.close(k - 1) - 1) == "pub":
            return self.t.close(k - 1) - 1
        return k


class _Classed(_Reader):
    """Java and C#: declarations are found by walking type bodies."""

    def read(self) -> None:
        self.types()
        self.uses()
        self.calls((".",) if self.language == "java" else (".", "?.", "->"))

    def types(self) -> None:
        t, cs = self.t, self.language == "csharp"
        ranks = {"class": (0, "class"), "record": (1, "class"), "struct": (2, "class"), "interface": (3, "interface"), "enum": (4, "enum")} if cs else {"class": (0, "class"), "interface": (1, "interface"), "enum": (2, "enum"), "record": (3, "class")}
        for k in range(len(t)):
            if not t.word(k) or t.text(k - 1) in (".", "::", "(", ",", "<") and t[k - 1].kind == "mark":
                continue
            word = t[k].text
            if word in ranks and t.word(k + 1) and t.text(k + 2) in ("{", ":", "<", "(", "extends", "implements", "permits", "where", ";"):
                name = k + 2 if cs and word == "record" and t.text(k + 1) in ("class", "struct") and t.word(k + 2) else k + 1
                if word == "record" and t.text(name + 1) not in ("(", "<", "{", ":", ";"):
                    continue
                first, at = self.first_of(k), self.body(name + 1)
                rank, kind = ranks[word]
                self.define(rank, name, kind, first, t.close(at) if t.text(at) == "{" else at)
                if t.text(at) == "{":
                    self.body_members(at, t[name].text, word == "enum")
            elif cs and word == "delegate" and t.word(k + 1):
                at = next((j for j in range(k, len(t)) if t.text(j) == "("), len(t) - 1)
                name = at - 1
                if t.word(name) and name > k + 1:
                    self.define(5, name, "type", self.first_of(k), self.body(at))

    def first_of(self, k: int) -> int:
        """Over modifiers, annotations and attributes before ``k``."""
        while True:
            k = self.back_over(k, _MODIFIERS)
            if self.t.text(k - 1) == "]" and self.language == "csharp":
                k = self.t.close(k - 1)
            elif self.t.text(k - 1) == ")" and self.language == "java" and self.t.text(self.t.close(k - 1) - 2) == "@":
                k = self.t.close(k - 1) - 2
            elif self.language == "java" and self.t.word(k - 1) and self.t.text(k - 2) == "@":
                k -= 2
            else:
                return k

    def body_members(self, open_at: int, owner: str, is_enum: bool) -> None:
        t, close_at = self.t, self.t.close(open_at)
        k = first = open_at + 1
        if is_enum:  # constants with arguments
            while k < close_at and t.text(k) != ";":
                if t.word(k) and t.text(k + 1) == "(":
                    self.declared.add(k)
                k = t.close(k) + 1 if t.text(k) in ("(", "{", "[") else k + 1
            k = first = min(k, close_at)
        while k < close_at:
            mark = t.text(k) if t[k].kind == "mark" else ""
            if mark == "(" and t.word(k - 1) and not (t.text(k - 2) == "@" or t.text(first) == "@" and k - 1 == first + 1):
                k = first = self.member(first, k - 1, k, close_at, owner)
            elif mark == "(":
                k = t.close(k) + 1
                first = k if t.text(first) == "@" else first
            elif mark == "[" and k == first and self.language == "csharp":
                k = t.close(k) + 1
            elif mark == "{":
                if self.language == "csharp" and t.word(k - 1) and k - 1 > first and not self.is_type(first, k):
                    end = t.close(k)
                    if t.text(end + 1) == "=":
                        end = self.semicolon(end, close_at)
                    self.define(8, k - 1, "field", first, end)
                    k = first = end + 1
                else:
                    k = first = t.close(k) + 1
            elif mark == "=>" and self.language == "csharp" and t.word(k - 1):
                end = self.semicolon(k, close_at)
                self.define(8, k - 1, "field", first, end)
                k = first = end + 1
            elif mark == "=":
                k = first = self.semicolon(k, close_at) + 1
            elif mark == ";":
                k = first = k + 1
            elif mark == "<":
                end = max(self.angle_end(k), k + 1)
                if t.text(end) == "(" and t.word(k - 1) and k - 1 > first:
                    k = first = self.member(first, k - 1, end, close_at, owner)
                else:
                    k = end
            else:
                k += 1

    def is_type(self, first: int, k: int) -> bool:
        return any(self.t.text(j) in ("class", "interface", "enum", "record", "struct", "namespace") for j in range(first, k))

    def semicolon(self, k: int, close_at: int) -> int:
        while k < close_at and self.t.text(k) != ";":
            k = self.t.close(k) + 1 if self.t.text(k) in ("(", "[", "{") else k + 1
        return min(k, close_at - 1)

    def member(self, first: int, name: int, open_at: int, close_at: int, owner: str) -> int:
        """A method or constructor whose parameters begin at ``open_at``; the place behind it."""
        t, at = self.t, self.t.close(open_at) + 1
        if self.is_type(first, name):
            at = self.body(at)
            return (t.close(at) if t.text(at) == "{" else at) + 1
        while at < close_at and t.text(at) not in ("{", ";", "=>", ",", "="):
            at = t.close(at) + 1 if t.text(at) in ("(", "[") else at + 1
        end = t.close(at) if t.text(at) == "{" else self.semicolon(at, close_at) if t.text(at) == "=>" else at
        typed = name > self.back_free(first)
        constructor = not typed and t[name].text == owner
        if (typed or constructor) and t.text(at) in ("{", ";", "=>") and t[name].text not in self.control:
            self.define(7 if constructor else 6, name, "method", first, end)
        return end + 1

    def back_free(self, k: int) -> int:
        while self.t.word(k) and self.t[k].text in _MODIFIERS or self.t.text(k) == "@" or self.t.text(k - 1) == "@":
            k += 1
        return k

    def uses(self) -> None:
        t = self.t
        for k in range(len(t)):
            if t.text(k) == ("using" if self.language == "csharp" else "import") and t.word(k) and t.text(k + 1) != "(" and (k == 0 or t.text(k - 1) in (";", "}", "{", "]") or t.text(k - 1) == "global"):
                j = k + 1 + (t.text(k + 1) == "static")
                end = j
                while t.text(end + 1) == "." and t.word(end + 2):
                    end += 2
                if t.word(j) and t.text(end + 1) in (";", ".") and (self.language == "csharp" or end > j):
                    self.facts.take(0, self.source[t[j].start : t[end].end], t[j].start)


_READERS = {"javascript": _Script, "typescript": _Script, "tsx": _Script, "go": _Go, "rust": _Rust, "java": _Classed, "csharp": _Classed}


def read(source: str, language: str, facts: Facts) -> None:
    _READERS[language](source, language, facts).read()
