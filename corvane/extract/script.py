"""TypeScript, TSX and JavaScript sources by a tolerant tokenizer with matched brackets; no grammar is needed.

A scope is what stands between a declaration's braces. Declarations are recognised by the tokens before them, so
broken code still gives what stands before and after the break.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from corvane.extract.rows import Extraction

_TOKEN = re.compile(
    r"(?:(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`)"
    r"|(?P<name>[A-Za-z_$#@][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|\.\.\.|[{}()\[\]<>;,.:=?!&|+\-*/%^~])|(?P<other>.))\s*",
    re.DOTALL,
)
_BLANKS = re.compile(r"\s*")
_NOT_CALLS = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "constructor", "import", "with", "void", "delete", "in", "of", "instanceof", "yield", "throw", "else", "do", "case"))
_BEFORE_REGEX = frozenset("(,=:[!&|?{};+-*%^~<>")


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def tokenize(source: str) -> tuple[list[Token], list[Token]]:
    """Tokens that are code, and comments."""
    code: list[Token] = []
    comments: list[Token] = []
    at = _BLANKS.match(source).end()
    while at < len(source):
        if source[at] == "/" and source[at + 1 : at + 2] not in ("/", "*") and (not code or code[-1].text in _BEFORE_REGEX or code[-1].text in ("return", "typeof", "case")):
            m = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(source, at)
            if m:
                code.append(Token("string", m[0], at, m.end()))
                at = _BLANKS.match(source, m.end()).end()
                continue
        m = _TOKEN.match(source, at)
        kind = m.lastgroup
        (comments if kind == "comment" else code).append(Token(kind, m[kind], at, m.end(kind)))
        at = m.end()
    return code, comments


def _pairs(code: list[Token]) -> tuple[dict[int, int], bool]:
    """Index of each opening bracket's partner, and whether all match."""
    out, stack, whole = {}, [], True
    close = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(code):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in close:
            while stack and code[stack[-1]].text != close[t.text]:
                out[stack.pop()] = i
                whole = False
            if stack:
                out[stack.pop()] = i
            else:
                whole = False
    for i in stack:
        out[i] = len(code)
        whole = False
    return out, whole


class _Reader:
    def __init__(self, path: str, language: str, source: str) -> None:
        self.out = Extraction(path, language, source)
        self.source, self.jsx = source, language == "tsx" or path.endswith(".jsx")
        self.code, self.comments = tokenize(source)
        self.partner, whole = _pairs(self.code)
        self.out.partial = not whole

    def text(self, i: int) -> str:
        return self.code[i].text if 0 <= i < len(self.code) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.code) and self.code[i].kind == "name"

    def skip(self, i: int) -> int:
        """The place after token i, or after the bracket it opens."""
        return self.partner.get(i, i) + 1

    def end_of(self, i: int) -> int:
        return self.code[min(i, len(self.code) - 1)].end if self.code else 0

    def documentation(self, start: int) -> str | None:
        """The comment that ends at most two line breaks before `start`."""
        for c in reversed(self.comments):
            if c.end <= start:
                between = self.source[c.end : start]
                if between.strip() or between.count("\n") > 2:
                    return None
                lines = [re.sub(r"^\s*(?:/\*\*?|\*/|\*|//+)\s?|\s*\*/\s*$", "", x).strip() for x in c.text.split("\n")]
                return "\n".join(x for x in lines if x) or None
        return None

    def head(self, a: int, b: int) -> str:
        """The source from token a up to token b, white space joined."""
        return " ".join(self.source[self.code[a].start : self.code[b].start if b < len(self.code) else len(self.source)].split())

    def body_of(self, i: int) -> int | None:
        """From a parameter list's opening bracket: the opening brace of the body, past a return type."""
        at = self.skip(i)
        if self.text(at) == ":":
            at += 1
            while at < len(self.code) and self.text(at) not in ("{", ";", "=>", ",", ")", "}"):
                at = self.skip(at) if self.text(at) in ("(", "[", "<") and at in self.partner else at + 1
            if self.text(at) == "{" and self.text(at - 1) in (":", "|", "&"):  # a type in braces
                at = self.skip(at)
        return at if self.text(at) == "{" else None

    def statement_end(self, i: int) -> int:
        """Index of the last token of the statement at i: up to `;`, or a line that starts something new."""
        depth_end = i
        while depth_end < len(self.code):
            t = self.code[depth_end]
            if t.text == ";" or (t.kind == "mark" and t.text in ")}]"):
                return max(i, depth_end - 1 if t.text != ";" else depth_end)
            nxt = self.skip(depth_end)
            if nxt < len(self.code) and "\n" in self.source[self.end_of(nxt - 1) : self.code[nxt].start]:
                a, b = self.code[nxt - 1], self.code[nxt]
                if (a.kind != "mark" or a.text in ")]}") and (b.kind == "name" and b.text not in ("in", "of", "instanceof", "as") or b.text == "@"):
                    return nxt - 1
            depth_end = nxt
        return len(self.code) - 1

    def names_in_braces(self, i: int) -> list[str]:
        """Local names of `{ a, b as c, d: e }` at i."""
        out, at, end = [], i + 1, self.partner.get(i, len(self.code))
        while at < end:
            part = at
            while at < end and self.text(at) != ",":
                at = self.skip(at)
            names = [self.text(k) for k in range(part, at) if self.is_name(k) and self.text(k) not in ("as", "type")]
            renamed = any(self.text(k) in ("as", ":") for k in range(part, at))
            if names:
                out.append(names[1] if renamed and len(names) > 1 else names[0])
            at += 1
        return out

    # --- declarations -------------------------------------------------------------------------------------------

    def read(self, at: int, end: int, scope: list[str], parent: str, owner: str, place: str, exported: bool = False) -> None:
        """Tokens at..end-1; place is file, class or inner."""
        while at < end:
            at = self.one(at, end, scope, parent, owner, place, exported)

    def one(self, at: int, end: int, scope: list[str], parent: str, owner: str, place: str, visible: bool) -> int:
        t, first = self.text(at), at
        if self.code[at].kind != "name":
            if t == "(" or t == "[":
                return at + 1
            if t == "{":
                self.read(at + 1, min(end, self.partner.get(at, end)), scope, parent, owner, "inner", False)
                return self.skip(at)
            return at + 1
        exported = visible
        while self.text(at) in ("export", "default", "declare", "abstract", "async", "public") and self.is_name(at) and (self.is_name(at + 1) or self.text(at) in ("export", "default")) and self.text(at + 1) not in ("=", "(", ":"):
            exported |= self.text(at) == "export"
            at += 1
            if at >= end:
                return end
        t = self.text(at)
        if t == "import" and self.text(at + 1) != "(" and place == "file":
            return self.imports(at)
        if t == "{" and exported and place == "file":
            return self.skip(at)
        if t == "class" and self.is_name(at + 1):
            return self.class_(first, at, scope, parent, owner, exported)
        if t == "function":
            name = at + 2 if self.text(at + 1) == "*" else at + 1
            if self.is_name(name):
                return self.function(first, name, scope, parent, exported)
        if t in ("interface", "type", "enum") and self.is_name(at + 1) and self.text(at + 2) in ("{", "=", "<", "extends"):
            return self.type_(first, at, scope, parent, exported, t)
        if place == "class" and (done := self.method(first, at, scope, parent, exported)):
            return done
        if t in ("const", "let", "var"):
            return self.variables(first, at, end, scope, parent, owner, place, exported)
        self.call(at, owner)
        return at + 1

    def imports(self, at: int) -> int:
        names, i = [], at + 1
        while i < len(self.code) and self.code[i].kind != "string" and self.text(i) != ";":
            if self.text(i) == "{":
                names += self.names_in_braces(i)
                i = self.skip(i)
                continue
            if self.is_name(i) and self.text(i) not in ("type", "from", "as"):
                names.append(self.text(i))
            i += 1
        if i < len(self.code) and self.code[i].kind == "string":
            self.out.relation(self.out.file_id, self.text(i)[1:-1], "IMPORTS", self.code[at].start, {"names": names})
        return i + 1

    def class_(self, first: int, at: int, scope: list[str], parent: str, owner: str, exported: bool) -> int:
        name, i = self.text(at + 1), at + 2
        heritage: list[tuple[str, str, int]] = []
        kind = None
        while i < len(self.code) and self.text(i) != "{":
            if self.text(i) in ("extends", "implements"):
                kind = {"extends": "EXTENDS", "implements": "IMPLEMENTS"}[self.text(i)]
            elif kind and self.is_name(i) and self.text(i - 1) in ("extends", "implements", ",", "."):
                if self.text(i - 1) == ".":
                    heritage[-1] = (kind, self.text(i), i)
                else:
                    heritage.append((kind, self.text(i), i))
            i = self.skip(i) if i in self.partner else i + 1
        close = self.partner.get(i, len(self.code) - 1)
        start = self.code[first].start
        own = self.out.entity("CLASS", name, ".".join([*scope, name]), start, self.end_of(close), parent, signature=self.head(at, i), documentation=self.documentation(start), exported=exported)
        for kind, base, where in heritage:
            self.out.relation(own, base, kind, self.code[where].start)
        self.read(i + 1, min(close, len(self.code)), [*scope, name], own, owner, "class", exported)
        return close + 1

    def method(self, first: int, at: int, scope: list[str], parent: str, exported: bool) -> int | None:
        i = at
        while self.text(i) in ("public", "private", "protected", "static", "readonly", "override", "async", "get", "set", "abstract", "*") and self.text(i + 1) not in ("(", "=", ":", ";", "?", "!"):
            i += 1
        params = i + 1
        if self.is_name(i) and self.text(params) == "<":
            while params < len(self.code) and self.text(params) != "(" and self.text(params) not in "{;":
                params += 1
        if not (self.is_name(i) and self.text(params) == "("):
            return None
        body = self.body_of(params)
        if body is None:
            return None
        return self.callable(first, i, body, scope, parent, exported, "METHOD")

    def callable(self, first: int, name: int, body: int, scope: list[str], parent: str, exported: bool, kind: str, signature_from: int | None = None) -> int:
        close, start = self.partner.get(body, len(self.code) - 1), self.code[first].start
        title = self.text(name)
        asynchronous = any(self.text(k) == "async" for k in range(first, body))
        own = self.out.entity(kind, title, ".".join([*scope, title]), start, self.end_of(close), parent, signature=self.head(first, body), documentation=self.documentation(start), exported=exported, metadata={"async": True} if asynchronous else None)
        for k in range(name + 1, body):
            self.call(k, own)
        self.read(body + 1, min(close, len(self.code)), [*scope, title], own, own, "inner")
        return close + 1

    def kind_of(self, name: str) -> str:
        return "COMPONENT" if self.jsx and name[:1].isupper() else "FUNCTION"

    def function(self, first: int, name: int, scope: list[str], parent: str, exported: bool) -> int:
        params = name + 1
        while params < len(self.code) and self.text(params) != "(":
            params += 1
        body = self.body_of(params) if params < len(self.code) else None
        if body is None:
            return name + 1
        return self.callable(first, name, body, scope, parent, exported, self.kind_of(self.text(name)))

    def type_(self, first: int, at: int, scope: list[str], parent: str, exported: bool, word: str) -> int:
        name, i = self.text(at + 1), at + 2
        bases = []
        while i < len(self.code) and self.text(i) not in ("{", "=", ";"):
            if self.is_name(i) and self.text(i - 1) in ("extends", ",") and word == "interface":
                bases.append(i)
            i += 1
        close = self.partner.get(i, i) if self.text(i) == "{" else self.statement_end(i)
        start = self.code[first].start
        own = self.out.entity("INTERFACE" if word == "interface" else "TYPE", name, ".".join([*scope, name]), start, self.end_of(close), parent, signature=self.head(at, i), documentation=self.documentation(start), exported=exported)
        for b in bases:
            self.out.relation(own, self.text(b), "EXTENDS", self.code[b].start)
        return close + 1

    def variables(self, first: int, at: int, end: int, scope: list[str], parent: str, owner: str, place: str, exported: bool) -> int:
        i = at + 1
        if self.text(i) in ("{", "["):  # destructuring gives no entity, but a require in it is an import
            close = self.partner.get(i, i)
            if self.text(close + 1) == "=" and self.text(close + 2) == "require" and self.text(close + 3) == "(" and self.code[close + 4].kind == "string":
                self.out.relation(self.out.file_id, self.text(close + 4)[1:-1], "IMPORTS", self.code[at].start, {"names": self.names_in_braces(i) if self.text(i) == "{" else [], "cjs": True})
                return self.skip(close + 3)
            return close + 1
        if not self.is_name(i):
            return i
        name, value = i, i + 1
        if self.text(value) == ":":
            while value < end and self.text(value) not in ("=", ";"):
                value = self.skip(value)
        if self.text(value) != "=":
            if place != "inner":
                self.plain(first, name, value - 1, scope, parent, exported)
            return value
        v = value + 1
        if self.text(v) == "require" and self.text(v + 1) == "(" and v + 2 < len(self.code) and self.code[v + 2].kind == "string":
            self.out.relation(self.out.file_id, self.text(v + 2)[1:-1], "IMPORTS", self.code[at].start, {"names": [self.text(name)], "cjs": True})
            return self.skip(v + 1)
        body = self.function_value(v)
        title = self.text(name)
        if body is not None and self.text(body) == "{":
            return self.callable(first, name, body, scope, parent, exported, self.kind_of(title))
        last = self.statement_end(v)
        if body is not None:  # an arrow whose body is an expression
            start = self.code[first].start
            own = self.out.entity(self.kind_of(title), title, ".".join([*scope, title]), start, self.end_of(last), parent, signature=self.head(first, body), documentation=self.documentation(start), exported=exported)
            self.read(body, min(last + 1, end), [*scope, title], own, own, "inner")
            return last + 1
        if place != "inner":
            self.plain(first, name, last, scope, parent, exported)
        return v

    def plain(self, first: int, name: int, last: int, scope: list[str], parent: str, exported: bool) -> None:
        title, start = self.text(name), self.code[first].start
        kind = "CONSTANT" if re.fullmatch(r"[A-Z][A-Z0-9_]*", title) else "VARIABLE"
        self.out.entity(kind, title, ".".join([*scope, title]), start, self.end_of(last), parent, documentation=self.documentation(start), exported=exported)

    def function_value(self, v: int) -> int | None:
        """If a function begins at v: the first token of its body."""
        i = v + 1 if self.text(v) == "async" else v
        if self.text(i) == "function":
            while i < len(self.code) and self.text(i) != "(":
                i += 1
            return self.body_of(i) if i < len(self.code) else None
        if self.text(i) == "(" or (self.is_name(i) and self.text(i + 1) == "=>"):
            j = self.skip(i) if self.text(i) == "(" else i + 1
            if self.text(j) == ":":
                while j < len(self.code) and self.text(j) not in ("=>", ";"):
                    j = self.skip(j)
            return j + 1 if self.text(j) == "=>" else None
        return None

    def call(self, i: int, owner: str) -> None:
        """An edge if token i is the last name of a call."""
        if not self.is_name(i) or self.text(i) in _NOT_CALLS and self.text(i - 1) not in (".", "?."):
            return
        j = i + 1
        if self.text(j) == "?.":
            j += 1
        if self.text(j) != "(":
            return
        if self.text(i) == "require" and j + 1 < len(self.code) and self.code[j + 1].kind == "string":
            self.out.relation(self.out.file_id, self.text(j + 1)[1:-1], "IMPORTS", self.code[i].start, {"names": [], "cjs": True})
            return
        a = i
        while self.text(a - 1) in (".", "?."):
            a -= 2
            while a >= 0 and self.text(a) in (")", "]"):
                opening = next((o for o, c in self.partner.items() if c == a), None)
                if opening is None:
                    break
                a = opening - 1 if self.is_name(opening - 1) or self.text(opening - 1) in (")", "]") else opening
        if self.text(a - 1) == "new":
            a -= 1
        whole = self.source[self.code[max(a, 0)].start : self.code[i].end]
        hint = self.text(i).lstrip("#")
        self.out.relation(owner, hint, "CALLS", self.code[i].start, {"expression": " ".join(whole.split())} if "." in whole else None)


def extract(path: str, language: str, source: str) -> Extraction:
    reader = _Reader(path, language, source)
    reader.read(0, len(reader.code), [], reader.out.file_id, reader.out.file_id, "file")
    return reader.out
