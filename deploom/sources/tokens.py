"""A tokenizer for brace languages, and a cursor over its tokens."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, op, regex
    text: str
    start: int
    end: int
    line: int


OPERATORS = ["===", "!==", "**=", "<<=", ">>=", "&&=", "||=", "??=", "...", "..=", "=>", "->", "::", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", ".."]
NAME = re.compile(r"[A-Za-z_$#À-￿][\w$À-￿]*")
NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[A-Za-z_\d]*|\.\d[\d_]*")
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}


def tokenize(source: str, rust: bool = False) -> list[Token]:
    out: list[Token] = []
    i, n, line = 0, len(source), 1
    while i < n:
        c = source[i]
        if c == "\n":
            line += 1
            i += 1
        elif c.isspace():
            i += 1
        elif source.startswith("//", i):
            j = source.find("\n", i)
            i = n if j < 0 else j
        elif source.startswith("/*", i):
            j = source.find("*/", i + 2)
            j = n if j < 0 else j + 2
            line += source.count("\n", i, j)
            i = j
        elif rust and (m := re.compile(r'b?r(#*)"').match(source, i)):
            j = source.find('"' + m[1], m.end())
            j = n if j < 0 else j + 1 + len(m[1])
            out.append(Token("str", source[i:j], i, j, line))
            line += source.count("\n", i, j)
            i = j
        elif rust and c == "'" and not re.compile(r"'(\\.[^']*|[^'\\])'").match(source, i):
            m = re.compile(r"'\w*").match(source, i)  # a lifetime
            out.append(Token("life", m[0], i, m.end(), line))
            i = m.end()
        elif c in "\"'" or (c == "`" and not rust):
            j = i + 1
            while j < n and source[j] != c:
                j += 2 if source[j] == "\\" else 1
            j = min(n, j + 1)
            out.append(Token("str", source[i:j], i, j, line))
            line += source.count("\n", i, j)
            i = j
        elif m := NUMBER.match(source, i):
            out.append(Token("num", m[0], i, m.end(), line))
            i = m.end()
        elif m := NAME.match(source, i):
            out.append(Token("id", m[0], i, m.end(), line))
            i = m.end()
        elif c == "/" and not rust and (not out or (out[-1].kind == "op" and out[-1].text not in (")", "]", "}")) or out[-1].text in BEFORE_REGEX) and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(source, i)):
            out.append(Token("regex", m[0], i, m.end(), line))
            i = m.end()
        else:
            text = next((o for o in OPERATORS if source.startswith(o, i)), c)
            out.append(Token("op", text, i, i + len(text), line))
            i += len(text)
    return out


PAIRS = {"(": ")", "[": "]", "{": "}"}
END = Token("end", "", 0, 0, 0)


class Cursor:
    """Tokens with a place; `close[i]` is the index of the bracket that closes the one at i."""

    def __init__(self, source: str, rust: bool = False):
        self.source, self.tokens, self.at = source, tokenize(source, rust), 0
        self.close, stack = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in PAIRS:
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                while stack and PAIRS[self.tokens[stack[-1]].text] != t.text:
                    self.close[stack.pop()] = i
                if stack:
                    self.close[stack.pop()] = i
        for i in stack:
            self.close[i] = len(self.tokens)

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if 0 <= i < len(self.tokens) else END

    def next(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def accept(self, *texts: str) -> bool:
        if self.peek().text in texts and self.peek().kind in ("op", "id"):
            self.at += 1
            return True
        return False

    def text(self, a: int, b: int) -> str:
        """Source text of the tokens a to b - 1."""
        b = min(b, len(self.tokens))
        return self.source[self.tokens[a].start : self.tokens[b - 1].end] if a < b else ""

    def split(self, a: int, b: int, separator: str = ",") -> list[tuple[int, int]]:
        """Ranges between separators at depth 0 within a..b; angle brackets count in type lists."""
        out, start, i, angle = [], a, a, 0
        while i < b:
            t = self.tokens[i]
            if t.kind == "op" and t.text in PAIRS:
                i = self.close[i]
            elif t.text == "<":
                angle += 1
            elif t.text == ">" and angle:
                angle -= 1
            elif t.text == separator and t.kind == "op" and not angle:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out


class Walker:
    """What the walkers of brace languages share: events with their scope, and nested names."""

    def __init__(self, module: str, source: str, rust: bool = False):
        self.c = Cursor(source, rust)
        self.events: list[dict] = []
        self.module, self.source, self.scope, self.named = module, source, module, [module]

    def emit(self, kind: str, line: int, **more) -> None:
        self.events.append({"kind": kind, "scope": self.scope, "line": line, "col": 0, **more})

    def qualified(self, name: str) -> str:
        return ".".join([*self.named, name])

    def define(self, name: str, kind: str, line: int) -> None:
        self.emit("DefineName", line, name=name, qualname=self.qualified(name), node_type=kind)

    def enter(self, kind: str, name: str, line: int, end: int, qualname: str | None = None, **more) -> tuple[str, str, str]:
        """Opens a scope; give what it returns to leave()."""
        q, outer = qualname or self.qualified(name), self.scope
        self.emit("EnterScope", line, name=name, qualname=q, scope_type=kind, end_line=end, **more)
        self.scope = q
        self.named.append(name)
        return q, kind, outer

    def leave(self, opened: tuple[str, str, str]) -> None:
        q, kind, outer = opened
        self.emit("ExitScope", 0, qualname=q, scope_type=kind)
        self.scope = outer
        self.named.pop()

    def last_line(self, i: int) -> int:
        return self.c.tokens[min(i, len(self.c.tokens) - 1)].line if self.c.tokens else 0


def source_lines(module: str, source: str) -> list[dict]:
    return [{"kind": "SourceLine", "scope": module, "line": k, "text": t} for k, t in enumerate(source.split("\n"), 1)]
