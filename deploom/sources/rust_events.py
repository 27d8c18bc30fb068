"""Rust source to events, by a tokenizer and a walk over items and statements.

Known gaps: bodies of macros (their arguments are walked as expressions), patterns beyond the names that they bind, and where clauses.
"""

from __future__ import annotations

import re

from .tokens import Walker, source_lines

KEYWORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union box".split())
PANICS = {"panic", "todo", "unimplemented"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}


def dotted(path: str) -> str:
    return re.sub(r"\s+", "", path).replace("::", ".")


class Rust(Walker):
    def __init__(self, module: str, source: str, rel: str):
        super().__init__(module, source, rust=True)
        stem = rel.rsplit("/", 1)[-1]
        self.is_root = stem in ("main.rs", "lib.rs", "mod.rs")

    def doc(self, i: int) -> str | None:
        before = self.source[: self.c.tokens[i].start].rstrip().split("\n") if i < len(self.c.tokens) else []
        out = []
        while before and (m := re.match(r"\s*///? ?(.*)", before[-1])) and before[-1].lstrip().startswith("///"):
            out.insert(0, m[1].lstrip("/").strip())
            before.pop()
        return "\n".join(out) or None

    def run(self) -> list[dict]:
        n = self.source.count("\n") + 1
        name = self.module.rsplit(".", 1)[-1]
        self.emit("DefineName", 1, name=name, qualname=self.module, node_type="module")
        self.emit("EnterScope", 1, name=name, qualname=self.module, scope_type="Module", end_line=n)
        self.items(len(self.c.tokens))
        self.emit("ExitScope", n, qualname=self.module, scope_type="Module")
        return self.events

    def items(self, end: int) -> None:
        while self.c.at < end:
            before = self.c.at
            self.statement(end)
            self.c.at += self.c.at == before
        self.c.at = max(self.c.at, end)

    def braces(self) -> None:
        if self.c.peek().text == "{":
            end = self.c.close[self.c.at]
            self.c.at += 1
            self.items(end)
            self.c.at = end + 1

    def find(self, end: int, *texts: str) -> int:
        """The next of the given tokens at this depth."""
        i = self.c.at
        while i < end:
            t = self.c.tokens[i]
            if t.text in texts and t.kind in ("op", "id"):
                return i
            i = self.c.close[i] + 1 if t.kind == "op" and t.text in "([{" else i + 1
        return end

    def types(self, a: int, b: int) -> None:
        """Names in a type are uses."""
        for k in range(a, min(b, len(self.c.tokens))):
            t = self.c.tokens[k]
            if t.kind == "id" and t.text not in KEYWORDS and self.c.tokens[k - 1].text != "::":
                self.emit("UseName", t.line, name=t.text)

    def statement(self, end: int) -> None:
        c, t = self.c, self.c.peek()
        if t.text == "#" and c.peek(1).text in ("[", "!"):
            i = c.at + 1 + (c.peek(1).text == "!")
            if i < len(c.tokens) and c.tokens[i].text == "[":
                text = c.text(i + 1, c.close[i])
                self.emit("Decorator", t.line, name=re.split(r"[(\s=]", text)[0], is_flag="(" in text, arguments=[x.strip() for x in text.partition("(")[2].rstrip(")").split(",") if x.strip()])
                c.at = c.close[i] + 1
            else:
                c.at = i
        elif t.text == "pub":
            c.at += 1
            if c.peek().text == "(":
                c.at = c.close[c.at] + 1
        elif t.text in ("unsafe", "async", "default", "extern", "move") and c.peek(1).text != "|":
            c.at += 1
            if c.peek().kind == "str":
                c.at += 1
        elif t.text == "use":
            stop = self.find(end, ";")
            c.at += 1
            self.use_tree(c.at, stop, [], t.line)
            c.at = stop + 1
        elif t.text == "mod" and c.peek(1).kind == "id":
            name = c.peek(1).text
            if c.peek(2).text == ";":
                base = self.module if self.is_root else self.module.rpartition(".")[0]
                self.emit("ImportStatement", t.line, module=f"{base}.{name}" if base else name, names=[], aliases={}, is_flag=False)
                c.at += 3
            else:
                c.at += 2
                self.scope_of("Module", name, t.line, "module")
        elif t.text == "fn":
            self.function()
        elif t.text in ("struct", "union", "enum") and c.peek(1).kind == "id":
            self.record(end)
        elif t.text == "trait":
            doc, name = self.doc(c.at), c.peek(1).text
            stop = self.find(end, "{", ";")
            c.at = stop
            self.scope_of("Class", name, t.line, "class", doc)
        elif t.text == "impl":
            self.impl(end)
        elif t.text in ("const", "static") and c.peek(1).text not in ("fn", "unsafe", "async"):
            c.at += 1
            c.accept("mut")
            self.let(end, t.line, False)
        elif t.text in ("const",):
            c.at += 1
        elif t.text == "type" and c.peek(1).kind == "id":
            stop = self.find(end, ";")
            self.define(c.peek(1).text, "variable", t.line)
            c.at += 2
            self.types(c.at, stop)
            c.at = stop + 1
        elif t.text == "let":
            c.at += 1
            self.let(end, t.line, True)
        elif t.text in ("if", "while", "for", "loop", "match"):
            getattr(self, t.text + "_")()
        elif t.text == "return":
            c.at += 1
            stop, a = self.find(end, ";", "}"), c.at
            self.expression(stop)
            self.emit("Return", t.line, value=c.text(a, stop), value_type=self.value_class(a, stop))
        elif t.text in ("break", "continue"):
            stop = self.find(end, ";", "}")
            c.at += 1
            self.expression(stop)
            self.emit("BreakStatement" if t.text == "break" else "ContinueStatement", t.line)
        elif t.text == "{":
            self.braces()
        elif t.text in (";", "}", ")", "]", ","):
            c.at += 1
        elif t.kind == "life" and c.peek(1).text == ":":
            c.at += 2
        else:
            stop = self.find(end, ";")
            block = next((i for i in range(c.at, stop) if c.tokens[i].text in ("if", "while", "for", "loop", "match") and c.tokens[i].kind == "id"), None)
            eq = next((i for i in range(c.at, stop) if c.tokens[i].text in ASSIGN and block is None), None)
            if eq is not None and all(x.kind == "id" or x.text in (".", "*") for x in c.tokens[c.at : eq]):
                a = c.at
                c.at = eq + 1
                self.expression(stop)
                name = dotted(c.text(a, eq)).lstrip("*")
                self.emit("Assignment", t.line, target=name, target_qualname=self.qualified(name), value=dotted_value(c.text(eq + 1, stop)), value_type=self.value_class(eq + 1, stop))
            else:
                self.expression(stop)

    def use_tree(self, a: int, b: int, prefix: list[str], line: int) -> None:
        c, path, i = self.c, list(prefix), a
        while i < b:
            t = c.tokens[i]
            if t.text == "{":
                for x, y in c.split(i + 1, c.close[i]):
                    self.use_tree(x, y, path, line)
                return
            if t.text == "*":
                self.import_(path, "*", None, line)
                return
            if t.kind == "id" and t.text != "as":
                path.append(t.text)
            if t.text == "as":
                self.import_(path[:-1], path[-1], c.tokens[i + 1].text, line)
                return
            i += 1
        if path:
            if path[-1] == "self":
                self.import_(path[:-2], path[-2] if len(path) > 1 else "self", None, line)
            else:
                self.import_(path[:-1], path[-1], None, line)

    def import_(self, path: list[str], name: str, alias: str | None, line: int) -> None:
        base = self.module.split(".")
        out = list(path)
        if out[:1] == ["crate"]:
            out = base[:1] + out[1:]
        elif out[:1] == ["self"]:
            out = base + out[1:]
        else:
            up = 0
            while out[up : up + 1] == ["super"]:
                up += 1
            if up:
                out = base[: len(base) - up] + out[up:]
        module = ".".join(out)
        if not module:
            self.emit("ImportStatement", line, module=name, names=[], aliases={name: alias} if alias else {}, is_flag=False)
        else:
            self.emit("ImportStatement", line, module=module, names=[name], aliases={name: alias} if alias else {}, is_flag=False)

    def scope_of(self, kind: str, name: str, line: int, node_type: str | None, doc: str | None = None, **more) -> None:
        c = self.c
        if node_type:
            self.define(name, node_type, line)
        if c.peek().text == "{":
            end = c.close[c.at]
            opened = self.enter(kind, name, line, self.last_line(end), docstring=doc, **more)
            self.braces()
            self.leave(opened)

    def record(self, end: int) -> None:
        c, doc, line = self.c, self.doc(self.c.at), self.c.peek().line
        is_enum = c.next().text == "enum"
        name = c.next().text
        c.at = self.find(end, "{", "(", ";")
        self.define(name, "class", line)
        open_, stop = c.peek().text, c.close.get(c.at, c.at)
        opened = self.enter("Class", name, line, self.last_line(stop), docstring=doc)
        if open_ in ("{", "("):
            for k, (a, b) in enumerate(c.split(c.at + 1, stop)):
                while a < b and c.tokens[a].text in ("pub", "#"):
                    a = c.close[a + 1] + 1 if c.tokens[a + 1].text in ("(", "[") else a + 1
                if a >= b:
                    continue
                named = is_enum or open_ == "{"
                self.define(c.tokens[a].text if named else str(k), "variable", c.tokens[a].line)
                self.types(a + 1 if named else a, b)
        self.leave(opened)
        c.at = stop + 1
        c.accept(";")

    def impl(self, end: int) -> None:
        c, line = self.c, self.c.next().line
        stop = self.find(end, "{", ";")
        words = [t for t in c.tokens[c.at : stop]]
        depth, flat = 0, []
        for t in words:
            depth += {"<": 1, ">": -1}.get(t.text, 0)
            if depth == 0 and t.text != ">":
                flat.append(t.text)
        if "where" in flat:
            flat = flat[: flat.index("where")]
        trait, target = ("".join(flat[: flat.index("for")]), flat[flat.index("for") + 1 :]) if "for" in flat else ("", flat)
        name = dotted("".join(x for x in target if re.match(r"[\w:]+$", x) and x not in ("mut", "dyn"))) or "impl"
        c.at = stop
        self.scope_of("Class", name.rsplit(".", 1)[-1], line, None, bases=[dotted(trait)] if trait else [])

    def function(self) -> None:
        c, doc, line = self.c, self.doc(self.c.at), self.c.next().line
        name = c.next().text
        c.at = self.find(len(c.tokens), "(", "{", ";")
        params = []
        if c.peek().text == "(":
            stop = c.close[c.at]
            for a, b in c.split(c.at + 1, stop):
                colon = next((i for i in range(a, b) if c.tokens[i].text == ":"), None)
                if colon is not None and c.tokens[a].text != "self":
                    params += [t.text for t in c.tokens[a:colon] if t.kind == "id" and t.text not in KEYWORDS][:1]
                    self.types(colon + 1, b)
            c.at = stop + 1
        stop = self.find(len(c.tokens), "{", ";")
        self.types(c.at, stop)
        c.at = stop
        self.define(name, "function", line)
        if c.peek().text == "{":
            end = c.close[c.at]
            opened = self.enter("Function", name, line, self.last_line(end), parameters=params, docstring=doc)
            c.at += 1
            self.body(end)
            c.at = end + 1
            self.leave(opened)
        else:
            opened = self.enter("Function", name, line, line, parameters=params, docstring=doc)
            self.leave(opened)
            c.at += 1

    def body(self, end: int) -> None:
        """Statements; a last expression without semicolon is what the block returns."""
        c = self.c
        while c.at < end:
            before, t = c.at, c.peek()
            stop = self.find(end, ";")
            plain = t.kind == "id" and (t.text not in KEYWORDS or t.text in ("self", "Self", "crate"))
            if stop >= end and plain and not any(x.text in ("if", "match", "for", "while", "loop") for x in c.tokens[c.at : end]):
                self.expression(end)
                self.emit("Return", t.line, value=dotted_value(c.text(before, end)), value_type=self.value_class(before, end))
            else:
                self.statement(end)
            c.at += c.at == before

    def names(self, a: int, b: int) -> list[str]:
        """Lower-case names that a pattern binds."""
        t = self.c.tokens
        return [x.text for k, x in enumerate(t[a:b], a) if x.kind == "id" and x.text not in KEYWORDS and re.match(r"[a-z_]", x.text) and x.text != "_" and t[k + 1].text not in ("::", "(", "{", "!")]

    def let(self, end: int, line: int, local: bool) -> None:
        c = self.c
        stop = self.find(end, ";")
        eq = next((i for i in range(c.at, stop) if c.tokens[i].text == "="), stop)
        colon = next((i for i in range(c.at, eq) if c.tokens[i].text == ":"), eq)
        names = self.names(c.at, colon) if local else [c.peek().text]
        for n in names:
            self.define(n, "variable", line)
        self.types(colon + 1, eq)
        c.at = eq + 1
        other = next((i for i in range(eq, stop) if c.tokens[i].text == "else" and c.tokens[i + 1].text == "{" and c.tokens[i - 1].text != "}"), None)
        self.expression(other or stop)
        if eq < stop:
            for n in names:
                self.emit("Assignment", line, target=n, target_qualname=self.qualified(n), value=dotted_value(c.text(eq + 1, other or stop)), value_type=self.value_class(eq + 1, other or stop))
        if other:
            c.at = other + 1
            self.braces()
        c.at = stop + 1

    def head(self) -> str:
        """Condition up to the block; names of `let` patterns are defined."""
        c = self.c
        stop, a = self.find(len(c.tokens), "{"), c.at
        if c.accept("let"):
            eq = self.find(stop, "=")
            for n in self.names(c.at, eq):
                self.define(n, "variable", c.peek().line)
            c.at = eq + 1
        self.expression(stop)
        c.at = stop
        return c.text(a, stop)

    def if_(self) -> None:
        c = self.c
        line = c.next().line
        i = len(self.events)
        condition = self.head()
        self.events.insert(i, {"kind": "ControlBlock", "scope": self.scope, "line": line, "col": 0, "block_type": "if", "condition": condition})
        self.braces()
        while c.peek().text == "else":
            line = c.next().line
            if c.accept("if"):
                i = len(self.events)
                condition = self.head()
                self.events.insert(i, {"kind": "ElseBlock", "scope": self.scope, "line": line, "col": 0, "block_type": "elif", "condition": condition})
                self.braces()
            else:
                self.emit("ElseBlock", line, block_type="else", condition="")
                self.braces()
                break
        self.emit("EndControlBlock", self.last_line(c.at - 1), block_type="if")

    def while_(self) -> None:
        line = self.c.next().line
        i = len(self.events)
        condition = self.head()
        self.events.insert(i, {"kind": "ControlBlock", "scope": self.scope, "line": line, "col": 0, "block_type": "while", "condition": condition})
        self.braces()
        self.emit("EndControlBlock", self.last_line(self.c.at - 1), block_type="while")

    def loop_(self) -> None:
        self.emit("ControlBlock", self.c.next().line, block_type="while", condition="true")
        self.braces()
        self.emit("EndControlBlock", self.last_line(self.c.at - 1), block_type="while")

    def for_(self) -> None:
        c, line = self.c, self.c.next().line
        a, stop = c.at, self.find(len(self.c.tokens), "{")
        over = self.find(stop, "in")
        self.emit("ControlBlock", line, block_type="for", condition=c.text(a, stop))
        for n in self.names(a, over):
            self.define(n, "variable", line)
        c.at = over + 1
        self.expression(stop)
        c.at = stop
        self.braces()
        self.emit("EndControlBlock", self.last_line(c.at - 1), block_type="for")

    def match_(self) -> None:
        c, line = self.c, self.c.next().line
        a, stop = c.at, self.find(len(self.c.tokens), "{")
        self.emit("ControlBlock", line, block_type="match", condition=c.text(a, stop))
        self.expression(stop)
        end = c.close.get(stop, stop)
        c.at = stop + 1
        while c.at < end:
            arrow = self.find(end, "=>")
            if arrow >= end:
                break
            a = c.at
            self.emit("ElseBlock", c.peek().line, block_type="case", condition=c.text(a, arrow))
            for n in self.names(a, arrow):
                self.define(n, "variable", c.tokens[a].line)
            c.at = arrow + 1
            if c.peek().text == "{":
                self.braces()
            else:
                stop = self.find(end, ",")
                self.expression(stop)
                c.at = stop
            c.accept(",")
        c.at = end + 1
        self.emit("EndControlBlock", self.last_line(c.at - 1), block_type="match")

    def value_class(self, a: int, b: int) -> str:
        t = self.c.tokens
        while a < b and t[a].text in ("&", "mut", "*"):
            a += 1
        if a >= b:
            return "none"
        if b - a == 1:
            return "literal" if t[a].kind in ("num", "str") or t[a].text in ("true", "false") else "name"
        i = a
        while i < b and (t[i].kind == "id" or t[i].text in (".", "::")):
            i += 1
        if i >= b:
            return "attribute"
        return "call" if t[i].text == "(" and i > a and self.c.close[i] + 1 >= b - (t[b - 1].text == "?") else "expression"

    def expression(self, end: int) -> None:
        c = self.c
        while c.at < end:
            t = c.peek()
            if t.kind in ("num", "str"):
                self.emit("Literal", t.line, value=t.text, value_type="string" if t.kind == "str" else "float" if "." in t.text else "integer")
                c.at += 1
            elif t.text in ("true", "false"):
                self.emit("Literal", t.line, value=t.text, value_type="boolean")
                c.at += 1
            elif t.kind == "id" and t.text in ("if", "match", "while", "for", "loop"):
                getattr(self, t.text + "_")()
            elif t.kind == "id" and t.text == "let":
                c.at += 1
                eq = self.find(end, "=")
                for n in self.names(c.at, eq):
                    self.define(n, "variable", t.line)
                c.at = eq + 1
            elif t.text in ("|", "||") and c.peek(-1).text in ("(", ",", "=", "move", "{", "=>", "return", "&&"):
                self.closure(end)
            elif t.text == "return":
                c.at += 1
                a = c.at
                self.expression(end)
                self.emit("Return", t.line, value=c.text(a, end), value_type=self.value_class(a, end))
            elif t.kind == "id" and (t.text not in KEYWORDS or t.text in ("self", "Self", "super", "crate")):
                self.chain(end)
            elif t.text == "{":
                self.braces()
            elif t.text in ("(", "["):
                stop = c.close[c.at]
                c.at += 1
                self.expression(stop)
                c.at = stop + 1
            elif t.text == "?":
                self.emit("Return", t.line, value="?", value_type="early_return")
                c.at += 1
            else:
                c.at += 1

    def closure(self, end: int) -> None:
        c, line = self.c, self.c.peek().line
        params = []
        if c.next().text == "|":
            stop = self.find(end, "|")
            params = self.names(c.at, stop)
            c.at = stop + 1
        name = f"<closure:{line}>"
        stop = c.close[c.at] + 1 if c.peek().text == "{" else min(end, self.find(end, ",", ";"))
        opened = self.enter("Lambda", name, line, self.last_line(stop - 1), parameters=params)
        for p in params:
            self.define(p, "variable", line)
        self.expression(stop)
        self.leave(opened)
        c.at = stop

    def chain(self, end: int) -> None:
        c, t = self.c, self.c.next()
        a = c.at - 1
        while c.peek().text == "::" and c.at < end:
            c.at += 1
            if c.peek().text == "<":
                depth = 0
                while c.at < end:
                    depth += {"<": 1, ">": -1}.get(c.peek().text, 0)
                    c.at += 1
                    if depth <= 0:
                        break
            else:
                c.at += 1
        path = re.sub(r"\.?<.*?>", "", dotted(c.text(a, c.at)))
        if c.peek().text == "!" and c.peek(1).text in ("(", "[", "{"):
            c.at += 1
            stop = c.close[c.at]
            args = c.split(c.at + 1, stop)
            c.at += 1
            self.expression(stop)
            c.at = stop + 1
            if path in PANICS:
                self.emit("RaiseStatement", t.line, value=c.text(a, c.at))
            else:
                self.emit("CallExpression", t.line, callee=path, arguments=[c.text(*r) for r in args])
            return
        called = False
        while c.at < end:
            n = c.peek()
            if n.text == "." and c.peek(1).kind in ("id", "num"):
                if not called and path != "self":
                    self.emit("AttributeAccess", n.line, object=path, attribute=c.peek(1).text)
                path += "." + c.peek(1).text
                c.at += 2
                if c.peek().text == "::":
                    c.at = self.find(end, "(")
            elif n.text == "(":
                stop = c.close[c.at]
                args = c.split(c.at + 1, stop)
                if "." in path and not called and t.text not in KEYWORDS and c.tokens[a + 1].text == ".":
                    self.emit("UseName", t.line, name=t.text)
                for x, y in args:
                    c.at = x
                    self.expression(y)
                c.at = stop + 1
                if not called:
                    self.emit("CallExpression", t.line, callee=path, arguments=[c.text(*r) for r in args])
                called = True
            elif n.text == "?":
                self.emit("Return", n.line, value="?", value_type="early_return")
                c.at += 1
            elif n.text == "[":
                stop = c.close[c.at]
                c.at += 1
                self.expression(stop)
                c.at = stop + 1
            elif n.text == "{" and re.match(r"[A-Z]", path.rsplit(".", 1)[-1]) and c.peek(1).kind == "id" and c.peek(2).text in (":", ",", "}"):
                stop = c.close[c.at]
                for x, y in c.split(c.at + 1, stop):
                    c.at = x + 2 if x + 1 < y and c.tokens[x + 1].text == ":" else x
                    self.expression(y)
                c.at = stop + 1
                called = True
                self.emit("UseName", t.line, name=path)
            else:
                break
        if not called and t.text not in ("self", "Self", "super", "crate"):
            self.emit("UseName", t.line, name=path if "::" in c.text(a, a + 2) else t.text)


def dotted_value(text: str) -> str:
    return re.sub(r"^[&*\s]*(mut\s+)?", "", text).replace("::", ".").rstrip("?")


def rust_events(module: str, source: str, rel: str) -> tuple[list[dict], str | None]:
    """(events, error). A module whose name isn't made of plain segments has no scope; a text that the walker can't follow gives its module
    scope and lines only."""
    lines = source_lines(module, source)
    if not re.fullmatch(r"[A-Za-z0-9_.]+", module):
        return lines, None
    try:
        return lines + Rust(module, source, rel).run(), None
    except (IndexError, KeyError, RecursionError) as e:
        return lines + Rust(module, "", rel).run(), f"{type(e).__name__}: {e}"
