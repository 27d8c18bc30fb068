"""JavaScript, TypeScript and JSX source to events, by a tokenizer and a walk over statements.

Known gaps: expressions inside template literals, text between JSX tags, and anonymous functions, whose bodies belong to the enclosing scope.
"""

from __future__ import annotations

import re

from .tokens import Walker, source_lines

KEYWORDS = set(
    "if else for while do switch case default break continue return throw try catch finally function class extends const let var new delete typeof "
    "instanceof in of void this super import export from as async await yield static get set null undefined true false debugger enum interface type "
    "implements public private protected readonly declare abstract namespace keyof infer is satisfies".split()
)
CONTINUES = {".", "?.", ",", "(", "[", "?", ":", "=", "=>", "+", "-", "*", "/", "%", "&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&", "|", "^", "instanceof", "in", "as", "satisfies"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "&&=", "||=", "??=", "&=", "|=", "^=", "<<=", ">>="}
MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "declare", "abstract", "override", "accessor", "*"}


def import_path(path: str, module: str, is_index: bool) -> str:
    """Dotted name of an import: relative paths from the module, scopes of packages with dots, others as they are; assets: empty."""
    if path.startswith("."):
        if re.search(r"\.(css|scss|less|json|svg|png|jpe?g|gif|html?|md|wasm)$", path):
            return ""
        base = module.split(".") if is_index else module.split(".")[:-1]
        for part in re.sub(r"\.(jsx?|tsx?|mjs|cjs)$", "", path).split("/"):
            if part == "..":
                base = base[:-1]
            elif part not in (".", ""):
                base = [*base, part]
        if base and base[-1] == "index":
            base = base[:-1]
        return ".".join(base)
    return path.replace("/", ".") if path.startswith("@") else path


def aliased(path: str, aliases: dict[str, str] | None) -> str | None:
    """Dotted name of a path under one of the project's own prefixes (see scan.import_aliases), the first that fits; None for others."""
    for prefix, target in () if path.startswith(".") else (aliases or {}).items():
        if prefix.endswith("/") and path.startswith(prefix):
            return ".".join([target, *[p for p in path[len(prefix) :].split("/") if p]])
        if path == prefix:
            return target
    return None


class JavaScript(Walker):
    def __init__(self, module: str, source: str, rel: str, aliases: dict[str, str] | None = None):
        super().__init__(module, source)
        self.aliases = aliases
        self.is_index = bool(re.search(r"(^|/)index\.\w+$", rel))

    def doc(self, i: int) -> str | None:
        """The JSDoc comment right before token i."""
        before = self.source[: self.c.tokens[i].start].rstrip() if i < len(self.c.tokens) else ""
        if not before.endswith("*/"):
            return None
        raw = before[before.rfind("/*") :]
        if not raw.startswith("/**"):
            return None
        return "\n".join(re.sub(r"^\s*\*? ?", "", x).rstrip() for x in raw[3:-2].split("\n")).strip()

    def run(self) -> list[dict]:
        n = self.source.count("\n") + 1
        self.emit("EnterScope", 1, name=self.module.rsplit(".", 1)[-1], qualname=self.module, scope_type="Module", end_line=n, docstring=self.doc(0))
        self.statements(len(self.c.tokens))
        self.emit("ExitScope", n, qualname=self.module, scope_type="Module")
        return self.events

    def statements(self, end: int) -> None:
        while self.c.at < end:
            before = self.c.at
            self.statement(end)
            if self.c.at == before:
                self.c.at += 1
        self.c.at = max(self.c.at, end)

    def braces(self) -> None:
        """A block, or one statement without braces."""
        if self.c.peek().text == "{":
            end = self.c.close[self.c.at]
            self.c.at += 1
            self.statements(end)
            self.c.at = end + 1
        else:
            self.statement(len(self.c.tokens))

    def until(self, end: int) -> int:
        """Index where the expression statement that starts here ends."""
        i = self.c.at
        while i < end:
            t = self.c.tokens[i]
            if t.text == ";" and t.kind == "op" or t.text in (")", "]", "}") and t.kind == "op":
                return i
            if i > self.c.at and t.line > self.c.tokens[i - 1].line and self.c.tokens[i - 1].text not in CONTINUES and t.text not in CONTINUES | {"}", ")", "]"}:
                return i
            i = self.c.close[i] + 1 if t.kind == "op" and t.text in "([{" else i + 1
        return end

    def statement(self, end: int) -> None:
        c, t = self.c, self.c.peek()
        follows = c.peek(1)
        if t.text == ";":
            c.at += 1
        elif t.text == "{":
            self.braces()
        elif t.text == "@":
            c.at += 1
            a = c.at
            while c.peek().kind == "id" or c.peek().text == ".":
                c.at += 1
            name, args = c.text(a, c.at), []
            call = c.peek().text == "("
            if call:
                args = [c.text(*r) for r in c.split(c.at + 1, c.close[c.at])]
                c.at = c.close[c.at] + 1
            self.emit("Decorator", t.line, name=name, is_flag=call, arguments=args)
        elif t.text == "import" and follows.text not in ("(", "."):
            self.imported(end)
        elif t.text == "export":
            self.exported(end)
        elif t.text in ("declare", "abstract") and follows.kind == "id":
            c.at += 1
            self.statement(end)
        elif t.text == "async" and follows.text == "function":
            c.at += 1
            self.function()
        elif t.text == "function":
            self.function()
        elif t.text == "class":
            self.class_()
        elif t.text == "interface" and follows.kind == "id":
            self.shape("interface", end)
        elif t.text == "enum" or t.text == "const" and follows.text == "enum":
            c.at += t.text == "const"
            self.shape("enum", end)
        elif t.text == "type" and follows.kind == "id" and c.peek(2).text in ("=", "<"):
            self.type_alias(end)
        elif t.text in ("namespace", "module") and follows.kind in ("id", "str") and c.peek(2).text == "{":
            c.at += 2
            self.braces()
        elif t.text in ("const", "let", "var"):
            c.at += 1
            self.declarations(self.until(end), t.line)
        elif t.text == "if":
            self.if_()
        elif t.text in ("for", "while", "do", "try", "switch"):
            getattr(self, t.text + "_")()
        elif t.text == "return":
            c.at += 1
            stop = c.at if c.peek().line > t.line else self.until(end)
            a = c.at
            self.expression(stop)
            self.emit("Return", t.line, value=c.text(a, stop), value_type=self.value_class(a, stop) if a < stop else "none")
        elif t.text == "throw":
            c.at += 1
            stop, a = self.until(end), c.at
            self.expression(stop)
            self.emit("RaiseStatement", t.line, value=c.text(a, stop))
        elif t.text in ("break", "continue"):
            c.at += 1
            self.emit("BreakStatement" if t.text == "break" else "ContinueStatement", t.line)
        elif t.text in (")", "]", "}"):
            c.at += 1
        else:
            stop, a = self.until(end), c.at
            if stop == a:
                c.at += 1
            elif t.kind == "id" and follows.text in ASSIGN - {"="}:
                self.expression(stop)
                self.emit("Assignment", t.line, target=t.text, target_qualname=self.qualified(t.text), value=c.text(a + 2, stop), value_type=self.value_class(a + 2, stop))
            else:
                self.expression(stop)

    # Modules

    def imported(self, end: int) -> None:
        c, line = self.c, self.c.next().line
        c.accept("type")
        names, aliases = [], {}
        while c.at < end and c.peek().kind != "str":
            t = c.next()
            if t.text == "*" and c.accept("as"):
                names.append("*")
                aliases["*"] = c.next().text
            elif t.text == "{":
                for a, b in c.split(c.at, c.close[c.at - 1]):
                    words = [x.text for x in c.tokens[a:b] if x.text != "type" or b - a == 1]
                    if words:
                        names.append(words[0])
                        if len(words) == 3:
                            aliases[words[0]] = words[2]
                c.at = c.close[c.at - 1] + 1
            elif t.kind == "id" and t.text != "from":
                names.append(t.text)
            elif t.text == ";":
                return
        self.import_from(c.next().text, names, aliases, line)

    def import_from(self, quoted: str, names: list[str], aliases: dict, line: int) -> None:
        path = quoted.strip("\"'`")
        own = aliased(path, self.aliases)
        self.emit("ImportStatement", line, module=import_path(path, self.module, self.is_index) if own is None else own, names=names, aliases=aliases, is_flag=False)

    def exported(self, end: int) -> None:
        c, line = self.c, self.c.next().line
        if c.accept("default"):
            c.accept("async")
            if c.peek().text in ("function", "class", "abstract") and (c.peek(1).kind == "id" or c.peek(1).text == "*"):
                self.statement(end)
            else:
                c.at = self.until(end)
        elif c.peek().text in ("{", "*"):
            names, aliases = ["*"], {}
            if c.next().text == "{":
                stop, names = c.close[c.at - 1], []
                for a, b in c.split(c.at, stop):
                    words = [x.text for x in c.tokens[a:b]]
                    names.append(words[0])
                    if len(words) == 3:
                        aliases[words[0]] = words[2]
                c.at = stop + 1
            elif c.accept("as"):
                aliases["*"] = c.next().text
            if c.accept("from"):
                self.import_from(c.next().text, names, aliases, line)
        else:
            self.statement(end)

    # Definitions

    def parameters(self) -> list[str]:
        """Names of a parameter list at the cursor; types and defaults are walked as uses. Destructured parameters keep their text."""
        c = self.c
        if c.peek().text != "(":
            return []
        stop, out = c.close[c.at], []
        for a, b in c.split(c.at + 1, stop):
            i = a
            while i < b and c.tokens[i].text in ("public", "private", "protected", "readonly"):
                i += 1
            spread = i < b and c.tokens[i].text == "..."
            i += spread
            if i < b and c.tokens[i].kind == "id":
                if c.tokens[i].text != "this":
                    out.append(("..." if spread else "") + c.tokens[i].text)
                c.at = i + 1
                self.expression(b)
            elif i < b:
                out.append(c.text(i, c.close.get(i, i) + 1))
        c.at = stop + 1
        return out

    def skip_types(self) -> None:
        """Type parameters, and a return type before a body."""
        c = self.c
        if c.peek().text == "<":
            depth = 0
            while c.at < len(c.tokens):
                depth += {"<": 1, ">": -1}.get(c.peek().text, 0)
                c.at += 1
                if depth <= 0:
                    break

    def return_type(self) -> None:
        c = self.c
        if c.peek().text == ":":
            c.at += 1
            if c.peek().text == "{":
                c.at = c.close[c.at] + 1
            while c.at < len(c.tokens) and c.peek().text not in ("{", ";", "=>", "}", ","):
                t = c.peek()
                if t.kind == "id" and t.text not in KEYWORDS:
                    self.emit("UseName", t.line, name=t.text)
                c.at = c.close[c.at] + 1 if t.text in ("(", "[") and t.kind == "op" else c.at + 1

    def callable_(self, name: str, line: int, doc: str | None, kind: str = "Function") -> None:
        """Parameters and body at the cursor, as a named scope."""
        c = self.c
        self.skip_types()
        here = len(self.events)
        params = self.parameters()
        self.return_type()
        early = self.events[here:]
        del self.events[here:]
        c.accept("=>")
        arrow = c.peek(-1).text == "=>"
        body = c.peek().text == "{"
        end = c.close[c.at] if body else self.until(len(c.tokens)) if arrow else c.at
        opened = self.enter(kind, name, line, self.last_line(end if body else end - 1), parameters=params, docstring=doc)
        self.events += [{**e, "scope": self.scope} for e in early]
        if body:
            self.braces()
        elif arrow:
            a = c.at
            self.expression(end)
            self.emit("Return", line, value=c.text(a, end), value_type=self.value_class(a, end))
        self.leave(opened)

    def function(self) -> None:
        c, doc, line = self.c, self.doc(self.c.at), self.c.next().line
        c.accept("*")
        name = c.next().text if c.peek().kind == "id" else f"<function:{line}>"
        self.define(name, "function", line)
        self.callable_(name, line, doc)

    def class_(self) -> None:
        c, doc, line = self.c, self.doc(self.c.at), self.c.next().line
        name = c.next().text if c.peek().kind == "id" and c.peek().text not in ("extends", "implements") else f"<class:{line}>"
        self.skip_types()
        bases = []
        while c.at < len(c.tokens) and c.peek().text != "{":
            if c.next().text == "extends":
                a = c.at
                while c.peek().kind == "id" and c.peek().text != "implements" or c.peek().text == ".":
                    c.at += 1
                bases = [c.text(a, c.at)] if c.at > a else []
        end = c.close.get(c.at, c.at)
        self.define(name, "class", line)
        opened = self.enter("Class", name, line, self.last_line(end), bases=bases, docstring=doc)
        c.at += 1
        while c.at < end:
            self.member(end)
        c.at = end + 1
        self.leave(opened)

    def member(self, end: int) -> None:
        c = self.c
        t = c.peek()
        if t.text == "@":
            self.statement(end)
            return
        doc = self.doc(c.at)
        while c.peek().text in MODIFIERS and c.peek(1).text not in ("(", "=", ";", ":", "?", "<"):
            c.at += 1
        if c.peek().text == "{":
            self.braces()
            return
        name = c.next()
        if name.text == "[":
            c.at = c.close[c.at - 1] + 1
        if name.kind not in ("id", "str", "num") and name.text != "[":
            return
        c.accept("?", "!")
        label = name.text.strip("\"'#")
        if c.peek().text in ("(", "<"):
            self.define(label, "function", name.line)
            self.callable_(label, name.line, doc)
            return
        self.define(label, "variable", name.line)
        stop = self.until(end)
        if c.peek().text == ":":
            c.at += 1
            while c.at < stop and c.peek().text != "=":
                x = c.peek()
                if x.kind == "id" and x.text not in KEYWORDS:
                    self.emit("UseName", x.line, name=x.text)
                c.at += 1
        if c.accept("="):
            a = c.at
            self.value(label, a, stop, name.line)
        c.at = max(c.at, stop)
        c.accept(";")

    def shape(self, kind: str, end: int) -> None:
        c, doc, line = self.c, self.doc(self.c.at), self.c.next().line
        name = c.next().text
        while c.at < end and c.peek().text != "{":
            c.at += 1
        stop = c.close.get(c.at, end)
        as_class = kind == "enum"
        self.define(name, "class" if as_class else "interface", line)
        opened = self.enter("Class" if as_class else "Interface", name, line, self.last_line(stop), docstring=doc)
        c.at += 1
        for a, b in c.split(c.at, stop, "," if as_class else ";"):
            if c.tokens[a].kind == "id":
                self.define(c.tokens[a].text, "variable", c.tokens[a].line)
                c.at = a + 1
                self.parameters()
                self.expression(b)
        c.at = stop + 1
        self.leave(opened)

    def type_alias(self, end: int) -> None:
        c, line = self.c, self.c.next().line
        i = c.at
        while i < end and c.tokens[i].text != "=":
            i += 1
        if i + 1 < end and c.tokens[i + 1].text == "{":
            c.at -= 1
            self.shape("interface", end)
        else:
            self.define(c.next().text, "interface", line)
            self.expression(self.until(end))

    def bound(self, a: int, b: int) -> list[str]:
        """Names that a pattern binds."""
        c, t = self.c, self.c.tokens[a]
        if t.text in ("{", "["):
            out = []
            for x, y in c.split(a + 1, c.close[a]):
                parts = c.split(x, y, ":")
                if c.tokens[x].text == "...":
                    out += self.bound(x + 1, y)
                elif len(parts) > 1:
                    out += self.bound(*parts[1])
                else:
                    out += self.bound(x, y)
            return out
        return [t.text] if t.kind == "id" else []

    def declarations(self, stop: int, line: int) -> None:
        c = self.c
        for a, b in c.split(c.at, stop):
            names = self.bound(a, b)
            i = c.close[a] + 1 if c.tokens[a].text in ("{", "[") else a + 1
            c.at = i
            if c.peek().text in ("!", "?"):
                c.at += 1
            if c.peek().text == ":":
                while c.at < b and c.peek().text != "=":
                    x = c.peek()
                    if x.kind == "id" and x.text not in KEYWORDS:
                        self.emit("UseName", x.line, name=x.text)
                    c.at = c.close[c.at] + 1 if x.kind == "op" and x.text in "([{" else c.at + 1
            if c.at < b and c.peek().text == "=":
                c.at += 1
                if len(names) == 1 and c.tokens[a].kind == "id":
                    self.define_value(names[0], c.at, b, c.tokens[a].line, self.doc(a - 1))
                else:
                    start = c.at
                    for n in names:
                        self.define(n, "variable", line)
                    self.expression(b)
                    for n in names:
                        self.emit("Assignment", line, target=n, target_qualname=self.qualified(n), value=c.text(start, b), value_type=self.value_class(start, b))
            else:
                for n in names:
                    self.define(n, "variable", line)
        c.at = max(c.at, stop)

    def is_function(self, a: int, b: int) -> int:
        """Where the parameters of a function value start; 0 if it is none."""
        t = self.c.tokens
        i = a + (t[a].text == "async")
        if i < b and t[i].text == "function":
            i += 1
            i += i < b and t[i].text == "*"
            return i + (i < b and t[i].kind == "id")
        if i < b and t[i].text == "(":
            j = self.c.close[i] + 1
            while j < b and t[j].text not in ("=>", ";", ","):
                j += 1
            return i if j < b and t[j].text == "=>" else 0
        return i if i + 1 < b and t[i].kind == "id" and t[i + 1].text == "=>" else 0

    def define_value(self, name: str, a: int, b: int, line: int, doc: str | None) -> None:
        if a < b and (i := self.is_function(a, b)):
            self.define(name, "function", line)
            self.c.at = i
            if self.c.peek().kind == "id":  # one parameter without parentheses
                param = self.c.next().text
                self.c.accept("=>")
                body = self.c.peek().text == "{"
                opened = self.enter("Function", name, line, self.last_line(b - 1), parameters=[param], docstring=doc)
                start = self.c.at
                self.braces() if body else self.expression(b)
                if not body:
                    self.emit("Return", line, value=self.c.text(start, b), value_type=self.value_class(start, b))
                self.leave(opened)
            else:
                self.callable_(name, line, doc)
            self.c.at = max(self.c.at, b)
            return
        self.define(name, "variable", line)
        self.value(name, a, b, line)

    def value(self, name: str, a: int, b: int, line: int) -> None:
        self.expression(b)
        self.emit("Assignment", line, target=name, target_qualname=self.qualified(name), value=self.c.text(a, b), value_type=self.value_class(a, b))

    def value_class(self, a: int, b: int) -> str:
        t = self.c.tokens
        if a >= b:
            return "expression"
        if b - a == 1:
            return "literal" if t[a].kind in ("num", "str", "regex") or t[a].text in ("true", "false", "null", "undefined") else "name"
        i = a + (t[a].text in ("new", "await"))
        while i < b and (t[i].kind == "id" or t[i].text in (".", "?.")):
            i += 1
        if i >= b:
            return "attribute"
        return "call" if t[i].text == "(" and i > a and self.c.close[i] + 1 >= b else "expression"

    # Control flow

    def condition(self) -> str:
        c = self.c
        if c.peek().text != "(":
            return ""
        stop, a = c.close[c.at], c.at + 1
        c.at += 1
        self.expression(stop)
        c.at = stop + 1
        return c.text(a, stop)

    def peeked(self) -> str:
        c = self.c
        return c.text(c.at + 1, c.close[c.at]) if c.peek().text == "(" else ""

    def if_(self) -> None:
        line = self.c.next().line
        self.emit("ControlBlock", line, block_type="if", condition=self.peeked())
        self.condition()
        self.braces()
        while self.c.peek().text == "else":
            line = self.c.next().line
            if self.c.accept("if"):
                self.emit("ElseBlock", line, block_type="elif", condition=self.peeked())
                self.condition()
                self.braces()
            else:
                self.emit("ElseBlock", line, block_type="else", condition="")
                self.braces()
                break
        self.emit("EndControlBlock", self.last_line(self.c.at - 1), block_type="if")

    def while_(self) -> None:
        line = self.c.next().line
        self.emit("ControlBlock", line, block_type="while", condition=self.peeked())
        self.condition()
        self.braces()
        self.emit("EndControlBlock", self.last_line(self.c.at - 1), block_type="while")

    def do_(self) -> None:
        line = self.c.next().line
        self.emit("ControlBlock", line, block_type="while", condition="")
        self.braces()
        if self.c.accept("while"):
            self.condition()
        self.emit("EndControlBlock", self.last_line(self.c.at - 1), block_type="while")

    def for_(self) -> None:
        c, line = self.c, self.c.next().line
        c.accept("await")
        if c.peek().text != "(":
            return
        stop = c.close[c.at]
        c.at += 1
        a = c.at
        over = next((i for i in range(a, stop) if c.tokens[i].text in ("of", "in") and c.tokens[i].kind == "id"), None)
        if over and ";" not in {t.text for t in c.tokens[a:stop]}:
            c.at = over + 1
            self.expression(stop)
            start = a + (c.tokens[a].text in ("const", "let", "var"))
            for n in self.bound(start, over):
                self.define(n, "variable", line)
        else:
            parts = c.split(a, stop, ";")
            for k, (x, y) in enumerate(parts):
                c.at = x
                if k == 0 and c.tokens[x].text in ("const", "let", "var"):
                    c.at = x + 1
                    self.declarations(y, line)
                else:
                    self.expression(y)
        c.at = stop + 1
        self.braces()

    def try_(self) -> None:
        line = self.c.next().line
        self.emit("ControlBlock", line, block_type="try", condition="")
        self.braces()
        if self.c.peek().text == "catch":
            line = self.c.next().line
            self.emit("ElseBlock", line, block_type="except", condition="")
            if self.c.peek().text == "(":
                for n in self.bound(self.c.at + 1, self.c.close[self.c.at]):
                    self.define(n, "variable", line)
                self.c.at = self.c.close[self.c.at] + 1
            self.braces()
        if self.c.peek().text == "finally":
            self.emit("ElseBlock", self.c.next().line, block_type="finally", condition="")
            self.braces()
        self.emit("EndControlBlock", self.last_line(self.c.at - 1), block_type="try")

    def switch_(self) -> None:
        c, line = self.c, self.c.next().line
        self.emit("ControlBlock", line, block_type="match", condition=self.peeked())
        self.condition()
        if c.peek().text == "{":
            end = c.close[c.at]
            c.at += 1
            while c.at < end:
                t = c.peek()
                if t.text in ("case", "default") and t.kind == "id":
                    c.at += 1
                    a = c.at
                    while c.at < end and c.peek().text != ":":
                        c.at = c.close[c.at] + 1 if c.peek().text in ("(", "[", "{") else c.at + 1
                    stop = c.at
                    self.emit("ElseBlock", t.line, block_type="case", condition=c.text(a, stop))
                    c.at = a
                    self.expression(stop)
                    c.at = stop + 1
                else:
                    before = c.at
                    self.statement(end)
                    c.at += c.at == before
            c.at = end + 1
        self.emit("EndControlBlock", self.last_line(c.at - 1), block_type="match")

    # Expressions

    def expression(self, end: int) -> None:
        c = self.c
        end = min(end, len(c.tokens))
        while c.at < end:
            t = c.peek()
            if t.kind in ("num", "str", "regex"):
                self.emit("Literal", t.line, value=t.text, value_type="string" if t.kind != "num" else "float" if "." in t.text else "integer")
                c.at += 1
            elif t.text in ("true", "false", "null"):
                self.emit("Literal", t.line, value=t.text, value_type="null" if t.text == "null" else "boolean")
                c.at += 1
            elif t.kind == "id" and (t.text in ("function", "class") and c.peek(-1).text not in (".", "?.")):
                c.at += 1
                while c.at < end and c.peek().text not in ("(", "{"):
                    c.at += 1
                if c.peek().text == "(":
                    self.parameters()
                    self.return_type()
                self.braces()
            elif t.kind == "id" and t.text == "yield":
                self.emit("YieldExpression", t.line, value=c.text(c.at + 1, end), is_flag=c.peek(1).text == "*")
                c.at += 1
            elif t.kind == "id" and (t.text not in KEYWORDS or t.text in ("this", "super", "import", "from", "as", "of", "type", "get", "set", "is", "static", "declare", "namespace", "async")):
                self.chain(end)
            elif t.text == "=>":
                c.at += 1
                if c.peek().text == "{":
                    self.braces()
            elif t.text == "{":
                self.object_(c.close[c.at])
            elif t.text in ("(", "["):
                stop = c.close[c.at]
                c.at += 1
                self.expression(stop)
                c.at = stop + 1
            else:
                c.at += 1

    def object_(self, end: int) -> None:
        """An object literal: keys are no uses, shorthands and values are; methods are walked in place."""
        c = self.c
        for a, b in c.split(c.at + 1, end):
            c.at = a
            while c.at + 1 < b and c.peek().text in ("async", "get", "set", "*") and c.peek(1).kind in ("id", "str"):
                c.at += 1
            if c.peek().kind in ("id", "str", "num") and c.peek(1).text == ":":
                c.at += 2
                self.expression(b)
            elif c.peek().kind == "id" and c.peek(1).text == "(" and c.close[c.at + 1] + 1 < b:
                c.at += 1
                self.parameters()
                self.return_type()
                if c.peek().text == "{":
                    self.braces()
            else:
                self.expression(b)
        c.at = end + 1

    def chain(self, end: int) -> None:
        """A name with its members and calls: arguments come before the call; what is called is neither a use nor an access of members."""
        c, t = self.c, self.c.next()
        a = c.at - 1
        called, members = False, []
        while c.at < end:
            n = c.peek()
            if n.text in (".", "?.") and c.peek(1).kind == "id":
                if not called:
                    members.append((n.line, c.text(a, c.at), c.peek(1).text))
                c.at += 2
            elif n.text in ("!",) and c.peek(1).text == ".":
                c.at += 1
            elif n.text == "(" or n.text == "?." and c.peek(1).text == "(":
                c.at += n.text == "?."
                callee, stop = c.text(a, c.at).replace("?.", "."), c.close[c.at]
                args = c.split(c.at + 1, stop)
                for x, y in args:
                    c.at = x
                    self.expression(y)
                c.at = stop + 1
                if not called:
                    callee = "self" + callee[4:] if callee.startswith("this.") else callee
                    if callee not in ("super", "import"):
                        self.emit("CallExpression", t.line, callee=callee, arguments=[c.text(*r) for r in args])
                called = True
            elif n.text == "[" and n.line == c.peek(-1).line:
                stop = c.close[c.at]
                c.at += 1
                self.expression(stop)
                c.at = stop + 1
            else:
                break
        if not called:
            for line, of, attribute in reversed(members):
                self.emit("AttributeAccess", line, object=of, attribute=attribute)
            if t.text not in ("this", "super", "import") and c.peek().text != "=>":
                self.emit("UseName", t.line, name=t.text)


def javascript_events(module: str, source: str, rel: str, aliases: dict[str, str] | None = None) -> tuple[list[dict], str | None]:
    """(events, error). A text that the walker can't follow gives its module scope and lines only."""
    lines = source_lines(module, source)
    try:
        return lines + JavaScript(module, source, rel, aliases).run(), None
    except (IndexError, KeyError, RecursionError) as e:
        return lines + JavaScript(module, "", rel).run(), f"{type(e).__name__}: {e}"


