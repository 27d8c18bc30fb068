"""Python source to an ordered list of events, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

LITERALS = {str: "string", bytes: "string", int: "integer", float: "float", complex: "float", bool: "boolean", type(None): "none", type(...): "none"}


#: Kinds of nodes that a walk goes down to: all but contexts, operators and comments on types.
VISITED = (ast.expr, ast.stmt, ast.comprehension, ast.excepthandler, ast.arguments, ast.arg, ast.keyword, ast.alias, ast.withitem, ast.match_case, ast.pattern, ast.type_param)
METHODS: dict[type, object] = {}


def clean_doc(node) -> str | None:
    return ast.get_docstring(node, clean=True)


class PythonEvents(ast.NodeVisitor):
    """Events carry the qualified scope that they happen in; inner calls come before outer ones, definitions before their values."""

    def __init__(self, module: str, source: str, is_package: bool, self_attributes: bool = False):
        self.events: list[dict] = []
        self.module, self.source, self.is_package, self.self_attributes = module, source, is_package, self_attributes
        self.scope, self.named = module, [module]  # scope of events; enclosing names that qualify definitions
        self.checking = 0
        self.lines = re.findall(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", source.encode())  # as the syntax tree counts them

    def visit(self, node):
        """As NodeVisitor's, with the method of a type looked up once."""
        kind = type(node)
        method = METHODS.get(kind)
        if method is None:
            method = METHODS[kind] = getattr(type(self), "visit_" + kind.__name__, type(self).generic_visit)
        return method(self, node)

    def generic_visit(self, node):
        """Children that are no operators or contexts, which have no events."""
        for field in node._fields:
            value = getattr(node, field, None)
            if type(value) is list:
                for x in value:
                    if isinstance(x, VISITED):
                        self.visit(x)
            elif isinstance(value, VISITED):
                self.visit(value)

    def emit(self, kind: str, node=None, **more) -> None:
        self.events.append({"kind": kind, "scope": self.scope, "line": getattr(node, "lineno", 0), "col": getattr(node, "col_offset", 0), **more})

    def text(self, node) -> str:
        last = getattr(node, "end_lineno", None)
        if last is None:
            return ast.unparse(node)
        first, last = node.lineno - 1, last - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode()
        parts = [self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]]
        return b"".join(parts).decode()

    def qualified(self, name: str) -> str:
        return ".".join([*self.named, name])

    def run(self, tree: ast.Module) -> list[dict]:
        self.enter("Module", self.module.rsplit(".", 1)[-1], self.module, tree, docstring=clean_doc(tree), line=1, end_line=self.source.count("\n") + 1)
        for child in tree.body:
            self.visit(child)
        self.leave(self.module, "Module")
        return self.events

    def enter(self, kind: str, name: str, qualname: str, node, **more) -> None:
        more.setdefault("end_line", getattr(node, "end_lineno", 0))
        self.emit("EnterScope", node, name=name, qualname=qualname, scope_type=kind, **more)
        self.scope = qualname

    def leave(self, qualname: str, kind: str, outer: str | None = None) -> None:
        self.emit("ExitScope", None, qualname=qualname, scope_type=kind)
        self.scope = outer or self.scope

    def define(self, name: str, kind: str, node) -> None:
        self.emit("DefineName", node, name=name, qualname=self.qualified(name), node_type=kind)

    def names_in(self, node) -> list[ast.Name]:
        return [n for n in ast.walk(node) if isinstance(n, ast.Name)]

    def annotation(self, node) -> None:
        if node is not None:
            self.visit(node)

    # Imports

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.emit("ImportStatement", node, module=a.name, names=[], aliases={a.name: a.asname} if a.asname else {}, is_flag=bool(self.checking))

    def visit_ImportFrom(self, node) -> None:
        module = node.module or ""
        if node.level:
            base = self.module.split(".")
            up = node.level - (1 if self.is_package else 0)
            module = ".".join([*base[: len(base) - up], *filter(None, [module])]) if up < len(base) or (up == len(base) and module) else "." * node.level + module
        self.emit("ImportStatement", node, module=module, names=[a.name for a in node.names], aliases={a.name: a.asname for a in node.names if a.asname}, is_flag=bool(self.checking))

    # Scopes

    def decorate(self, node) -> None:
        for d in node.decorator_list:
            call = isinstance(d, ast.Call)
            self.emit("Decorator", d, name=self.text(d.func if call else d), is_flag=call, arguments=[self.text(a) for a in d.args] if call else [])
            self.visit(d)

    def visit_ClassDef(self, node) -> None:
        self.decorate(node)
        self.define(node.name, "class", node)
        bases = [self.text(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        heads = [*node.bases, *[k.value for k in node.keywords]]
        self.body_scope("Class", node.name, node, lambda: self.statements(heads), bases=bases, docstring=clean_doc(node))

    def body_scope(self, kind: str, name: str, node, head, **more) -> None:
        """A scope whose head (superclasses; parameters) belongs to it."""
        outer, q = self.scope, self.qualified(name)
        self.enter(kind, name, q, node, **more)
        head()
        self.named.append(name)
        for child in node.body:
            self.visit(child)
        self.named.pop()
        self.leave(q, kind, outer)

    def parameters(self, a: ast.arguments) -> list[str]:
        out = [p.arg for p in [*a.posonlyargs, *a.args]]
        out += ["*" + a.vararg.arg] if a.vararg else []
        out += [p.arg for p in a.kwonlyargs]
        out += ["**" + a.kwarg.arg] if a.kwarg else []
        return [p for p in out if p not in ("self", "cls")]

    def visit_FunctionDef(self, node) -> None:
        self.decorate(node)
        a = node.args
        for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
            self.annotation(p.annotation)
        self.annotation(node.returns)
        self.define(node.name, "function", node)

        def head():
            self.parameter_uses(a)
            self.annotation(node.returns)

        self.body_scope("Function", node.name, node, head, parameters=self.parameters(a), docstring=clean_doc(node))

    def parameter_uses(self, a: ast.arguments) -> None:
        """Names, types and defaults of parameters, in order."""
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults
        rest = [(a.vararg, None), *zip(a.kwonlyargs, a.kw_defaults, strict=True), (a.kwarg, None)]
        for p, default in [*zip(plain, defaults, strict=True), *rest]:
            if p is not None:
                self.emit("UseName", p, name=p.arg)
                self.annotation(p.annotation)
                if default is not None:
                    self.visit(default)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node) -> None:
        name = f"<lambda:{node.lineno}>"
        self.define(name, "function", node)
        outer, q = self.scope, self.qualified(name)
        self.enter("Lambda", name, q, node, parameters=self.parameters(node.args))
        self.parameter_uses(node.args)
        self.visit(node.body)
        self.leave(q, "Lambda", outer)

    def comprehension(self, node, name: str) -> None:
        outer, q = self.scope, self.qualified(name)
        self.enter("Comprehension", name, q, node)
        self.leave(q, "Comprehension", outer)
        for g in node.generators:
            self.visit(g.iter)
            for i in g.ifs:
                self.visit(i)
        for part in ("key", "value", "elt"):
            if hasattr(node, part):
                self.visit(getattr(node, part))

    def visit_ListComp(self, node) -> None:
        self.comprehension(node, "<listcomp>")

    def visit_SetComp(self, node) -> None:
        self.comprehension(node, "<setcomp>")

    def visit_DictComp(self, node) -> None:
        self.comprehension(node, "<dictcomp>")

    def visit_GeneratorExp(self, node) -> None:
        self.comprehension(node, "<genexpr>")

    # Bindings of names

    def value_class(self, v) -> str:
        if isinstance(v, ast.Constant):
            return "literal"
        if isinstance(v, (ast.Call, ast.Await)):
            return "call"
        if isinstance(v, ast.Name):
            return "name"
        if isinstance(v, ast.Attribute):
            return "attribute"
        if isinstance(v, (ast.List, ast.Tuple, ast.Dict, ast.Set, ast.ListComp, ast.SetComp, ast.DictComp)):
            return "collection"
        return "expression"

    def targets(self, t) -> list[ast.expr]:
        if isinstance(t, ast.Name):
            return [t]
        if isinstance(t, (ast.Tuple, ast.List)):
            return [x for e in t.elts for x in self.targets(e)]
        if isinstance(t, ast.Starred):
            return self.targets(t.value)
        return [t] if self.self_attributes and isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" else []

    def bind(self, targets, value, node) -> None:
        found = [x for t in targets for x in self.targets(t)]
        for t in found:
            if isinstance(t, ast.Name):
                self.define(t.id, "variable", t)
        if value is not None:
            self.visit(value)
        for t in found:
            name = self.text(t)
            owner = self.qualified(name) if isinstance(t, ast.Name) else ".".join([*self.named[:-1], t.attr])
            self.emit("Assignment", node, target=name, target_qualname=owner, value=self.text(value) if value is not None else "", value_type=self.value_class(value) if value is not None else "expression")

    def visit_Assign(self, node) -> None:
        self.bind(node.targets, node.value, node)

    def visit_AnnAssign(self, node) -> None:
        self.annotation(node.annotation)
        self.bind([node.target], node.value, node)

    def visit_TypeAlias(self, node) -> None:
        self.bind([node.name], node.value, node)

    def visit_AugAssign(self, node) -> None:
        self.visit(node.target)
        self.visit(node.value)
        if isinstance(node.target, ast.Name):
            self.emit("Assignment", node, target=node.target.id, target_qualname=self.qualified(node.target.id), value=self.text(node.value), value_type=self.value_class(node.value))

    def visit_NamedExpr(self, node) -> None:
        self.define(node.target.id, "variable", node)
        self.emit("Assignment", node, target=node.target.id, target_qualname=self.qualified(node.target.id), value=self.text(node.value), value_type=self.value_class(node.value))
        self.visit(node.value)

    def visit_Global(self, node) -> None:
        for n in node.names:
            self.define(n, type(node).__name__.lower(), node)

    visit_Nonlocal = visit_Global

    def visit_Delete(self, node) -> None:
        for t in node.targets:
            self.visit(t)

    # Uses

    def visit_Name(self, node) -> None:
        self.emit("UseName", node, name=node.id)

    def visit_Call(self, node) -> None:
        self.visit(node.func)
        for a in [*node.args, *[k.value for k in node.keywords]]:
            self.visit(a)
        args = [self.text(a) for a in node.args] + [(f"{k.arg}=" if k.arg else "**") + self.text(k.value) for k in node.keywords]
        self.emit("CallExpression", node, callee=self.text(node.func), arguments=args)

    def visit_Attribute(self, node) -> None:
        """A name right before the dot is no use of its own."""
        self.emit("AttributeAccess", node, object=self.text(node.value), attribute=node.attr)
        if not isinstance(node.value, ast.Name):
            self.visit(node.value)

    def visit_Constant(self, node) -> None:
        self.emit("Literal", node, value=self.text(node), value_type=LITERALS.get(type(node.value), "string"))

    # Control flow

    def block(self, kind: str, node, condition: str = "") -> None:
        self.emit("ControlBlock", node, block_type=kind, condition=condition)

    def end(self, kind: str, node) -> None:
        self.emit("EndControlBlock", None, block_type=kind, line=getattr(node, "end_lineno", 0))

    def statements(self, body) -> None:
        for s in body:
            self.visit(s)

    def visit_If(self, node) -> None:
        condition = self.text(node.test)
        self.block("if", node, condition)
        self.visit(node.test)
        guard = condition == "TYPE_CHECKING"
        self.checking += guard
        self.statements(node.body)
        rest = node.orelse
        while rest:
            if len(rest) == 1 and isinstance(rest[0], ast.If) and self.lines[rest[0].lineno - 1].lstrip().startswith(b"elif"):
                self.emit("ElseBlock", rest[0], block_type="elif", condition=self.text(rest[0].test))
                self.visit(rest[0].test)
                self.statements(rest[0].body)
                rest = rest[0].orelse
            else:
                self.emit("ElseBlock", rest[0], block_type="else", condition="")
                self.statements(rest)
                rest = []
        self.checking -= guard
        self.end("if", node)

    def visit_For(self, node) -> None:
        kind = "async_for" if isinstance(node, ast.AsyncFor) else "for"
        self.block(kind, node, f"{self.text(node.target)} in {self.text(node.iter)}")
        for t in self.targets(node.target):
            if isinstance(t, ast.Name):
                self.define(t.id, "variable", t)
        self.visit(node.iter)
        self.statements(node.body)
        if node.orelse:
            self.emit("ElseBlock", node.orelse[0], block_type="else", condition="")
            self.statements(node.orelse)
        self.end(kind, node)

    visit_AsyncFor = visit_For

    def visit_While(self, node) -> None:
        self.block("while", node, self.text(node.test))
        self.visit(node.test)
        self.statements(node.body)
        if node.orelse:
            self.emit("ElseBlock", node.orelse[0], block_type="else", condition="")
            self.statements(node.orelse)
        self.end("while", node)

    def visit_With(self, node) -> None:
        kind = "async_with" if isinstance(node, ast.AsyncWith) else "with"
        self.block(kind, node, ", ".join(self.text(i.context_expr) for i in node.items))
        for i in node.items:
            for t in self.targets(i.optional_vars) if i.optional_vars is not None else []:
                if isinstance(t, ast.Name):
                    self.define(t.id, "variable", t)
            self.visit(i.context_expr)
        self.statements(node.body)
        self.end(kind, node)

    visit_AsyncWith = visit_With

    def visit_Try(self, node) -> None:
        self.block("try", node)
        self.statements(node.body)
        for h in node.handlers:
            if h.name:
                self.define(h.name, "variable", h)
            self.type_uses(h.type)
            self.statements(h.body)
        if node.orelse:
            self.emit("ElseBlock", node.orelse[0], block_type="else", condition="")
            self.statements(node.orelse)
        self.statements(node.finalbody)
        self.end("try", node)

    visit_TryStar = visit_Try

    def type_uses(self, node) -> None:
        """Every name in the types of a handler, members included."""
        if isinstance(node, ast.Attribute):
            self.type_uses(node.value)
            self.emit("UseName", node, name=node.attr)
        elif isinstance(node, ast.Name):
            self.emit("UseName", node, name=node.id)
        elif node is not None:
            for child in ast.iter_child_nodes(node):
                self.type_uses(child)

    def visit_Match(self, node) -> None:
        self.block("match", node, self.text(node.subject))
        self.visit(node.subject)
        for c in node.cases:
            self.emit("ElseBlock", c.pattern, block_type="case", condition=self.text(c.pattern))
            for n in ast.walk(c.pattern):
                if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
                    self.define(n.name, "variable", n)
                if isinstance(n, (ast.MatchValue, ast.MatchClass)):
                    self.visit(n.value if isinstance(n, ast.MatchValue) else n.cls)
            if c.guard is not None:
                self.visit(c.guard)
            self.statements(c.body)
        self.end("match", node)

    def visit_Assert(self, node) -> None:
        self.block("assert", node, self.text(node.test))
        self.generic_visit(node)
        self.end("assert", node)

    def visit_Return(self, node) -> None:
        if node.value is not None:
            self.visit(node.value)
        self.emit("Return", node, value=self.text(node.value) if node.value is not None else "", value_type=self.value_class(node.value) if node.value is not None else "none")

    def visit_Raise(self, node) -> None:
        self.generic_visit(node)
        self.emit("RaiseStatement", node, value=self.text(node.exc) if node.exc is not None else "")

    def visit_Break(self, node) -> None:
        self.emit("BreakStatement", node)

    def visit_Continue(self, node) -> None:
        self.emit("ContinueStatement", node)

    def visit_Yield(self, node) -> None:
        self.emit("YieldExpression", node, value=self.text(node.value) if node.value is not None else "", is_flag=isinstance(node, ast.YieldFrom))
        self.generic_visit(node)

    visit_YieldFrom = visit_Yield


def python_events(module: str, source: str, is_package: bool = False, self_attributes: bool = False) -> tuple[list[dict], str | None]:
    """(events, error). A text that doesn't parse gives its module scope and lines only."""
    lines = [{"kind": "SourceLine", "scope": module, "line": k, "text": t} for k, t in enumerate(source.split("\n"), 1)]
    walker = PythonEvents(module, source, is_package, self_attributes)
    try:
        return lines + walker.run(ast.parse(source)), None
    except (SyntaxError, ValueError, RecursionError) as e:
        bare = PythonEvents(module, source, is_package)
        return lines + bare.run(ast.Module(body=[], type_ignores=[])), str(e)
