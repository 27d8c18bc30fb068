"""Files that are parsed by their shape, against the parser on each text."""

import random

import pytest

from deploom.operators import flow
from deploom.plans import projected_sources
from deploom.sources import parse
from deploom.sources.python_events import python_events
from deploom.sources.shapes import Shapes, line_parts

TEXTS = [
    "def {a}(x, {b}=1):\n    return {b} + x  # {c}\n{a}({n}, '{c}')\n",
    '"""About {a} {n}."""\nimport {a}.{b} as {c}\nfrom ..{b} import {a}, {c} as {b}\nclass {c}({a}.{b}):\n    {a} = {n}\n    {b}, {a} = {n}, 2.5\n',
    "if {a} or {b}:\n    {c} = lambda y: {a}(y)\nelif {a} == {n}:\n    {c} = [{a} for {b} in {c} if {b}]\nprint({a}, {b}, {a}); {a}.{b}({c}={n}, *{a})\n",
    "{a} = f'{{{b}!r:>{n}}} {{{c}}}'\n{b} = b'{a}' + r'{c}\\d' ; é = {a}\nmatch {a}:\n    case {{'{b}': {c}}}:\n        {c} = {n}\n",
    "def {a}(:\n", "{a} = {n}1j + 0{n} if {b} else {n}e5\n", "while {a}: {b} -= {n}; break\n\t\nx = '''\n{a}  {b}\n'''\n",
    "with {a} as {b}, {b}: assert {c}, {n}\n{a}: {b} = {c}\nglobal_{a} = {{{n}: {a}, **{b}}}\n",
]


def files():
    """Texts of a few shapes with words that repeat, are keywords, or look like something else."""
    rng = random.Random(5)
    words = ["a", "bb", "ccc", "self", "None", "TYPE_CHECKING", "null", "match", "f", "b", "_", "__name__", "e5", "x1", "Zq7w000001w"]
    out = []
    for k in range(6000):
        one = {c: rng.choice(words[:3] * 12 + words) for c in "abc"} | {"n": rng.choice([0, 1, 7, 10, 12345, 99, 5, 6, 73184000001, "007", "1_0"])}
        module = rng.choice(["m", "pack.m", "a.bb.ccc", f"m{k}"])
        out.append((k, module, rng.choice(TEXTS).format(**one), f"{module.replace('.', '/')}/__init__.py" if k % 5 == 0 else f"{module}.py"))
    return out


DERIVED = {
    "events": (lambda events: [e | {"seq": k} for k, e in enumerate(events)], [c for c in parse.COLUMNS if c[0] not in parse.OF_FILE]),
    "definitions": (parse.definition_rows, parse.DEFINITION[1:]),
    "bindings": (parse.binding_rows, parse.BINDING[1:]),
    "flow": (lambda events: flow.fold([dict.fromkeys(flow.USED) | e for e in events if e["kind"] in flow.KINDS])[0], [tuple(c.split(" ")) for c in flow.NODES.split(", ")]),
}


@pytest.mark.parametrize("name", DERIVED)
def test_shapes_give_what_the_parser_gives(name):
    derive, fields = DERIVED[name]

    def rows_of(module, source, path):
        events, error = python_events(module, source, path.endswith("__init__.py"))
        return derive(events), error

    plain = lambda v, kind: list(v.items()) if kind.startswith("map") and v is not None else v
    want = {k: [tuple(plain(r.get(n), t) for n, t in fields) for r in rows_of(m, s, p)[0]] for k, m, s, p in files()}
    got, by_shape = {}, 0
    for kind, tag, *more in Shapes(rows_of, fields, parse.ARROW, frozenset(["uses"])).of_files(iter(files())):
        if kind == "rows":
            got[tag] = [tuple(plain(r.get(n), t) for n, t in fields) for r in more[0]]
        else:
            rows, by_shape = list(zip(*(c.to_pylist() for c in more[0]), strict=True)), by_shape + len(tag)
            size = len(rows) // len(tag)
            got |= {k: rows[j * size : (j + 1) * size] for j, k in enumerate(tag)}
    assert by_shape > 500
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_words_of_a_line():
    assert line_parts("x1 = self.f(10) + b'no' if 1.5 else 007") == ("\0n = self.\0n(\0d) + b'\0n' if \0d.\0d else 007", ("x1", "f", "10", "no", "1", "5"))
    assert line_parts("é = a") == ("é = a", ()) and line_parts("a = '\\n1'") == ("a = '\\n1'", ())


def test_files_of_one_shape_are_parsed_once(monkeypatch):
    """Thousands of files of one shape need few parses."""
    parsed = []

    def rows_of(module, source, path):
        parsed.append(path)
        return python_events(module, source)

    item = "".join(x + "\n" for x in projected_sources.ITEM)
    texts = ((k, f"o{k}", item.replace("{ln}", "0").replace("{sk}", str(k)).replace("{qty}", str(k % 50)), f"o{k}.py") for k in range(1, 3001))
    n = sum(len(x[1]) if x[0] == "columns" else 1 for x in Shapes(rows_of, [("name", "string")], parse.ARROW).of_files(texts))
    assert n == 3000 and len(parsed) <= 4


@pytest.mark.parametrize("name", ["source_definitions", "source_uses", "source_imports", "source_bindings", "source_flow_nodes", "source_scopes"])
def test_only_tables_are_shuffled(spark, name):
    """A file is one task's: after the parser nothing is exchanged or sorted."""
    from helpers import DATA

    from deploom import registry

    plan = registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert not any(x in above for x in ("Aggregate", "Window", "Sort", "Join", "Repartition")) and "Scan" not in above


def test_scopes_of_all_items(spark):
    """source_scopes takes every item, whatever its flag."""
    from helpers import DATA

    from deploom import registry

    items = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").count()
    assert registry.QUERIES["source_scopes"](spark, f"{DATA}/sf0.001").where("file like 'o%' and scope_type = 'function'").count() == items
    assert "l_returnflag" not in registry.ORACLE_SQL["source_scopes"] and "l_returnflag" in registry.ORACLE_SQL["source_uses"]
