"""Selection, parsing, resolution, flow graphs, live analysis."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from deploom.api import Project, to_json
from deploom.functions import ids as I
from deploom.functions.glob import to_regex
from deploom.operators import changes, finalize, flow, resolve, selector, view
from deploom.plans import sample
from deploom.sources import parse, scan
from deploom.sources.javascript_events import javascript_events
from deploom.sources.parse import PARSERS, events_of
from deploom.sources.python_events import python_events
from deploom.sources.rust_events import rust_events
from deploom.streaming import live

@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    (top / "app.py").write_text(sample.PYTHON)
    return Project(spark, str(top))


def found(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_edges_of_the_sample(project):
    want = {e for e in sample.EDGES if e[0].partition(".")[0] == "app"}
    assert found(project.edges, "caller", "type", "callee") == want


def test_nodes_of_the_sample(project):
    kinds = dict(found(project.nodes, "id", "object_type"))
    assert kinds["app"] == kinds["math"] == kinds["print"] == "module"
    assert kinds["app.Wagon"] == "class" and kinds["app.Wagon.go"] == "function" and kinds["app.assemble.m"] == "assignment" and kinds["math.sqrt"] == "unknown"
    origins = dict(found(project.nodes, "id", "origin"))
    assert origins["app"] is None and origins["math"] == origins["math.sqrt"] == "standard" and origins["Motor"] == "third-party"
    code = dict(found(project.nodes, "id", "code_block"))
    assert code["app.Motor.run"] == '    def run(self):\n        print("on")'


def test_front(project, spark):
    nodes, edges = project.graph("1+app.main")
    assert "app.assemble" in {r[0] for r in found(nodes, "id")} and "math" not in {r[0] for r in found(nodes, "id")}
    data = json.loads(to_json(project.nodes, project.edges))
    assert data["metadata"]["edge_count"] == project.edges.count() and any(n["id"] == "app" and n["children"] for n in data["nodes"])
    assert {r[0] for r in found(project.catalog(["app.main*"]), "id")} == {"app.main", "app.main.w"}
    assert dict(((m, k), n) for m, k, n in project.stats().collect())[("type", "class")] == 2
    n, e = project.flow()
    assert {r[0] for r in found(n.where("owner = 'app.Wagon.go'"), "type")} == {"condition", "call", "block"}


def test_imports_reexports_and_types(spark, tmp_path):
    (tmp_path / "pkg" / "sub").mkdir(parents=True)
    (tmp_path / "pkg" / "__init__.py").write_text("from .core import Engine as Motor\n")
    (tmp_path / "pkg" / "core.py").write_text("class Engine:\n    def start(self): pass\n")
    (tmp_path / "pkg" / "sub" / "__init__.py").write_text("")
    (tmp_path / "pkg" / "sub" / "use.py").write_text("from .. import Motor\nimport os.path as p\n\ndef f(x):\n    e = Motor()\n    e.start()\n    return p.join(x)\n")
    (tmp_path / "bad.py").write_text("def (:\n")
    files = scan.scan(spark, str(tmp_path))
    assert dict(found(files, "rel_path", "module")) == {"pkg/__init__.py": "pkg", "pkg/core.py": "pkg.core", "pkg/sub/__init__.py": "pkg.sub", "pkg/sub/use.py": "pkg.sub.use", "bad.py": "bad"}
    nodes, edges = resolve.build(events_of(files))
    got = found(edges, "caller", "type", "callee")
    assert ("pkg.sub.use.f.e", "has-a", "pkg.core.Engine") in got
    assert ("pkg.sub.use.f", "calls", "pkg.core.Engine.start") in got
    assert ("pkg.sub.use.f", "calls", "os.path.join") in got
    assert ("pkg.sub.use", "imports", "pkg.core.Engine") in got
    assert "bad" in {r[0] for r in found(nodes, "id")}
    again = resolve.build(events_of(files.repartition(3)))[1]
    assert found(again, "caller", "type", "callee") == got


def kinds(events, *names):
    return [e for e in events if e["kind"] in names]


def test_python_events():
    source = "from . import a\nfrom ..b import c as d\nasync def f(x: T, *y, z=1, **k):\n    if (n := x):\n        return [i for i in y]\n    match x:\n        case 1: pass\n    async with q() as r:\n        r.s()\n"
    events, error = python_events("p.q.m", source)
    assert error is None
    assert [e["module"] for e in kinds(events, "ImportStatement")] == ["p.q", "p.b"]
    assert next(e for e in kinds(events, "EnterScope") if e["name"] == "f")["parameters"] == ["x", "*y", "z", "**k"]
    assert [e["block_type"] for e in kinds(events, "ControlBlock")] == ["if", "match", "async_with"] and len(kinds(events, "EndControlBlock")) == 3
    assert {e["name"] for e in kinds(events, "DefineName")} == {"f", "n", "r"}


def test_javascript_events():
    source = "import R, {useState as u} from 'react';\nexport {x} from './x';\nexport const f = (a, {b}) => { if (a) { g(b) } else { return new W(a) } };\nclass A extends B.C { m(p) { this.f(p) } }\ninterface I { k: T }\nconst {p, q: [r]} = h();\n"
    events, error = javascript_events("pkg.main", source, "main.ts")
    assert error is None
    assert [(e["module"], e["names"]) for e in kinds(events, "ImportStatement")] == [("react", ["R", "useState"]), ("pkg.x", ["x"])]
    assert [e["callee"] for e in kinds(events, "CallExpression")] == ["g", "W", "self.f", "h"]
    assert {e["name"] for e in kinds(events, "DefineName")} == {"f", "A", "m", "I", "k", "p", "r"}
    assert next(e for e in kinds(events, "EnterScope") if e["name"] == "A")["bases"] == ["B.C"]
    assert javascript_events("m", "function (((", "m.js")[0]


def test_rust_events():
    source = "use std::{fs, io::Read as R};\nuse super::a::*;\nstruct S { x: T }\nimpl Tr for S { fn go(&self, n: u8) -> u8 { let v = S::new(n)?; match n { 0 => v.a(), _ => b() } } }\n"
    events, error = rust_events("k.m", source, "m.rs")
    assert error is None
    assert [(e["module"], e["names"]) for e in kinds(events, "ImportStatement")] == [("std", ["fs"]), ("std.io", ["Read"]), ("k.a", ["*"])]
    assert [e["callee"] for e in kinds(events, "CallExpression")] == ["S.new", "v.a", "b"]
    assert [e.get("bases") for e in kinds(events, "EnterScope") if e["scope_type"] == "Class"] == [None, ["Tr"]]
    assert next(e for e in kinds(events, "EnterScope") if e["name"] == "go")["parameters"] == ["n"]


def test_mixed_languages(spark):
    files = spark.createDataFrame([("a.py", "python", "a", "x = f()"), ("b.ts", "typescript", "b", "let y = 1"), ("c.rs", "rust", "c", "fn z() {}"), ("d.go", "go", "d", "x"), ("e.py", "python", "e", None)], "rel_path string, lang string, module string, source string")
    events = events_of(files)
    assert {r[0] for r in found(events.where("kind = 'DefineName'"), "qualname")} == {"a.x", "b.y", "c", "c.z"}
    assert set(PARSERS) == {"python", "javascript", "typescript", "tsx", "rust"}


def test_flow_graph():
    source = "def f(a):\n    for i in a:\n        if i:\n            break\n        g(1)\n    return a\n"
    events = [{**dict.fromkeys(flow.USED), **e} for e in python_events("m", source)[0]]
    nodes, edges = flow.fold(events)
    text = {n["id"]: n["text"] for n in nodes}
    assert {(text[e["from"]], text[e["to"]], e["type"]) for e in edges} == {
        ("a", "i in a", "flow"), ("i in a", "i", "true_branch"), ("i", "break", "true_branch"), ("i", "g(1)", "false_branch"), ("1", "g(1)", "data"),
        ("g(1)", "i in a", "back_edge"), ("i in a", "return a", "false_branch"), ("break", "return a", "flow"),
    }


def test_flow_queries(spark):
    nodes = spark.createDataFrame([("f", "f1", "call", "g()", "g", None), ("f", "f2", "return", "r", None, "b"), ("f", "b", "block", "true", None, None), ("g", "g1", "call", "f()", "f", None)], "owner string, id string, type string, text string, references string, block_id string")
    edges = spark.createDataFrame([("f", "f1", "f2", "flow"), ("f", "f1", "gone", "flow")], "owner string, from string, to string, type string")
    n, e = flow.inline(nodes, edges, "f")
    assert {r[0] for r in found(n, "id")} == {"f1", "f2", "b", "f1::g1"}
    assert found(flow.nested_edges(nodes, edges.where("to = 'f2'")), "from", "to") == {("f1", "b")}
    assert {r[0] for r in found(flow.reachable(edges, "f2"), "id")} == {"f1", "f2"}
    assert flow.labelled_edges(nodes, edges).count() == 1 and flow.visible_edges(edges, ["data"]).count() == 0


def test_tokens():
    T = selector.Token
    assert selector.parse("@a, 2+b*, +c, d+, e+3, 1+f+, , 0+g") == [T("a", True), T("b*", False, 2, 0), T("c", False, None, 0), T("d", False, 0, None), T("e", False, 0, 3), T("f", False, 1, None), T("g", False, 0, 0)]


def test_globs():
    import fnmatch
    import re

    for pattern in ("a.*", "a.?[bc]", "[!x]*", "a+b", "a[", "*.[]]", "a^b$"):
        for text in ("a.b", "a.bc", "a.xb", "xa", "a+b", "a[", "q.]", "a^b$", "a\nb"):
            mine = re.fullmatch(to_regex(pattern)[6:-2], text, re.S) is not None
            assert mine == fnmatch.fnmatchcase(text, pattern), (pattern, text)


def test_closure_by_brute_force(spark):
    rng = random.Random(5)
    ids = sorted({".".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    ids = sorted({".".join(i.split(".")[: k + 1]) for i in ids for k in range(i.count(".") + 1)})
    chosen = set(rng.sample(ids, 5))
    up = {".".join(i.split(".")[:k]) for i in chosen for k in range(1, i.count(".") + 1)}
    seen, queue = chosen | up, list(chosen)
    while queue:
        x = queue.pop()
        for child in ids:
            if child.rpartition(".")[0] == x and child not in seen:
                seen.add(child)
                queue.append(child)
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    from deploom.operators.traverse import context_closure

    assert {r[0] for r in found(context_closure(nodes.where(F.col("id").isin(list(chosen))), nodes), "id")} == seen


def test_empty_and_null_inputs(spark):
    nodes = spark.createDataFrame([], "id string, object_type string, origin string")
    edges = spark.createDataFrame([("a", None, "calls"), (None, "b", "calls"), ("a", "a", None)], "caller string, callee string, type string")
    assert selector.selected_ids(nodes, edges, "+*").count() == 0
    assert finalize.drop_general_has_a(edges).count() == 3
    assert view.roll_up(edges, 1).count() == 0
    assert changes.edge_diff(edges, edges).where("caller is not null and callee is not null").count() == 0


def test_ids(spark):
    df = spark.createDataFrame([("a.b.c", "a.b.d.e"), ("x", "y")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(I.depth(a), I.parent(a), I.last(a), I.common_depth(a, b), I.lift(b, F.lit(2)), I.fnv1a(F.lit(""))).collect()] == [(3, "a.b", "c", 2, "a.b", "cbf29ce484222325"), (1, None, "x", 0, "y", "cbf29ce484222325")]
    assert [r[0] for r in df.select(I.ancestors(a)).collect()] == [["a", "a.b"], []]


def test_helpers(spark):
    got = spark.createDataFrame([("Car(eng)",), ("Engine()",), ("math.sqrt(25)",), ("Graph.new(a, b)",)], "t string").select(resolve.callable_of(F.col("t")), resolve.arguments_of(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("Car", ["eng"]), ("Engine", []), ("math.sqrt", ["25"]), ("Graph", ["a", "b"])]
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    ids = spark.createDataFrame([("mine.app",), ("os.path",), ("requests",)], "id string")
    assert dict(found(finalize.classify_origin(ids, one("os", "math"), one("mine")), "id", "origin")) == {"mine.app": "local", "os.path": "standard", "requests": "third-party"}


def test_config(tmp_path):
    (tmp_path / "deploom.yml").write_text("analysis:\n  extensions: ['.py']\n  exclude_patterns: ['t/*']\n")
    for p in ("a.py", "b.js", "t/c.py", ".hidden/d.py", "venv/e.py"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("")
    assert scan.find_files(str(tmp_path), scan.load_config(str(tmp_path))) == ["a.py"]


def test_live(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "app.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")

    def read(changed):
        return scan.scan(spark, str(src)).join(changed.select(F.col("path").alias("rel_path")), "rel_path", "left_semi")

    graph = live.LiveGraph(spark, str(tmp_path / "snapshots"), read)
    graph.start(scan.scan(spark, str(src)))
    (src / "app.py").write_text("def f():\n    return h()\n\ndef h():\n    return 1\n")
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"path": "app.py", "event_type": "modified", "ts": "2024-01-01T00:00:00Z", "seq": 1}\n')
    q = graph.follow(live.change_stream(spark, str(log)), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    assert q.exception() is None
    nodes, edges = graph.view()
    status = {k: (v, g) for k, v, g in nodes.select("id", "change_status", "is_ghost").collect() if v}
    assert status == {"app": ("modified", False), "app.f": ("modified", False), "app.g": ("deleted", True), "app.h": ("added", False)}
    assert ("app.f", "app.g", "deleted") in found(edges, "caller", "callee", "change_status")
    graph.dismiss("app.g")
    assert "app.g" not in {r[0] for r in found(graph.load("statuses"), "id")}
    shutil.rmtree(tmp_path / "snapshots")


def test_relations_read_the_files_once(spark):
    """A relation is made in one pass of the parser, asks it for its own kinds and columns only, and many small files leave as one batch."""
    rows = [(f"f{k}.py", "python", f"f{k}", f"import json\nx: int = {k}\ndef g(a):\n    return json.dumps(a)\n") for k in range(300)]
    files = spark.createDataFrame(rows, "rel_path string, lang string, module string, source string").coalesce(1)
    whole = parse.events_of(files)
    for name, (kinds, fields) in parse.NEEDED.items():
        part = parse.events_for(files, name)
        assert set(part.columns) == set(fields) and {r.kind for r in part.select("kind").distinct().collect()} <= set(kinds)
        if name != "values":
            make = getattr(parse, name)
            plan = make(part)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MapInArrow") == 1
            assert sorted(map(str, make(part).collect())) == sorted(map(str, make(whole).collect())) != []

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.num_rows]})

    assert parse.events_for(files, "uses").mapInArrow(sizes, "n long").count() <= 10
