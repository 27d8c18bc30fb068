"""Live analysis over restarts, clients, aliases of imports, the command line, inference through constructors."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deploom.__main__ import main
from deploom.api import Project
from deploom.functions import ids as I
from deploom.functions import storage
from deploom.operators import flow, resolve, traverse, view
from deploom.plans import sample
from deploom.sources import parse, scan
from deploom.streaming import live
from deploom.streaming.clients import Clients

FIRST, SECOND = "def f():\n    return g()\n\ndef g():\n    return 1\n", "def f():\n    return h()\n\ndef h():\n    return 1\n"


def found(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def change(folder, n, path, second):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text(json.dumps({"path": path, "event_type": "modified", "ts": f"2024-01-01T00:00:{second:02d}Z", "seq": n}) + "\n")


def test_live_restart_watch_debounce(spark, tmp_path):
    src, log = tmp_path / "src", tmp_path / "log"
    src.mkdir()
    (src / "app.py").write_text(FIRST)

    def read(changed):
        return scan.scan(spark, str(src)).join(changed.select(F.col("path").alias("rel_path")), "rel_path", "left_semi")

    def follow(graph, **more):
        q = graph.follow(live.change_stream(spark, str(log)), str(tmp_path / "cp"), extensions=[".py"], availableNow=True, **more)
        q.awaitTermination(120)
        assert q.exception() is None

    graph = live.LiveGraph(spark, str(tmp_path / "snapshots"), read, keep=2)
    graph.start(scan.scan(spark, str(src)))
    (src / "app.py").write_text(SECOND)
    change(log, 1, "app.py", 1)
    change(log, 2, "node_modules/x.py", 1)
    change(log, 3, "notes.md", 1)
    follow(graph, gap="2 seconds")
    assert graph.version == 0  # the session is open
    change(log, 4, "gone.py", 30)
    follow(graph, gap="2 seconds")
    assert graph.version == 1
    status = {k: v for k, v in found(graph.view()[0], "id", "change_status") if v}
    assert status == {"app": "modified", "app.f": "modified", "app.g": "deleted", "app.h": "added"}

    # A new process goes on from the last version; a batch that is in the log changes nothing.
    again = live.LiveGraph(spark, str(tmp_path / "snapshots"), read, keep=2)
    assert again.version == 1
    (_, batch, source) = max(again.log())
    again.step(spark.createDataFrame([("app.py", "modified", None, 9)], live.CHANGES), batch, source)
    assert again.version == 1
    again.step(spark.createDataFrame([("app.py", "deleted", None, 9)], live.CHANGES), batch + 1, source)
    assert again.version == 2 and {r[0] for r in found(again.load("nodes"), "id")} == set()
    assert sorted(v for v, _, _ in again.log()) == [1, 2]  # the first was dropped


def test_clients(spark, tmp_path):
    files = lambda text: spark.createDataFrame([("app.py", "python", "app", text)], "rel_path string, lang string, module string, source string")
    graph = live.LiveGraph(spark, str(tmp_path / "s"), lambda changed: files(SECOND))
    clients, got = Clients(graph), []

    def broken(text):
        raise OSError("gone")

    clients.connect(got.append)
    clients.connect(broken)
    assert got == []
    graph.start(files(FIRST))
    assert len(got) == 1 and len(clients.connected) == 1 and json.loads(got[0])["type"] == "graph_update"
    graph.step(spark.createDataFrame([("app.py", "modified", None, 1)], live.CHANGES))
    clients.receive('{"type": "ping"}', got.append)
    assert json.loads(got[-1]) == {"type": "pong"}
    clients.receive('{"action": "dismiss_change", "data": {"node_id": "app.h"}}', got.append)
    assert "app.h" not in {r[0] for r in found(graph.load("statuses"), "id")}
    clients.receive('{"action": "dismiss_all_changes"}', got.append)
    assert graph.load("statuses").isEmpty()
    n = len(got)
    clients.receive('{"type": "request_graph"}', got.append)
    for text in ("", "[]", "{", '{"type": 1}', '{"action": "dismiss_change"}'):
        clients.receive(text, got.append)
    assert len(got) == n + 1
    told = []
    clients.connect(told.append, by_folder=True)
    clients.receive('{"type": "request_graph"}', told.append)
    assert len(told) == 2 and told[0] == told[1]
    parts = sorted(Path(json.loads(told[0])["folder"]).glob("part-*"))
    assert json.loads("".join(x.read_text() for x in parts)) == json.loads(clients.document())["data"]
    clients.connected.remove(told.append)


def test_import_aliases(spark, tmp_path):
    web, shared = tmp_path / "web", tmp_path / "shared"
    (web / "src").mkdir(parents=True)
    shared.mkdir()
    paths = {"@": ["./no"], "@app/*": ["./src/*"], "~/*": ["../shared/*"], "store": ["src/store.ts"]}
    (web / "tsconfig.json").write_text(json.dumps({"compilerOptions": {"paths": paths}}))
    (shared / "package.json").write_text("{}")
    (shared / "tools.ts").write_text("export const cut = (a) => { return a };\n")
    (web / "src" / "store.ts").write_text("export const save = (a) => { return a };\n")
    (web / "src" / "main.ts").write_text("import { save } from '@app/store';\nimport { cut } from '~/tools';\nimport { x } from 'store';\nimport { y } from '@other/lib';\nexport const go = () => { save(1); cut(2) };\n")
    files = scan.scan(spark, str(tmp_path))
    events = parse.events_of(files)
    assert [r[0] for r in events.where("kind = 'ImportStatement'").orderBy("seq").select("module").collect()] == ["web.src.store", "shared.tools", "web.src.store", "@other.lib"]
    edges = found(resolve.build(events)[1], "caller", "type", "callee")
    assert ("web.src.main.go", "calls", "web.src.store.save") in edges and ("web.src.main.go", "calls", "shared.tools.cut") in edges


def test_scan_one_update_fingerprint(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    with pytest.raises(ValueError, match="Unsupported language"):
        scan.open_file(spark, str(tmp_path), "a.txt")
    assert found(scan.open_file(spark, str(tmp_path), "a.py"), "rel_path", "module") == {("a.py", "a")}
    before = storage.written(scan.scan(spark, str(tmp_path)))
    events = storage.written(parse.events_of(before))
    (tmp_path / "a.py").write_text("z = 1\n")
    after = scan.scan(spark, str(tmp_path))
    got = parse.updated_events(events, after, before.select("path", "source_hash"))
    assert found(got.where("kind = 'DefineName'"), "qualname") == {("a.z",), ("b.y",)}
    one = lambda *a, **k: scan.fingerprint(*a, **k).first()[0]
    assert one(before) == one(before.repartition(3)) != one(before, more="x") and one(before) != one(before.withColumn("mtime_ns", F.col("mtime_ns") + 1))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "app.py").write_text(sample.PYTHON)
    out = tmp_path / "graph.json"
    main(["analyze", str(tmp_path / "p"), "--select", "app.main*", "-o", str(out)], spark)
    assert "app.main" in out.read_text() and "nodes" in json.loads(out.read_text())
    main(["analyze", str(tmp_path / "p"), "--edges-only"], spark)
    assert all(e["caller"].startswith("app") for e in json.loads(capsys.readouterr().out))
    main(["catalog", str(tmp_path / "p"), "app.main*"], spark)
    assert capsys.readouterr().out == "app.main\tfunction\napp.main.w\tassignment\n2 items\n"
    main(["stats", str(tmp_path / "p")], spark)
    assert "type\tclass\t2" in capsys.readouterr().out


def test_cache_is_used(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "app.py").write_text("x = 1\n")
    cache = str(tmp_path / "cache")
    first = Project(spark, str(tmp_path / "p"), cache=cache)
    second = Project(spark, str(tmp_path / "p"), cache=cache)
    assert first.nodes.inputFiles() == second.nodes.inputFiles()


def test_types_through_constructors(spark):
    source = "class Engine:\n    def start(self): pass\n\nclass Car:\n    def __init__(self, engine):\n        self.engine = engine\n    def go(self, engine):\n        self.engine.start()\n\ndef build():\n    e = Engine()\n    c = Car(e)\n    c.go(e)\n"
    files = spark.createDataFrame([("m.py", "python", "m", source)], "rel_path string, lang string, module string, source string")
    plain = found(resolve.build(parse.events_of(files))[1], "caller", "type", "callee")
    assert ("m.Car.go", "calls", "m.Engine.start") not in plain and ("m.build", "calls", "m.Car.go") in plain
    from deploom.sources.python_events import python_events

    known = parse.events_of(files, {"python": lambda module, text, rel: python_events(module, text, False, True)})
    assert ("m.Car.go", "calls", "m.Engine.start") in found(resolve.build(known)[1], "caller", "type", "callee")


def test_flow_references(spark):
    nodes = spark.createDataFrame([("m.f", "1", "call", "A()", "A"), ("m.f", "2", "call", "g(1)", "g"), ("m.f", "3", "return", "r", None), ("m.f", "4", "call", "B()", "B")], "owner string, id string, type string, text string, callee_text string")
    defs = spark.createDataFrame([("m.f", "function"), ("m.A", "class"), ("m.A.__init__", "function"), ("m.g", "function"), ("m.B", "class")], "id string, object_type string")
    none = spark.createDataFrame([], "key string, value string")
    names = resolve.Names(defs, none, spark.createDataFrame([("m",)], "name string"))
    assert found(resolve.flow_references(nodes, names), "id", "references") == {("1", "m.A.__init__"), ("2", "m.g"), ("3", None), ("4", "m.B")}
    attached = flow.attach(defs, nodes, spark.createDataFrame([("m.f", "1", "2", "flow")], "owner string, from string, to string, type string"))
    assert {r["id"]: (len(r["pdg"]["nodes"]), len(r["pdg"]["edges"])) for r in attached.collect() if r["pdg"]} == {"m.f": (4, 1)}


def test_components_by_brute_force(spark):
    import random

    rng = random.Random(3)
    ids = [f"n{k:03d}" for k in range(150)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)] + [(ids[k], ids[k + 1]) for k in range(100, 140)] + [(None, "n001"), ("n001", "absent")]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a in root and b in root:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "caller string, callee string, type string")
    assert dict(found(traverse.all_components(nodes, edges), "id", "component")) == {i: top(i) for i in ids}
    assert traverse.all_components(nodes.where("false"), edges).count() == 0


def test_hash_stale_and_depth(spark):
    texts = [b"", b"a", *[bytes([k]) * (k * 7) for k in range(40)], "éx".encode()]

    def plain(t):
        h = 0xCBF29CE484222325
        for b in t:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    assert I.fnv1a_all(texts) == [plain(t) for t in texts] and I.fnv1a_all([]) == []
    saved = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    assert found(view.prune_stale(saved, saved.where("id = 'a'").select("id")), "id") == {("a",)}
    df = spark.createDataFrame([("a.b", "a.b"), ("a", "a.b.c"), ("x.y", "a.y"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(I.common_depth(F.col("a"), F.col("b"))).collect()][:3] == [2, 1, 0]
