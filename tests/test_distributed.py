"""Operators over ranges, deltas, streams and indexes against plain Python."""

import datetime as dt
import fnmatch
import json
import os
import random
import re

import pytest
from helpers import DATA

from deploom import registry
from deploom.functions import storage
from deploom.operators import changes, document, filters, finalize, incremental, intervals, resolve, search, selector, traverse, types, view
from deploom.plans import synth
from deploom.streaming import status

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("parts", [1, 7])
def test_global_sessions(spark, parts):
    rng = random.Random(parts)
    at = 0
    times = []
    for _ in range(400):
        at += rng.choice([0, 1, 1, 2, 9, 10, 11, 40])
        times.append(at)
    times += [5000 + k for k in range(300)] + [9000] * 300  # a run over several ranges, and one time of many events
    rows = [(START + dt.timedelta(seconds=t), 1) for t in rng.sample(times, len(times))] + [(None, 1)] * 3
    got = {tuple(r) for r in changes.global_sessions(spark.createDataFrame(rows, "at timestamp, n int"), "at", "10 seconds", parts).collect()}
    want, run = set(), []
    for t in sorted(times) + [10**9]:
        if run and t - run[-1] >= 10:
            want.add((START + dt.timedelta(seconds=run[0]), START + dt.timedelta(seconds=run[-1]), len(run)))
            run = []
        run.append(t)
    assert got == want
    assert changes.global_sessions(spark.createDataFrame([], "at timestamp"), "at", "10 seconds").count() == 0


@pytest.mark.parametrize("hops", [0, 1, 5, 20])
def test_chains(spark, hops):
    pairs = {f"a{k}": f"a{k + 1}" for k in range(40)} | {f"c{k}": f"c{(k + 1) % 6}" for k in range(6)} | {"to_c": "c3", "self": "self", "to_self": "self", "one": "end", "d0": "d1", "d1": "d0"}

    def end(key):
        value = pairs[key]
        for _ in range(hops):
            if pairs.get(value, value) == value:
                break
            value = pairs[value]
        return value

    df = spark.createDataFrame(list(pairs.items()), "key string, value string")
    assert {r.key: r.value for r in resolve.follow_chains(df, hops).collect()} == {k: end(k) for k in pairs}
    short = df.where("key like 'a3%' or key in ('one', 'self')")
    assert {r.key: r.value for r in resolve.follow_chains(short).collect()} == {"a3": "a4", "one": "end", "self": "self"} | {f"a{k}": "a40" for k in range(30, 40)}


def test_types_to_a_fixpoint(spark):
    rng = random.Random(4)
    for n_facts, n_flows in ((6, 60), (20, 30), (3, 0)):
        facts = [(f"v{rng.randrange(40)}", f"T{rng.randrange(3)}") for _ in range(n_facts)]
        flows = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(n_flows)]
        held = {}
        for node, t in facts:
            held.setdefault(node, set()).add(t)
        grown = True
        while grown:
            grown = False
            for a, b in flows:
                new = held.get(a, set()) - held.get(b, set())
                if new:
                    held.setdefault(b, set()).update(new)
                    grown = True
        f = spark.createDataFrame([*facts, (None, "T1"), ("v1", None)], "node string, type string")
        got = types.types_to_fixpoint(f, spark.createDataFrame([*flows, (None, "v1"), ("v1", None)], "src string, dst string"))
        assert {r.node: r.type for r in got.collect()} == {k: min(v) for k, v in held.items() if len(v) == 1}


def test_chained_types_of_sources(spark):
    """A factory that calls a factory: its type is known with chained_types alone."""
    from deploom.sources.parse import events_of

    text = "class Car:\n    pass\n\ndef make():\n    c = Car()\n    return c\n\ndef sell():\n    return make()\n\ndef both():\n    x = sell()\n    return x\n\nmine = both()\n"
    files = spark.createDataFrame([("app.py", "app.py", "python", "app", text)], "path string, rel_path string, lang string, module string, source string")
    files = files.selectExpr("*", "cast(map() as map<string,string>) as aliases", "xxhash64(source) as source_hash", "0L as mtime_ns", "cast(null as string) as error")
    has = lambda **o: {(r.caller, r.callee) for r in resolve.build(events_of(files), **o)[1].where("type = 'has-a'").collect()}
    assert ("app.mine", "app.Car") in has(chained_types=True) and ("app.both.x", "app.Car") in has(chained_types=True)
    assert not {e for e in has() if e[0] == "app.mine"}


def resolved(defs, refs):
    """Edges of all files at once, by the innermost enclosing definition."""
    ids = {i for rows in defs.values() for i, _ in rows}
    out = set()
    for file, rows in refs.items():
        for scope, name in rows:
            parts = scope.split(".")
            hit = next((k for k in (".".join([*parts[:n], name]) for n in range(len(parts), 0, -1)) if k in ids), None)
            if hit:
                out.add((file, scope, name, hit))
    return out


def test_incremental_graph(spark, tmp_path):
    """Every step equals a full rebuild, writes only buckets that the change concerns, and may be repeated."""
    rng = random.Random(8)
    graph = incremental.NameGraph(spark, f"{tmp_path}/g", 8).create()
    defs, refs = {}, {}

    def change(files):
        for f in files:
            defs[f] = {(f"p.{rng.choice('ab')}.x{rng.randrange(6)}", "class") for _ in range(rng.randrange(3))} | {(f"p.y{rng.randrange(6)}", "function") for _ in range(rng.randrange(2))}
            refs[f] = {(f"p.{rng.choice('ab')}.f{rng.randrange(3)}", f"{rng.choice('xy')}{rng.randrange(6)}") for _ in range(rng.randrange(5))}
            if rng.random() < 0.2:  # the file is gone
                defs.pop(f), refs.pop(f)
        d = spark.createDataFrame([(f, *r) for f, rows in defs.items() for r in rows], "file string, id string, object_type string")
        r = spark.createDataFrame([(f, *r) for f, rows in refs.items() for r in rows], "file string, scope string, name string")
        graph.apply(spark.createDataFrame([(f,) for f in files], "file string"), d, r)
        return d, r

    edges = lambda: {tuple(r) for r in graph.load("edges").select("file", "caller", "name", "callee").collect()}
    change([f"f{k}" for k in range(12)])
    assert edges() == resolved(defs, refs) and edges()
    for step in (["f3"], ["f1", "f40"], ["f3", "f5"]):
        d, r = change(step)
        assert edges() == resolved(defs, refs)
        assert graph.touched["defs"] <= len(step) and graph.touched["refs"] <= len(step)
    graph.apply(spark.createDataFrame([("f3",), ("f5",)], "file string"), d, r)
    assert edges() == resolved(defs, refs)
    # A file that concerns no other leaves the files of other buckets as they are.
    listed = lambda: {os.path.join(a, x) for a, _, c in os.walk(f"{tmp_path}/g/edges") for x in c if x.endswith(".parquet")}
    before = listed()
    defs["lone"], refs["lone"] = {("q.z", "class")}, {("q.f", "z")}
    change_of = spark.createDataFrame([("lone",)], "file string")
    graph.apply(change_of, spark.createDataFrame([("lone", "q.z", "class")], "file string, id string, object_type string"), spark.createDataFrame([("lone", "q.f", "z")], "file string, scope string, name string"))
    assert edges() == resolved(defs, refs) and len({os.path.dirname(x) for x in before - listed()}) <= 1


def plain_statuses(rows):
    nodes = {}
    for i, _, _, kind, h in sorted(rows, key=lambda r: (r[1], r[2])):
        nodes[i] = status.apply_one(nodes.get(i, (False, None, None, False, None)), kind, h)
    return {(i, n[2], n[3]) for i, n in nodes.items() if n[2] is not None}


def test_status_stream(spark, tmp_path):
    """Changes and dismissals out of order, over two runs of one checkpoint, equal a replay in order of time."""
    rng = random.Random(6)
    rows = [(f"n{k}", START, k, "load", "h0") for k in range(25)]
    for k in range(250):
        kind = rng.choice(["put", "put", "gone", "dismiss"])
        rows.append((f"n{rng.randrange(32)}", START + dt.timedelta(minutes=rng.randrange(1, 100)), 100 + k, kind, f"h{rng.randrange(2)}" if kind == "put" else None))
    schema, base = "id string, ts timestamp, seq long, kind string, hash string", str(tmp_path)

    def feed(part, last):
        part = rng.sample(part, len(part)) + [("", last, 0, "load", None)]
        spark.createDataFrame([r for r in part if r[3] != "dismiss"] + [(None, START, 1, "put", "x")], schema).coalesce(1).write.mode("append").json(f"{base}/changes")
        spark.createDataFrame([r[:3] for r in part if r[3] == "dismiss"] + [("", last, 1)], "id string, ts timestamp, seq long").coalesce(1).write.mode("append").json(f"{base}/controls")
        status.run(spark.readStream.schema(schema).json(f"{base}/changes"), spark.readStream.schema("id string, ts timestamp, seq long").json(f"{base}/controls"), f"{base}/out", f"{base}/check", "2 hours")
        return {tuple(r) for r in status.latest(spark.read.schema(status.STATUS).parquet(f"{base}/out")).where("id <> ''").collect()}

    early = [r for r in rows if r[2] % 2 == 0 or r[1] == START]
    # The watermark stays behind what the second run brings.
    feed(early, START + dt.timedelta(minutes=110))
    assert feed([r for r in rows if r not in early], START + dt.timedelta(days=2)) == plain_statuses(rows)


def test_status_rules_are_those_of_node_diff(spark):
    """One step of the machine against changes.node_diff, from every state of a node."""
    for here, old in ((True, "a"), (False, None)):
        for prior in (None, "added", "modified", "deleted"):
            for ghost_hash in (None, "a", "b"):
                if here and ghost_hash:
                    continue
                for new in (None, "a", "b"):
                    node = (here, old, prior, ghost_hash is not None, ghost_hash)
                    if ghost_hash and prior is None:
                        continue
                    got = status.apply_one(node, "put" if new else "gone", new)
                    frame = lambda h: spark.createDataFrame([("x", h)] if h else [], "id string, hash string")
                    told = spark.createDataFrame([("x", prior, ghost_hash is not None, ghost_hash)] if prior else [], "id string, status string, is_ghost boolean, hash string")
                    if (here, prior, new) not in STATES:
                        continue
                    out = changes.node_diff(frame(old), frame(new), told).collect()
                    assert [(r.status, r.is_ghost) for r in out] == ([(got[2], got[3])] if got[2] else []), (node, new)


#: States and changes that are looked at, one job each.
STATES = {(True, None, None), (True, None, "b"), (True, "added", "b"), (True, "modified", None), (False, None, "a"), (False, "deleted", "a"), (False, "modified", "b"), (False, "deleted", None)}


def test_preorder(spark):
    rng = random.Random(2)
    ids = {".".join(rng.choice(["a", "b", "a-b", "a b", "é", "a0", "B"]) for _ in range(rng.randrange(1, 5))) for _ in range(150)}
    df = spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "id string")
    ranked = sorted(ids, key=lambda i: [p.encode() for p in i.split(".")])
    for parts in (1, 5):
        got = {r.id: (r.pre, r.end) for r in intervals.number(df, parts).collect()}
        assert got == {i: (k, k + sum(j.startswith(i + ".") for j in ids)) for k, i in enumerate(ranked)}
    numbered = intervals.number(df, 3)
    for block in (4096, 4):
        intervals.BLOCK = block
        chosen = spark.createDataFrame([("a",), ("a.b",), ("B",), ("nowhere",)], "id string")
        assert {r.id for r in intervals.below(numbered, chosen).collect()} == {i for i in ids if i.startswith(("a.", "a.b.", "B."))}
        assert {r.id for r in intervals.prune(numbered, chosen).collect()} == {i for i in ids if not (i + ".").startswith(("a.", "B."))}
    intervals.BLOCK = 4096
    assert intervals.number(df.limit(0)).count() == 0


def test_many_terms_and_globs(spark):
    ids = ["", "a", "Ab", "abc.Abc", "x[1].y", "a*b", "q]z", "pkg.mod.Class", "pkg.mod.other", "pkg2.mod.Class", "É.é"]
    terms = ["", None, "a", "B", "abc", "mod.C", "kg.mod.cl", "zz", "é", ".", "bc.ab", "aaaa"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {tuple(r) for r in search.find_terms(df, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(t, i) for t in terms if t for i in ids if t.lower() in i.lower()}
    globs = ["*", "", None, "a", "a*", "*b", "pkg*.Class", "pkg.mod.*", "p?g.*", "*mod*", "[ap]*", "x[[]1].y", "*[]]z", "[!a]*", "pkg.mod.Clas[s-t]", "a[*]b", "*.[Cé]*", "pkg.mod.OTHER", "x[1"]
    got = {tuple(r) for r in search.match_globs(df, spark.createDataFrame([(g,) for g in globs], "pattern string")).collect()}
    assert got == {(g, i) for g in globs if g is not None for i in ids if fnmatch.fnmatchcase(i, g)}


def test_cache_hit_parses_nothing(spark, tmp_path, monkeypatch):
    """A second look at unchanged files takes the kept graph without opening one; a changed file is parsed again."""
    from deploom import api

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("def f():\n    return 1\n")
    first = api.Project(spark, str(tmp_path / "p"), cache=str(tmp_path / "c"))
    want = {r.id for r in first.nodes.collect()}

    def never(*_):
        raise AssertionError("parsed")

    with monkeypatch.context() as m:
        m.setattr(api, "events_of", never)
        assert {r.id for r in api.Project(spark, str(tmp_path / "p"), cache=str(tmp_path / "c")).nodes.collect()} == want
    (tmp_path / "p" / "a.py").write_text("def g():\n    return 1\n")
    os.utime(tmp_path / "p" / "a.py", ns=(1, 1))
    assert "a.g" in {r.id for r in api.Project(spark, str(tmp_path / "p"), cache=str(tmp_path / "c")).nodes.collect()}


@pytest.mark.parametrize("parts", [1, 9])
def test_nested_document(spark, tmp_path, parts):
    """Any forest, with ids whose parents are no nodes, against one nested in Python; written by tasks and read by the names of the files."""
    rng = random.Random(parts)
    ids = {".".join(rng.choice(["a", "b", "b1", "b-x", 'q"', "\u00e9"]) for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"deep" + ".d" * k for k in range(40)} | {"gap.x.y", "gap.x.y.z"}
    rows = [(i, rng.choice(["class", "module", None]), rng.choice([None, "p"])) for i in sorted(ids)]
    edges = [(rng.choice(rows)[0], rng.choice(rows)[0], rng.choice(["calls", None])) for _ in range(200)]
    n = spark.createDataFrame([*rows, rows[5], (None, "class", None)], "id string, object_type string, origin string")
    e = spark.createDataFrame([*edges, edges[0]], "caller string, callee string, type string")

    def bare(pairs):
        return {k: v for k, v in pairs if v is not None}

    def nest(i, full):
        kids = [nest(k, full) for k in sorted(x for x in ids if x.rpartition(".")[0] == i)]
        return full(i) | ({"children": kids} if kids or full is shown else {})

    kinds = {i: (t, o) for i, t, o in rows}
    plain = lambda i: bare([("id", i), ("object_type", kinds[i][0]), ("origin", kinds[i][1])])
    roots = sorted((i for i in ids if i.rpartition(".")[0] not in ids), key=lambda i: (i.count("."), i))
    document.write_document(document.document(n, e, parts), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    data = json.loads("".join(f.read_text() for f in files))
    counts = {}
    for t, _ in kinds.values():
        counts[t or "unknown"] = counts.get(t or "unknown", 0) + 1
    shown = None
    assert data["nodes"] == [nest(i, plain) for i in roots]
    assert [tuple(map(x.get, ("caller", "callee", "type"))) for x in data["edges"]] == sorted([*edges, edges[0]], key=lambda x: (x[0], x[1], x[2] or ""))
    assert data["metadata"] == {"node_count": len(ids), "edge_count": 201, "node_types": counts}

    def shown(i):  # noqa: F811
        name = i.rpartition(".")[2]
        return {"id": i, "name": name, "label": name, "type": kinds[i][0], "origin": kinds[i][1] or "local", "parent": i.rpartition(".")[0] or None}

    data = json.loads("".join(document.stream(document.catalog_document(n, parts))))
    assert data == {"nodes": [nest(i, shown) for i in roots], "metadata": {"node_count": len(ids)}}
    got = {r.id: r.n_below for r in intervals.sizes(intervals.number(n, parts)).collect()}
    assert got == {i: sum(x.startswith(i + ".") for x in ids) for i in ids}


def test_empty_document(spark):
    n, e = spark.createDataFrame([], "id string, object_type string"), spark.createDataFrame([], "caller string, callee string, type string")
    assert json.loads("".join(document.stream(document.document(n, e)))) == {"nodes": [], "edges": [], "metadata": {"node_count": 0, "edge_count": 0, "node_types": {}}}
    assert json.loads("".join(document.stream(document.catalog_document(n)))) == {"nodes": [], "metadata": {"node_count": 0}}


def test_status_takes_many_nodes_a_call():
    """One call of the state function applies the changes of all nodes of a bucket."""

    class State:
        exists, hasTimedOut, kept, due = False, False, None, None

        def getCurrentWatermarkMs(self):
            return 1

        def update(self, value):
            self.kept = value

        def setTimeoutTimestamp(self, ms):
            self.due = ms

    import pandas as pd

    frame = pd.DataFrame([(f"n{k}", us, k, "put", "h") for k in range(3) for us in (5, 9000)], columns=["id", "us", "seq", "kind", "hash"])
    state = State()
    out = list(status.advance((0,), iter([frame]), state))
    assert [(r.id, r.status) for d in out for r in d.itertuples()] == [(f"n{k}", "added") for k in range(3)] and state.due == 10


def test_incremental_keeps_a_reference_once(spark, tmp_path):
    """References are kept by the end of their name, not once for each key that they try; a definition at any level still finds them."""
    graph = incremental.NameGraph(spark, f"{tmp_path}/g", 4).create()
    refs = spark.createDataFrame([("f", "a.b.c.d", "x"), ("f", "a.b.c.d", "m.x")], "file string, scope string, name string")
    apply = lambda file, ids: graph.apply(spark.createDataFrame([(file,)], "file string"), spark.createDataFrame([(file, i, "class") for i in ids], "file string, id string, object_type string"), refs)
    apply("f", [])
    assert graph.load("tries").count() == 2
    for ids in (["a.x"], ["a.x", "a.b.c.x", "a.b.m.x"], []):
        apply("g", ids)
        assert {tuple(r) for r in graph.load("edges").select("name", "callee").collect()} == ({("x", max(ids[:2], key=len))} if ids else set()) | ({("m.x", "a.b.m.x")} if len(ids) > 1 else set())


def shuffles_of(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def test_line_items_move_as_bare_keys(spark):
    """Line items are dealt by one key, that of the join behind, and once more for parts; nothing else of their size moves."""
    keys = shuffles_of(synth.edges(spark, f"{DATA}/sf0.01"))
    assert any(k.startswith("l_orderkey") for k in keys) and any(k.startswith("l_partkey") for k in keys)
    assert not [k for k in keys if k.startswith("l_") and ("l_suppkey" in k)]


def test_components_move_numbers(spark):
    ids = ["a", "b", "c", "d", "e", None]
    pairs = [("b", "a"), ("c", "b"), ("c", "c"), ("e", "d"), ("d", "z"), ("z", "a"), (None, "a"), ("a", None), ("b", "a")]
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "caller string, callee string")
    links = traverse.links_of(edges, traverse.numbered(nodes))
    assert [t for _, t in links.dtypes] == ["bigint", "bigint"] and links.count() == 4
    got = {r.id: r.component for r in traverse.all_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", None: None}


def test_context_looks_up_what_is_left(spark):
    """Chosen nodes aren't looked up again by their prefixes: where all are chosen, nothing is."""
    nodes = spark.createDataFrame([(i,) for i in ("a", "a.b", "a.b.c", "d", "d.e", "d.e.f")], "id string")
    assert sorted(r.id for r in traverse.context_closure(nodes.where("id in ('a.b', 'd')"), nodes).collect()) == ["a", "a.b", "a.b.c", "d", "d.e", "d.e.f"]
    assert sorted(r.id for r in traverse.context_closure(nodes, nodes).collect()) == sorted(r.id for r in nodes.collect())
    plan = traverse.context_closure(nodes, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") >= 2


def test_callees_are_looked_up_first(spark):
    edges, ids = spark.createDataFrame([("a", "b", "calls")], "caller string, callee string, type string"), spark.createDataFrame([("a",)], "id string")
    plan = selector.induced_edges(edges, ids)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join LeftSemi, \((\w+)#", plan)
    assert joins == ["caller", "callee"]  # the outer one comes last


def test_terms_are_looked_up_whole(spark):
    """Repeated ids, and terms that are longer than what is looked up."""
    ids = ["Alpha.beta", "Alpha.beta", "x" * 15 + "yz", "x" * 15 + "yw", None]
    nodes, terms = (spark.createDataFrame([(v,) for v in c], f"{n} string") for n, c in (("id", ids), ("term", ["BETA", "beta", "x" * 15 + "Yz", "q", "", None])))
    got = sorted(tuple(r) for r in search.find_terms(nodes, terms).collect())
    assert got == [("BETA", "Alpha.beta"), ("beta", "Alpha.beta"), ("x" * 15 + "Yz", "x" * 15 + "yz")]


def test_names_take_one_pass(spark):
    """A fallback is one more candidate: references aren't joined with what was found."""
    refs = spark.createDataFrame([("m.f", "len"), ("m.f", "os"), ("m.f", "g"), ("m", "g"), ("m.f", "zz"), (None, "len")], "scope string, name string")
    defs = spark.createDataFrame([("m", "module"), ("m.g", "function"), ("m.f.g", "function"), ("m.os", "variable")], "id string, object_type string")
    none = spark.createDataFrame([], "key string, value string")
    out = resolve.resolve_names(refs, resolve.Names(defs, none, none))
    assert {(r.scope, r.name): r.resolved for r in out.collect()} == {("m.f", "len"): "builtins.len", ("m.f", "os"): "m.os", ("m.f", "g"): "m.f.g", ("m", "g"): "m.g", (None, "len"): "builtins.len"}
    assert "LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 10_000)
    keys = [k.split(", ") for k in shuffles_of(registry.QUERIES["drop_ancestor_edges"](spark, f"{DATA}/sf0.01"))]
    lines = spark.read.parquet(f"{DATA}/sf0.01/lineitem.parquet").count()
    for first, each in (("l_orderkey", 1), ("l_partkey", 1), ("caller", 2)):
        assert max(int(k[-1]) for k in keys if k[0].startswith(first)) == -(-each * lines // 10_000)


def test_edges_of_a_document_move_once(spark):
    """Sorted rows are numbered where they are written; no shuffle by range follows, and no text moves."""
    rows = [(rng, f"b{k}", "calls") for k in range(50) for rng in ("a", "c")] * 2
    out = document.edge_lines(spark.createDataFrame(rows, "caller string, callee string, type string"), 5)
    assert len([k for k in shuffles_of(out) if k.startswith("part")]) == 1  # that of the counts, a row a range
    lines = [r["text"] for r in out.sort("place").collect()]
    assert [tuple(json.loads(t.lstrip(",")).values()) for t in lines] == sorted(rows) and [t[0] for t in lines] == ["{"] + [","] * 199


@pytest.mark.parametrize("deep", [4, 14])
def test_general_has_a_looks_itself_up(spark, deep):
    """Only callers of has-a edges are looked for among ancestors; what goes is broadcast. Over eight different depths, all ancestors are looked up."""
    rng = random.Random(deep)
    name = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, deep)))
    edges = {(name(), rng.choice("xyz") + rng.choice(["", ".k"]), rng.choice(["has-a", "calls"])) for _ in range(300)} | {("a", None, "has-a"), (None, "x", "has-a"), ("a.b", "x", None)}
    out = finalize.drop_general_has_a(storage.written(spark.createDataFrame(list(edges), "caller string, callee string, type string")))
    told = {(a[:k], b.split(".")[0]) for a, b, _ in edges if a and b for k in range(len(a)) if a[k] == "."}
    want = {(a, b, t) for a, b, t in edges if not (t == "has-a" and a and b and (a, b.split(".")[0]) in told)}
    assert {tuple(r) for r in out.collect()} == want
    assert not [k for k in shuffles_of(out) if k.startswith("caller")]


def test_large_frontiers_are_hashed_in_shares(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(storage, "TASK_ROWS", 2)
    plans = []
    monkeypatch.setattr(traverse, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), storage.written(df))[1])
    pairs = [(f"a{k}", f"a{k + 10}") for k in range(40)] + [("a3", "a3"), (None, "a1"), ("a1", None)]
    edges = storage.written(spark.createDataFrame(pairs, "caller string, callee string"))
    got = traverse.reach(spark.createDataFrame([(f"a{k}",) for k in range(10)], "id string"), edges)
    assert sorted(r[0] for r in got.collect()) == sorted(f"a{k}" for k in range(50))
    assert all("ShuffledHashJoin" in p and "SortMergeJoin [caller" not in p for p in plans[1:6])
    assert "hashpartitioning(id" in plans[1] and ", 5), REPARTITION_BY_NUM" in plans[1]  # ten ids, two a task


def test_best_edge_sorts_once(spark):
    rows = [("a", "b", "imports"), ("a", "b", "calls"), ("a", "c", "x"), ("a", "c", "y"), ("a", "c", None), ("b", "c", None), ("b", None, "has-a"), ("b", None, "is-a")]
    out = view.best_edge(spark.createDataFrame(rows, "caller string, callee string, type string"), 3)
    assert {tuple(r) for r in out.collect()} == {("a", "b", "calls"), ("a", "c", "y"), ("b", "c", None), ("b", None, "is-a")}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and [k.rsplit(", ", 1)[1] for k in shuffles_of(out)][0] == "3"


@pytest.mark.parametrize("deep", [3, 14])
def test_hidden_subtrees_are_looked_up_by_depth(spark, deep):
    rng = random.Random(deep)
    ids = {".".join(rng.choice("abcd") for _ in range(rng.randint(1, deep))) for _ in range(400)}
    if deep > 8:
        ids |= {".".join("e" * k + "f") for k in range(12)}
    nodes = [(i, "third-party" if rng.random() < 0.05 or i[-1] == "f" else None) for i in sorted(ids)] + [(None, None)]
    frame = storage.written(spark.createDataFrame(nodes, "id string, origin string"))
    edges = spark.createDataFrame([], "caller string, callee string, type string")
    kept = filters.origin_tree(frame, edges)[0]
    bad = [i for i, o in nodes if o]
    assert {r["id"] for r in kept.collect()} == {i for i, _ in nodes if i is None or not any(i == b or i.startswith(b + ".") for b in bad)}
    if deep <= 8:
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and not shuffles_of(kept)


def test_catalogs_write_no_edges(spark, monkeypatch):
    frames = []
    monkeypatch.setattr(registry, "written", lambda df: (frames.append(df.columns), storage.written(df))[1])
    for name in ("catalog_document", "catalog_api", "origin_tree", "exclude_only"):
        registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert len(frames) == 4 and not [c for c in frames if "caller" in c]
