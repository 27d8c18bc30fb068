"""Control-flow and dependence graphs of functions and modules, folded from ordered events, and queries on them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deploom.functions.storage import written
from deploom.sources import parse

from .traverse import reach, reversed_edges

LITERAL = re.compile(r"""-?\d[\w.]*|["'`].*["'`]|True|False|None|true|false|null|undefined""", re.S)
NODES = "owner string, id string, type string, text string, line int, uses array<string>, defines string, callee_text string, block_id string"
EDGES = "owner string, from string, to string, type string"


class Flow:
    """One graph under construction. `exits` are the loose ends that the next node is wired to."""

    def __init__(self, owner: str):
        self.owner, self.nodes, self.edges = owner, [], []
        self.exits: list[tuple[str, str]] = []
        self.uses: list[str] = []
        self.frames: list[dict] = []
        self.blocks: list[str] = []
        self.count = 0

    def row(self, kind: str, text: str, line: int, **more) -> str:
        node = f"{self.owner}:node_{self.count}"
        self.count += 1
        self.nodes.append({"owner": self.owner, "id": node, "type": kind, "text": text, "line": line, "block_id": self.blocks[-1] if self.blocks else None, "uses": [], **more})
        return node

    def add(self, kind: str, text: str, line: int, **more) -> str:
        node = self.row(kind, text, line, **more)
        self.nodes[-1]["uses"], self.uses = list(dict.fromkeys(self.uses)), []
        for source, how in self.exits:
            self.edge(source, node, how)
        self.exits = [(node, "flow")]
        return node

    def edge(self, a: str, b: str, kind: str) -> None:
        self.edges.append({"owner": self.owner, "from": a, "to": b, "type": kind})

    def branch(self, label: str) -> None:
        """Opens a block for the nodes that follow; the frame on top closes it."""
        block = f"{self.owner}:block_{self.count}"
        self.count += 1
        self.nodes.append({"owner": self.owner, "id": block, "type": "block", "text": label, "line": 0, "uses": [], "block_id": self.blocks[-1] if self.blocks else None})
        self.blocks.append(block)

    def shut(self) -> None:
        if self.blocks:
            self.blocks.pop()

    def loop(self) -> dict | None:
        return next((f for f in reversed(self.frames) if f["kind"] == "loop"), None)

    def open(self, kind: str, condition: str, line: int) -> None:
        if kind == "if":
            node = self.add("condition", condition, line)
            self.frames.append({"kind": "if", "block": kind, "at": node, "ends": [], "last": False})
            self.exits = [(node, "true_branch")]
            self.branch("true")
        elif kind in ("for", "async_for", "while"):
            node = self.add("condition", condition, line)
            self.frames.append({"kind": "loop", "block": kind, "at": node, "breaks": [], "left": False})
            self.exits = [(node, "true_branch")]
            self.branch("true")
        elif kind == "match":
            node = self.add("condition", condition, line)
            self.frames.append({"kind": "match", "block": kind, "at": node, "ends": [], "cases": 0})
        elif kind in ("try", "with", "async_with"):
            self.frames.append({"kind": "plain", "block": kind})

    def other(self, kind: str, condition: str, line: int) -> None:
        frame = self.frames[-1] if self.frames else None
        if frame is None or frame["kind"] == "plain":
            return
        if frame["kind"] == "loop":
            self.close_loop(frame)
            frame["left"] = True
            self.branch("false")
            return
        if frame["kind"] == "match":
            if frame["cases"]:
                frame["ends"] += self.exits
                self.shut()
            frame["cases"] += 1
            self.exits = [(frame["at"], "false_branch")]
            frame["at"] = self.add("condition", condition, line)
            self.exits = [(frame["at"], "true_branch")]
            self.branch("true")
            return
        frame["ends"] += self.exits
        self.shut()
        self.exits = [(frame["at"], "false_branch")]
        if kind == "elif":
            frame["at"] = self.add("condition", condition, line)
            self.exits = [(frame["at"], "true_branch")]
            self.branch("true")
        else:
            frame["last"] = True
            self.branch("false")

    def close_loop(self, frame: dict) -> None:
        for source, _ in self.exits:
            self.edge(source, frame["at"], "back_edge")
        self.exits = [(frame["at"], "false_branch")]
        self.shut()

    def close(self, kind: str) -> None:
        """Closes the innermost frame of this kind of block; an end that no block has opened changes nothing."""
        if not any(f["block"] == kind for f in self.frames):
            return
        while self.frames:
            frame = self.frames.pop()
            if frame["kind"] == "if":
                self.shut()
                self.exits = frame["ends"] + self.exits + ([] if frame["last"] else [(frame["at"], "false_branch")])
            elif frame["kind"] == "loop":
                if frame["left"]:
                    self.shut()
                else:
                    self.close_loop(frame)
                self.exits = self.exits + frame["breaks"]
            elif frame["kind"] == "match":
                if frame["cases"]:
                    self.shut()
                self.exits = frame["ends"] + self.exits + [(frame["at"], "false_branch")]
            if frame["block"] == kind:
                return

    def take(self, e: dict) -> None:
        kind, line = e["kind"], e["line"] or 0
        if kind == "UseName":
            self.uses.append(e["name"])
        elif kind == "Assignment":
            self.add("assignment", f"{e['target']} = {e['value']}", line, defines=e["target"])
        elif kind == "CallExpression":
            args = e["arguments"] or []
            node = self.add("call", f"{e['callee']}({', '.join(args)})", line, callee_text=e["callee"])
            for a in args:
                if LITERAL.fullmatch(a.rpartition("=")[2].strip() if "=" in a and a[:1] not in "\"'`" else a):
                    self.edge(self.row("literal", a, line), node, "data")
        elif kind in ("Return", "RaiseStatement") and e["value_type"] != "early_return":
            self.add("return" if kind == "Return" else "raise", f"{'return' if kind == 'Return' else 'raise'} {e['value'] or ''}".strip(), line)
            self.exits = []
        elif kind in ("BreakStatement", "ContinueStatement"):
            loop = self.loop()
            node = self.add("break" if kind == "BreakStatement" else "continue", "break" if kind == "BreakStatement" else "continue", line)
            if loop and kind == "BreakStatement":
                loop["breaks"] += self.exits
                self.exits = []
            elif loop:
                self.edge(node, loop["at"], "back_edge")
                self.exits = []
        elif kind == "ControlBlock":
            self.open(e["block_type"], e["condition"] or "", line)
        elif kind == "ElseBlock":
            self.other(e["block_type"], e["condition"] or "", line)
        elif kind == "EndControlBlock":
            self.close(e["block_type"])


def fold(events: list[dict]) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of the functions and the module of one file, from its events in order."""
    done, stack = [], []
    for e in events:
        if e["kind"] == "EnterScope":
            if e["scope_type"] in ("Function", "Module"):
                flow = Flow(e["qualname"])
                for p in e["parameters"] or []:
                    flow.add("parameter", p, 0, defines=p)
                stack.append(flow)
                done.append(flow)
            else:
                stack.append(stack[-1] if stack else Flow(e["qualname"]))
        elif e["kind"] == "ExitScope":
            if stack:
                stack.pop()
        elif stack:
            stack[-1].take(e)
    return [n for f in done for n in f.nodes], [x for f in done for x in f.edges]


#: Kinds and columns of the events that graphs are folded from.
KINDS = ("EnterScope", "ExitScope", "UseName", "Assignment", "CallExpression", "Return", "RaiseStatement", "BreakStatement", "ContinueStatement", "ControlBlock", "ElseBlock", "EndControlBlock")
USED = ["file", "seq", "kind", "scope", "qualname", "scope_type", "parameters", "name", "callee", "arguments", "block_type", "condition", "value", "value_type", "target", "line"]


def flow_nodes(files: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """These columns of the nodes that flow_graphs makes of the events of files. A file is folded where it is parsed, so that its events aren't shuffled."""
    none = dict.fromkeys(USED)

    def derive(events: list[dict]) -> list[dict]:
        return fold([none | e for e in events if e["kind"] in KINDS])[0]

    columns = [tuple(c.split(" ")) for c in NODES.split(", ") if c.split(" ")[0] in fields]
    return parse.rows_of(files, columns, derive, distinct=frozenset(["uses"]))


def flow_graphs(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all functions and modules; each file is folded on its own, and a file's events fit in a task."""
    def run(group: pa.Table) -> pa.Table:
        nodes, edges = fold(group.sort_by("seq").to_pylist())
        rows = [(n["owner"], n["id"], n["type"], n["text"], n["line"], n["uses"], n.get("defines"), n.get("callee_text"), n["block_id"], None, None) for n in nodes]
        rows += [(e["owner"], None, e["type"], None, None, None, None, None, None, e["from"], e["to"]) for e in edges]
        kinds_ = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), *[pa.string()] * 5]
        names = ["owner", "id", "type", "text", "line", "uses", "defines", "callee_text", "block_id", "from", "to"]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds_, strict=True))})

    both = written(events.where(F.col("kind").isin(*KINDS)).select(*USED).groupBy("file").applyInArrow(run, NODES + ", from string, to string"))
    return both.where("id is not null").drop("from", "to"), both.where("id is null").select("owner", "from", "to", "type")


def attach(nodes: DataFrame, flow_nodes: DataFrame, flow_edges: DataFrame) -> DataFrame:
    """nodes with `pdg`, the flow graph of a function or module as arrays of its nodes and edges; null for other types and where there is none.
    The graph of one owner is one value."""
    n = flow_nodes.groupBy("owner").agg(F.collect_list(F.struct(*[c for c in flow_nodes.columns if c != "owner"])).alias("nodes"))
    e = flow_edges.groupBy("owner").agg(F.collect_list(F.struct("from", "to", "type")).alias("edges"))
    both = n.join(e, "owner", "left").select(F.col("owner").alias("id"), F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges")).alias("pdg"))
    holds = nodes.where("object_type in ('function', 'module')").select("id").join(both, "id")
    return nodes.drop("pdg").join(holds, "id", "left")


def nested_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their ends moved to the blocks that hold them, where the other end is outside; edges between two blocks go."""
    b = nodes.select("id", "block_id")
    j = edges.join(b.toDF("from", "fb"), "from", "left").join(b.toDF("to", "tb"), "to", "left")
    same = F.col("fb").eqNullSafe(F.col("tb"))
    out = j.where(same | F.col("fb").isNull() | F.col("tb").isNull())
    return out.select("owner", F.when(same, F.col("from")).otherwise(F.coalesce("fb", "from")).alias("from"), F.when(same, F.col("to")).otherwise(F.coalesce("tb", "to")).alias("to"), "type").where("from <> to").distinct()


def inline(nodes: DataFrame, edges: DataFrame, owner: str, max_depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """The graph of an owner with calls replaced by the graphs that they refer to, ids prefixed by the call's id; a function that is already on
    the path is not opened again. nodes: with `references`."""
    level = written(nodes.where(F.col("owner") == owner).select("id", "type", "text", "references", F.array(F.lit(owner)).alias("path")))
    links = edges.where(F.col("owner") == owner).select("from", "to", "type")
    out, n = level, 0
    body = nodes.select(F.col("owner").alias("o"), F.col("id").alias("bid"), F.col("type").alias("bt"), F.col("text").alias("bx"), F.col("references").alias("br"))
    inner = edges.select(F.col("owner").alias("o"), F.col("from").alias("bf"), F.col("to").alias("bo"), F.col("type").alias("bt"))
    while n < max_depth:
        calls = level.where("type = 'call' and references is not null and not array_contains(path, references)")
        if calls.isEmpty():
            break
        opened = calls.select("id", "references", "path")
        level = written(opened.join(body, F.col("references") == body["o"]).select(F.concat("id", F.lit("::"), "bid").alias("id"), F.col("bt").alias("type"), F.col("bx").alias("text"), F.col("br").alias("references"), F.concat("path", F.array("o")).alias("path")))
        links = links.unionByName(opened.join(inner, F.col("references") == inner["o"]).select(F.concat("id", F.lit("::"), "bf").alias("from"), F.concat("id", F.lit("::"), "bo").alias("to"), F.col("bt").alias("type")))
        out, n = out.unionByName(level), n + 1
    return out.select("id", "type", "text", "references"), links


def reachable(edges: DataFrame, node: str) -> DataFrame:
    """Ids that lie before or after a node."""
    pairs = edges.select(F.col("from").alias("caller"), F.col("to").alias("callee"))
    seed = edges.sparkSession.createDataFrame([(node,)], "id string")
    return reach(seed, pairs).unionByName(reach(seed, reversed_edges(pairs))).distinct()


def visible_edges(edges: DataFrame, types: list[str]) -> DataFrame:
    return edges.where(F.col("type").isin(types))


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a label (true, false or none); those with a missing end go unless they are calls or uses."""
    a, b = nodes.select(F.col("id").alias("from"), F.lit(1).alias("a")), nodes.select(F.col("id").alias("to"), F.lit(1).alias("b"))
    j = edges.join(a, "from", "left").join(b, "to", "left").where("(a is not null and b is not null) or type in ('calls', 'uses')")
    return j.select("owner", "from", "to", "type", F.when(F.col("type") == "true_branch", "true").when(F.col("type") == "false_branch", "false").alias("label"))
