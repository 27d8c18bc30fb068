"""files to events, and events to the relations of each file."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .javascript_events import javascript_events
from .python_events import python_events
from .rust_events import rust_events
from .scan import changed_files
from .shapes import Shapes

FIELDS = [
    ("kind", "string"), ("scope", "string"), ("name", "string"), ("qualname", "string"), ("node_type", "string"), ("scope_type", "string"),
    ("parameters", "array<string>"), ("bases", "array<string>"), ("docstring", "string"), ("callee", "string"), ("arguments", "array<string>"),
    ("module", "string"), ("names", "array<string>"), ("aliases", "map<string,string>"), ("block_type", "string"), ("condition", "string"),
    ("value", "string"), ("value_type", "string"), ("target", "string"), ("target_qualname", "string"), ("object", "string"),
    ("attribute", "string"), ("text", "string"), ("is_flag", "boolean"), ("line", "int"), ("end_line", "int"), ("col", "int"),
]
COLUMNS = [("file", "string"), ("lang", "string"), ("file_module", "string"), ("seq", "int"), *FIELDS, ("error", "string")]
SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)
ARROW = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()), "boolean": pa.bool_(), "int": pa.int32()}

#: Parsers by language: (module, source, path), and the import aliases of the file where it has some. Register another to add a language.
PARSERS = {
    "python": lambda module, source, rel: python_events(module, source, rel.endswith("__init__.py")),
    "javascript": javascript_events,
    "typescript": javascript_events,
    "tsx": javascript_events,
    "rust": lambda module, source, rel: rust_events(module, source, rel),
}
PYTHON = PARSERS["python"]

#: Events of several files that go to the JVM together, about.
BATCH_EVENTS = 20_000

#: Columns that are those of the file.
OF_FILE = {"file": 0, "lang": 1, "file_module": 2, "error": 3}


def rows_of(files: DataFrame, wanted: list[tuple[str, str]], derive: Callable[[list[dict]], list[dict]], parsers: dict | None = None, distinct: frozenset[str] = frozenset()) -> DataFrame:
    """Rows (dicts) that `derive` makes of the ordered events of each file, as `wanted` columns; those of OF_FILE come from the file.

    Python files go by their shape (shapes.py), so derive may copy texts of events and cut them at what is no word, but must not look at the words themselves;
    distinct: columns of lists that hold no text twice.
    """
    parsers = parsers or PARSERS
    schema = ", ".join(f"{n} {t}" for n, t in wanted)
    own_fields = [(n, t) for n, t in wanted if n not in OF_FILE]
    by_shape = parsers.get("python") is PYTHON

    def packed(held: list[tuple]) -> pa.RecordBatch:
        """One batch of what (rel, lang, module, error, rows) hold."""
        columns = []
        for name, kind in wanted:
            if name in OF_FILE:
                values = [v for h in held for v in [h[OF_FILE[name]]] * len(h[4])]
            else:
                values = [r.get(name) for h in held for r in h[4]]
                if kind.startswith("map"):
                    values = [None if v is None else list(v.items()) for v in values]
            columns.append(pa.array(values, ARROW[kind]))
        return pa.RecordBatch.from_arrays(columns, [n for n, _ in wanted])

    def of_shape(tags: list[tuple], columns: list[pa.Array]) -> pa.RecordBatch:
        """One batch of files of one shape, (rel, lang, module) each."""
        text = pa.array(np.repeat(np.arange(len(tags)), len(columns[0]) // len(tags)))
        by_name = dict(zip([n for n, _ in own_fields], columns, strict=True))
        given = lambda name: pa.array([None if name == "error" else t[OF_FILE[name]] for t in tags], pa.string()).take(text)
        return pa.RecordBatch.from_arrays([given(n) if n in OF_FILE else by_name[n] for n, _ in wanted], [n for n, _ in wanted])

    def run(batches):
        def parsed(module, source, path, lang="python", aliases=None):
            events, error = parsers[lang](module, source, path, *([dict(aliases)] if aliases else []))
            return derive(events), error

        shapes = Shapes(parsed, own_fields, ARROW, distinct)

        def found():
            def plain():
                for batch in batches:
                    for rel, lang, module, source, aliases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if source is not None and lang in parsers:
                            yield rel, lang, module, source, aliases

            if not (by_shape and own_fields):
                for rel, lang, module, source, aliases in plain():
                    yield "rows", (rel, lang, module), *parsed(module, source, rel, lang, aliases)
                return
            others = []

            def python():
                for rel, lang, module, source, aliases in plain():
                    if lang == "python" and module is not None and not aliases:
                        yield (rel, lang, module), module, source, rel
                    else:
                        others.append(("rows", (rel, lang, module), *parsed(module, source, rel, lang, aliases)))

            for x in shapes.of_files(python()):
                while others:
                    yield others.pop()
                yield x
            yield from others

        held, n, alike, m = [], 0, [], 0
        for kind, tag, *more in found():
            if kind == "columns":
                alike.append(of_shape(tag, more[0]))
                m += alike[-1].num_rows
                if m >= BATCH_EVENTS:
                    yield pa.concat_batches(alike)
                    alike, m = [], 0
                continue
            own, error = more
            for a in range(0, len(own), BATCH_EVENTS):
                part = own[a : a + BATCH_EVENTS]
                if n + len(part) > BATCH_EVENTS:
                    yield packed(held)
                    held, n = [], 0
                held.append((*tag, error, part))
                n += len(part)
        if held:
            yield packed(held)
        if alike:
            yield pa.concat_batches(alike)

    aliases = F.col("aliases") if "aliases" in files.columns else F.lit(None).cast("map<string,string>").alias("aliases")
    return files.select("rel_path", "lang", "module", "source", aliases).mapInArrow(run, schema)


def events_of(files: DataFrame, parsers: dict | None = None, kinds: tuple[str, ...] | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Ordered events of files (rel_path, lang, module, source); files without text or parser give none. A broken text gives its module scope,
    its lines, and an `error`.

    kinds: events of these only; fields: these columns of SCHEMA only. What isn't asked for doesn't leave the parser's task; seq counts all events.
    """
    kept = None if kinds is None else frozenset(kinds)

    def derive(events: list[dict]) -> list[dict]:
        own = []
        for k, e in enumerate(events):
            if kept is None or e["kind"] in kept:
                e["seq"] = k
                own.append(e)
        return own

    return rows_of(files, [(n, t) for n, t in COLUMNS if fields is None or n in fields], derive, parsers)


#: Kinds and columns that a relation is made of.
NEEDED = {
    "scopes": (("EnterScope",), ("file", "lang", "file_module", "seq", "kind", "scope", "name", "qualname", "scope_type", "parameters", "bases", "docstring", "line", "end_line")),
    "definitions": (("DefineName", "EnterScope"), ("file", "seq", "kind", "scope", "qualname", "name", "node_type", "scope_type", "line")),
    "uses": (("UseName",), ("file", "seq", "kind", "scope", "name", "line", "col")),
    "imports": (("ImportStatement",), ("file", "lang", "file_module", "seq", "kind", "module", "names", "aliases", "is_flag", "line")),
    "values": (("Assignment", "Return", "CallExpression"), ("file", "seq", "kind", "scope", "target", "target_qualname", "value", "value_type", "callee")),
    "bindings": (
        ("Assignment", "CallExpression", "Return", "ControlBlock", "ElseBlock", "DefineName", "UseName", "Literal"),
        ("file", "seq", "kind", "scope", "line", "name", "qualname", "callee", "block_type", "condition", "value", "target_qualname"),
    ),
}


def events_for(files: DataFrame, *relations: str) -> DataFrame:
    """Events of files that these relations are made of, with the columns that they read."""
    needed = [NEEDED[r] for r in relations]
    return events_of(files, None, tuple({k for kinds, _ in needed for k in kinds}), tuple({f for _, fields in needed for f in fields}))


def updated_events(events: DataFrame, files: DataFrame, seen: DataFrame) -> DataFrame:
    """Events after a new scan: those of files that are as in `seen` (path, source_hash) stay, files that are new or differ are parsed, and
    files that are gone have none."""
    changed = changed_files(files, seen).select("rel_path", "lang", "module", "source", *[c for c in ("aliases",) if c in files.columns])
    same = files.join(changed.select("rel_path"), "rel_path", "left_anti").select(F.col("rel_path").alias("file"))
    return events.join(same, "file", "left_semi").unionByName(events_of(changed))


def scopes(events: DataFrame) -> DataFrame:
    e = events.where("kind = 'EnterScope'")
    return e.select("file", "lang", "file_module", "qualname", F.col("scope").alias("parent_qualname"), "name", F.lower("scope_type").alias("scope_type"), F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"), F.coalesce("bases", F.array().cast("array<string>")).alias("bases"), (F.col("scope_type") == "Module").alias("is_root"), "docstring", "line", "end_line", "seq")


def definitions(events: DataFrame) -> DataFrame:
    """Definitions by scope; scopes below the module define their own name as well. The events are read once."""
    defined = F.col("kind") == "DefineName"
    named = events.where("kind = 'DefineName' or (kind = 'EnterScope' and scope_type <> 'Module')")
    return named.select("file", "scope", "qualname", "name", F.when(defined, F.col("node_type")).otherwise(F.lower("scope_type")).alias("def_type"), "line", "seq")


def uses(events: DataFrame) -> DataFrame:
    return events.where("kind = 'UseName'").select("file", "scope", "name", "line", "col", "seq")


def imports(events: DataFrame) -> DataFrame:
    return events.where("kind = 'ImportStatement'").select("file", "lang", "file_module", F.col("module").alias("source_module"), F.col("names").alias("imported_names"), "aliases", F.coalesce("is_flag", F.lit(False)).alias("is_type_checking"), "line", "seq")


def bindings(events: DataFrame) -> DataFrame:
    """(file, seq, relationship, scope, line, source, target): assigned, calls, returns, guards, contains, uses and with.

    An event gives an array of rows, so that the events are read once; the last call before an event comes from one sort of each file's events."""
    words = F.array_distinct(F.filter(F.split("condition", r"[^A-Za-z0-9_.]+"), lambda w: F.rlike(w, F.lit(r"^[A-Za-z_][A-Za-z0-9_.]*$")) & ~w.isin("and", "or", "not", "in", "is", "None", "True", "False", "null", "true", "false", "undefined")))
    after = F.expr("last_value(case when kind = 'CallExpression' then struct(callee, line) end) ignore nulls over (partition by file order by seq rows between unbounded preceding and 1 preceding)")
    row = lambda kind, source, target: F.struct(F.lit(kind).alias("relationship"), source.alias("source"), target.alias("target"))
    kind = F.col("kind")
    guard = F.concat(F.array(row("GUARDS", F.col("condition"), F.col("block_type"))), F.transform(words, lambda w: row("USES", w, F.col("block_type"))))
    given = (
        F.when(kind == "Assignment", F.array(row("ASSIGNED", F.col("value"), F.col("target_qualname"))))
        .when(kind == "CallExpression", F.array(row("CALLS", F.col("scope"), F.col("callee"))))
        .when((kind == "Return") & (F.col("value") != ""), F.array(row("RETURNS", F.col("scope"), F.col("value"))))
        .when((kind == "ControlBlock") & (F.col("condition") != ""), guard)
        .when(kind == "ElseBlock", F.array(row("GUARDS_ELSE", F.coalesce("condition", F.lit("")), F.col("block_type"))))
        .when(kind == "DefineName", F.array(row("CONTAINS", F.col("scope"), F.col("qualname"))))
        .when(kind.isin("UseName", "Literal") & F.col("call").isNotNull() & (F.col("call.line") == F.col("line")), F.array(row("WITH", F.col("call.callee"), F.coalesce("name", "value"))))
    )
    kinds, columns = NEEDED["bindings"]
    rows = events.where(kind.isin(*kinds)).select(*columns).withColumn("call", after).select("file", "seq", "scope", "line", given.alias("given")).where("given is not null")
    return rows.select("file", "seq", "scope", "line", F.inline("given")).select("file", "seq", "relationship", "scope", "line", "source", "target")


DEFINITION = [("file", "string"), ("scope", "string"), ("qualname", "string"), ("name", "string"), ("def_type", "string"), ("line", "int")]


def definition_rows(events: list[dict]) -> list[dict]:
    """Rows of DEFINITION of one file's events; a scope that a statement defines (DefineName, then EnterScope) is told once."""
    out, told = [], set()
    for e in events:
        if e["kind"] == "DefineName" or (e["kind"] == "EnterScope" and e["scope_type"] != "Module"):
            row = {"scope": e["scope"], "qualname": e["qualname"], "name": e["name"], "def_type": e["node_type"] if e["kind"] == "DefineName" else e["scope_type"].lower(), "line": e["line"]}
            own = (row["qualname"], row["def_type"], row["line"])
            if e["kind"] == "DefineName":
                told.add(own)
            elif own in told:
                continue
            out.append(row)
    return out


def definitions_of(files: DataFrame) -> DataFrame:
    """Definitions of files, one for each statement that makes it, without seq. They are told apart where a file is parsed, so that nothing is shuffled."""
    return rows_of(files, DEFINITION, definition_rows)


BINDING = [("file", "string"), ("relationship", "string"), ("scope", "string"), ("line", "int"), ("source", "string"), ("target", "string"), ("others", "array<string>")]
WORDS, WORD = re.compile(r"[^A-Za-z0-9_.]+"), re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
NO_NAMES = ("and", "or", "not", "in", "is", "None", "True", "False", "null", "true", "false", "undefined")


def binding_rows(events: list[dict]) -> list[dict]:
    """Rows of BINDING of one file's events; others: words before one in a condition, which it may repeat."""
    out, last = [], None
    for e in events:
        kind = e["kind"]
        add = lambda relationship, source, target, e=e, **more: out.append({"relationship": relationship, "scope": e["scope"], "line": e["line"], "source": source, "target": target, **more})
        if kind == "Assignment":
            add("ASSIGNED", e.get("value"), e.get("target_qualname"))
        elif kind == "CallExpression":
            add("CALLS", e["scope"], e["callee"])
            last = e
        elif kind == "Return" and e.get("value"):
            add("RETURNS", e["scope"], e["value"])
        elif kind == "ControlBlock" and e.get("condition"):
            add("GUARDS", e["condition"], e["block_type"])
            words = [w for w in WORDS.split(e["condition"]) if WORD.fullmatch(w) and w not in NO_NAMES]
            for k, word in enumerate(words):
                add("USES", word, e["block_type"], others=words[:k] or None)
        elif kind == "ElseBlock":
            add("GUARDS_ELSE", e.get("condition") or "", e["block_type"])
        elif kind == "DefineName":
            add("CONTAINS", e["scope"], e["qualname"])
        elif kind in ("UseName", "Literal") and last is not None and last["line"] is not None and last["line"] == e["line"]:
            add("WITH", last["callee"], e["value"] if e.get("name") is None else e["name"])
    return out


def bindings_of(files: DataFrame) -> DataFrame:
    """bindings of the events of files, without seq. A file's rows are made where it is parsed, in order, so that nothing is shuffled or sorted."""
    rows = rows_of(files, BINDING, binding_rows)
    return rows.where("others is null or not array_contains(others, source)").drop("others")


def code(events: DataFrame) -> DataFrame:
    """(id, file_path, code_block, content_hash, docstring) of functions, classes and modules."""
    from deploom.operators.finalize import snippets

    lines = events.where("kind = 'SourceLine'").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))
    s = scopes(events).where("scope_type in ('function', 'class', 'interface', 'module')")
    ranges = s.select(F.col("qualname").alias("id"), "file", F.col("line").alias("start"), F.col("end_line").alias("end"))
    docs = s.groupBy(F.col("qualname").alias("id")).agg(F.max_by("docstring", F.struct("file", "seq")).alias("docstring"))
    return snippets(lines, ranges).join(docs, "id")
