"""Files of one shape: parsed once as a template, and filled in with the words of each.

The shape of a text is the text with its names and whole numbers taken out. Texts of one shape have one syntax tree but for these words, so what a
parser makes of one text, it makes of the others with their words in the same places. Names that mean something to the language or to a parser,
and all words that the syntax might read otherwise, stay in the shape. A shape becomes a template when it comes a second time and its template, filled in
with the words of that text, gives what the parser gives for it; texts of other shapes are parsed one by one.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa

WORD = re.compile(r"([A-Za-z0-9_]+)")
NUMBER = re.compile(r"0|[1-9][0-9]{0,14}")
MODULE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", re.ASCII)
#: Words that parsers and flow graphs tell from other names.
FIXED = frozenset([*keyword.kwlist, *keyword.softkwlist, "self", "cls", "TYPE_CHECKING", "true", "false", "null", "undefined"])
PREFIXES = frozenset(a + b for a in ("", "r", "b", "f", "u", "t") for b in ("", "r", "b", "f", "u", "t")) - {""}
#: What stands for a name and a number in a template; no text with these becomes one.
NAME_MARK, NUMBER_MARK = "Zq7w", "73184"
PLACE = re.compile(NAME_MARK + r"(\d{6})w|" + NUMBER_MARK + r"(\d{6})")
#: Lines and shapes that a task remembers, and rows of its templates.
LINES, SHAPES, TEMPLATE_ROWS = 50_000, 50_000, 50_000
MAX_SOURCE = 100_000
#: Words of texts that are filled in together, about.
BATCH_ROWS = 60_000


def line_parts(line: str) -> tuple[str, tuple[str, ...]]:
    """The shape of a line, and the words that were taken out of it."""
    if not line.isascii() or "\\" in line or "\t" in line:
        return line, ()
    parts, words = WORD.split(line), []
    for k in range(1, len(parts), 2):
        word = parts[k]
        if word in FIXED or word[:2] == "__":
            continue
        if word[0] <= "9":
            if not NUMBER.fullmatch(word):
                continue
            parts[k] = "\x00d"
        elif parts[k + 1][:1] in ("'", '"') and parts[k + 1] and word.lower() in PREFIXES:
            continue
        else:
            parts[k] = "\x00n"
        words.append(word)
    return "".join(parts), tuple(words)


def cut(value: str):
    """A text of a template: as it is, or (format, places) if it holds marks."""
    pieces = PLACE.split(value)
    if len(pieces) == 1:
        return value
    places = tuple(int(a or b) for a, b in zip(pieces[1::3], pieces[2::3], strict=True))
    return "%s".join(p.replace("%", "%%") for p in pieces[::3]), places


def cell(value, kind: str):
    """A value of a template with its texts cut."""
    if value is None or kind in ("int", "boolean"):
        return value
    if kind == "string":
        return cut(value)
    if kind == "array<string>":
        return tuple(cut(v) for v in value)
    return tuple((cut(k), cut(v)) for k, v in value.items())


def fixed(value, kind: str) -> bool:
    """Whether a cell is the same in all texts."""
    return value is None or kind in ("int", "boolean") or isinstance(value, str) or not value


class Template:
    """Rows (dicts of fields) of a shape whose texts hold marks: for each column its different cells, and which of them each row has."""

    def __init__(self, rows: list[dict], fields: list[tuple[str, str]]):
        self.size = len(rows)
        self.columns = []
        for name, kind in fields:
            different: dict = {}
            at = np.array([different.setdefault(cell(r.get(name), kind), len(different)) for r in rows], np.int64)
            self.columns.append((list(different), at, all(fixed(c, kind) for c in different)))
        # A column that starts behind words of its line moves with their lengths.
        self.moved = {"col": [r.get("_before", ()) for r in rows]}


class Filled:
    """Words of texts of one shape, and what they make of cells, each text made once."""

    def __init__(self, words: list[list[str]]):
        self.n, self.words, self.known, self.arrays, self.lengths = len(words), words, {}, {}, {}

    def text(self, value) -> list[str]:
        if isinstance(value, str):
            return [value] * self.n
        if value not in self.known:
            form, places = value
            if len(places) == 1:
                at = places[0]
                self.known[value] = [w[at] for w in self.words] if form == "%s" else [form % w[at] for w in self.words]
            else:
                pick = itemgetter(*places)
                self.known[value] = [form % pick(w) for w in self.words]
        return self.known[value]

    def array(self, value, kind: str, arrow: pa.DataType, distinct: bool) -> pa.Array:
        """What a cell is in each text."""
        if value is None:
            return pa.nulls(self.n, arrow)
        if kind == "string":
            if value not in self.arrays:
                self.arrays[value] = pa.array(self.text(value), arrow)
            return self.arrays[value]
        if not value:
            rows = [[]] * self.n
        elif kind == "array<string>":
            rows = zip(*[self.text(c) for c in value], strict=True)
            rows = [list(dict.fromkeys(r)) if distinct else list(r) for r in rows]
        else:
            (key, own), = value
            rows = [[kv] for kv in zip(self.text(key), self.text(own), strict=True)]
        return pa.array(rows, arrow)

    def widths(self, place: int, mark: int) -> np.ndarray:
        """How much longer the words of a place are than their mark."""
        if place not in self.lengths:
            self.lengths[place] = np.array([len(w[place]) for w in self.words], np.int32) - mark
        return self.lengths[place]


class Shapes:
    """What `rows_of(module, source, path)` gives for many texts, by shape.

    rows_of: (rows, error), rows as dicts of `fields`, texts of them copied from module and source, `line` and `col` as the syntax tree has them. distinct: fields
    of lists without repeats.
    """

    def __init__(self, rows_of: Callable, fields: list[tuple[str, str]], arrow: dict[str, pa.DataType], distinct: frozenset[str] = frozenset()):
        self.rows_of, self.fields, self.arrow, self.distinct = rows_of, fields, arrow, distinct
        self.lines: dict[str, tuple[int, tuple[str, ...]]] = {}
        self.kinds: dict[str, int] = {}
        self.told: list[str] = []
        self.templates: dict[tuple, Template | None] = {}
        self.seen: set[tuple] = set()
        self.held = 0

    def key(self, module: str, source: str, path: str) -> tuple[tuple | None, list[str]]:
        """The shape of a text, None if it can be none, and its words: those of the module first."""
        if len(source) > MAX_SOURCE or "\x00" in source or "\r" in source or not MODULE.fullmatch(module):
            return None, []
        lines = source.split("\n")
        found = [*map(self.lines.get, lines)]
        if None in found:
            found = [f or self.remembered(line) for f, line in zip(found, lines, strict=True)]
        words = module.split(".")
        return (len(words), path.endswith("__init__.py"), *[f[0] for f in found]), [*words, *chain.from_iterable([f[1] for f in found])]

    def remembered(self, line: str) -> tuple[int, tuple[str, ...]]:
        shape, words = line_parts(line)
        if shape not in self.kinds:
            self.kinds[shape] = len(self.told)
            self.told.append(shape)
        if len(self.lines) >= LINES:
            self.lines.clear()
        self.lines[line] = self.kinds[shape], words
        return self.lines[line]

    def full(self) -> bool:
        """Whether so many kinds of lines came that what is known should be forgotten."""
        return len(self.told) > LINES

    def forget(self) -> None:
        for x in (self.lines, self.kinds, self.told, self.templates, self.seen):
            x.clear()
        self.held = 0

    def marked(self, key: tuple, words: list[str]) -> tuple[str, str, list[list[tuple[int, int, int]]]] | None:
        """Module and source of a shape with a mark for each word, and (column, place, length of the mark) of the marks of each line."""
        mark = lambda k, name: f"{NAME_MARK}{k:06d}w" if name else f"{NUMBER_MARK}{k:06d}"
        shapes = [self.told[k] for k in key[2:]]
        if any(NAME_MARK in s or NUMBER_MARK in s for s in [*shapes, *words]) or len(words) > 999_999:
            return None
        at, lines, where = key[0], [], []
        for shape in shapes:
            parts, own = re.split("\x00([nd])", shape) if shape.isascii() and "\\" not in shape else [shape], []
            out, column = [parts[0]], len(parts[0].encode())
            for k in range(1, len(parts), 2):
                one = mark(at, parts[k] == "n")
                own.append((column, at, len(one)))
                out += [one, parts[k + 1]]
                column += len(one) + len(parts[k + 1])
                at += 1
            lines.append("".join(out))
            where.append(own)
        return ".".join(mark(k, True) for k in range(key[0])), "\n".join(lines), where

    def learn(self, key: tuple, words: list[str], module: str, source: str, path: str) -> Template | None:
        marked = self.marked(key, words)
        if marked is None:
            return None
        rows, error = self.rows_of(marked[0], marked[1], path)
        want, wrong = self.rows_of(module, source, path)
        if error or wrong or any(len(r.get(name) or ()) > 1 for name, kind in self.fields if kind.startswith("map") for r in rows):
            return None
        for r in rows:
            own = marked[2][r["line"] - 1] if "col" in r and 0 < (r.get("line") or 0) <= len(marked[2]) else []
            r["_before"] = tuple((place, n) for column, place, n in own if column < r["col"])
        template = Template(rows, self.fields)
        got = self.fill(template, [words])
        plain = {name: [r.get(name) for r in want] for name, _ in self.fields}
        for (name, kind), column in zip(self.fields, got, strict=True):
            values = [None if v is None else list(v.items()) for v in plain[name]] if kind.startswith("map") else plain[name]
            if pa.array(values, self.arrow[kind]) != column:
                return None
        return template

    def fill(self, template: Template, words: list[list[str]]) -> list[pa.Array]:
        """Columns of the rows of several texts of one shape, text by text."""
        filled, out = Filled(words), []
        n = filled.n
        for (name, kind), (cells, at, same) in zip(self.fields, template.columns, strict=True):
            arrow = self.arrow[kind]
            if name == "col" and any(template.moved["col"]):
                start = np.array([cells[k] or 0 for k in at], np.int32)
                moved = np.repeat(start[None, :], n, axis=0)
                for k, before in enumerate(template.moved["col"]):
                    for place, mark in before:
                        moved[:, k] += filled.widths(place, mark)
                out.append(pa.array(moved.ravel(), arrow, mask=np.tile([cells[k] is None for k in at], n)))
            elif same:
                values = [list(c) if isinstance(c, tuple) else c for c in cells]
                out.append(pa.array(values, arrow).take(pa.array(np.tile(at, n))))
            else:
                base = pa.concat_arrays([filled.array(c, kind, arrow, name in self.distinct) for c in cells])
                out.append(base.take(pa.array((at[None, :] * n + np.arange(n)[:, None]).ravel())))
        return out

    def of_files(self, files: Iterator[tuple[str, str, str]]):
        """files (tag, module, source, path) as ("rows", tag, rows, error) of one text, or ("columns", tags, columns) of many of one shape, whose rows come text by text."""
        waiting: dict[tuple, tuple[list, list]] = {}
        rows = 0
        for tag, module, source, path in files:
            if self.full():
                yield from self.flush(waiting)
                rows = 0
                self.forget()
            key, words = self.key(module, source, path)
            template = self.templates.get(key) if key else None
            if key and template is None and key not in self.templates:
                if key in self.seen and self.held < TEMPLATE_ROWS:
                    template = self.templates[key] = self.learn(key, words, module, source, path)
                    self.held += template.size if template else 1
                elif len(self.seen) < SHAPES:
                    self.seen.add(key)
            if template is None:
                yield "rows", tag, *self.rows_of(module, source, path)
                continue
            tags, taken = waiting.setdefault(key, ([], []))
            tags.append(tag)
            taken.append(words)
            rows += template.size + 1
            if rows >= BATCH_ROWS:
                yield from self.flush(waiting)
                rows = 0
        yield from self.flush(waiting)

    def flush(self, waiting: dict):
        for key, (tags, words) in waiting.items():
            template = self.templates[key]
            if template.size:
                yield "columns", tags, self.fill(template, words)
        waiting.clear()
