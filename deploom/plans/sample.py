"""A small corpus in three languages, for queries on parsed sources; its edges and nodes were derived by hand, the
relations below them were taken from a run and checked against the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PYTHON = '''"""Sample."""
import math

LIMIT = 7


class Motor:
    def run(self):
        print("on")


class Wagon(Motor):
    def __init__(self, motor):
        self.motor = motor

    def go(self):
        if LIMIT > 3:
            self.halt()

    def halt(self):
        print("off")


def assemble():
    m = Motor()
    w = Wagon(m)
    return w


def main():
    w = assemble()
    w.go()
    return math.sqrt(4)
'''

TYPESCRIPT = """import { join } from 'path';
export const size = (n) => { return join(n) };
export class Box { fill() { size(2) } }
"""

RUST = """use std::fs;
struct Wheel { r: u32 }
impl Wheel { fn spin(&self) -> u32 { turn(self.r) } }
fn turn(r: u32) -> u32 { r }
"""

FILES = [("app.py", "python", "app", PYTHON), ("web/box.ts", "typescript", "web.box", TYPESCRIPT), ("krate/src/wheel.rs", "rust", "krate.wheel", RUST)]

EDGES = [
    ("app", "imports", "math"), ("app.Motor.run", "calls", "print"), ("app.Wagon", "is-a", "Motor"), ("app.Wagon", "calls", "app.Motor"), ("app.Wagon.halt", "calls", "print"),
    ("app.Wagon.go", "calls", "app.LIMIT"), ("app.Wagon.go", "calls", "app.Wagon.halt"), ("app.assemble", "calls", "app.Motor"), ("app.assemble", "calls", "app.Wagon"),
    ("app.assemble.m", "has-a", "app.Motor"), ("app.assemble.w", "has-a", "app.Wagon"), ("app.assemble.w", "calls", "app.assemble.m"), ("app.main", "calls", "app.assemble"),
    ("app.main", "calls", "app.Wagon.go"), ("app.main", "calls", "math.sqrt"), ("app.main.w", "has-a", "app.Wagon"), ("app.main.w", "calls", "app.assemble"),
    ("web.box", "imports", "path.join"), ("web.box.size", "calls", "path.join"), ("web.box.Box.fill", "calls", "web.box.size"),
    ("krate.wheel", "imports", "std.fs"), ("krate.wheel.Wheel.spin", "calls", "krate.wheel.turn"),
]

NODES = {
    "module": "app math print web web.box path krate krate.wheel std Motor", "class": "app.Motor app.Wagon web.box.Box krate.wheel.Wheel",
    "function": "app.Motor.run app.Wagon.__init__ app.Wagon.go app.Wagon.halt app.assemble app.main web.box.size web.box.Box.fill krate.wheel.Wheel.spin krate.wheel.turn",
    "assignment": "app.LIMIT app.assemble.m app.assemble.w app.main.w krate.wheel.Wheel.r", "unknown": "math.sqrt path.join std.fs",
}

#: Scopes: file, id, id above, kind, parameters, superclasses, first and last line.
SCOPES = [
    ('app.py', 'app', 'app', 'module', '', '', 1, 34),
    ('app.py', 'app.Motor', 'app', 'class', '', '', 7, 9),
    ('app.py', 'app.Motor.run', 'app.Motor', 'function', '', '', 8, 9),
    ('app.py', 'app.Wagon', 'app', 'class', '', 'Motor', 12, 21),
    ('app.py', 'app.Wagon.__init__', 'app.Wagon', 'function', 'motor', '', 13, 14),
    ('app.py', 'app.Wagon.go', 'app.Wagon', 'function', '', '', 16, 18),
    ('app.py', 'app.Wagon.halt', 'app.Wagon', 'function', '', '', 20, 21),
    ('app.py', 'app.assemble', 'app', 'function', '', '', 24, 27),
    ('app.py', 'app.main', 'app', 'function', '', '', 30, 33),
    ('krate/src/wheel.rs', 'krate.wheel', 'krate.wheel', 'module', '', '', 1, 5),
    ('krate/src/wheel.rs', 'krate.wheel.Wheel', 'krate.wheel', 'class', '', '', 2, 2),
    ('krate/src/wheel.rs', 'krate.wheel.Wheel', 'krate.wheel', 'class', '', '', 3, 3),
    ('krate/src/wheel.rs', 'krate.wheel.Wheel.spin', 'krate.wheel.Wheel', 'function', '', '', 3, 3),
    ('krate/src/wheel.rs', 'krate.wheel.turn', 'krate.wheel', 'function', 'r', '', 4, 4),
    ('web/box.ts', 'web.box', 'web.box', 'module', '', '', 1, 4),
    ('web/box.ts', 'web.box.size', 'web.box', 'function', 'n', '', 2, 2),
    ('web/box.ts', 'web.box.Box', 'web.box', 'class', '', '', 3, 3),
    ('web/box.ts', 'web.box.Box.fill', 'web.box.Box', 'function', '', '', 3, 3),
]

#: Bindings: file, relationship, scope, line, source, target.
BINDINGS = [
    ('app.py', 'ASSIGNED', 'app', 4, '7', 'app.LIMIT'),
    ('app.py', 'CONTAINS', 'app', 4, 'app', 'app.LIMIT'),
    ('app.py', 'CONTAINS', 'app', 7, 'app', 'app.Motor'),
    ('app.py', 'CONTAINS', 'app.Motor', 8, 'app.Motor', 'app.Motor.run'),
    ('app.py', 'CALLS', 'app.Motor.run', 9, 'app.Motor.run', 'print'),
    ('app.py', 'CONTAINS', 'app', 12, 'app', 'app.Wagon'),
    ('app.py', 'CONTAINS', 'app.Wagon', 13, 'app.Wagon', 'app.Wagon.__init__'),
    ('app.py', 'CONTAINS', 'app.Wagon', 16, 'app.Wagon', 'app.Wagon.go'),
    ('app.py', 'GUARDS', 'app.Wagon.go', 17, 'LIMIT > 3', 'if'),
    ('app.py', 'USES', 'app.Wagon.go', 17, 'LIMIT', 'if'),
    ('app.py', 'CALLS', 'app.Wagon.go', 18, 'app.Wagon.go', 'self.halt'),
    ('app.py', 'CONTAINS', 'app.Wagon', 20, 'app.Wagon', 'app.Wagon.halt'),
    ('app.py', 'CALLS', 'app.Wagon.halt', 21, 'app.Wagon.halt', 'print'),
    ('app.py', 'CONTAINS', 'app', 24, 'app', 'app.assemble'),
    ('app.py', 'ASSIGNED', 'app.assemble', 25, 'Motor()', 'app.assemble.m'),
    ('app.py', 'CALLS', 'app.assemble', 25, 'app.assemble', 'Motor'),
    ('app.py', 'CONTAINS', 'app.assemble', 25, 'app.assemble', 'app.assemble.m'),
    ('app.py', 'ASSIGNED', 'app.assemble', 26, 'Wagon(m)', 'app.assemble.w'),
    ('app.py', 'CALLS', 'app.assemble', 26, 'app.assemble', 'Wagon'),
    ('app.py', 'CONTAINS', 'app.assemble', 26, 'app.assemble', 'app.assemble.w'),
    ('app.py', 'RETURNS', 'app.assemble', 27, 'app.assemble', 'w'),
    ('app.py', 'CONTAINS', 'app', 30, 'app', 'app.main'),
    ('app.py', 'ASSIGNED', 'app.main', 31, 'assemble()', 'app.main.w'),
    ('app.py', 'CALLS', 'app.main', 31, 'app.main', 'assemble'),
    ('app.py', 'CONTAINS', 'app.main', 31, 'app.main', 'app.main.w'),
    ('app.py', 'CALLS', 'app.main', 32, 'app.main', 'w.go'),
    ('app.py', 'CALLS', 'app.main', 33, 'app.main', 'math.sqrt'),
    ('app.py', 'RETURNS', 'app.main', 33, 'app.main', 'math.sqrt(4)'),
    ('krate/src/wheel.rs', 'CONTAINS', 'krate.wheel', 1, 'krate.wheel', 'krate.wheel'),
    ('krate/src/wheel.rs', 'CONTAINS', 'krate.wheel', 2, 'krate.wheel', 'krate.wheel.Wheel'),
    ('krate/src/wheel.rs', 'CONTAINS', 'krate.wheel.Wheel', 2, 'krate.wheel.Wheel', 'krate.wheel.Wheel.r'),
    ('krate/src/wheel.rs', 'CALLS', 'krate.wheel.Wheel.spin', 3, 'krate.wheel.Wheel.spin', 'turn'),
    ('krate/src/wheel.rs', 'CONTAINS', 'krate.wheel.Wheel', 3, 'krate.wheel.Wheel', 'krate.wheel.Wheel.spin'),
    ('krate/src/wheel.rs', 'RETURNS', 'krate.wheel.Wheel.spin', 3, 'krate.wheel.Wheel.spin', 'turn(self.r)'),
    ('krate/src/wheel.rs', 'CONTAINS', 'krate.wheel', 4, 'krate.wheel', 'krate.wheel.turn'),
    ('krate/src/wheel.rs', 'RETURNS', 'krate.wheel.turn', 4, 'krate.wheel.turn', 'r'),
    ('web/box.ts', 'CALLS', 'web.box.size', 2, 'web.box.size', 'join'),
    ('web/box.ts', 'CONTAINS', 'web.box', 2, 'web.box', 'web.box.size'),
    ('web/box.ts', 'RETURNS', 'web.box.size', 2, 'web.box.size', 'join(n)'),
    ('web/box.ts', 'CALLS', 'web.box.Box.fill', 3, 'web.box.Box.fill', 'size'),
    ('web/box.ts', 'CONTAINS', 'web.box', 3, 'web.box', 'web.box.Box'),
    ('web/box.ts', 'CONTAINS', 'web.box.Box', 3, 'web.box.Box', 'web.box.Box.fill'),
]

#: Nodes of flow graphs: owner, type, text, line, block.
FLOW_NODES = [
    ('app', 'assignment', 'LIMIT = 7', 4, None),
    ('app.Motor.run', 'call', 'print("on")', 9, None),
    ('app.Motor.run', 'literal', '"on"', 9, None),
    ('app.Wagon.__init__', 'parameter', 'motor', 0, None),
    ('app.Wagon.go', 'block', 'true', 0, None),
    ('app.Wagon.go', 'condition', 'LIMIT > 3', 17, None),
    ('app.Wagon.go', 'call', 'self.halt()', 18, 'true'),
    ('app.Wagon.halt', 'call', 'print("off")', 21, None),
    ('app.Wagon.halt', 'literal', '"off"', 21, None),
    ('app.assemble', 'assignment', 'm = Motor()', 25, None),
    ('app.assemble', 'call', 'Motor()', 25, None),
    ('app.assemble', 'assignment', 'w = Wagon(m)', 26, None),
    ('app.assemble', 'call', 'Wagon(m)', 26, None),
    ('app.assemble', 'return', 'return w', 27, None),
    ('app.main', 'assignment', 'w = assemble()', 31, None),
    ('app.main', 'call', 'assemble()', 31, None),
    ('app.main', 'call', 'w.go()', 32, None),
    ('app.main', 'call', 'math.sqrt(4)', 33, None),
    ('app.main', 'literal', '4', 33, None),
    ('app.main', 'return', 'return math.sqrt(4)', 33, None),
    ('krate.wheel.Wheel.spin', 'call', 'turn(self.r)', 3, None),
    ('krate.wheel.Wheel.spin', 'return', 'return turn(self.r)', 3, None),
    ('krate.wheel.turn', 'parameter', 'r', 0, None),
    ('krate.wheel.turn', 'return', 'return r', 4, None),
    ('web.box.Box.fill', 'call', 'size(2)', 3, None),
    ('web.box.Box.fill', 'literal', '2', 3, None),
    ('web.box.size', 'parameter', 'n', 0, None),
    ('web.box.size', 'call', 'join(n)', 2, None),
    ('web.box.size', 'return', 'return join(n)', 2, None),
]

#: Edges of flow graphs: owner, texts of the ends, type.
FLOW_EDGES = [
    ('app.Motor.run', '"on"', 'print("on")', 'data'),
    ('app.Wagon.go', 'LIMIT > 3', 'self.halt()', 'true_branch'),
    ('app.Wagon.halt', '"off"', 'print("off")', 'data'),
    ('app.assemble', 'Motor()', 'm = Motor()', 'flow'),
    ('app.assemble', 'Wagon(m)', 'w = Wagon(m)', 'flow'),
    ('app.assemble', 'm = Motor()', 'Wagon(m)', 'flow'),
    ('app.assemble', 'w = Wagon(m)', 'return w', 'flow'),
    ('app.main', '4', 'math.sqrt(4)', 'data'),
    ('app.main', 'assemble()', 'w = assemble()', 'flow'),
    ('app.main', 'math.sqrt(4)', 'return math.sqrt(4)', 'flow'),
    ('app.main', 'w = assemble()', 'w.go()', 'flow'),
    ('app.main', 'w.go()', 'math.sqrt(4)', 'flow'),
    ('krate.wheel.Wheel.spin', 'turn(self.r)', 'return turn(self.r)', 'flow'),
    ('krate.wheel.turn', 'r', 'return r', 'flow'),
    ('web.box.Box.fill', '2', 'size(2)', 'data'),
    ('web.box.size', 'join(n)', 'return join(n)', 'flow'),
    ('web.box.size', 'n', 'join(n)', 'flow'),
]

#: Events by kind.
EVENT_COUNTS = [
    ('Assignment', 4),
    ('AttributeAccess', 3),
    ('CallExpression', 11),
    ('ControlBlock', 1),
    ('DefineName', 20),
    ('EndControlBlock', 1),
    ('EnterScope', 18),
    ('ExitScope', 18),
    ('ImportStatement', 3),
    ('Literal', 7),
    ('Return', 5),
    ('SourceLine', 43),
    ('UseName', 21),
    ('total', 155),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "rel_path string, lang string, module string, source string")


def snippets() -> list[tuple[str, str]]:
    """(id, code) of every scope: its lines."""
    lines = {rel: source.split("\n") for rel, _, _, source in FILES}
    return [(id_, "\n".join(lines[file][first - 1 : last])) for file, id_, _, _, _, _, first, last in SCOPES]


def sql_value(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql_value, r)) + ')' for r in rows)}) AS t({names})"
