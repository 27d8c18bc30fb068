"""Sources and events of features.py: fixed values, one list a feature, in order. They were taken from a run and
each was checked against the definition of the feature."""

from __future__ import annotations

PYTHON = {
    "imports": (
"""
import a.b as c, d
from e import f as g, h
from x import *
""",
"""
ImportStatement a.b() a.b as c
ImportStatement d()
ImportStatement e(f, h) f as g
ImportStatement x(*)
""",
    ),
    "relative": (
"""
from . import a
from .b import c
from .. import d
from ..e.f import g
""",
"""
ImportStatement p.q(a)
ImportStatement p.q.b(c)
ImportStatement p(d)
ImportStatement p.e.f(g)
""",
    ),
    "typing_only": (
"""
if TYPE_CHECKING:
    import t
import u
""",
"""
ControlBlock if TYPE_CHECKING
UseName TYPE_CHECKING
ImportStatement t() typing
EndControlBlock if
ImportStatement u()
""",
    ),
    "classes": (
"""
class A(B, c.D):
    x = 1
""",
"""
DefineName class A
EnterScope class A() of B, c.D
UseName B
AttributeAccess c.D
DefineName variable x
Literal integer 1
Assignment literal x = 1
ExitScope class
""",
    ),
    "functions": (
"""
def f(self, a: T, *b, c=1, **d) -> R:
    pass
""",
"""
UseName T
UseName R
DefineName function f
EnterScope function f(a, *b, c, **d)
UseName self
UseName a
UseName T
UseName b
UseName c
Literal integer 1
UseName d
UseName R
ExitScope function
""",
    ),
    "async_functions": (
"""
async def f(a):
    await g(a)
""",
"""
DefineName function f
EnterScope function f(a)
UseName a
UseName g
UseName a
CallExpression g(a)
ExitScope function
""",
    ),
    "assignments": (
"""
a = 1
b = c
d, e = f()
g.h = a
""",
"""
DefineName variable a
Literal integer 1
Assignment literal a = 1
DefineName variable b
UseName c
Assignment name b = c
DefineName variable d
DefineName variable e
UseName f
CallExpression f()
Assignment call d = f()
Assignment call e = f()
UseName a
""",
    ),
    "annotated": (
"""
a: int = 1
b: T
""",
"""
UseName int
DefineName variable a
Literal integer 1
Assignment literal a = 1
UseName T
DefineName variable b
Assignment expression b =
""",
    ),
    "value_kinds": (
"""
a = 'x'
b = f()
c = d
e = f.g
h = [1]
i = 1 + 2
""",
"""
DefineName variable a
Literal string 'x'
Assignment literal a = 'x'
DefineName variable b
UseName f
CallExpression f()
Assignment call b = f()
DefineName variable c
UseName d
Assignment name c = d
DefineName variable e
AttributeAccess f.g
Assignment attribute e = f.g
DefineName variable h
Literal integer 1
Assignment collection h = [1]
DefineName variable i
Literal integer 1
Literal integer 2
Assignment expression i = 1 + 2
""",
    ),
    "calls": (
"""
f(g(1), k=h)
a.b.c(2)
""",
"""
UseName f
UseName g
Literal integer 1
CallExpression g(1)
UseName h
CallExpression f(g(1), k=h)
AttributeAccess a.b.c
AttributeAccess a.b
Literal integer 2
CallExpression a.b.c(2)
""",
    ),
    "attributes": (
"""
a.b
""",
"""
AttributeAccess a.b
""",
    ),
    "conditions": (
"""
if a:
    f()
elif b:
    g()
else:
    h()
""",
"""
ControlBlock if a
UseName a
UseName f
CallExpression f()
ElseBlock elif b
UseName b
UseName g
CallExpression g()
ElseBlock else
UseName h
CallExpression h()
EndControlBlock if
""",
    ),
    "loops": (
"""
for i in a:
    break
while b:
    continue
else:
    f()
""",
"""
ControlBlock for i in a
DefineName variable i
UseName a
BreakStatement
EndControlBlock for
ControlBlock while b
UseName b
ContinueStatement
ElseBlock else
UseName f
CallExpression f()
EndControlBlock while
""",
    ),
    "async_blocks": (
"""
async def f():
    async for i in a:
        pass
    async with b as c:
        pass
""",
"""
DefineName function f
EnterScope function f()
ControlBlock async_for i in a
DefineName variable i
UseName a
EndControlBlock async_for
ControlBlock async_with b
DefineName variable c
UseName b
EndControlBlock async_with
ExitScope function
""",
    ),
    "with_blocks": (
"""
with f(a) as b, c:
    pass
""",
"""
ControlBlock with f(a), c
DefineName variable b
UseName f
UseName a
CallExpression f(a)
UseName c
EndControlBlock with
""",
    ),
    "tries": (
"""
try:
    f()
except E as e:
    g(e)
except (A, B):
    pass
else:
    h()
finally:
    i()
""",
"""
ControlBlock try
UseName f
CallExpression f()
DefineName variable e
UseName E
UseName g
UseName e
CallExpression g(e)
UseName A
UseName B
ElseBlock else
UseName h
CallExpression h()
UseName i
CallExpression i()
EndControlBlock try
""",
    ),
    "returns": (
"""
def f(a):
    return a
def g():
    raise E('x')
def h():
    return
""",
"""
DefineName function f
EnterScope function f(a)
UseName a
UseName a
Return a
ExitScope function
DefineName function g
EnterScope function g()
UseName E
Literal string 'x'
CallExpression E('x')
RaiseStatement E('x')
ExitScope function
DefineName function h
EnterScope function h()
Return
ExitScope function
""",
    ),
    "literals": (
"""
a = 1.5
b = True
c = None
d = 'x'
""",
"""
DefineName variable a
Literal float 1.5
Assignment literal a = 1.5
DefineName variable b
Literal boolean True
Assignment literal b = True
DefineName variable c
Literal none None
Assignment literal c = None
DefineName variable d
Literal string 'x'
Assignment literal d = 'x'
""",
    ),
    "decorators": (
"""
@a
@b.c(1)
def f():
    pass
""",
"""
Decorator a
UseName a
Decorator b.c(1)
AttributeAccess b.c
Literal integer 1
CallExpression b.c(1)
DefineName function f
EnterScope function f()
ExitScope function
""",
    ),
    "matches": (
"""
match a:
    case 1:
        f()
    case _:
        g()
""",
"""
ControlBlock match a
UseName a
ElseBlock case 1
Literal integer 1
UseName f
CallExpression f()
ElseBlock case _
UseName g
CallExpression g()
EndControlBlock match
""",
    ),
    "walrus": (
"""
if (a := f()):
    pass
""",
"""
ControlBlock if a := f()
DefineName variable a
Assignment call a = f()
UseName f
CallExpression f()
EndControlBlock if
""",
    ),
    "comprehensions": (
"""
a = [b for b in c if d]
""",
"""
DefineName variable a
EnterScope comprehension <listcomp>()
ExitScope comprehension
UseName c
UseName d
UseName b
Assignment collection a = [b for b in c if d]
""",
    ),
    "lambdas": (
"""
a = lambda b, *c: b
""",
"""
DefineName variable a
DefineName function <lambda:1>
EnterScope lambda <lambda:1>(b, *c)
UseName b
UseName c
UseName b
ExitScope lambda
Assignment expression a = lambda b, *c: b
""",
    ),
    "augmented": (
"""
a = 1
a += b
""",
"""
DefineName variable a
Literal integer 1
Assignment literal a = 1
UseName a
UseName b
Assignment name a = b
""",
    ),
    "scopes_outside": (
"""
def f():
    global a
    def g():
        nonlocal b
""",
"""
DefineName function f
EnterScope function f()
DefineName global a
DefineName function g
EnterScope function g()
DefineName nonlocal b
ExitScope function
ExitScope function
""",
    ),
    "deletes": (
"""
del a
assert b, 'c'
""",
"""
UseName a
ControlBlock assert b
UseName b
Literal string 'c'
EndControlBlock assert
""",
    ),
    "yields": (
"""
def f():
    yield a
    yield from b
""",
"""
DefineName function f
EnterScope function f()
YieldExpression a
UseName a
YieldExpression b
UseName b
ExitScope function
""",
    ),
}

TYPESCRIPT = {
    "functions": (
"""
function f(a, b = 1, ...c) { return a }
async function* g() { yield 1 }
""",
"""
DefineName function f
EnterScope function f(a, b, ...c)
Literal integer 1
UseName a
Return a
ExitScope function
DefineName function g
EnterScope function g()
YieldExpression 1
Literal integer 1
ExitScope function
""",
    ),
    "arrows": (
"""
const f = (a) => { g(a) };
const h = function (b) { return b };
""",
"""
DefineName function f
EnterScope function f(a)
UseName a
CallExpression g(a)
ExitScope function
DefineName function h
EnterScope function h(b)
UseName b
Return b
ExitScope function
""",
    ),
    "classes": (
"""
class A extends B { x = 1; m(a) { this.n() } static s() {} }
""",
"""
DefineName class A
EnterScope class A() of B
DefineName variable x
Literal integer 1
Assignment literal x = 1
DefineName function m
EnterScope function m(a)
CallExpression self.n()
ExitScope function
DefineName function s
EnterScope function s()
ExitScope function
ExitScope class
""",
    ),
    "variables": (
"""
let a = 1, b = c;
var d = f();
const { e, g: h, ...i } = j;
const [k, l] = m;
""",
"""
DefineName variable a
Literal integer 1
Assignment literal a = 1
DefineName variable b
UseName c
Assignment name b = c
DefineName variable d
CallExpression f()
Assignment call d = f()
DefineName variable e
DefineName variable h
DefineName variable i
UseName j
Assignment name e = j
Assignment name h = j
Assignment name i = j
DefineName variable k
DefineName variable l
UseName m
Assignment name k = m
Assignment name l = m
""",
    ),
    "interfaces": (
"""
interface I { a: T; f(b): U }
""",
"""
DefineName interface I
EnterScope interface I()
DefineName variable a
UseName T
DefineName variable f
UseName U
ExitScope interface
""",
    ),
    "type_aliases": (
"""
type P = { a: string };
type Q = R;
""",
"""
DefineName interface P
EnterScope interface P()
DefineName variable a
UseName string
ExitScope interface
DefineName interface Q
UseName R
""",
    ),
    "enums": (
"""
enum E { A, B }
""",
"""
DefineName class E
EnterScope class E()
DefineName variable A
DefineName variable B
ExitScope class
""",
    ),
    "imports": (
"""
import d, { a as b, c } from 'x';
import * as n from './y';
import '../z';
import s from '@o/p/q';
import './w.css';
""",
"""
ImportStatement x(d, a, c) a as b
ImportStatement p.q.y(*) * as n
ImportStatement p.z()
ImportStatement @o.p.q(s)
ImportStatement ()
""",
    ),
    "reexports": (
"""
export { a as b } from './x';
export * from './y';
""",
"""
ImportStatement p.q.x(a) a as b
ImportStatement p.q.y(*)
""",
    ),
    "exports": (
"""
export const a = 1;
export default f(b);
""",
"""
DefineName variable a
Literal integer 1
Assignment literal a = 1
""",
    ),
    "calls": (
"""
f(g(1), a);
new A(b);
a.b.c(2);
""",
"""
Literal integer 1
CallExpression g(1)
UseName a
CallExpression f(g(1), a)
UseName b
CallExpression A(b)
Literal integer 2
CallExpression a.b.c(2)
""",
    ),
    "conditions": (
"""
if (a) { f() } else if (b) { g() } else { h() }
""",
"""
ControlBlock if a
UseName a
CallExpression f()
ElseBlock elif b
UseName b
CallExpression g()
ElseBlock else
CallExpression h()
EndControlBlock if
""",
    ),
    "loops": (
"""
while (a) { break }
do { f() } while (b);
for (const i of c) { g(i) }
for (let j = 0; j < 2; j++) { h() }
""",
"""
ControlBlock while a
UseName a
BreakStatement
EndControlBlock while
ControlBlock while
CallExpression f()
UseName b
EndControlBlock while
UseName c
DefineName variable i
UseName i
CallExpression g(i)
DefineName variable j
Literal integer 0
Assignment literal j = 0
UseName j
Literal integer 2
UseName j
CallExpression h()
""",
    ),
    "switches": (
"""
switch (a) { case 1: f(); break; default: g() }
""",
"""
ControlBlock match a
UseName a
ElseBlock case 1
Literal integer 1
CallExpression f()
BreakStatement
ElseBlock case
CallExpression g()
EndControlBlock match
""",
    ),
    "tries": (
"""
try { f() } catch (e) { g(e) } finally { h() }
""",
"""
ControlBlock try
CallExpression f()
ElseBlock except
DefineName variable e
UseName e
CallExpression g(e)
ElseBlock finally
CallExpression h()
EndControlBlock try
""",
    ),
    "throws": (
"""
function f() { throw new E('x') }
""",
"""
DefineName function f
EnterScope function f()
Literal string 'x'
CallExpression E('x')
RaiseStatement new E('x')
ExitScope function
""",
    ),
    "augmented": (
"""
let a = 1;
a += b;
a = c;
""",
"""
DefineName variable a
Literal integer 1
Assignment literal a = 1
UseName a
UseName b
Assignment name a = b
UseName a
UseName c
""",
    ),
    "members": (
"""
a.b.c;
""",
"""
AttributeAccess a.b.c
AttributeAccess a.b
UseName a
""",
    ),
    "value_kinds": (
"""
let a = 'x', b = f(), c = new D(), d = e, g = h.i, j = 1 + 2;
""",
"""
DefineName variable a
Literal string 'x'
Assignment literal a = 'x'
DefineName variable b
CallExpression f()
Assignment call b = f()
DefineName variable c
CallExpression D()
Assignment call c = new D()
DefineName variable d
UseName e
Assignment name d = e
DefineName variable g
AttributeAccess h.i
UseName h
Assignment attribute g = h.i
DefineName variable j
Literal integer 1
Literal integer 2
Assignment expression j = 1 + 2
""",
    ),
    "literals": (
"""
f(1, 'x', true, null, `t`);
""",
"""
Literal integer 1
Literal string 'x'
Literal boolean true
Literal null null
Literal string `t`
CallExpression f(1, 'x', true, null, `t`)
""",
    ),
}

RUST = {
    "items": (
"""
fn f(a: T) -> U { a }
struct S { x: T }
enum E { A, B(u8) }
trait R { fn g(&self); }
mod n { fn h() {} }
""",
"""
DefineName module m
UseName T
UseName U
DefineName function f
EnterScope function f(a)
UseName a
Return a
ExitScope function
DefineName class S
EnterScope class S()
DefineName variable x
UseName T
ExitScope class
DefineName class E
EnterScope class E()
DefineName variable A
DefineName variable B
UseName u8
ExitScope class
DefineName class R
EnterScope class R()
DefineName function g
EnterScope function g()
ExitScope function
ExitScope class
DefineName module n
DefineName function h
EnterScope function h()
ExitScope function
""",
    ),
    "impls": (
"""
struct S;
impl S { fn new() -> S { S } }
impl R for S { fn g(&self) {} }
""",
"""
DefineName module m
DefineName class S
EnterScope class S()
ExitScope class
EnterScope class S()
UseName S
DefineName function new
EnterScope function new()
UseName S
Return S
ExitScope function
ExitScope class
EnterScope class S() of R
DefineName function g
EnterScope function g()
ExitScope function
ExitScope class
""",
    ),
    "tuple_fields": (
"""
struct S(u8, T);
""",
"""
DefineName module m
DefineName class S
EnterScope class S()
DefineName variable 0
UseName u8
DefineName variable 1
UseName T
ExitScope class
""",
    ),
    "uses": (
"""
use a::b;
use a::{c, d::{e, f as g}};
use super::h;
use crate::i::*;
mod j;
""",
"""
DefineName module m
ImportStatement a(b)
ImportStatement a(c)
ImportStatement a.d(e)
ImportStatement a.d(f) f as g
ImportStatement p.q(h)
ImportStatement p.i(*)
ImportStatement p.q.j()
""",
    ),
    "lets": (
"""
fn f() { let a = 1; let (b, c) = g(); let mut d = e; d = 2; d += a; }
""",
"""
DefineName module m
DefineName function f
EnterScope function f()
DefineName variable a
Literal integer 1
Assignment literal a = 1
DefineName variable b
DefineName variable c
CallExpression g()
Assignment call b = g()
Assignment call c = g()
DefineName variable d
UseName e
Assignment name d = e
Literal integer 2
Assignment literal d = 2
UseName a
Assignment name d = a
ExitScope function
""",
    ),
    "if_lets": (
"""
fn f() { if let Some(a) = b { g(a) } else { h() } }
""",
"""
DefineName module m
DefineName function f
EnterScope function f()
ControlBlock if let Some(a) = b
DefineName variable a
UseName b
UseName a
CallExpression g(a)
ElseBlock else
CallExpression h()
EndControlBlock if
ExitScope function
""",
    ),
    "calls": (
"""
fn f() { g(1); S::new(a); a.b(c); println!("x", d); }
""",
"""
DefineName module m
DefineName function f
EnterScope function f()
Literal integer 1
CallExpression g(1)
UseName a
CallExpression S.new(a)
AttributeAccess a.b
UseName a
UseName c
CallExpression a.b(c)
Literal string "x"
UseName d
CallExpression println("x", d)
ExitScope function
""",
    ),
    "panics": (
"""
fn f() { panic!("x") }
""",
"""
DefineName module m
DefineName function f
EnterScope function f()
Literal string "x"
RaiseStatement panic!("x")
Return panic!("x")
ExitScope function
""",
    ),
    "matches": (
"""
fn f(a: u8) { match a { 0 => g(), _ => h() } }
""",
"""
DefineName module m
UseName u8
DefineName function f
EnterScope function f(a)
ControlBlock match a
UseName a
ElseBlock case 0
CallExpression g()
ElseBlock case _
CallExpression h()
EndControlBlock match
ExitScope function
""",
    ),
    "loops": (
"""
fn f() { for i in a { g(i); } while b { break; } loop { continue; } }
""",
"""
DefineName module m
DefineName function f
EnterScope function f()
ControlBlock for i in a
DefineName variable i
UseName a
UseName i
CallExpression g(i)
EndControlBlock for
ControlBlock while b
UseName b
BreakStatement
EndControlBlock while
ControlBlock while true
ContinueStatement
EndControlBlock while
ExitScope function
""",
    ),
    "returns": (
"""
fn f() -> u8 { return 1; }
fn g() -> u8 { h()? }
""",
"""
DefineName module m
UseName u8
DefineName function f
EnterScope function f()
Literal integer 1
Return 1
ExitScope function
UseName u8
DefineName function g
EnterScope function g()
CallExpression h()
Return ?
Return h()
ExitScope function
""",
    ),
}

#: Edges as from, to, type, by the texts of nodes.
FLOW = {
    "parameters": (
"""
def f(a, *b):
    return a
""",
"""
a -> *b : flow
*b -> return a : flow
""",
    ),
    "literals": (
"""
def f():
    g(1, 'x', k=True, a=b)
""",
"""
1 -> g(1, 'x', k=True, a=b) : data
'x' -> g(1, 'x', k=True, a=b) : data
k=True -> g(1, 'x', k=True, a=b) : data
""",
    ),
    "raises": (
"""
def f():
    raise E('x')
    g()
""",
"""
'x' -> E('x') : data
E('x') -> raise E('x') : flow
""",
    ),
    "breaks": (
"""
def f(a):
    for i in a:
        if i:
            break
        if a:
            continue
        g()
    h()
""",
"""
a -> i in a : flow
i in a -> i : true_branch
i -> break : true_branch
i -> a : false_branch
a -> continue : true_branch
continue -> i in a : back_edge
a -> g() : false_branch
g() -> i in a : back_edge
i in a -> h() : false_branch
break -> h() : flow
""",
    ),
    "branches": (
"""
def f(a, b):
    if a:
        g()
    elif b:
        h()
    else:
        i()
    j()
""",
"""
a -> b : flow
b -> a : flow
a -> g() : true_branch
a -> b : false_branch
b -> h() : true_branch
b -> i() : false_branch
g() -> j() : flow
h() -> j() : flow
i() -> j() : flow
""",
    ),
    "loops": (
"""
def f(a):
    while a:
        g()
    else:
        h()
    i()
""",
"""
a -> a : flow
a -> g() : true_branch
g() -> a : back_edge
a -> h() : false_branch
h() -> i() : flow
""",
    ),
    "tries": (
"""
def f():
    try:
        g()
    except E:
        h()
    with i() as j:
        k()
""",
"""
g() -> h() : flow
h() -> i() : flow
i() -> k() : flow
""",
    ),
    "matches": (
"""
def f(a):
    match a:
        case 1:
            g()
        case _:
            h()
    i()
""",
"""
a -> a : flow
a -> 1 : false_branch
1 -> g() : true_branch
1 -> _ : false_branch
_ -> h() : true_branch
g() -> i() : flow
h() -> i() : flow
_ -> i() : false_branch
""",
    ),
}
