"""Blanking of types: which spans go, and that everything else and every place stays."""

import pytest

from weirflow.functions.flow import blanked

F = "// @flow\n"


GONE = [
    ("function g(a: ?number) { return a; }", ": ?number"),
    ("function g(o: {[string]: mixed}, p) { return o; }", ": {[string]: mixed}"),
    ("function g(): ?number { return 1; }", ": ?number"),
    ("function g(): { a: ?T } { return h({ b: 1 }); }", ": { a: ?T }"),
    ("let b: ?T = h(), c: U = 1;", ": ?T", ": U"),
    (F + "for (const k: string of ks) { k; }", ": string"),
    ("opaque type Key = string;", "opaque type Key = string;"),
    ("type P = { a?: ?string };\nrun();", "type P = { a?: ?string };"),
    (F + "export type P = { a: string };\nrun();", "export type P = { a: string };"),
    (F + "declare export type T = string;\nrun();", "declare export type T = string;"),
    (F + "declare var x: number;\nrun();", "declare var x: number;"),
    (F + "type U =\n  | 'a'\n  | 'b'\nrun();", "type U =\n  | 'a'\n  | 'b'"),
    (F + "const a = (b: any);", ": any"),
    (F + "n = Object.keys((s.t: any)).length;", ": any"),
    (F + "const c = ({ ...d, e: 1 }: T);", ": T"),
    (F + "class Box<T: Object> { v: ?T; static w: ?U = 1; m<K: { [k: string]: any }>(a: K): ?T { return a; } }", "<T: Object>", ": ?T", ": ?U", "<K: { [k: string]: any }>", ": K", ": ?T"),
    (F + "class C {\n  // note: this\n  p: ?string;\n  q = { r: 1 };\n}", ": ?string"),
    (F + "const f = (a: T, b?: U = 1): ?V => ({ w: a });", ": T", ": U", ": ?V"),
    (F + "f((x: ?T) => x ? { a: 1 } : y);", ": ?T"),
    (F + "const o = { m(a: T): U { return a; }, k: 1 };", ": T", ": U"),
    (F + "function isS(x: mixed): boolean %checks { return !!x; }", ": mixed", ": boolean", "%checks"),
    (F + "import type X from './y';\nconst a: ?T = g();", ": ?T"),
    (F + "import { type C } from './c';\nfunction r(c: ?string) { x.exec(c); }", ": ?string"),
]
STAY = [
    "const a = c ? x : y;", "const o = { a: 1, b: { d: 2 } };", "f(c ? 1 : 2, d);", "outer: for (;;) { break outer; }", "switch (x) { case 1: y(); break; default: z(); }",
    "const u = 'http://x';", "const u = `a:${b ? `c:${d}` : 1}`;", "f({ a: 1 });", "const r = c ? g({}) : h();", "const r = x < y ? 1 : 2;", "if (a) { b(); }\nconst o = { k: 1 };", "const c = (type as U);\nnext();",
    "render(request, type, props);\nnext();", "const t = 1;\na<b ? c : d>e;", "const x = /a: ?b/.test(y) ? 1 : 2;", "type = 1;\nrun(type);", "return_({ a: b ? (c) : d });", "const p = q ? (r) : (s) => t;", "export { type C } from './c';", "const o = { type, opaque: 1 };",
]


@pytest.mark.parametrize("text, spans", [(t, s) for t, *s in GONE])
def test_types_go(text, spans):
    got = blanked(text)
    want, at = text, 0
    for s in spans:  # one after another
        i = want.index(s, at)
        want, at = want[:i] + "".join(c if c in "\r\n" else " " for c in s) + want[i + len(s) :], i + len(s)
    assert got == want and len(got) == len(text)


@pytest.mark.parametrize("text", STAY)
def test_values_stay(text):
    assert blanked(F + text) == F + text


def test_what_does_not_read_is_left_alone():
    assert blanked("function f(a: ?T { }") == "function f(a: ?T { }" and blanked("const a: ?T = 'x") == "const a: ?T = 'x"
    assert blanked("function f(a: T) {}") == "function f(a: T) {}"  # no mark of Flow
