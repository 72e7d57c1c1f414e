"""A vulnerable sample and a safe twin for every shipped rule: as source where there is a frontend, and for all rules as a
program made of their own patterns."""

import json

import pytest

from weirflow.functions.globs import matches
from weirflow.operators import engine
from weirflow.rules import shipped
from weirflow.sources import js_frontend, python_frontend

PY = "import os, subprocess, requests, flask, pickle, jinja2, hashlib, tempfile, markupsafe, shlex, ast, tarfile, html\nfrom flask import request\n"
Q = "request.args.get('q')"
PYTHON = {
    "py-sql-injection": (f"def f(c):\n    c.execute('select ' + {Q})", f"def f(c):\n    c.execute('select %s', ({Q},))"),
    "py-command-injection": (f"def f():\n    os.system('ls ' + {Q})", f"def f():\n    os.system('ls ' + shlex.quote({Q}))"),
    "py-path-traversal": (f"def f():\n    return open('/data/' + {Q})", f"def f():\n    return open('/data/' + os.path.basename({Q}))"),
    "py-ssrf": (f"def f():\n    requests.get({Q})", f"def f():\n    requests.get('https://a.example/' + {Q})"),
    "py-open-redirect": (f"def f():\n    return flask.redirect({Q})", f"def f():\n    return flask.redirect('https://a.example/' + {Q})"),
    "py-xss": (f"def f():\n    return markupsafe.Markup({Q})", f"def f():\n    return markupsafe.Markup(html.escape({Q}))"),
    "py-deserialization": (f"def f():\n    return pickle.loads({Q})", "def f():\n    return pickle.loads(b'x')"),
    "py-code-injection": (f"def f():\n    eval({Q})", f"def f():\n    ast.literal_eval({Q})"),
    "py-template-injection": (f"def f():\n    return jinja2.Template({Q})", f"def f():\n    return jinja2.Template('x').render(x={Q})"),
    "py-ldap-injection": (f"def f(c):\n    c.search_s('dc', 2, '(uid=' + {Q} + ')')", f"def f(c):\n    c.search_s('dc', 2, '(uid=' + c.escape_filter_chars({Q}) + ')')"),
    "py-xpath-injection": (f"def f(t):\n    t.xpath('//a[' + {Q} + ']')", f"def f(t):\n    t.xpath('//a[$x]', x={Q})"),
    "py-zip-slip": (f"def f():\n    tarfile.open('a.tar').extractall({Q})", f"def f():\n    tarfile.open('a.tar').extractall('/tmp')\n    len({Q})"),
    "py-insecure-tls": ("def f():\n    requests.get('https://a', verify=False)", "def f():\n    requests.get('https://a', verify=True)"),
    "py-debug-server": ("def f(app):\n    app.run(debug=True)", "def f(app):\n    app.run(debug=False)"),
    "py-shell-true": ("def f(x):\n    subprocess.run(x, shell=True)", "def f(x):\n    subprocess.run(x)"),
    "py-weak-hash": ("def f():\n    hashlib.md5(b'')", "def f():\n    hashlib.sha256(b'')"),
    "py-weak-hash-name": ("def f():\n    hashlib.new('SHA1')", "def f():\n    hashlib.new('sha256')"),
    "py-temp-name": ("def f():\n    tempfile.mktemp()", "def f():\n    tempfile.mkstemp()"),
}
JS = "const cp = require('child_process'), fs = require('fs'), http = require('http'), ns = require('node-serialize'), crypto = require('crypto'), path = require('path');\n"
X = "req.query.q"
JAVASCRIPT = {
    "js-sql-injection": (f"function f(req, db) {{ db.query(`select ${{{X}}}`); }}", f"function f(req, db) {{ db.query('select ?', [{X}]); }}"),
    "js-command-injection": (f"function f(req) {{ cp.exec('ls ' + {X}); }}", f"function f(req) {{ cp.execFile('ls', [{X}]); }}"),
    "js-path-traversal": (f"function f(req) {{ fs.readFile('/d/' + {X}, g); }}", f"function f(req) {{ fs.readFile('/d/' + path.basename({X}), g); }}"),
    "js-ssrf": (f"function f(req) {{ http.get({X}); }}", f"function f(req) {{ http.get('http://a.example/' + {X}); }}"),
    "js-open-redirect": (f"function f(req, res) {{ res.redirect({X}); }}", f"function f(req, res) {{ res.redirect('https://a.example/' + {X}); }}"),
    "js-xss": (f"function f(req, res) {{ res.send('<p>' + {X}); }}", f"function f(req, res) {{ res.send('<p>' + escapeHtml({X})); }}"),
    "js-deserialization": (f"function f(req) {{ ns.unserialize({X}); }}", f"function f(req) {{ JSON.parse({X}); }}"),
    "js-code-injection": (f"function f(req) {{ eval({X}); }}", f"function f(req) {{ eval('1'); g({X}); }}"),
    "js-weak-hash": ("function f() { crypto.createHash('md5'); }", "function f() { crypto.createHash('sha256'); }"),
}


def found(functions):
    rules = shipped()
    rows = engine.analyze(functions, rules).select("rule_id", "fn").collect() + engine.dangerous(functions, rules).select("rule_id", "fn").collect()
    return {(r.rule_id, r.fn) for r in rows}


@pytest.mark.parametrize("frontend, head, samples, suffix", [(python_frontend, PY, PYTHON, "py"), (js_frontend, JS, JAVASCRIPT, "js")])
def test_samples(spark, frontend, head, samples, suffix):
    ids = [r.id for r in shipped() if r.id.startswith(f"{suffix}-")]
    assert sorted(ids) == sorted(samples)
    files = [(f"{kind}{k}.{suffix}", head + pair[n]) for k, pair in enumerate(samples.values()) for n, kind in enumerate(("bad", "good"))]
    low = frontend.lower(spark.createDataFrame(files, "path string, text string")).cache()
    assert not low.where("error IS NOT NULL").count()
    got = found(python_frontend.functions(low))
    sep = "." if suffix == "py" else "."
    missed = [r for k, r in enumerate(samples) if (r, f"{suffix}:bad{k}{sep}f") not in got]
    false = sorted(x for x in got if x[1].startswith(f"{suffix}:good"))
    assert not missed and not false


def concrete(glob):
    return glob.replace("*", "x")


def test_every_rule_on_a_program_of_its_patterns(spark):
    rows, want = [], set()

    def add(fn, rule, instrs):
        lang = rule.languages[0] if rule.languages else "go"
        rows.append((fn, "", lang, True, json.dumps({"params": [], "blocks": [{"index": 0, "preds": [], "succs": [], "instrs": instrs}], "seeds": {}}), [], [], False))

    def call(k, callee, *args, fn, name=None):
        return {"op": "CALL", "id": f"{fn}:{k}", "callee": callee, "args": list(args), **({"name": name} if name else {})}

    for r in shipped():
        kinds = {"string": ["const", "plain", "string"]}
        if r.kind == "taint":
            for s, sink in enumerate(r.sinks):
                for n, source in enumerate(r.sources[:1]):
                    name, from_ = concrete(sink.pattern), concrete(source)
                    if r.is_("sources", name) or r.is_("sanitizers", name) or r.sink(from_) or r.sink(name) != type(sink)(sink.pattern, sink.args, sink.when or r.when):
                        continue
                    at = sink.args or (0,)
                    args = [["reg", "a"] if k in at else kinds["string"] for k in range(max(at) + 1)]
                    bad, good = f"{r.id}/bad/{s}", f"{r.id}/good/{s}"
                    add(bad, r, [call(0, from_, fn=bad, name="a"), call(1, name, *args, fn=bad)])
                    add(good, r, [call(0, from_, fn=good, name="a"), call(1, name, *[kinds["string"]] * len(args), fn=good)])
                    if sink.when is None or "hostFixed" in sink.when or "Tainted" in sink.when:
                        want.add((r.id, bad))
        elif r.kind == "dangerous-call" and not r.when:
            fn = f"{r.id}/bad/0"
            at, text = (r.const_arg[0], {"(?i)^(md5|sha1)$": "MD5", "(?i)^(md5|sha-?1)$": "sha-1", "(?i)^(des|rc4|.*/ecb/)": "AES/ECB/NoPadding"}[r.const_arg[1]]) if r.const_arg else (0, "x")
            add(fn, r, [call(0, concrete(r.callees[0]), *[["const", text, "string"]] * (at + 1), fn=fn)])
            want.add((r.id, fn))
            if r.const_arg:
                fn = f"{r.id}/good/0"
                add(fn, r, [call(0, concrete(r.callees[0]), *[["const", "sha512", "string"]] * (at + 1), fn=fn)])
    got = found(spark.createDataFrame(rows, engine.FUNCTION))
    own = {(i, fn) for i, fn in got if fn.split("/")[0] == i}
    assert {x for x in own if "/bad/" in x[1]} >= want and not {x for x in own if "/good/" in x[1]}
    covered = {i for i, _ in want}
    assert {r.id for r in shipped() if not r.id.startswith(("py-", "js-"))} <= covered and len(covered) > 50
    assert matches("x", "*")
