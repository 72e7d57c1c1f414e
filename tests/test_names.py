"""Names, places and replies, one by one."""

import pytest
from pyspark.sql import functions as F

from weirflow.functions import scalars
from weirflow.operators import closure, names
from weirflow.sources import mir_frontend


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("path, plain", [
    ("Result::<String, VarError>::unwrap", "Result::unwrap"), ("Command::arg::<&str>", "Command::arg"), ("<T as A<B<C>>>::m", "m"), ("a>b", "ab"), ("a<b", "a"), ("", ""), ("::x::", "x"), ("plain", "plain"), ("a:::b", "a::b"),
])
def test_plain_name(spark, path, plain):
    assert one(spark, scalars.plain_name(F.lit(path))) == plain == mir_frontend.plain(path)


def test_line_and_column(spark):
    text = "aé\r\nb\n\nc\rd"
    raw = text.encode()
    want, line, start = {}, 1, 0
    k = 0
    while k <= len(raw):
        want[k] = (line, k - start + 1)
        if raw[k : k + 2] == b"\r\n":
            want[k + 1] = (line, k + 2 - start)
            k += 1
        if raw[k : k + 1] in (b"\r", b"\n"):
            line, start = line + 1, k + 1
        k += 1
    at = scalars.line_and_column(F.lit(text), F.col("id").cast("int"))
    got = {r.id: (r.l, r.c) for r in spark.range(len(raw) + 1).select("id", at[0].alias("l"), at[1].alias("c")).collect()}
    assert got == want


@pytest.mark.parametrize("text, params", [("(Ljava/lang/String;I[B)V", ["Ljava/lang/String;", "I", "[B"]), ("()V", []), ("([[JD)I", ["[[J", "D"]), ("nonsense", []), ("(Lx", []), ("(ILx)V", ["I"]), ("([)V", [])])
def test_descriptor_params(spark, text, params):
    assert one(spark, scalars.descriptor_params(F.lit(text))) == params


@pytest.mark.parametrize("reply, drops", [
    ('x {"verdict": "false_positive"} y', True), ('{"verdict": " FALSE-positive "}', True), ("false_positive", False), ('{"verdict": "false"}', False), ('{"verdict": "fp"', False), ("", False), ('{"a": {"verdict": "false_positive"}}', False), ("} {", False),
])
def test_verdicts(spark, reply, drops):
    assert one(spark, scalars.false_positive(F.lit(reply))) is drops
    assert ((scalars.verdict(reply) or "").strip().lower() in ("false_positive", "false-positive")) is drops


@pytest.mark.parametrize("token, text", [
    (r'const b"\x03ab \xc0\x01!"', "ab {}!"), (r'b"\x02\n\"\xc0"', '\n"{}'), (r'b"\xc1zz"', "{}"), (r'b"\x05ab"', None), ("plain", None), (r'b"\q"', None), (r'b"\x01\xff"', None), ('b""', ""),
])
def test_rust_format(token, text):
    assert scalars.rust_format(token) == text


def test_strings_for_readers(spark):
    shown = [one(spark, scalars.humanised(F.lit(n))) for n in (0, 1023, 1536, 3 << 20, 5 << 30)]
    assert shown == ["0 B", "1023 B", "1.5 KB", "3.0 MB", "5.0 GB"]
    assert [one(spark, scalars.first_sentence(F.lit(t))) for t in ("One. Two.", "v1.2 is out! Yes", "none", "End.")] == ["One.", "v1.2 is out!", "none", "End."]


def test_imports_take_the_whole_path_first(spark):
    f = spark.createDataFrame([("py:a/pkg/mod.fn", "py", "a.pkg.mod.fn"), ("py:pkg/mod.fn", "py", "pkg.mod.fn"), ("py:x/one.g", "py", "x.one.g"), ("py:y/one.g", "py", "y.one.g"), ("py:top", "py", "top"), ("js:x.one.g", "js", "x.one.g")], "target string, scope string, path string")
    c = spark.createDataFrame([(p, "py", p) for p in ("pkg.mod.fn", "mod.fn", "site.x.one.g", "one.g", "top", "z.pkg.mod.fn", "execute")], "callee string, scope string, path string")
    got = {r.callee: r.target for r in names.import_targets(f, c.union(c)).collect()}
    assert got == {"pkg.mod.fn": "py:pkg/mod.fn", "site.x.one.g": "py:x/one.g", "z.pkg.mod.fn": "py:pkg/mod.fn"}


def test_markers(spark):
    calls = spark.createDataFrame([("@default:lib/a",), ("@default:lib/b",), ("plain",), (None,)], "callee string")
    exports = spark.createDataFrame([("lib/a", "js:lib/a.run"), ("lib/a", "js:lib/a.run"), ("lib/b", "p"), ("lib/b", "q")], "module string, target string")
    assert sorted(str(r.callee) for r in names.default_exports(calls, exports).collect()) == ["None", "js:b", "js:lib/a.run", "plain"]
    calls = spark.createDataFrame([("@cell:app/cells/foo/show|name",), ("@cell:app/cells/foo/show|raw",), ("@cell:app/cells/foo/show|two",), ("plain",)], "callee string")
    methods = spark.createDataFrame([("app/cells/foo_cell", "name", "ruby:Foo.name"), ("app/cells/foo_cell", "two", "a"), ("app/cells/foo_cell", "two", "b")], "module string, method string, target string")
    assert sorted(r.callee for r in names.cell_calls(calls, methods).collect()) == ["plain", "ruby:Foo.name", "ruby:raw", "ruby:two"]


def test_summaries_are_the_closure_of_each_function(spark):
    """The vectorised summaries against sets, also with operands that nothing defines and places that aren't dense."""
    import random

    r = random.Random(5)
    rows = []
    for fn in range(200):
        at = sorted(r.sample(range(1, 60), r.randrange(1, 12)))
        rows += [(fn, s, r.randrange(14), r.choice([0, 0, *[x for x in at if x < s], 77]), r.randrange(9)) for s in at]
    got = {(x.fn, x.from_entry): (x["keys"], x.callees, x.sinks) for x in closure.summaries(spark.createDataFrame(rows, "fn long, seq long, k long, opnd long, callee_fn long")).collect()}
    want = {}
    for fn in range(200):
        own = [x for x in rows if x[0] == fn]
        for entry in (False, True):
            hot = {0} if entry else {s for _, s, k, *_ in own if k == 0}
            for _, s, k, o, _ in own:
                if k not in (0, 3) and o in hot:
                    hot.add(s)
            if hot:
                want[fn, entry] = (sorted(hot), sorted({c for _, _, k, o, c in own if 4 <= k <= 7 and o in hot}), [s for _, s, k, o, _ in own if k in (1, 2) and s in hot and o in hot])
    assert got == want
