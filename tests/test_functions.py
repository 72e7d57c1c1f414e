import re

import pytest
from pyspark.sql import functions as F

from weirflow.functions import globs, scalars
from weirflow.functions.guards import Arg, Guard
from weirflow.rules import Rule, RuleError, Sink, build, shipped

GLOBS = [
    ("a*b", "ab", True), ("a*b", "a/x:y.b", True), ("a*b", "abc", False), ("aa*aa", "aaa", False), ("aa*aa", "aaaa", True), ("", "", True), ("", "x", False),
    ("*", "", True), ("*", "anything", True), ("x*", "xy", True), ("x*", "yx", False), ("*x", "yx", True), ("*mid*", "amidb", True), ("*mid*", "am-id", False),
    ("a*b*c", "a1b2c", True), ("a*b*c", "a1c2b", False), ("**x**", "wxy", True), ("a.b", "a.b", True), ("a.b", "axb", False), ("a[1]*", "a[1]z", True), ("a?*", "ab", False), ("*\n*", "a\nb", True),
    ("a*b*", "acb", True), ("*a*b", "xaxb", True), ("ab*ba", "aba", False),
]


@pytest.mark.parametrize("pattern,name,want", GLOBS)
def test_glob(pattern, name, want):
    assert globs.matches(name, pattern) == want


def test_glob_columns_agree(spark):
    d = spark.createDataFrame([(n,) for _, n, _ in GLOBS] + [(None,)], "n string")
    for p, _, _ in GLOBS:
        got = {r.n: r.y for r in d.select("n", globs.predicate(F.col("n"), p).alias("y")).collect()}
        assert all(bool(got[n]) == globs.matches(n, p) for _, n, _ in GLOBS), p
        assert not got[None]


def A(s="", whole=True, **k):
    return Arg(String=s, Complete=whole, **k)


GUARDS = [
    (None, [], True), ("", [], True), ('arg[0].String == "x"', [A("x")], True), ('arg[3].String == "x"', [A("x")], False), ("arg[0].Complete and not arg[0].Tainted", [A("x")], True),
    ('arg[0].String matches "^a+$"', [A("aaa")], True), ('arg[0].String in ["a", "b"]', [A("b")], True), ('arg[0].String not in ["a", "b"]', [A("b")], False), ("len(arg) >= 2 || arg[0].Tainted", [A("x")], False),
    ('kwargs.shell.String == "True"', [A("True", Name="shell")], True), ('kwargs.shell.String == "True"', [A("x")], False), ('kwargs["shell"].String == "True"', [A("True", Name="shell"), A("False", Name="shell")], True),
    ("all(arg, {.Complete})", [A("x"), A("y")], True), ("any(arg, {.Tainted})", [A("x")], False), ("len(filter(arg[0].Elems, {.Complete})) == 1", [A(Elems=[A("a"), A("b", False)])], True),
    ('arg[0].Entries["k"].String == "v"', [A(Entries={"k": A("v")})], True), ("hostFixed(arg[0])", [A("https://h/<DYN>", False)], True), ("hostFixed()", [A("https://<DYN>", False, Tainted=True)], False),
    ("hostFixed()", [A("https://h/<DYN>", False, Tainted=True), A("x")], True), ("not hostFixed()", [A("<DYN>", False, Tainted=True)], True), ("arg[0].String", [A("x")], False), ("arg[0]..", [A("x")], False), ("nothing(1)", [], False), ("arg[0].Nope", [A()], False),
]


@pytest.mark.parametrize("text,args,want", GUARDS)
def test_guard(text, args, want):
    assert Guard(text).holds(args) is want


HOSTS = [("https://h/x", True), ("https://h/<DYN>", True), ("https://h<DYN>", False), ("<DYN>", False), ("https://<DYN>/x", False), ("http://h?q=<DYN>", True), ("/local/<DYN>", False), ("ftp+x://h#f", True), ("https://h\\<DYN>", True), ("https:///<DYN>", False)]
SKELETONS = [("a %s b", "a <DYN> b"), ("%5.2f|%d", "<DYN>|<DYN>"), ("100%%", "100%"), ("{} {name}", "<DYN> <DYN>"), ("{{x}}", "{x}"), ("open {x", "open <DYN>"), ("tail %", "tail <DYN>"), ("", ""), ("%%s {{{}}}", "%s {<DYN>}")]


def test_hosts_and_skeletons_agree_on_both_sides(spark):
    for s, want in HOSTS:
        assert scalars.is_host_fixed(s) == want
    got = spark.createDataFrame(HOSTS, "s string, w boolean").select("w", scalars.host_fixed(F.col("s")).alias("g")).collect()
    assert all(r.w == r.g for r in got)
    for s, want in SKELETONS:
        assert scalars.skeleton(s) == want
    got = spark.createDataFrame(SKELETONS, "s string, w string").select("s", "w", scalars.template_skeleton(F.col("s")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_scalars(spark):
    d = spark.createDataFrame([("r", "a/b.py", 3, 4, "Critical", "go:x/y.T.m"), ("r", "a/b.py", None, 4, "nope", "f")], "rule string, file string, line int, col int, sev string, name string")
    r = d.select(
        scalars.position(F.col("file"), F.col("line"), F.col("col")).alias("pos"), scalars.severity_rank(F.col("sev")).alias("rank"), scalars.trailing_name(F.col("name")).alias("tail"), scalars.owner_class(F.col("name")).alias("cls"),
        scalars.fingerprint(F.col("rule"), F.col("file")).alias("fp"), scalars.module_name(F.col("file")).alias("mod"), scalars.sarif_level(F.col("sev")).alias("level"), scalars.relative(F.col("file"), "a/").alias("rel"),
    ).collect()
    assert (r[0].pos, r[1].pos) == ("a/b.py:3:4", "<unknown>") and (r[0].rank, r[1].rank) == (5, 0) and r[0].tail == "m" and r[0].cls == "T"
    assert r[0].fp == r[1].fp and re.fullmatch("[0-9a-f]{16}", r[0].fp) and r[0].mod == "a/b" and r[0].level == "error" and r[1].level == "none" and r[0].rel == "b.py"


def test_sink_specs():
    assert Sink.parse("a.b#0,2") == Sink("a.b", (0, 2)) and Sink.parse("a") == Sink("a") and Sink.parse({"match": "a#1", "when": "true"}).when == "true"
    for bad in ("a#", "a#x", "a#1,", "#1"):
        with pytest.raises(RuleError):
            Sink.parse(bad)


def test_rules_merge_and_are_checked():
    base = {"web": {"sources": ["s1", "s2"], "when": "true"}}
    r = build([{"id": "a", "extend": ["web"], "sources": ["s2", "s3"], "sinks": ["k"]}], base, ["p"])[0]
    assert r.sources == ["s1", "s2", "s3"] and r.when == "true" and r.propagators == ["p"] and r.sink("k").when == "true"
    for bad in (
        [{"id": "a", "sources": ["s"], "sinks": ["k"]}] * 2, [{"id": "a", "sources": ["s"]}], [{"id": "a", "sources": ["s"], "sinks": ["k"], "when": "(("}], [{"id": "a", "sources": ["s"], "sinks": ["k"], "severity": "huge"}],
        [{"id": "a", "extend": ["none"], "sources": ["s"], "sinks": ["k"]}], [{"id": "", "sources": ["s"], "sinks": ["k"]}],
    ):
        with pytest.raises(RuleError):
            build(bad, base)
    assert Rule("x", languages=["Go"]).speaks("go") and not Rule("x", languages=["go"]).speaks("java") and len(shipped()) > 50


def test_spread_keys_fill_every_partition(spark):
    from weirflow.session import spread_keys

    for n in (1, 4, 49, 200):
        d = spark.createDataFrame([(k,) for k in spread_keys(n)], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("p"))
        assert sorted(r.p for r in d.collect()) == list(range(n))
