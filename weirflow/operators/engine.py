"""Taint between functions: rounds of the kernel over the functions whose facts changed.

All rules run together. A fact is addressed to a function: (rule_id, fn, kind, key,
origin), where kind is

- param: a parameter that a call gives a tainted value, by number;
- ret, mem, sink: a callee that returns taint, writes it through a parameter, or
  hands a parameter on to a sink (key callee or callee#parameter), for its callers;
- global: a global that some function stores taint to, for its readers;
- func, opaque: function values, and unknown ones, that a parameter may hold.

The first origin of a fact stays (least round, then least origin), so rounds end.
Rounds are breadth-first; the set of (rule, sink) is what is defined, an origin only
where it is the only one. A parameter that holds one function in an early round and
two in a later one has passed on what the first call did; that isn't taken back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.globs import matches
from weirflow.functions.guards import Arg, Guard
from weirflow.operators import names
from weirflow.operators.kernel import Kernel
from weirflow.rules import Rule
from weirflow.session import written

#: A function of the program: body is JSON of what the kernel reads; calls, reads and indirect are what rounds join on.
FUNCTION = "fn string, method_name string, lang string, is_target boolean, body string, calls array<struct<id:string,callee:string,method_name:string,untyped:boolean>>, reads array<string>, indirect boolean"
_OUT = "rule_id string, fn string, kind string, to string, key string, origin string, path string, callee string, confidence string"


def resolved(functions: DataFrame) -> DataFrame:
    """(fn, id, target) of every call that has a known target: by key, by the one key that ends in the name, or by
    method name, which for a call without types must be the only one of that name."""
    calls = functions.select("fn", F.explode("calls").alias("c")).select("fn", "c.*")
    keys = functions.select(F.col("fn").alias("target"), "method_name", "lang")
    calls = written(calls.join(keys.select("target"), calls["callee"] == keys["target"], "left"))
    exact = calls.where("target IS NOT NULL").select("fn", "id", "target")
    rest = written(calls.where("target IS NULL").drop("target").join(exact.select("id"), "id", "left_anti"))
    if rest.isEmpty():
        return exact.distinct()
    scope = lambda c: F.substring_index(c, ":", 1).alias("scope")
    path = lambda c: F.translate(F.substring_index(c, ":", -1), "/", ".").alias("path")
    one = names.import_targets(keys.select("target", scope("target"), path("target")), rest.select("callee", scope("callee"), path("callee")))
    tail = rest.join(one, "callee").select("fn", "id", "target")
    rest = rest.join(tail.select("id"), "id", "left_anti").where("method_name <> ''")
    named = keys.where("method_name <> ''").select("method_name", "target")
    only = named.groupBy("method_name").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    typed, untyped = rest.where("NOT untyped").join(named, "method_name"), rest.where("untyped").join(only, "method_name")
    every = [d.select("fn", "id", "target") for d in (exact, tail, typed, untyped)]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).distinct()


#: Up to so many names select rows of a large table by a broadcast of their hashes, 8 bytes each.
MOST = 500_000


def near(rows: DataFrame, wanted: DataFrame, key: str, n: int) -> DataFrame:
    """rows without most of those that a join with the n rows of ``wanted`` by ``key`` would drop, so that the join
    doesn't shuffle a large table for a few rows. The hashes only select; the join is by the key itself."""
    if n > MOST:
        return rows
    hashes = wanted.select(F.xxhash64(key).alias("_h")).distinct()
    return rows.join(F.broadcast(hashes), F.xxhash64(rows[key]) == hashes["_h"], "left_semi")


def analyze(functions: DataFrame, rules: list[Rule], scope: DataFrame | None = None) -> DataFrame:
    """(rule_id, fn, sink, callee, origin, steps, confidence, severity, cwe, message), one for each rule and sink; steps are
    the places from the origin to the sink.

    scope: (fn) to which seeding is limited; what it reaches is followed everywhere."""
    spark = functions.sparkSession
    taint = [r for r in rules if r.kind == "taint"]
    sent = spark.sparkContext.broadcast(taint)  # rules, not data
    calls = written(resolved(functions))
    targets = calls.groupBy("fn").agg(F.collect_list(F.struct("id", "target")).alias("targets"))
    passes = calls.join(functions.where("indirect").select(F.col("fn").alias("target")), "target", "left_semi").groupBy("fn").agg(F.collect_set("id").alias("passes"))
    bodies = written(functions.select("fn", "lang", "is_target", "body").join(targets, "fn", "left").join(passes, "fn", "left"))
    callers = written(calls.select(F.col("target").alias("src"), "fn").distinct())
    readers = written(functions.select("fn", F.explode("reads").alias("key")).distinct())

    def rows_of(k: Kernel, rule: str, fn: str) -> list[tuple[str, ...]]:
        found = [(rule, fn, "finding", "", x["sink"], x["origin"], "\n".join(x["steps"]), x["callee"], x["confidence"]) for x in k.findings]
        return found + [(rule, fn, kind, to, key, o, path, "", "") for (kind, to, key, *_), (o, path) in k.out.items()]

    def batch(out: list[tuple[str, ...]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([o[c] for o in out], pa.string()) for c in range(9)], ["rule_id", "fn", "kind", "to", "key", "origin", "path", "callee", "confidence"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The functions that have a source, by the rules it is a source of: nothing is known of others yet."""
        having: dict[str, list[int]] = {}  # the rules that a name is a source of: a name is tested once a task
        for b in batches:
            out = []
            for at, (fn, lang, body) in enumerate(zip(*(b.column(c).to_pylist() for c in ("fn", "lang", "body")))):
                f = json.loads(body)
                hit: set[int] = set()
                for n in {i.get("callee") for x in f["blocks"] for i in x["instrs"] if i.get("callee")} | set(f.get("seeds", {}).values()):
                    if n not in having:
                        if len(having) >= 1 << 16:
                            having.clear()
                        having[n] = [k for k, r in enumerate(sent.value) if r.is_("sources", n)]
                    hit.update(having[n])
                rules = [sent.value[k] for k in sorted(hit) if sent.value[k].speaks(lang)]
                if rules:
                    f = prepared(b.slice(at, 1).to_pylist()[0], f)
                    for r in rules:
                        out += rows_of(Kernel(f, r, []).run(), r.id, fn)
            yield batch(out)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {r.id: r for r in sent.value}
        for b in batches:
            out, parsed, f = [], None, {}
            for row in b.to_pylist():
                if row["fn"] != parsed:  # the rules of a function come one after another
                    parsed, f = row["fn"], prepared(row)
                k = Kernel(f, by[row["rule_id"]], [(x["kind"], x["key"], x["origin"], x["path"]) for x in row["facts"] or []]).run()
                out += rows_of(k, row["rule_id"], row["fn"])
            yield batch(out)

    def prepared(row: dict, body: dict | None = None) -> dict:
        f = (body or json.loads(row["body"])) | {"key": row["fn"], "is_target": row["is_target"]}
        at: dict[str, list[str]] = {}
        for t in row["targets"] or []:
            at.setdefault(t["id"], []).append(t["target"])
        passes = set(row["passes"] or [])
        for x in f["blocks"]:
            for i in x["instrs"]:
                if i.get("id") in at:
                    i["targets"] = sorted(at[i["id"]])
                i["passes_on"] = i.get("id") in passes
        return f

    seeds = bodies.join(scope, "fn", "left_semi") if scope is not None else bodies
    out = written(seeds.mapInArrow(first, _OUT))
    facts = spark.createDataFrame([], "rule_id string, fn string, kind string, key string, origin string, path string")
    found, round_ = [], 0
    identity = ["rule_id", "fn", "kind", "key"]
    ways = [("param", "func", "opaque"), ("ret", "mem", "sink"), ("global",)]
    while True:
        found.append(out.where("kind = 'finding'").withColumn("round", F.lit(round_)))
        count = {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()}  # a row for each kind
        direct, up, wide = ((out.where(F.col("kind").isin(*w)), sum(count.get(k, 0) for k in w)) for w in ways)
        sends = []  # only what is there is joined: callers and readers are large
        if direct[1]:
            sends.append(direct[0].select("rule_id", F.col("to").alias("fn"), "kind", "key", "origin", "path"))
        if up[1]:
            u = up[0].withColumnRenamed("fn", "src")
            u = u.join(near(callers, u, "src", up[1]), "src")
            sends.append(u.select("rule_id", "fn", "kind", F.when(F.col("kind") == "ret", F.col("src")).otherwise(F.concat_ws("#", "src", "key")).alias("key"), "origin", "path"))
        if wide[1]:
            g = wide[0].drop("fn")
            sends.append(g.join(near(readers, g, "key", wide[1]), "key").select("rule_id", "fn", "kind", "key", "origin", "path"))
        if not sends:
            break
        new = sends[0]
        for d in sends[1:]:
            new = new.unionByName(d)
        # a parameter may hold several functions, all else has one origin
        new = new.groupBy(*identity, F.when(F.col("kind") == "func", F.col("origin")).alias("_o")).agg(F.min(F.struct("origin", "path")).alias("m")).select(*identity, "m.*", "_o")
        if round_:
            old = facts.select(*identity, F.when(F.col("kind") == "func", F.col("origin")).alias("_o"))
            new = new.join(old, [new[c].eqNullSafe(old[c]) for c in (*identity, "_o")], "left_anti")
        new = written(new.drop("_o"))
        n = new.count()
        if not n:
            break
        facts = facts.unionByName(new)
        if round_ % 6 == 5:
            facts = written(facts)
        frontier = new.select("rule_id", "fn").distinct()
        known = near(facts, new, "fn", n).join(frontier, ["rule_id", "fn"], "left_semi").groupBy("rule_id", "fn").agg(F.collect_list(F.struct("kind", "key", "origin", "path")).alias("facts"))
        out = written(known.join(near(bodies, new, "fn", n), "fn").sortWithinPartitions("fn").mapInArrow(step, _OUT))
        round_ += 1
    rows = spark.createDataFrame([(r.id, r.severity, r.cwe, r.message, r.confidence) for r in taint], "rule_id string, severity string, cwe string, message string, _most string")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = every.groupBy("rule_id", F.col("key").alias("sink")).agg(F.min(F.struct("round", "origin", "fn", "callee", "confidence", "path")).alias("m"))
    return first.join(F.broadcast(rows), "rule_id").select("rule_id", "m.fn", "sink", "m.callee", "m.origin", F.split("m.path", "\n").alias("steps"), F.when(F.col("_most") == "low", "low").otherwise(F.col("m.confidence")).alias("confidence"), "severity", "cwe", "message")


def constants(functions: DataFrame) -> DataFrame:
    """(fn, lang, at, text) of the string constants of functions; ``at`` is the instruction that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for fn, lang, body in zip(*(b.column(c).to_pylist() for c in ("fn", "lang", "body"))):
                for i in (i for x in json.loads(body)["blocks"] for i in x["instrs"] if i.get("id")):
                    out += [(fn, lang, i["id"], v[1]) for v in [*i.get("operands", []), *i.get("args", [])] if v[0] == "const" and isinstance(v[1], str)]
            yield pa.record_batch([pa.array([o[c] for o in out], pa.string()) for c in range(4)], ["fn", "lang", "at", "text"])

    return functions.select("fn", "lang", "body").mapInArrow(run, "fn string, lang string, at string, text string")


def dangerous(functions: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, fn, sink, callee, confidence, severity): calls of banned names, by constant or guard, no flow needed."""
    banned = [r for r in rules if r.kind == "dangerous-call"]
    sent = functions.sparkSession.sparkContext.broadcast(banned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        banning: dict[str, list[int]] = {}  # the rules that a name is banned by: a name is tested once a task
        for b in batches:
            out = []
            for fn, lang, body in zip(*(b.column(c).to_pylist() for c in ("fn", "lang", "body"))):
                f = json.loads(body) | {"key": fn}
                sites: dict[int, list[dict]] = {}
                for i in (i for x in f["blocks"] for i in x["instrs"] if i.get("callee")):
                    if i["callee"] not in banning:
                        banning[i["callee"]] = [n for n, r in enumerate(sent.value) if any(matches(i["callee"], c) for c in r.callees)]
                    for n in banning[i["callee"]]:
                        sites.setdefault(n, []).append(i)
                for n, calls in sorted(sites.items()):
                    r = sent.value[n]
                    if r.speaks(lang):
                        k = Kernel(f, r, [])
                        for i in calls:
                            args = i.get("args", [])
                            args = args[1:] if not i.get("is_invoke") and i.get("method_name") and not i.get("recv") else args
                            seen: list[Arg] = [k.arg(v, {}, [256]) for v in args]
                            if r.const_arg:
                                at, x_ = r.const_arg
                                try:
                                    ok = at < len(seen) and seen[at].Complete and re.search(x_, seen[at].String) is not None
                                except re.error:
                                    ok = False
                                if not ok:
                                    continue
                            if Guard(r.when).holds(seen, taint_known=False):
                                out.append((r.id, fn, i["id"], i["callee"], r.confidence, r.severity))
            yield pa.record_batch([pa.array([o[c] for o in out], pa.string()) for c in range(6)], ["rule_id", "fn", "sink", "callee", "confidence", "severity"])

    got = functions.select("fn", "lang", "body").mapInArrow(run, "rule_id string, fn string, sink string, callee string, confidence string, severity string")
    return got.groupBy("rule_id", "sink").agg(F.min(F.struct("fn", "callee", "confidence", "severity")).alias("m")).select("rule_id", "m.fn", "sink", "m.callee", "m.confidence", "m.severity")
