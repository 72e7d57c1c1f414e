"""The whole analysis over the derived program and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.catalog import query
from weirflow.functions.guards import Arg, Guard
from weirflow.operators import engine
from weirflow.plans import derived
from weirflow.plans.derived import SQL
from weirflow.plans.derived import TAINT_SQL as _TAINT
from weirflow.rules import build
from weirflow.session import table, written
from weirflow.streaming import new_findings


def program(spark, sf_dir) -> DataFrame:
    """The derived program as functions of the engine. A source is a call; a sink and a call pass their operand on."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    fn, seq, k, reg, target = (F.col(c) for c in ("fn", "seq", "k", "opnd", "callee_fn"))
    call = lambda name, to: text('{"op": "CALL", ', *name, '"callee": "', *to, '", "args": [["reg", "t', reg, '"]], "id": "', fn, ":", seq, '"}')
    named = ('"name": "t', seq, '", ')
    plain = text('{"op": "BIN_OP", ', *named, '"operands": [["reg", "t', reg, '"]], "id": "', fn, ":", seq, 'v"}')
    instr = (
        F.when(k == 0, call(named, ["lib.source"])).when(k == 3, call(named, ["lib.clean"])).when(k.isin(1, 2), text(plain, ", ", call((), ["lib.sink"])))
        .when(k.between(4, 7), text(plain, ", ", call((), ["f:", target]))).otherwise(plain)
    )
    empty = F.lit("").alias("method_name")
    made = F.when(k.between(4, 7), F.struct(text(fn, ":", seq).alias("id"), text("f:", target).alias("callee"), empty, F.lit(False).alias("untyped")))
    i = derived.instructions(spark, sf_dir, *derived.FLOW).select("fn", F.struct("seq", instr.alias("text"), made.alias("call")).alias("r"))
    f = derived.functions(spark, sf_dir).select("fn", "lang").join(i.groupBy("fn").agg(F.sort_array(F.collect_list("r")).alias("r")), "fn", "left")
    body = text('{"params": ["t0"], "blocks": [{"index": 0, "preds": [], "succs": [], "instrs": [', F.coalesce(F.array_join("r.text", ", "), F.lit("")), ']}], "seeds": {}}')
    calls = F.coalesce(F.array_compact("r.call"), F.array())
    return written(f.select(text("f:", fn).alias("fn"), empty, "lang", F.lit(True).alias("is_target"), body.alias("body"), calls.alias("calls"), F.array().cast("array<string>").alias("reads"), F.lit(False).alias("indirect")))


_DERIVED = {"id": "derived", "severity": "high", "sources": ["lib.source"], "sanitizers": ["lib.clean"], "sinks": ["lib.sink"]}


@query("engine_taint", SQL + _TAINT + " SELECT 'f:' || instr.fn AS fn, instr.fn || ':' || seq AS sink FROM instr JOIN t ON t.fn = instr.fn AND t.key = opnd WHERE k IN (1, 2)")
def engine_taint(spark, sf_dir):
    """The flow-sensitive engine over the derived program: functions are straight lines without kills, so it must find
    what the closure finds."""
    return engine.analyze(program(spark, sf_dir), build([_DERIVED])).select("fn", "sink")


@query(
    "engine_paths",
    SQL + ", own AS (SELECT fn, seq AS key FROM instr WHERE k = 0 UNION SELECT i.fn, i.seq FROM own o JOIN instr i ON i.fn = o.fn AND i.opnd = o.key AND i.k NOT IN (0, 3))"
    ", walk AS (SELECT i.fn, i.seq AS sink, i.seq, i.opnd, i.k, 0 AS back FROM instr i JOIN own ON own.fn = i.fn AND own.key = i.opnd WHERE i.k IN (1, 2)"
    " UNION ALL SELECT w.fn, w.sink, i.seq, i.opnd, i.k, w.back + 1 FROM walk w JOIN instr i ON i.fn = w.fn AND i.seq = w.opnd WHERE w.k <> 0)"
    " SELECT fn || ':' || sink AS sink, (max(back) OVER (PARTITION BY fn, sink) - back)::BIGINT AS step, fn || ':' || seq || CASE WHEN back = 0 OR k = 0 THEN '' ELSE 'v' END AS place FROM walk",
)
def engine_paths(spark, sf_dir):
    """The steps of findings whose taint never leaves its function, from source to sink."""
    found = engine.analyze(program(spark, sf_dir), build([_DERIVED])).where("confidence = 'high'")
    return found.select("sink", F.posexplode("steps")).select("sink", F.col("pos").cast("long").alias("step"), F.col("col").alias("place"))


_GUARDS = {
    "fixed": "hostFixed()",
    "literal": 'arg[0].Complete && arg[0].String startsWith "https://"',
    "listed": 'any(arg, {.Tainted}) and not (arg[1].String in ["fr", "de"])',
    "deep": "len(filter(arg, {.Complete})) == 2 || arg[7].Tainted",
}


@query(
    "guard_eval",
    "WITH p AS (SELECT page_id, url, page_id % 3 <> 0 AS whole, ['en','fr','de'][page_id % 3 + 1] AS l FROM pages),"
    " s AS (SELECT *, CASE WHEN whole THEN url ELSE substr(url, 1, 9) || '<DYN>' END AS a FROM p)"
    " SELECT page_id, NOT whole AND regexp_matches(string_split(a, '<DYN>')[1], '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#\\\\]+[/?#\\\\]') AS fixed, whole AND starts_with(a, 'https://') AS literal,"
    " NOT whole AND l NOT IN ('fr', 'de') AS listed, whole AS deep FROM s",
)
def guard_eval(spark, sf_dir):
    p, whole = table(spark, sf_dir, "pages"), F.col("page_id") % 3 != 0
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("page_id") % 3 + 1).cast("int"))
    text = F.when(whole, F.col("url")).otherwise(F.concat(F.substring("url", 1, 9), F.lit("<DYN>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guards = {k: Guard(g) for k, g in _GUARDS.items()}
        for b in batches:
            args = [[Arg(String=t, Complete=w, Tainted=not w), Arg(String=n, Complete=True)] for t, w, n in zip(*(b.column(c).to_pylist() for c in ("text", "whole", "lang")))]
            yield pa.record_batch([b.column("page_id"), *(pa.array([g.holds(a) for a in args], pa.bool_()) for g in guards.values())], ["page_id", *guards])

    return p.select("page_id", text.alias("text"), whole.alias("whole"), lang.alias("lang")).mapInArrow(run, "page_id long, " + ", ".join(f"{k} boolean" for k in _GUARDS))


@query(
    "streaming_new_findings",
    "SELECT DISTINCT substr(sha256(user_id || '/k' || (props->>'$.k')), 1, 16) AS fingerprint, user_id, 'k' || (props->>'$.k') AS kind FROM events WHERE event_type = 'error' AND user_id % 10 <> 0",
)
def streaming_new_findings(spark, sf_dir):
    path = f"{sf_dir}/event[s].parquet"  # a pattern stands for a file as well as for a folder
    events = spark.read.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    known = new_findings.error_findings(events.where("user_id % 10 = 0"))
    new = new_findings.unseen(new_findings.against(new_findings.error_findings(stream), known))
    return new_findings.drained(new, "new-findings").select("fingerprint", "user_id", "kind")
