"""Taint over the derived program, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.catalog import query
from weirflow.operators import closure
from weirflow.plans import derived, graph
from weirflow.plans.derived import EDGES_SQL as _EDGES
from weirflow.plans.derived import INTRA_SQL as _INTRA
from weirflow.plans.derived import SQL
from weirflow.plans.derived import TAINT_SQL as _TAINT
from weirflow.session import written

_ENTRY = ", entry AS (SELECT fn, 0::BIGINT AS key FROM func UNION SELECT i.fn, i.seq FROM entry o JOIN instr i ON i.fn = o.fn AND i.opnd = o.key AND i.k NOT IN (0, 3))"


def _program(spark, sf_dir, *columns) -> tuple[DataFrame, DataFrame]:
    """What the closure reads of the instructions and further columns, and the functions. Each is gone over once."""
    return derived.instructions(spark, sf_dir, *derived.FLOW, *columns), derived.functions(spark, sf_dir)


@query("taint_intra", SQL + _INTRA + " SELECT fn, key FROM own")
def taint_intra(spark, sf_dir):
    s = closure.summaries(derived.instructions(spark, sf_dir))
    return s.where("NOT from_entry").select("fn", F.explode("keys").alias("key"))


@query("taint_interproc", SQL + _TAINT + " SELECT fn, key FROM t")
def taint_interproc(spark, sf_dir):
    return closure.tainted(*_program(spark, sf_dir))


@query("taint_sinks", SQL + _TAINT + " SELECT instr.fn, seq, callee, line FROM instr JOIN t ON t.fn = instr.fn AND t.key = opnd WHERE k IN (1, 2)")
def taint_sinks(spark, sf_dir):
    i, f = _program(spark, sf_dir, "callee", "line")
    return closure.fed(i, f, "k IN (1, 2)", ["seq", "callee", "line"]).drop("own")


@query(
    "taint_scoped",
    SQL + _EDGES + ", t AS (SELECT fn, seq AS key FROM instr WHERE k = 0 AND is_target UNION SELECT n_fn, n_key FROM t JOIN edges USING (fn, key) WHERE n_fn IN (SELECT fn FROM func WHERE is_target)) SELECT fn, key FROM t",
)
def taint_scoped(spark, sf_dir):
    """Only functions of target modules are seeded and entered."""
    i, f = _program(spark, sf_dir)
    return closure.tainted(i, f, f.where("is_target").select("fn"))


@query("param_taint", SQL + _TAINT + " SELECT fn FROM t WHERE key = 0")
def param_taint(spark, sf_dir):
    return closure.tainted(*_program(spark, sf_dir)).where("key = 0").select("fn")


@query("return_taint", SQL + _TAINT + " SELECT fn FROM (SELECT fn, max(seq) AS key FROM instr GROUP BY fn) JOIN t USING (fn, key)")
def return_taint(spark, sf_dir):
    """Functions whose last register, what they return, is tainted."""
    s, into = closure.entered(*_program(spark, sf_dir))
    s = s.where(F.array_contains("keys", F.col("last"))).select("fn", "from_entry")
    own = s.where("NOT from_entry").select("fn")
    return own.unionByName(s.where("from_entry").select("fn").join(into, "fn", "left_semi")).distinct()


@query("global_taint", SQL + _TAINT + ", g AS (SELECT DISTINCT part AS name FROM instr JOIN t ON t.fn = instr.fn AND t.key = opnd WHERE k = 8) SELECT DISTINCT name, i.fn, i.seq FROM instr i JOIN g ON i.part = name WHERE k BETWEEN 9 AND 12")
def global_taint(spark, sf_dir):
    """Reads of a global that some function stores a tainted value to."""
    i, f = _program(spark, sf_dir, "part")
    s, into = closure.entered(i, f, None, "k BETWEEN 8 AND 12", ["seq", "k", "part"])
    # names as a table of known size: few are broadcast, and reads of a common name stay where they are
    g = written(closure.hot(s, into).where("k = 8").select(F.col("part").alias("name")).distinct())
    reads = F.array_distinct(F.transform(F.filter("kept", lambda x: x["k"] > 8), lambda x: F.struct(x["part"].alias("name"), x["seq"].alias("seq"))))
    return s.where("from_entry").select("fn", F.explode(reads).alias("r")).select("r.name", "fn", "r.seq").join(g, "name", "left_semi")


@query("outparam_fill", SQL + _INTRA + " SELECT DISTINCT c.fn, c.seq FROM instr c JOIN (SELECT DISTINCT i.fn FROM instr i JOIN own o ON o.fn = i.fn AND o.key = i.opnd WHERE k = 10) w ON c.callee_fn = w.fn WHERE c.k BETWEEN 4 AND 7")
def outparam_fill(spark, sf_dir):
    """Calls whose argument comes back filled: the callee stores a tainted value into memory of its parameter (kind 10)."""
    i = derived.program(spark, sf_dir)
    own = closure.summaries(i).where("NOT from_entry").select("fn", F.explode("keys").alias("key"))
    writers = closure.at(i, own, "k = 10").select(F.col("fn").alias("callee_fn")).distinct()
    return i.where("k BETWEEN 4 AND 7").join(writers, "callee_fn", "left_semi").select("fn", "seq")


@query(
    "sink_wrappers",
    SQL + _ENTRY + ", w AS (SELECT i.fn, min(i.line) AS sink_line FROM instr i JOIN entry e ON e.fn = i.fn AND e.key = i.opnd WHERE k IN (1, 2) AND NOT is_target GROUP BY i.fn)"
    " SELECT c.fn, c.seq, c.callee_fn, sink_line FROM instr c JOIN w ON c.callee_fn = w.fn WHERE c.k BETWEEN 4 AND 7 AND c.is_target",
)
def sink_wrappers(spark, sf_dir):
    """Target call sites of dependency functions that hand their parameter to a sink, with the first such sink."""
    i = derived.program(spark, sf_dir)
    s = closure.summaries(i).where("from_entry").select("fn", F.explode("sinks").alias("seq"))
    w = i.where("NOT is_target").join(s, ["fn", "seq"], "left_semi").groupBy(F.col("fn").alias("callee_fn")).agg(F.min("line").alias("sink_line"))
    return i.where("k BETWEEN 4 AND 7 AND is_target").join(w, "callee_fn").select("fn", "seq", "callee_fn", "sink_line")


@query(
    "confidence_assignment",
    SQL + _INTRA.replace("own", "o1") + _TAINT + " SELECT i.fn, i.seq, CASE WHEN o1.fn IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM instr i JOIN t ON t.fn = i.fn AND t.key = i.opnd LEFT JOIN o1 ON o1.fn = i.fn AND o1.key = i.opnd WHERE k IN (1, 2)",
)
def confidence_assignment(spark, sf_dir):
    """High where the taint never left the function, medium where it crossed a call."""
    i, f = _program(spark, sf_dir)
    return closure.fed(i, f, "k IN (1, 2)", ["seq"]).select("fn", "seq", F.when(F.col("own"), "high").otherwise("medium").alias("confidence"))


@query(
    "taint_path_steps",
    SQL + _INTRA + ", walk AS (SELECT i.fn, i.seq AS sink, i.seq, i.opnd, i.k, 0 AS back FROM instr i JOIN own ON own.fn = i.fn AND own.key = i.opnd WHERE i.k IN (1, 2)"
    " UNION ALL SELECT w.fn, w.sink, i.seq, i.opnd, i.k, w.back + 1 FROM walk w JOIN instr i ON i.fn = w.fn AND i.seq = w.opnd WHERE w.k <> 0)"
    " SELECT fn, sink, (max(back) OVER (PARTITION BY fn, sink) - back)::BIGINT AS step, seq FROM walk",
)
def taint_path_steps(spark, sf_dir):
    i = derived.program(spark, sf_dir)
    own = closure.summaries(i).where("NOT from_entry").select("fn", F.explode("sinks").alias("key"))
    return closure.paths(i, own)


@query(
    "strong_update",
    SQL + ", s AS (SELECT fn, 0::BIGINT AS seq, 0::BIGINT AS mask FROM func UNION ALL SELECT s.fn, i.seq, CASE WHEN i.k = 0 OR (i.k <> 3 AND (mask >> (i.opnd % 3)::INT) & 1 = 1) THEN mask | (1 << (i.seq % 3)::INT) ELSE mask & (7 - (1 << (i.seq % 3)::INT)) END"
    " FROM s JOIN instr i ON i.fn = s.fn AND i.seq = s.seq + 1) SELECT fn, mask AS live FROM s QUALIFY row_number() OVER (PARTITION BY fn ORDER BY seq DESC) = 1 AND mask > 0",
)
def strong_update(spark, sf_dir):
    """Three variables a function, written in order: a clean value kills the taint of what it overwrites."""
    i = derived.instructions(spark, sf_dir)
    one = F.lit(1).cast("long")
    shift = lambda c: F.when(c % 3 == 0, one).when(c % 3 == 1, 2 * one).otherwise(4 * one)
    rows = F.sort_array(F.collect_list(F.struct("seq", "k", "opnd")))

    def write(mask, r):
        hot = (r["k"] == 0) | ((r["k"] != 3) & (mask.bitwiseAND(shift(r["opnd"])) != 0))
        return F.when(hot, mask.bitwiseOR(shift(r["seq"]))).otherwise(mask.bitwiseAND(F.lit(7) - shift(r["seq"])))

    return i.groupBy("fn").agg(rows.alias("r")).select("fn", F.aggregate("r", F.lit(0).cast("long"), write).alias("live")).where("live > 0")


@query(
    "field_sensitive_reads",
    SQL + _INTRA + ", w AS (SELECT i.fn, i.opnd AS base, i.block % 3 AS field, min(i.seq) AS at FROM instr i JOIN own ON own.fn = i.fn AND own.key = i.seq WHERE i.k = 8 GROUP BY ALL)"
    " SELECT DISTINCT r.fn, r.seq FROM instr r JOIN w ON w.fn = r.fn AND w.base = r.opnd AND w.field = r.block % 3 AND w.at < r.seq WHERE r.k BETWEEN 9 AND 12",
)
def field_sensitive_reads(spark, sf_dir):
    """Reads of the field that a tainted store went to (base and field number), not of its siblings."""
    i = derived.program(spark, sf_dir)
    own = closure.summaries(i).where("NOT from_entry").select("fn", F.explode("keys").alias("seq"))
    path = F.concat(F.lit("t"), F.col("opnd").cast("string"), F.lit("#f"), (F.col("block") % 3).cast("string")).alias("path")
    w = i.where("k = 8").join(own, ["fn", "seq"], "left_semi").groupBy("fn", path).agg(F.min("seq").alias("at"))
    return i.where("k BETWEEN 9 AND 12").select("fn", "seq", path).join(w, ["fn", "path"]).where("at < seq").select("fn", "seq")


@query(
    "guarded_sinks",
    SQL + graph._EDGES + ", avoid AS (SELECT p.fn, p.p AS d, 1::BIGINT AS at FROM pos p WHERE p.p <> 1 UNION SELECT v.fn, v.d, c.b FROM avoid v JOIN cfg c ON c.fn = v.fn AND c.a = v.at WHERE c.b <> v.d),"
    " loc AS (SELECT i.fn, i.seq, i.k, p.p FROM instr i JOIN pos p ON p.fn = i.fn AND p.block = i.block)"
    " SELECT DISTINCT s.fn, s.seq FROM loc s JOIN loc g ON g.fn = s.fn AND g.k = 12 AND g.p <> s.p WHERE s.k IN (1, 2) AND NOT EXISTS (SELECT 1 FROM avoid v WHERE v.fn = s.fn AND v.d = g.p AND v.at = s.p)",
)
def guarded_sinks(spark, sf_dir):
    """Sinks in a block that a validator's block (kind 12) dominates; only functions that have both are looked at."""
    i = derived.program(spark, sf_dir)
    both = i.groupBy("fn").agg(F.max(F.col("k") == 12).alias("g"), F.max(F.col("k").isin(1, 2)).alias("s")).where("g AND s").select("fn")
    some = i.join(both, "fn", "left_semi")
    from pyspark.sql.window import Window

    ordinal = some.select("fn", "block").distinct().withColumn("p", F.row_number().over(Window.partitionBy("fn").orderBy("block")).cast("long"))
    at = some.join(ordinal, ["fn", "block"]).select("fn", "seq", "k", "p")
    dom = closure.dominators(graph.blocks(some)).where("block <> dom")
    guards = at.where("k = 12").select("fn", F.col("p").alias("dom")).distinct()
    safe = dom.join(guards, ["fn", "dom"], "left_semi").select("fn", F.col("block").alias("p")).distinct()
    return at.where("k IN (1, 2)").join(safe, ["fn", "p"], "left_semi").select("fn", "seq")
