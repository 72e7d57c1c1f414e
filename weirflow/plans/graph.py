"""Structural indexes of the program: call graphs, def-use edges, control flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.catalog import query
from weirflow.operators import closure, rulejoin
from weirflow.plans import derived
from weirflow.plans.derived import CLASSES_SQL, METHOD, PATTERNS_SQL, RULES_SQL, SQL


def direct_calls(instr: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn, seq, callee_fn) of the calls whose target is a known function."""
    calls = instr.where("k BETWEEN 4 AND 7").select("fn", "seq", "callee_fn")
    return calls.join(functions.select(F.col("fn").alias("callee_fn")), "callee_fn", "left_semi")


def dynamic_calls(instr: DataFrame) -> DataFrame:
    """Calls by method name alone: kind 7, for the method that the derived callee number names."""
    return instr.where("k = 7").select("fn", "seq", "module", F.expr(METHOD.format("callee_fn")).alias("method_name"))


def methods(functions: DataFrame) -> DataFrame:
    return functions.select(F.col("fn").alias("target"), "method_name", F.col("module").alias("owner"))


_DYNAMIC = f", dyn AS (SELECT fn, seq, module, {METHOD.format('callee_fn')} AS method_name FROM instr WHERE k = 7), methods AS (SELECT fn AS target, method_name, module AS owner FROM func)"


@query("call_graph_direct", SQL + " SELECT DISTINCT fn, callee_fn FROM instr WHERE k BETWEEN 4 AND 7 AND callee_fn IN (SELECT fn FROM func)")
def call_graph_direct(spark, sf_dir):
    return direct_calls(derived.instructions(spark, sf_dir), derived.functions(spark, sf_dir)).select("fn", "callee_fn").distinct()


@query("call_graph_cha", SQL + _DYNAMIC + " SELECT DISTINCT fn, target FROM dyn JOIN methods USING (method_name)")
def call_graph_cha(spark, sf_dir):
    """Class-hierarchy edges: every implementation of the method name."""
    return dynamic_calls(derived.instructions(spark, sf_dir)).join(methods(derived.functions(spark, sf_dir)), "method_name").select("fn", "target").distinct()


@query("cha_unambiguous", SQL + _DYNAMIC + " SELECT fn, seq, target FROM dyn JOIN (SELECT method_name, min(target) AS target FROM methods GROUP BY 1 HAVING count(*) = 1) USING (method_name)")
def cha_unambiguous(spark, sf_dir):
    one = methods(derived.functions(spark, sf_dir)).groupBy("method_name").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1")
    return dynamic_calls(derived.instructions(spark, sf_dir)).join(one, "method_name").select("fn", "seq", "target")


@query("receiver_narrowing", SQL + _DYNAMIC + " SELECT fn, seq, target FROM dyn JOIN methods m ON dyn.method_name = m.method_name AND dyn.module = m.owner")
def receiver_narrowing(spark, sf_dir):
    """Where the receiver's class is known, only implementations of that class."""
    d, m = dynamic_calls(derived.instructions(spark, sf_dir)), methods(derived.functions(spark, sf_dir))
    return d.join(m, (d["method_name"] == m["method_name"]) & (d["module"] == m["owner"])).select("fn", "seq", "target")


@query("reverse_call_graph", SQL + " SELECT callee_fn AS fn, count(DISTINCT fn) AS callers FROM instr WHERE k BETWEEN 4 AND 7 AND callee_fn IN (SELECT fn FROM func) GROUP BY callee_fn")
def reverse_call_graph(spark, sf_dir):
    edges = direct_calls(derived.instructions(spark, sf_dir), derived.functions(spark, sf_dir)).select("fn", "callee_fn").distinct()
    return edges.groupBy(F.col("callee_fn")).agg(F.count("*").alias("callers")).withColumnRenamed("callee_fn", "fn")


@query("callee_site_counts", SQL + " SELECT callee, count(*) AS sites FROM instr WHERE k >= 4 GROUP BY callee")
def callee_site_counts(spark, sf_dir):
    return derived.instructions(spark, sf_dir).where("k >= 4").groupBy("callee").agg(F.count("*").alias("sites"))


@query(
    "site_totals",
    SQL + f", {RULES_SQL}, {PATTERNS_SQL}, {CLASSES_SQL}, first AS (SELECT callee, role, arg_min(rule_id, r.ord) AS rule_id FROM classes JOIN rules r USING (rule_id) WHERE role IN ('source', 'sink') GROUP BY callee, role),"
    " sites AS (SELECT callee, count(*) AS n FROM instr WHERE k >= 4 GROUP BY callee) SELECT role, rule_id, sum(n)::BIGINT AS sites FROM first JOIN sites USING (callee) GROUP BY ALL",
)
def site_totals(spark, sf_dir):
    """Call sites of sources and sinks; a callee counts for the first rule that has it."""
    i = derived.instructions(spark, sf_dir)
    c = rulejoin.classes(i, derived.patterns(spark)).where("role IN ('source', 'sink')").drop("ord")
    order = F.broadcast(derived.rules(spark).select("rule_id", "ord"))  # rules, not data
    first = c.join(order, "rule_id").groupBy("callee", "role").agg(F.min_by("rule_id", "ord").alias("rule_id"))
    sites = i.where("k >= 4").groupBy("callee").agg(F.count("*").alias("n"))
    return first.join(sites, "callee").groupBy("role", "rule_id").agg(F.sum("n").alias("sites"))


@query("global_readers", SQL + ", stores AS (SELECT DISTINCT part AS name FROM instr WHERE k = 8) SELECT DISTINCT name, fn FROM instr JOIN stores ON part = name WHERE k BETWEEN 9 AND 12")
def global_readers(spark, sf_dir):
    i = derived.instructions(spark, sf_dir)
    return i.where("k BETWEEN 9 AND 12").select(F.col("part").alias("name"), "fn").distinct().join(i.where("k = 8").select(F.col("part").alias("name")).distinct(), "name", "left_semi")


@query("indirect_callees", SQL + " SELECT DISTINCT fn FROM instr WHERE k = 6 AND seq % 2 = 0")
def indirect_callees(spark, sf_dir):
    """Functions that call a value: kind 6 at even places has no name."""
    return derived.instructions(spark, sf_dir).where("k = 6 AND seq % 2 = 0").select("fn").distinct()


@query(
    "callback_singletons",
    SQL + ", passed AS (SELECT callee_fn AS fn, callee_fn * 7 % 11 AS param, fn * 3 % 5 AS target FROM instr WHERE k = 5),"
    " opaque AS (SELECT DISTINCT callee_fn AS fn, callee_fn * 7 % 11 AS param FROM instr WHERE k = 4 AND opnd = 1)"
    " SELECT fn, param, min(target) AS target FROM passed p WHERE NOT EXISTS (SELECT 1 FROM opaque o WHERE o.fn = p.fn AND o.param = p.param) GROUP BY ALL HAVING count(DISTINCT target) = 1",
)
def callback_singletons(spark, sf_dir):
    """Parameters that hold one function only and never an unknown value."""
    i = derived.instructions(spark, sf_dir)
    param = (F.col("callee_fn") * 7 % 11).alias("param")
    passed = i.where("k = 5").select(F.col("callee_fn").alias("fn"), param, (F.col("fn") * 3 % 5).alias("target"))
    opaque = i.where("k = 4 AND opnd = 1").select(F.col("callee_fn").alias("fn"), param)
    one = passed.groupBy("fn", "param").agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most").drop("most")
    return one.join(opaque, ["fn", "param"], "left_anti")


@query("def_use_edges", SQL + " SELECT a.fn, b.seq AS def, a.seq AS use FROM instr a JOIN instr b ON a.fn = b.fn AND a.opnd = b.seq")
def def_use_edges(spark, sf_dir):
    """A use is an operand that names a register which an instruction of the same function defines."""
    i = derived.instructions(spark, sf_dir)
    defs = i.select("fn", F.col("seq").alias("def"))
    return i.select("fn", F.col("opnd").alias("def"), F.col("seq").alias("use")).join(defs, ["fn", "def"])


@query("nonescaping_allocs", SQL + " SELECT fn, seq FROM instr a WHERE k BETWEEN 13 AND 16 AND NOT EXISTS (SELECT 1 FROM instr u WHERE u.fn = a.fn AND u.opnd = a.seq AND u.k NOT IN (8, 9, 10))")
def nonescaping_allocs(spark, sf_dir):
    """Allocations (kinds 13 to 16) that are only stored to, loaded or negated (8, 9, 10)."""
    i = derived.instructions(spark, sf_dir)
    return i.where("k BETWEEN 13 AND 16").select("fn", "seq").join(i.where("k NOT IN (8, 9, 10)").select("fn", F.col("opnd").alias("seq")), ["fn", "seq"], "left_anti")


_BLOCKS = ", pos AS (SELECT fn, block, bool_or(back) AS back, row_number() OVER (PARTITION BY fn ORDER BY block) AS p FROM instr GROUP BY fn, block), n AS (SELECT fn, max(p) AS n FROM pos GROUP BY fn)"
_EDGES = _BLOCKS + ", cfg AS (SELECT fn, p AS a, p + 1 AS b FROM pos JOIN n USING (fn) WHERE p < n UNION SELECT fn, p, p + 2 FROM pos JOIN n USING (fn) WHERE p + 2 <= n AND block % 3 = 1 UNION SELECT fn, p, greatest(p - 2, 1) FROM pos WHERE back)"


def blocks(instr: DataFrame) -> DataFrame:
    """(fn, block, succs, entry): blocks by ordinal; next, a skip over one block, and a back edge."""
    b = instr.groupBy("fn", "block").agg(F.max("back").alias("back"))
    w = Window.partitionBy("fn")
    b = b.withColumn("p", F.row_number().over(w.orderBy("block")).cast("long")).withColumn("n", F.count("*").over(w))
    succs = F.array(F.when(F.col("p") < F.col("n"), F.col("p") + 1), F.when((F.col("p") + 2 <= F.col("n")) & (F.col("block") % 3 == 1), F.col("p") + 2), F.when(F.col("back"), F.greatest(F.col("p") - 2, F.lit(1))))
    return b.select("fn", F.col("p").alias("block"), F.array_distinct(F.array_compact(succs)).alias("succs"), (F.col("p") == 1).alias("entry"))


@query("cfg_edges", SQL + _EDGES + " SELECT fn, a AS block, b AS succ FROM cfg")
def cfg_edges(spark, sf_dir):
    return blocks(derived.instructions(spark, sf_dir)).select("fn", "block", F.explode("succs").alias("succ"))


@query(
    "dominators",
    SQL + _EDGES + ", avoid AS (SELECT p.fn, p.p AS d, 1::BIGINT AS at FROM pos p WHERE p.p <> 1 UNION SELECT v.fn, v.d, c.b FROM avoid v JOIN cfg c ON c.fn = v.fn AND c.a = v.at WHERE c.b <> v.d)"
    " SELECT x.fn, x.p AS block, y.p AS dom FROM pos x JOIN pos y ON x.fn = y.fn WHERE x.p = y.p OR NOT EXISTS (SELECT 1 FROM avoid v WHERE v.fn = x.fn AND v.d = y.p AND v.at = x.p)",
)
def dominators(spark, sf_dir):
    return closure.dominators(blocks(derived.instructions(spark, sf_dir)))


_ROOTS = ", roots AS (SELECT fn FROM func WHERE fn % 50 = 0)"


@query(
    "reachable_functions",
    SQL + _ROOTS + ", edges AS (SELECT DISTINCT fn, callee_fn FROM instr WHERE k BETWEEN 4 AND 7 AND callee_fn IN (SELECT fn FROM func)), r AS (SELECT fn FROM roots UNION SELECT callee_fn FROM r JOIN edges USING (fn)) SELECT fn FROM r",
)
def reachable_functions(spark, sf_dir):
    f = derived.functions(spark, sf_dir)
    return closure.entered_functions(derived.instructions(spark, sf_dir), f, f.where("fn % 50 = 0").select("fn"))
