"""A program derived from the order tables, so that every operator of the analysis
has functions, instructions, calls and constants to run on: an order is a
function, its lines are its instructions, and parts give the callee names.

``SQL`` is the same program as a prelude of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.session import table, written

#: A third of the functions have a method name of their own, the others share one with the rest of their sixteen, so
#: both kinds of call grow with the table. SQL and Spark read the same text.
METHOD = "CASE WHEN {0} % 3 = 0 THEN 'M' || {0} ELSE 'G' || CAST(floor({0} / 16) AS BIGINT) END"

LANGS = ("go", "python", "javascript", "java")
SOURCE, SINKS, SANITIZER, CALLS = 0, (1, 2), 3, (4, 5, 6, 7)


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn, key, module, lang, method_name, is_target)."""
    o = table(spark, sf_dir, "orders")
    module = F.concat(F.lit("app/m"), (F.col("o_custkey") % 16).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("fn"),
        module.alias("module"),
        F.element_at(F.array(*map(F.lit, LANGS)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("lang"),
        F.expr(METHOD.format("o_orderkey")).alias("method_name"),
        (F.col("o_custkey") % 5 != 0).alias("is_target"),
    )


def instructions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(fn, seq, k, opnd, callee_fn, callee, block, file, line, col, part, back, lang, module, is_target, method_name), or
    the columns that are named.

    Parts are joined first, each with the number of its rows, and lines are numbered after that: what follows, joins and
    groups by fn too, finds the rows where they are and shuffles nothing more."""
    li, f = table(spark, sf_dir, "lineitem"), functions(spark, sf_dir)
    held = [c for c, of in (("p_name", ("callee", "part")), ("p_brand", ("callee",)), ("p_type", ("callee",))) if not columns or set(of) & set(columns)]
    rows = F.collect_list(F.struct(*held or [F.lit(True).alias("one")])).alias("_parts")
    p = table(spark, sf_dir, "part").groupBy("p_partkey").agg(rows)
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))  # one row
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    li = li.select("l_orderkey", *order).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    li = li.withColumn("seq", seq).select("l_orderkey", "seq", "l_partkey", "l_suppkey", "l_linenumber", F.explode("_parts").alias("_part"))
    name = lambda c: F.col(f"_part.{c}")
    found = {
        "fn": F.col("fn"), "seq": F.col("seq"),
        "k": (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 23,
        "opnd": F.when(F.col("seq") > 1, 1 + F.try_mod(F.col("l_partkey") + F.col("l_suppkey"), F.col("seq") - 1)).otherwise(0).cast("long"),
        "callee_fn": 1 + (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % F.col("n"),
        "callee": lambda: F.concat("lang", F.lit(":lib/"), name("p_type"), F.lit("."), name("p_brand"), F.lit("."), F.translate(name("p_name"), " ", "_")),
        "block": F.col("l_linenumber").cast("long"),
        "file": F.concat("module", F.lit(".src")),
        "line": F.col("fn") * 100 + F.col("seq"),
        "col": (1 + F.col("l_linenumber")).cast("long"),
        "part": lambda: name("p_name"),
        "back": F.col("l_partkey") % 11 == 0,
        "lang": F.col("lang"), "module": F.col("module"), "is_target": F.col("is_target"), "method_name": F.col("method_name"),
    }
    at = li.join(f, li["l_orderkey"] == f["fn"]).crossJoin(F.broadcast(n))
    return at.select(*[(v() if callable(v) else v).alias(c) for c, v in found.items() if not columns or c in columns])


#: What the closure of a function reads.
FLOW = ("fn", "seq", "k", "opnd", "callee_fn")


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instructions as a table, for queries that go over them several times."""
    return written(instructions(spark, sf_dir))


SQL = f"""
WITH RECURSIVE func AS (
  SELECT o_orderkey AS fn, 'app/m' || (o_custkey % 16) AS module, ['go','python','javascript','java'][o_custkey % 4 + 1] AS lang,
    {METHOD.format('o_orderkey')} AS method_name, o_custkey % 5 <> 0 AS is_target
  FROM orders),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq
  FROM lineitem),
instr AS (
  SELECT fn, seq, (l_partkey * 31 + l_suppkey) % 23 AS k,
    CASE WHEN seq > 1 THEN 1 + (l_partkey + l_suppkey) % (seq - 1) ELSE 0 END AS opnd,
    1 + (l_partkey * 7919 + l_suppkey * 104729) % (SELECT count(*) FROM orders) AS callee_fn,
    lang || ':lib/' || p_type || '.' || p_brand || '.' || replace(p_name, ' ', '_') AS callee,
    l_linenumber::BIGINT AS block, module || '.src' AS file, fn * 100 + seq AS line, (1 + l_linenumber)::BIGINT AS col,
    p_name AS part, l_partkey % 11 = 0 AS back, lang, module, is_target, method_name
  FROM lines JOIN func ON l_orderkey = fn JOIN part ON l_partkey = p_partkey)
"""

#: Rules over the derived names: (rule, severity, cwe, languages). Order of the list is load order.
RULES = [
    ("promo-injection", "high", "CWE-89", ("go", "python")),
    ("small-command", "critical", "CWE-78", ()),
    ("bolt-path", "medium", "CWE-22", ("javascript", "java")),
    ("weak-ring", "low", "", ()),
    ("cobol-only", "high", "CWE-94", ("cobol",)),
]
#: (rule, role, order, pattern, pinned arguments)
PATTERNS = [
    ("promo-injection", "source", 0, "*:lib/MEDIUM.Brand#1.*", ""),
    ("promo-injection", "sink", 0, "*:lib/PROMO.Brand#1*.*_widget", "1"),
    ("promo-injection", "sink", 1, "go:lib/PROMO.*", "0"),
    ("promo-injection", "sanitizer", 0, "*.Brand#9.*", ""),
    ("small-command", "source", 0, "python:lib/*", ""),
    ("small-command", "sink", 0, "*:lib/SMALL.Brand#2.blue_bolt", "0"),
    ("small-command", "sink", 1, "*SMALL*", ""),
    ("small-command", "propagator", 0, "*", ""),
    ("bolt-path", "sink", 0, "*_bolt", "2,0"),
    ("bolt-path", "source", 0, "java:lib/ECONOMY.*", ""),
    ("bolt-path", "validator", 0, "*.Brand#7.*", ""),
    ("weak-ring", "callee", 0, "*.Brand#2*.*ring", ""),
    ("weak-ring", "callee", 1, "javascript:lib/LARGE.Brand#5.small_ring", ""),
    ("cobol-only", "sink", 0, "*", ""),
]


def rules(spark: SparkSession) -> DataFrame:
    rows = [(r, i, s, c, list(langs)) for i, (r, s, c, langs) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, ord long, severity string, cwe string, languages array<string>")


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "rule_id string, role string, ord long, pattern string, args string")


RULES_SQL = "rules(rule_id, ord, severity, cwe, languages) AS (VALUES " + ", ".join(f"('{r}', {i}, '{s}', '{c}', {list(langs)!r}::VARCHAR[])" for i, (r, s, c, langs) in enumerate(RULES)) + ")"
PATTERNS_SQL = "patterns(rule_id, role, ord, pattern, args) AS (VALUES " + ", ".join(f"('{r}', '{role}', {o}, '{p}', '{a}')" for r, role, o, p, a in PATTERNS) + ")"
#: distinct callees with the rules and roles whose glob they match
CLASSES_SQL = "classes AS (SELECT DISTINCT callee, rule_id, role, ord, pattern, args FROM (SELECT DISTINCT callee FROM instr) JOIN patterns ON callee GLOB pattern)"
#: what the sources of a function reach inside it
INTRA_SQL = ", own AS (SELECT fn, seq AS key FROM instr WHERE k = 0 UNION SELECT i.fn, i.seq FROM own o JOIN instr i ON i.fn = o.fn AND i.opnd = o.key AND i.k NOT IN (0, 3))"
#: edges of taint, and (fn, key) of every tainted register
EDGES_SQL = ", edges AS (SELECT fn, opnd AS key, fn AS n_fn, seq AS n_key FROM instr WHERE k NOT IN (0, 3) UNION SELECT fn, opnd, callee_fn, 0 FROM instr WHERE k BETWEEN 4 AND 7 AND callee_fn IN (SELECT fn FROM func))"
TAINT_SQL = EDGES_SQL + ", t AS (SELECT fn, seq AS key FROM instr WHERE k = 0 UNION SELECT n_fn, n_key FROM t JOIN edges USING (fn, key))"
