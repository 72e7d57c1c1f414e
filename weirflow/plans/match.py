"""Rules against callee names: globs, classes, pins, arguments, dangerous calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.catalog import query
from weirflow.functions.globs import any_of, predicate
from weirflow.functions.scalars import fingerprint, owner_class, position, trailing_name
from weirflow.operators import closure, rulejoin, triage
from weirflow.plans import derived
from weirflow.plans.derived import CLASSES_SQL, PATTERNS_SQL, RULES_SQL, SQL, TAINT_SQL

SHAPES = {
    "exact": "go:lib/LARGE.Brand#5.small_ring",
    "prefix": "python:lib/*",
    "suffix": "*_bolt",
    "ends": "java:*_widget",
    "contains": "*.Brand#1*",
    "segments": "*:lib/*.Brand#2?.*_*",
    "any": "*",
    "never": "",
}


def _classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = derived.instructions(spark, sf_dir)
    return i, rulejoin.classes(i, derived.patterns(spark))


@query(
    "glob_match_shapes",
    SQL + ", names AS (SELECT DISTINCT callee FROM instr) SELECT " + ", ".join(f"count(*) FILTER (callee GLOB '{p.replace('?', '[?]')}') AS n_{k}" for k, p in SHAPES.items()) + ", count(*) FILTER (callee GLOB 'go:*' OR callee GLOB '*_ring') AS n_several FROM names",
)
def glob_match_shapes(spark, sf_dir):
    c = F.col("callee")
    names = derived.instructions(spark, sf_dir).select("callee").distinct()
    return names.agg(*[F.count(F.when(predicate(c, p), 1)).alias(f"n_{k}") for k, p in SHAPES.items()], F.count(F.when(any_of(c, ["go:*", "*_ring"]), 1)).alias("n_several"))


@query("callee_classes", SQL + f", {PATTERNS_SQL}, {CLASSES_SQL} SELECT callee, rule_id, role, ord::BIGINT AS ord FROM classes")
def callee_classes(spark, sf_dir):
    return _classified(spark, sf_dir)[1].select("callee", "rule_id", "role", "ord")


@query("sink_first_match", SQL + f", {PATTERNS_SQL}, {CLASSES_SQL} SELECT callee, rule_id, min(ord)::BIGINT AS ord, arg_min(args, ord) AS args FROM classes WHERE role = 'sink' GROUP BY callee, rule_id")
def sink_first_match(spark, sf_dir):
    return rulejoin.first_sink(_classified(spark, sf_dir)[1])


@query(
    "rule_prefilter",
    SQL + f", {RULES_SQL}, {PATTERNS_SQL}, {CLASSES_SQL} SELECT rule_id, severity FROM rules r WHERE EXISTS (SELECT 1 FROM classes c WHERE c.rule_id = r.rule_id AND role = 'sink')"
    " AND (len(languages) = 0 OR EXISTS (SELECT 1 FROM func WHERE list_contains(languages, lang)))",
)
def rule_prefilter(spark, sf_dir):
    i, c = _classified(spark, sf_dir)
    return rulejoin.live_rules(derived.rules(spark), i, c).select("rule_id", "severity")


_ARGS = "CASE WHEN k BETWEEN 4 AND 5 THEN ['t' || opnd, part, 't' || (seq - 1)] ELSE [part, 't' || opnd] END"


def _args() -> tuple:
    """Derived arguments: kinds 4 and 5 are method calls with a receiver first, 6 and 7 plain calls."""
    t = lambda c: F.concat(F.lit("t"), c.cast("string"))
    method = F.col("k").between(4, 5)
    args = F.when(method, F.array(t(F.col("opnd")), F.col("part"), t(F.col("seq") - 1))).otherwise(F.array(F.col("part"), t(F.col("opnd"))))
    return method, args


def logical(args, method):
    """Arguments as written: a method call that isn't dynamic has its receiver first, which is no argument."""
    return F.when(method, F.slice(args, 2, F.size(args))).otherwise(args)


@query("logical_args", SQL + f", a AS (SELECT fn, seq, k, {_ARGS} AS args FROM instr WHERE k BETWEEN 4 AND 7) SELECT fn, seq, array_to_string(CASE WHEN k <= 5 THEN args[2:] ELSE args END, '|') AS args FROM a")
def logical_args(spark, sf_dir):
    i = derived.instructions(spark, sf_dir).where("k BETWEEN 4 AND 7")
    method, args = _args()
    return i.select("fn", "seq", F.array_join(logical(args, method), "|").alias("args"))


@query(
    "injectable_args",
    SQL + f", {PATTERNS_SQL}, {CLASSES_SQL}, first AS (SELECT callee, rule_id, arg_min(args, ord) AS pin FROM classes WHERE role = 'sink' GROUP BY ALL),"
    f" a AS (SELECT fn, seq, k, callee, {_ARGS} AS args FROM instr WHERE k BETWEEN 4 AND 7)"
    " SELECT fn, seq, rule_id, array_to_string(CASE WHEN pin = '' THEN args ELSE list_filter(list_transform(string_split(pin, ','), lambda i: CASE WHEN k <= 5 THEN args[i::INT + 2] ELSE args[i::INT + 1] END), lambda v: v IS NOT NULL) END, '|') AS args"
    " FROM a JOIN first USING (callee)",
)
def injectable_args(spark, sf_dir):
    """Raw arguments without a pin; with one the pinned logical arguments, those out of range left out."""
    i, c = _classified(spark, sf_dir)
    method, args = _args()
    a = i.where("k BETWEEN 4 AND 7").select("fn", "seq", "callee", args.alias("raw"), logical(args, method).alias("logical"))
    j = a.join(rulejoin.first_sink(c).withColumnRenamed("args", "pin"), "callee")
    pinned = F.filter(F.transform(F.split("pin", ","), lambda i: F.get(F.col("logical"), F.try_to_number(i, F.lit("99")).cast("int"))), lambda v: v.isNotNull())
    return j.select("fn", "seq", "rule_id", F.array_join(F.when(F.col("pin") == "", F.col("raw")).otherwise(pinned), "|").alias("args"))


@query(
    "arg_param_map",
    SQL + ", a AS (SELECT fn, seq, k, callee_fn, 't' || opnd AS recv, [part, 't' || (seq - 1)] AS args FROM instr WHERE k BETWEEN 4 AND 7),"
    " m AS (SELECT fn, seq, callee_fn, CASE WHEN k >= 6 THEN list_concat([recv], args) ELSE args END AS vals FROM a)"
    " SELECT fn, seq, callee_fn, unnest(range(len(vals))) AS param, unnest(vals) AS val FROM m",
)
def arg_param_map(spark, sf_dir):
    """A dynamic call's receiver is parameter 0 and its arguments shift by one; others align."""
    i = derived.instructions(spark, sf_dir).where("k BETWEEN 4 AND 7")
    args = F.array(F.col("part"), F.concat(F.lit("t"), (F.col("seq") - 1).cast("string")))
    vals = F.when(F.col("k") >= 6, F.concat(F.array(F.concat(F.lit("t"), F.col("opnd").cast("string"))), args)).otherwise(args)
    return i.select("fn", "seq", "callee_fn", F.posexplode(vals)).select("fn", "seq", "callee_fn", F.col("pos").cast("long").alias("param"), F.col("col").alias("val"))


#: rule, patterns of callees, constant that the argument must match
BANNED = [("weak-ring", ["*.Brand#2*.*ring", "javascript:lib/LARGE.Brand#5.small_ring"], None), ("red-const", ["*:lib/SMALL.*", "*:lib/PROMO.*"], "^red (bolt|gear)$")]
_SEVERITY = {"weak-ring": "low", "red-const": "high"}
_BANNED_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, '{_SEVERITY[r]}' AS severity, * FROM instr WHERE k >= 4 AND (" + " OR ".join(f"callee GLOB '{p}'" for p in ps) + ")" + (f" AND regexp_matches(part, '{c}')" if c else "") for r, ps, c in BANNED
)
DANGEROUS_SQL = f", hits AS ({_BANNED_SQL}), dangerous AS (SELECT rule_id, severity, file || ':' || line || ':' || col AS pos, min(fn) AS fn, min(callee) AS callee, min(file) AS file, min(line) AS line, min(col) AS col FROM hits GROUP BY ALL)"


def dangerous(instr: DataFrame) -> DataFrame:
    """Call sites of banned names, one for each rule and place. The program passes once, all rules tested together."""
    calls = instr.where("k >= 4").select("fn", "callee", "part", "file", "line", "col", position(F.col("file"), F.col("line"), F.col("col")).alias("pos"))
    hits = []
    for rule, globs, const in BANNED:
        test = any_of(F.col("callee"), globs)
        hits.append(F.when(test & F.col("part").rlike(const) if const else test, F.struct(F.lit(rule).alias("rule_id"), F.lit(_SEVERITY[rule]).alias("severity"))))
    found = calls.select(F.explode(F.array_compact(F.array(*hits))).alias("hit"), *[c for c in calls.columns if c != "part"]).select("hit.*", *[c for c in calls.columns if c != "part"])
    return triage.one_per(found, ["rule_id", "pos"], ["fn", "callee"])


_SITE = ["callee", "part", "file", "line", "col"]


def maybe_banned():
    """Calls with a banned name, whatever their constants: all that ``dangerous`` finds, and all with such a callee."""
    return (F.col("k") >= 4) & any_of(F.col("callee"), [g for _, globs, _ in BANNED for g in globs])


@query("dangerous_calls", SQL + DANGEROUS_SQL + " SELECT rule_id, severity, pos, fn, callee FROM dangerous")
def dangerous_calls(spark, sf_dir):
    return dangerous(derived.instructions(spark, sf_dir)).select("rule_id", "severity", "pos", "fn", "callee")


@query(
    "dangerous_minus_taint",
    SQL + DANGEROUS_SQL + TAINT_SQL + ", taint AS (SELECT DISTINCT file || ':' || line || ':' || col AS pos, callee FROM instr JOIN t ON t.fn = instr.fn AND t.key = opnd WHERE k >= 4)"
    " SELECT rule_id, pos, callee FROM dangerous d WHERE NOT EXISTS (SELECT 1 FROM taint t WHERE t.pos = d.pos AND t.callee = d.callee)",
)
def dangerous_minus_taint(spark, sf_dir):
    """Banned calls but those that are given a tainted value, which are findings of their own."""
    i = derived.instructions(spark, sf_dir, *derived.FLOW, *_SITE).withColumn("banned", maybe_banned())
    s, into = closure.entered(i, derived.functions(spark, sf_dir), None, "banned", ["k", *_SITE])
    sites = s.where("from_entry").select("fn", F.explode("kept").alias("_k")).select("fn", "_k.*")
    taint = closure.hot(s, into).select(position(F.col("file"), F.col("line"), F.col("col")).alias("pos"), "callee")
    return triage.without_located(dangerous(sites), taint).select("rule_id", "pos", "callee")


@query("fingerprint", SQL + DANGEROUS_SQL + " SELECT rule_id, pos, substr(sha256(rule_id || chr(0) || file || chr(0) || file || chr(0) || fn || chr(0) || callee), 1, 16) AS fingerprint FROM dangerous")
def fingerprints(spark, sf_dir):
    d = dangerous(derived.instructions(spark, sf_dir))
    return d.select("rule_id", "pos", fingerprint(F.col("rule_id"), F.col("file"), F.col("file"), F.col("fn"), F.col("callee")).alias("fingerprint"))


@query("callee_names", SQL + r" SELECT DISTINCT callee, regexp_extract(callee, '([^.:]*)$', 1) AS trailing, regexp_extract(callee, '([^.:/]*)[.:][^.:]*$', 1) AS owner FROM instr")
def callee_names(spark, sf_dir):
    c = F.col("callee")
    return derived.instructions(spark, sf_dir).select("callee").distinct().select("callee", trailing_name(c).alias("trailing"), owner_class(c).alias("owner"))
