"""Rules against code: patterns are a small dimension, callee names the large side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.globs import predicate, shape

#: Rules are written by hand; beyond this many patterns they are joined by their literal parts instead of one by one.
MANY = 2_000


def classes(callees: DataFrame, patterns: DataFrame, name: str = "callee") -> DataFrame:
    """(callee, rule_id, role, ord, pattern, args) of every distinct callee and pattern that match.

    The names pass once: each pattern becomes one test in a projection that gives the numbers of the patterns that
    match, and only those are exploded. Exact patterns are an equi-join."""
    spark = callees.sparkSession
    rows = patterns.select("rule_id", "role", "ord", "pattern", "args").collect()  # rules, not data
    names = callees.select(F.col(name).alias("callee")).where(F.col("callee").isNotNull()).distinct()
    schema = "i int, rule_id string, role string, ord long, pattern string, args string"
    distinct = sorted({r["pattern"] for r in rows})
    exact = [p for p in distinct if shape(p)[0] == "exact"]
    globs = [p for p in distinct if shape(p)[0] not in ("exact", "never")]
    number = {p: i for i, p in enumerate(distinct)}
    dim = F.broadcast(spark.createDataFrame([(number[r["pattern"]], *r) for r in rows], schema))
    out = None
    for at in range(0, len(globs), MANY):
        tests = [F.when(predicate(F.col("callee"), p), F.lit(number[p])) for p in globs[at : at + MANY]]
        hit = names.select("callee", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("i"))
        out = hit if out is None else out.unionByName(hit)
    if exact:
        known = F.broadcast(spark.createDataFrame([(p, number[p]) for p in exact], "callee string, i int"))
        hit = names.join(known, "callee")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        return names.join(dim, F.lit(False)).select("callee", "rule_id", "role", "ord", "pattern", "args")
    return out.join(dim, "i").select("callee", "rule_id", "role", "ord", "pattern", "args")


def first_sink(classified: DataFrame) -> DataFrame:
    """(callee, rule_id, ord, args): the first sink entry of a rule that a callee matches."""
    sinks = classified.where("role = 'sink'")
    return sinks.groupBy("callee", "rule_id").agg(F.min(F.struct("ord", "args")).alias("m")).select("callee", "rule_id", "m.ord", "m.args")


def speaks(languages, lang):
    """No languages mean all; case doesn't matter."""
    return (F.size(languages) == 0) | F.exists(languages, lambda x: F.lower(x) == F.lower(lang))


def live_rules(rules: DataFrame, code: DataFrame, classified: DataFrame) -> DataFrame:
    """Rules that have a sink, a language of the program, and a callee that a sink matches."""
    langs = code.select("lang").distinct().agg(F.collect_set("lang").alias("langs"))
    spoken = rules.crossJoin(F.broadcast(langs)).where((F.size("languages") == 0) | F.exists("languages", lambda x: F.exists("langs", lambda y: F.lower(x) == F.lower(y)))).drop("langs")
    return spoken.join(classified.where("role = 'sink'").select("rule_id").distinct(), "rule_id", "left_semi")
