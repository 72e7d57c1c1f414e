"""What happens to findings after the analysis: scope, duplicates, suppression, order, gate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.functions.scalars import severity_rank

IGNORE = "weirflow:ignore"


def one_per(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    cols = findings.columns
    rest = [c for c in cols if c not in keys]
    m = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("m")
    return findings.groupBy(*keys).agg(m).select(*[c if c in keys else F.col(f"m.{c}").alias(c) for c in cols])


def without_located(findings: DataFrame, taint: DataFrame) -> DataFrame:
    """Findings without those that a taint finding has at the same place and callee; an unknown place is no place."""
    t = taint.select(F.col("pos").alias("_p"), F.col("callee").alias("_c")).distinct()
    return findings.join(t, (findings["pos"] == t["_p"]) & (findings["callee"] == t["_c"]), "left_anti")


def against_baseline(findings: DataFrame, baseline: DataFrame, order: list[str]) -> DataFrame:
    """findings with ``suppressed``: k copies of a fingerprint in the baseline cover the first k findings."""
    n = baseline.groupBy("fingerprint").agg(F.count("*").alias("_n"))
    k = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))
    return findings.withColumn("_k", k).join(n, "fingerprint", "left").withColumn("suppressed", F.coalesce(F.col("_k") <= F.col("_n"), F.lit(False))).drop("_k", "_n")


def ignored(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings with ``ignored``: a directive on the line or the one above, for all rules or those it lists in brackets."""
    listed = F.regexp_extract("text", re.escape(IGNORE) + r"\[([A-Za-z0-9_, -]+)\]", 1)
    d = lines.where(F.col("text").contains(IGNORE)).select("file", "line", F.when(listed == "", F.array()).otherwise(F.transform(F.split(listed, ","), lambda x: F.trim(x))).alias("_ids"))
    both = d.union(d.withColumn("line", F.col("line") + 1)).groupBy("file", "line").agg(F.max(F.size("_ids") == 0).alias("_all"), F.flatten(F.collect_list("_ids")).alias("_ids"))
    j = findings.join(both, ["file", "line"], "left")
    return j.withColumn("ignored", F.coalesce(F.col("_all") | F.array_contains("_ids", F.col("rule_id")), F.lit(False))).drop("_all", "_ids")


def path_test(path: Column, pattern: str) -> Column:
    """A bare name tests every segment; otherwise ** spans segments, * stays in one and the rest is literal."""
    if "/" not in pattern and "**" not in pattern:
        one = "^" + "[^/]*".join(re.escape(p) for p in pattern.split("*")) + "$"
        return F.exists(F.split(path, "/"), lambda s: s.rlike(one))
    body = re.escape(pattern.lstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*")
    return path.rlike(f"^{body}$")


def path_state(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Why a path is out of scope: 'include', 'exclude' or null."""
    inside = F.lit(not include)
    for p in include:
        inside = inside | path_test(path, p)
    out = F.lit(False)
    for p in exclude:
        out = out | path_test(path, p)
    return F.when(~inside, "include").when(out, "exclude")


def in_order(findings: DataFrame) -> list[Column]:
    """Severity first, then place; unknown places last, ties by ordinal."""
    known = [F.asc_nulls_last(c) for c in ("file", "line", "col")]
    return [severity_rank(F.col("severity")).desc(), *known, F.asc("ord")]


def rule_rows(findings: DataFrame) -> DataFrame:
    """(rule_id, n, worst, place): rules by worst severity, number of findings and id."""
    g = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).cast("long").alias("worst"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("worst"), F.desc("n"), "rule_id")))  # a row for each rule


def gate(findings: DataFrame, threshold: str) -> DataFrame:
    """(active, failing): findings that aren't suppressed, and those at the threshold or above."""
    active = ~F.col("suppressed")
    at = severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold))
    return findings.agg(F.count(F.when(active, 1)).alias("active"), F.count(F.when(active & at, 1)).alias("failing"))
