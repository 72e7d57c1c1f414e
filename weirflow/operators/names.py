"""Names against names: imports, default exports, cells, hosts of sources. All are joins on keys that are made of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tails(path: Column, begin: int) -> Column:
    """Dotted suffixes of a path from its part number ``begin`` on, the longest first; each keeps two parts at least."""
    parts = F.split(path, "\\.")
    whole = F.transform(F.sequence(F.lit(begin), F.greatest(F.size(parts) - 1, F.lit(begin))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.size(parts) > begin, whole).otherwise(F.array())


def import_targets(functions: DataFrame, callees: DataFrame) -> DataFrame:
    """(callee, target): the function that an imported name means.

    functions: (target, scope, path), callees: (callee, scope, path); paths are dotted and meet within a scope only. A
    callee's path is tried whole and then without its first parts; each try asks for the one function of that path, and
    only then for the one function whose path ends in it. A path with several functions answers nothing."""
    own = lambda keys: keys.groupBy("scope", "key").agg(F.min("target").alias("target"), F.max("target").alias("_last")).where("target = _last").drop("_last")
    exact = own(functions.where(F.col("path").contains(".")).select("scope", F.col("path").alias("key"), "target"))
    ends = own(functions.select("scope", F.explode(_tails(F.col("path"), 2)).alias("key"), "target"))
    index = exact.withColumn("tier", F.lit(0)).unionByName(ends.withColumn("tier", F.lit(1)))
    tries = callees.distinct().select("callee", "scope", F.posexplode(_tails(F.col("path"), 1)).alias("cut", "key"))
    return tries.join(index, ["scope", "key"]).groupBy("callee").agg(F.min_by("target", F.struct("cut", "tier")).alias("target"))


DEFAULT, CELL = "@default:", "@cell:"


def default_exports(calls: DataFrame, exports: DataFrame) -> DataFrame:
    """calls with ``callee`` resolved: a marker of a module's default export becomes the one function (module, target)
    that is exported so, or else the bare name of the module."""
    one = exports.groupBy("module").agg(F.min("target").alias("_to"), F.max("target").alias("_last")).where("_to = _last").select(F.col("module").alias("_m"), "_to")
    module = F.when(F.col("callee").startswith(DEFAULT), F.substring("callee", len(DEFAULT) + 1, 1 << 20))
    bare = F.concat(F.lit("js:"), F.regexp_extract(module, r"([^/]*)$", 1))
    return calls.withColumn("_m", module).join(one, "_m", "left").withColumn("callee", F.when(F.col("_m").isNull(), F.col("callee")).otherwise(F.coalesce("_to", bare))).drop("_m", "_to")


def cell_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls with ``callee`` resolved: a template in a cell's folder calls methods of the class beside that folder. A
    marker '@cell:template|name' becomes the one method (module, method, target) of the paired class, or the bare name."""
    one = methods.groupBy("module", "method").agg(F.min("target").alias("_to"), F.count("*").alias("_n")).where("_n = 1").select(F.col("module").alias("_m"), F.col("method").alias("_f"), "_to")
    cell = r"^@cell:(.*)/[^/|]*\|(.*)$"
    marked = F.col("callee").rlike(cell)
    c = calls.withColumns({"_m": F.when(marked, F.concat(F.regexp_extract("callee", cell, 1), F.lit("_cell"))), "_f": F.when(marked, F.regexp_extract("callee", cell, 2))})
    return c.join(one, ["_m", "_f"], "left").withColumn("callee", F.when(F.col("_f").isNull(), F.col("callee")).otherwise(F.coalesce("_to", F.concat(F.lit("ruby:"), "_f")))).drop("_m", "_f", "_to")


def request_hosts(calls: DataFrame, plain: Column, objects: Column) -> DataFrame:
    """(fn): functions outside the target that call a source themselves, so that they are looked into. ``plain`` names
    ordinary sources, at any depth; ``objects`` request objects, which frameworks hand to their own pipeline too: only
    where target code calls the function directly. calls: (fn, is_target, callee)."""
    inner = calls.where("NOT is_target")
    entered = calls.where("is_target").select(F.col("callee").alias("fn")).distinct()
    direct = inner.where(objects & ~plain).select("fn").distinct().join(entered, "fn", "left_semi")
    return inner.where(plain).select("fn").union(direct).distinct()
