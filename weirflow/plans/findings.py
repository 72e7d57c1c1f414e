"""Findings after the analysis: suppression, order, summaries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.catalog import query
from weirflow.functions.scalars import fingerprint, relative, sarif_level, sarif_score, severity_rank
from weirflow.operators import closure, rulejoin, triage
from weirflow.plans import derived, match
from weirflow.plans.derived import CLASSES_SQL, INTRA_SQL, PATTERNS_SQL, RULES_SQL, SQL
from weirflow.plans.match import DANGEROUS_SQL
from weirflow.session import table, written

_RANK = "(list_position(['info','low','medium','high','critical'], severity))"
FIND = (
    SQL + DANGEROUS_SQL + INTRA_SQL + f", {RULES_SQL}, {PATTERNS_SQL}, {CLASSES_SQL}, first AS (SELECT callee, arg_min(rule_id, r.ord) AS rule_id FROM classes JOIN rules r USING (rule_id) WHERE role = 'sink' GROUP BY callee),"
    " found AS (SELECT rule_id, severity, CASE rule_id WHEN 'weak-ring' THEN 'CWE-327' ELSE '' END AS cwe, fn, callee, file, line, col, line * 8 + CASE rule_id WHEN 'weak-ring' THEN 0 ELSE 1 END AS ord FROM dangerous"
    " UNION ALL SELECT r.rule_id, r.severity, r.cwe, i.fn, i.callee, i.file, i.line, i.col, i.line * 8 + 2 + r.ord FROM instr i JOIN own ON own.fn = i.fn AND own.key = i.opnd JOIN first USING (callee) JOIN rules r ON r.rule_id = first.rule_id WHERE i.k IN (1, 2)),"
    " finding AS (SELECT rule_id, severity, cwe, fn, callee, split_part(callee, ':', 1) AS lang, CASE WHEN line % 17 <> 0 THEN file END AS file, CASE WHEN line % 17 <> 0 THEN line END AS line, CASE WHEN line % 17 <> 0 THEN col END AS col,"
    " ord, substr(sha256(rule_id || chr(0) || file || chr(0) || callee), 1, 16) AS fingerprint, fn % 7 = 0 AS suppressed FROM found)"
)


def findings(spark, sf_dir) -> DataFrame:
    """Findings of the derived program: banned calls, and sinks that a source reaches inside their function, each for the
    first rule that its name is a sink of. Some places are unknown and some functions ignored."""
    site = ["k", "callee", "part", "file", "line", "col"]
    i = derived.instructions(spark, sf_dir, *derived.FLOW, *site).withColumn("kept", match.maybe_banned() | F.col("k").isin(1, 2))
    # the program passes once: what can be a finding is kept, with whether a source of its function reaches it
    kept = F.filter("kept", lambda x: (x["k"] >= 4) | x["own"])
    i = written(closure.summaries(i, "kept", site).where("from_entry").select("fn", F.explode(kept).alias("_k")).select("fn", "_k.*").drop("entry"))
    banned = match.dangerous(i).drop("pos").withColumns({"cwe": F.when(F.col("rule_id") == "weak-ring", "CWE-327").otherwise(""), "ord": F.col("line") * 8 + F.when(F.col("rule_id") == "weak-ring", 0).otherwise(1)})
    rules = F.broadcast(derived.rules(spark).select("rule_id", "severity", "cwe", F.col("ord").alias("_at")))  # rules, not data
    sinks = i.where("k IN (1, 2)")
    classes = rulejoin.classes(sinks, derived.patterns(spark)).where("role = 'sink'").select("callee", "rule_id")
    first = classes.join(rules, "rule_id").groupBy("callee").agg(F.min_by(F.struct("rule_id", "severity", "cwe", "_at"), "_at").alias("r")).select("callee", "r.*")
    flows = sinks.join(first, "callee").withColumn("ord", F.col("line") * 8 + 2 + F.col("_at"))
    cols = ["rule_id", "severity", "cwe", "fn", "callee", "file", "line", "col", "ord"]
    known = lambda c: F.when(F.col("line") % 17 != 0, F.col(c)).alias(c)
    return banned.select(*cols).unionByName(flows.select(*cols)).select(
        "rule_id", "severity", "cwe", "fn", "callee", F.substring_index("callee", ":", 1).alias("lang"), known("file"), known("line"), known("col"), "ord",
        fingerprint(F.col("rule_id"), F.col("file"), F.col("callee")).alias("fingerprint"), (F.col("fn") % 7 == 0).alias("suppressed"),
    )


@query("severity_override", FIND + " SELECT ord, rule_id, CASE rule_id WHEN 'red-const' THEN 'critical' WHEN 'small-command' THEN 'info' ELSE severity END AS severity FROM finding WHERE rule_id <> 'promo-injection'")
def severity_override(spark, sf_dir):
    """Rules switched off go; others may get another severity."""
    off = spark.createDataFrame([("promo-injection",)], "rule_id string")
    change = spark.createDataFrame([("red-const", "critical"), ("small-command", "info")], "rule_id string, new string")
    f = findings(spark, sf_dir).join(F.broadcast(off), "rule_id", "left_anti").join(F.broadcast(change), "rule_id", "left")  # settings, not data
    return f.select("ord", "rule_id", F.coalesce("new", "severity").alias("severity"))


@query("baseline_multiset", FIND + ", base AS (SELECT fingerprint, count(*) AS n FROM finding WHERE fn % 3 = 0 GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS i FROM finding) SELECT ord, k.fingerprint, coalesce(i <= n, false) AS suppressed FROM k LEFT JOIN base USING (fingerprint)")
def baseline_multiset(spark, sf_dir):
    f = findings(spark, sf_dir)
    return triage.against_baseline(f, f.where("fn % 3 = 0"), ["ord"]).select("ord", "fingerprint", "suppressed")


_PATHS = ["**/m1*.src"], ["m13.src", "app/m1[4].src"]


@query(
    "path_filter",
    FIND + " SELECT file, count(*) AS n, CASE WHEN NOT regexp_matches(file, '^(?:.*/)?m1[^/]*\\.src$') THEN 'include' WHEN list_contains(string_split(file, '/'), 'm13.src') OR regexp_matches(file, '^app/m1\\[4\\]\\.src$') THEN 'exclude' END AS state FROM finding WHERE file IS NOT NULL GROUP BY ALL",
)
def path_filter(spark, sf_dir):
    f = findings(spark, sf_dir).where("file IS NOT NULL")
    return f.groupBy("file", triage.path_state(F.col("file"), *_PATHS).alias("state")).agg(F.count("*").alias("n"))


@query("finding_order", FIND + f" SELECT ord, row_number() OVER (ORDER BY {_RANK} DESC, file NULLS LAST, line NULLS LAST, col NULLS LAST, ord) AS place FROM finding")
def finding_order(spark, sf_dir):
    """A place for every finding. One window over all would be one task, so rows are ranged into sorted partitions
    and each partition starts from the count of those before."""
    f = written(findings(spark, sf_dir).select("severity", "file", "line", "col", "ord"))  # ranging reads its input twice
    keys = triage.in_order(f)
    s = f.repartitionByRange(*keys).sortWithinPartitions(*keys).select("ord", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    s = written(s.withColumn("i", F.col("m") - F.col("p").cast("long") * (1 << 33)))
    n = s.groupBy("p").agg(F.count("*").alias("n"))
    before = n.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row for each partition
    return s.join(F.broadcast(before), "p").select("ord", (F.col("before") + F.col("i") + 1).alias("place"))


@query("top_findings", FIND + f" SELECT ord, rule_id, severity FROM finding WHERE NOT suppressed ORDER BY {_RANK} DESC, file NULLS LAST, line NULLS LAST, col NULLS LAST, ord LIMIT 200")
def top_findings(spark, sf_dir):
    f = findings(spark, sf_dir).where("NOT suppressed")
    return f.orderBy(*triage.in_order(f)).limit(200).select("ord", "rule_id", "severity")


@query(
    "rule_summary",
    FIND + f" SELECT rule_id, count(*) AS n, max({_RANK})::BIGINT AS worst, arg_min(cwe, ord) FILTER (cwe <> '') AS cwe, round(100.0 * count(*) / (SELECT count(*) FROM finding), 4)::DOUBLE AS pct FROM finding GROUP BY rule_id",
)
def rule_summary(spark, sf_dir):
    f = findings(spark, sf_dir)
    g = f.groupBy("rule_id").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).cast("long").alias("worst"), F.min_by("cwe", F.when(F.col("cwe") != "", F.col("ord"))).alias("cwe"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a row for each rule


@query("rule_rows", FIND + f", r AS (SELECT rule_id, count(*) AS n, max({_RANK})::BIGINT AS worst FROM finding GROUP BY rule_id) SELECT rule_id, n, worst, row_number() OVER (ORDER BY worst DESC, n DESC, rule_id) AS place FROM r")
def rule_rows(spark, sf_dir):
    """Rules as a report lists them: the worst first, then the most frequent."""
    return triage.rule_rows(findings(spark, sf_dir))


@query("severity_pivot", FIND + " SELECT lang, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ("critical", "high", "medium", "low", "info")) + ", count(DISTINCT file) AS files FROM finding GROUP BY lang")
def severity_pivot(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("lang").agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}") for s in ("critical", "high", "medium", "low", "info")], F.countDistinct("file").alias("files"))


@query("gate_count", FIND + f" SELECT count(*) FILTER (NOT suppressed) AS active, count(*) FILTER (NOT suppressed AND {_RANK} >= 4) AS failing FROM finding")
def gate_count(spark, sf_dir):
    return triage.gate(findings(spark, sf_dir), "high")


#: What a scan of a text for poor or toxic writing reports, by expression.
_MARKS = {"toxic": r"(?i)\b(?:idiot|moron|pathetic|scum|stupid|trash|worthless)s?\b", "poor": r"[!?$#*]{3,}"}


@query(
    "precision_recall",
    "WITH e AS (SELECT doc_id, 'toxic' AS rule_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor' FROM labels WHERE quality = 0), d AS (SELECT DISTINCT doc_id, text FROM documents JOIN labels USING (doc_id)),"
    " g AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, sum(len(regexp_extract_all(text, '{x}'))) AS n FROM d WHERE regexp_matches(text, '{x}') GROUP BY doc_id" for r, x in _MARKS.items()) + "),"
    " c AS (SELECT coalesce(e.rule_id, g.rule_id) AS rule_id, sum(CASE WHEN e.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN e.doc_id IS NULL THEN n ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN g.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS fn"
    " FROM e FULL JOIN g ON e.doc_id = g.doc_id AND e.rule_id = g.rule_id GROUP BY 1)"
    " SELECT rule_id, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS p, round(tp / (tp + fn)::DOUBLE, 6) AS r FROM c",
)
def precision_recall(spark, sf_dir):
    """Expected against found rules of each labelled text: hits and misses count rules, false alarms count findings."""
    la = table(spark, sf_dir, "labels")
    tag = lambda d, r: d.select("doc_id", F.lit(r).alias("rule_id"))
    e = tag(la.where("toxic = 1"), "toxic").union(tag(la.where("quality = 0"), "poor")).withColumn("e", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(la.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    counts = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.size(F.regexp_extract_all("text", F.lit(x), F.lit(0))).alias("n")) for r, x in _MARKS.items()])
    g = d.select("doc_id", F.explode(counts).alias("c")).select("doc_id", "c.*").where("n > 0").groupBy("doc_id", "rule_id").agg(F.sum("n").alias("n"))
    return score(e, g)


def score(expected: DataFrame, got: DataFrame) -> DataFrame:
    j = expected.join(got, ["doc_id", "rule_id"], "full")
    c = j.groupBy("rule_id").agg(
        F.count(F.when(F.col("e") & F.col("n").isNotNull(), 1)).alias("tp"),
        F.sum(F.when(F.col("e").isNull(), F.col("n")).otherwise(0)).cast("long").alias("fp"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("fn"),
    )
    return c.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("p"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("r"))


@query("sarif_rule_index", FIND + ", f AS (SELECT rule_id, min(ord) AS first FROM finding GROUP BY 1) SELECT rule_id, row_number() OVER (ORDER BY first) - 1 AS idx FROM f")
def sarif_rule_index(spark, sf_dir):
    """Rules numbered in the order in which they first appear."""
    f = findings(spark, sf_dir).groupBy("rule_id").agg(F.min("ord").alias("first"))
    return f.select("rule_id", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("idx"))  # a row for each rule


@query(
    "sarif_levels",
    FIND + f" SELECT DISTINCT severity, CASE WHEN {_RANK} >= 4 THEN 'error' WHEN {_RANK} = 3 THEN 'warning' ELSE 'note' END AS level, (2 * {_RANK} - 1) || '.0' AS score FROM finding",
)
def sarif_levels(spark, sf_dir):
    return findings(spark, sf_dir).select("severity").distinct().select("severity", sarif_level(F.col("severity")).alias("level"), sarif_score(F.col("severity")).alias("score"))


@query("union_passes", SQL + " SELECT 0::BIGINT AS pass, fn, seq FROM instr WHERE k = 1 UNION ALL SELECT 1, fn, seq FROM instr WHERE k = 2 AND seq % 2 = 0 UNION ALL SELECT 2, fn, seq FROM instr WHERE k = 20")
def union_passes(spark, sf_dir):
    i = derived.instructions(spark, sf_dir)
    passes = [i.where("k = 1"), i.where("k = 2 AND seq % 2 = 0"), i.where("k = 20")]
    out = [p.select(F.lit(n).cast("long").alias("pass"), "fn", "seq") for n, p in enumerate(passes)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("finding_dedup", FIND + " SELECT rule_id, file, line % 50 AS slot, min(ord) AS ord, arg_min(callee, ord) AS callee FROM finding WHERE file IS NOT NULL GROUP BY rule_id, file, line % 50")
def finding_dedup(spark, sf_dir):
    f = findings(spark, sf_dir).where("file IS NOT NULL").select("rule_id", "file", (F.col("line") % 50).alias("slot"), "ord", "callee")
    return triage.one_per(f, ["rule_id", "file", "slot"], ["ord"])


@query("relative_paths", FIND + " SELECT DISTINCT file, CASE WHEN starts_with(file, 'app/') THEN substr(file, 5) ELSE file END AS rel FROM finding WHERE file IS NOT NULL")
def relative_paths(spark, sf_dir):
    return findings(spark, sf_dir).where("file IS NOT NULL").select("file", relative(F.col("file"), "app").alias("rel")).distinct()


@query(
    "fragment_merge",
    "WITH base AS (SELECT p_brand AS id, p_partkey AS k, p_name AS item FROM part WHERE p_size < 20), own AS (SELECT p_brand AS id, 1000000000 + p_partkey AS k, p_name AS item FROM part WHERE p_size >= 15),"
    " f AS (SELECT id, item, min(k) AS k FROM (SELECT * FROM base UNION ALL SELECT * FROM own) GROUP BY id, item) SELECT id, string_agg(item, ',' ORDER BY k) AS items FROM f GROUP BY id",
)
def fragment_merge(spark, sf_dir):
    """A fragment's list, then a rule's own, each item at its first place."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("k"), F.col("p_name").alias("item"), "p_size")
    items = lambda d: d.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))
    base, own = items(p.where("p_size < 20")), items(p.where("p_size >= 15")).withColumnRenamed("items", "own")
    both = F.array_distinct(F.concat(F.coalesce("items", F.array()), F.coalesce("own", F.array())))
    return base.join(own, "id", "full").select("id", F.array_join(both, ",").alias("items"))


@query(
    "suffix_import_resolution",
    SQL + ", names AS (SELECT DISTINCT replace(replace(callee, ':', '/'), '/', '.') AS nm FROM instr), suf AS (SELECT nm, array_to_string(string_split(nm, '.')[i:], '.') AS s FROM (SELECT nm, unnest(range(1, len(string_split(nm, '.')) + 1)) AS i FROM names)),"
    " uniq AS (SELECT s, min(nm) AS nm FROM suf GROUP BY s HAVING count(DISTINCT nm) = 1) SELECT s AS name, nm AS target FROM uniq",
)
def suffix_import_resolution(spark, sf_dir):
    """Dotted suffixes that one module alone ends in, and that module."""
    n = derived.instructions(spark, sf_dir).select(F.translate("callee", ":/", "..").alias("full")).distinct()
    parts = F.split("full", "\\.")
    s = n.select("full", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name"))
    return s.groupBy("name").agg(F.min("full").alias("target"), F.max("full").alias("_most")).where("target = _most").drop("_most")


@query("duplicate_rule_ids", "SELECT p_name AS rule_id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_rule_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("rule_id")).agg(F.count("*").alias("n")).where("n > 1")


@query("last_definition_wins", SQL + ", d AS (SELECT lang || ':' || method_name AS key, fn, row_number() OVER (PARTITION BY lang || ':' || method_name ORDER BY module DESC, fn DESC) AS i FROM func) SELECT key, fn FROM d WHERE i = 1")
def last_definition_wins(spark, sf_dir):
    """Of functions with one canonical name the last module's last one is it."""
    f = derived.functions(spark, sf_dir)
    return f.groupBy(F.concat_ws(":", "lang", "method_name").alias("key")).agg(F.max_by("fn", F.struct("module", "fn")).alias("fn"))
