"""Scanning a tree: files to functions to findings, then triage and the gate.

    findings = scan(spark, "src/")
    print(reports.as_sarif(findings)); sys.exit(exit_code(findings, "high"))
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import reports
from weirflow.functions.globs import any_of
from weirflow.functions.scalars import fingerprint, verdict
from weirflow.operators import engine, lines, names, triage
from weirflow.rules import Rule, shipped
from weirflow.session import cut, written
from weirflow.sources import inventory, js_frontend, mir_frontend, python_frontend

CONFIGS = (".weirflow.yaml", ".weirflow.yml", ".weirflow.json")
#: An id is file:line:col and the number of the instruction there.
_PLACE = r"^(.*):(\d+):(\d+):\d+$"


@dataclass
class Config:
    fail_on: str = "high"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    disable: list[str] = field(default_factory=list)
    severities: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """The file itself, or the first of CONFIGS in a folder where there is one. YAML needs PyYAML."""
        p = Path(path)
        if p.is_dir():
            p = next((p / c for c in CONFIGS if (p / c).exists()), None)
            if p is None:
                return cls()
        if p.suffix == ".json":
            raw = json.loads(p.read_text())
        else:
            import yaml

            raw = yaml.safe_load(p.read_text()) or {}
        raw = {k.replace("-", "_"): v for k, v in raw.items()}
        rules = raw.pop("rules", None) or {}
        raw |= {own: rules[k] for k, own in (("disable", "disable"), ("severity-overrides", "severities")) if k in rules}
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"{p}: {', '.join(sorted(unknown))} isn't known")
        return cls(**raw)


def configured(rules: list[Rule], config: Config) -> list[Rule]:
    """The rules that are on, with the severities that are set; the given ones stay as they are."""
    return [replace(r, severity=config.severities.get(r.id, r.severity)) for r in rules if r.id not in config.disable]


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a list of files, a line each."""
    line = F.trim("value")
    return spark.read.text(path).select(F.regexp_replace(line, r"^\./", "").alias("path")).where("path <> ''").distinct()


def read_program(spark: SparkSession, path: str) -> DataFrame:
    """Functions that another frontend wrote, as Parquet or JSON of the engine's schema."""
    return spark.read.schema(engine.FUNCTION).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(engine.FUNCTION).parquet(path)


def lowered(text: DataFrame) -> DataFrame:
    """Functions or errors of the files (path, lang, text) that a frontend reads."""
    low = python_frontend.lower(text.where("lang = 'python'")).unionByName(mir_frontend.lower(text.where("path LIKE '%.mir'")))
    return low.unionByName(js_frontend.lower(text.where("lang = 'javascript'")), allowMissingColumns=True)


def scan(spark: SparkSession, path: str, rules: list[Rule] | None = None, config: Config | None = None, baseline: str | None = None, changed: list[str] | DataFrame | None = None, program: DataFrame | None = None) -> DataFrame:
    """Findings of the Python files, the templates, the text and any further functions of a tree:
    (rule_id, severity, confidence, cwe, message, fn, callee, origin, sink, steps, file, line, col, fingerprint, suppressed, reason).

    Suppressed findings stay, with the reason. changed, a list or (path): findings are seeded from these files only."""
    config = config or Config.load(path)
    rules = configured(shipped() if rules is None else rules, config)
    files = inventory.inventory(spark, path, content=True)
    text = files.select("path", "lang", inventory.text().alias("text"))
    low = cut(lowered(text))
    functions = js_frontend.with_default_exports(python_frontend.functions(low), low)
    if program is not None:
        functions = functions.unionByName(program.select(*functions.columns))
    functions = cut(functions)
    scope = None
    if changed is not None:
        wanted = changed if isinstance(changed, DataFrame) else spark.createDataFrame([(c,) for c in changed], "path string")
        scope = low.join(wanted, "path", "left_semi").select("fn").where("fn IS NOT NULL")
    taint = engine.analyze(functions, rules, scope)
    danger = engine.dangerous(functions, rules)
    if scope is not None:
        danger = danger.join(scope, "fn", "left_semi")
    meta = spark.createDataFrame([(r.id, r.cwe, r.message) for r in rules], "rule_id string, cwe string, message string")
    danger = danger.join(F.broadcast(meta), "rule_id").withColumn("origin", F.col("sink"))  # rules, not data
    danger = danger.withColumn("steps", F.array().cast("array<string>"))
    place = lambda d: d.withColumns({"file": F.regexp_extract("sink", _PLACE, 1), "line": F.regexp_extract("sink", _PLACE, 2).try_cast("long"), "col": F.regexp_extract("sink", _PLACE, 3).try_cast("long")})
    cols = ["rule_id", "severity", "confidence", "cwe", "message", "fn", "callee", "origin", "sink", "steps", "file", "line", "col"]
    taint, danger = place(taint).select(*cols), place(danger).select(*cols)
    at = F.concat_ws(":", "file", "line", "col")
    danger = triage.without_located(danger.withColumn("pos", at), taint.withColumn("pos", at)).drop("pos")
    src = lines.numbered(text.where("text IS NOT NULL"), ["path"], "text").withColumnRenamed("path", "file")
    secret = secrets(text, functions, [*_builtin(config), *[r for r in rules if r.kind == "secret"]]).select(*cols)
    raw = template_findings(text, config).select(*cols)
    every = taint.unionByName(danger).unionByName(secret).unionByName(raw)
    # flows from two files into one call are two findings; an origin without a place is named by itself
    source = F.when(F.col("origin").rlike(_PLACE), F.regexp_extract("origin", _PLACE, 1)).otherwise(F.col("origin"))
    every = every.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), source, F.col("fn"), F.col("callee")))
    every = triage.ignored(every, src)
    every = every.withColumn("_path", triage.path_state(F.col("file"), config.include, config.exclude))
    known = reports.read_baseline(spark, baseline) if baseline else spark.createDataFrame([], "fingerprint string")
    every = triage.against_baseline(every, known, ["file", "line", "col", "rule_id"])
    reason = F.when(F.col("ignored"), "inline").when(F.col("_path").isNotNull(), F.concat(F.lit("path "), "_path")).when(F.col("suppressed"), "baseline")
    return every.withColumn("reason", reason).withColumn("suppressed", F.col("reason").isNotNull()).drop("ignored", "_path")


def _builtin(config: Config) -> list[Rule]:
    every = [Rule(id=r, kind="secret", severity=s, cwe="CWE-798", message="credential in the source", matches=x) for r, s, x in lines.SECRETS]
    return configured(every, config)


def secrets(text: DataFrame, functions: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches of secret rules: in the string constants of functions, and line by line in text, where a rule without
    languages looks everywhere and one with languages into constants only. One finding for each rule and line."""
    own = text.where("text IS NOT NULL").select(F.col("path").alias("file"), "text").where(~lines.exempt(F.col("file")))
    every = [r for r in rules if not r.languages]
    found = lines.matching(own, ["file"], [(r.id, r.matches) for r in every]).select("file", "line", "rule_id")
    const = engine.constants(functions).where(F.col("at").rlike(_PLACE))
    const = const.select(F.regexp_extract("at", _PLACE, 1).alias("file"), F.regexp_extract("at", _PLACE, 2).cast("long").alias("line"), "lang", "text").where(~lines.exempt(F.col("file")))
    for r in rules:
        spoken = const if not r.languages else const.where(F.lower("lang").isin(*[x.lower() for x in r.languages]))
        found = found.unionByName(spoken.where(F.col("text").rlike(r.matches)).select("file", "line", F.lit(r.id).alias("rule_id")))
    meta = text.sparkSession.createDataFrame([(r.id, r.severity, r.cwe, r.message) for r in rules], "rule_id string, severity string, cwe string, message string")
    return _located(found.distinct().join(F.broadcast(meta), "rule_id"))  # rules, not data


def _located(found: DataFrame) -> DataFrame:
    """Findings (rule_id, severity, cwe, message, file, line[, callee]) of text, with the columns of all findings."""
    empty = {c: F.lit("") for c in ("fn", "callee", "origin") if c not in found.columns}
    return found.withColumns({**empty, "confidence": F.lit("medium"), "sink": F.concat_ws(":", "file", "line"), "steps": F.array().cast("array<string>"), "col": F.lit(1).cast("long")})


#: Directives of templates that put a value into a page raw: (callee, rule, message).
RAW = [
    ("vue_html", "template-raw-html", "a value is put into the page as HTML"), ("svelte_html", "template-raw-html", "a value is put into the page as HTML"),
    ("vue_url", "template-raw-url", "an address of the page is a value"), ("erb_raw", "template-raw-html", "a value is put into the page as HTML"),
]


def template_findings(text: DataFrame, config: Config) -> DataFrame:
    """Raw output of single-file components and of ERB templates."""
    t = text.where("text IS NOT NULL").where(F.col("path").rlike(r"\.(vue|svelte|erb)$"))
    got = lines.raw_outputs(t, ["path"]).withColumnRenamed("path", "file")
    severity = {r: config.severities.get(r, "low" if r == "template-raw-url" else "medium") for _, r, _ in RAW}
    meta = text.sparkSession.createDataFrame([(c, r, severity[r], "CWE-79", m) for c, r, m in RAW if r not in config.disable], "callee string, rule_id string, severity string, cwe string, message string")
    return _located(got.join(F.broadcast(meta), "callee").drop("expression"))


def builds_allowed(spark: SparkSession) -> bool:
    """Whether a frontend may run a project's own build tool: off unless the session says so."""
    return spark.conf.get("weirflow.allow.build", "false").strip().lower() in ("1", "true", "yes", "on")


def request_hosts(functions: DataFrame, rules: list[Rule]) -> DataFrame:
    """(fn): functions outside the target that call a source of the rules themselves (``operators.names``)."""
    objects = sorted({s for r in rules for s in r.request_objects})
    plain = sorted({s for r in rules for s in r.sources} - set(objects))
    test = lambda globs: any_of(F.col("callee"), globs) if globs else F.lit(False)
    return names.request_hosts(functions.select("fn", "is_target", F.explode("calls.callee").alias("callee")), test(plain), test(objects))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(lang, files, converted, failed, bytes, lines): what a scan saw. A file that failed is not a clean file."""
    files = inventory.inventory(spark, path, content=True)
    text = inventory.text()
    low = lowered(files.select("path", "lang", text.alias("text")))
    files = files.withColumn("lines", F.size(F.split(text, "\n")).cast("long"))
    return inventory.coverage(files.drop("content"), low.select("path", "error").distinct())


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a tree."""
    return inventory.inventory(spark, path, content=True).select(F.col("path").alias("file"), inventory.text().alias("text"))


def exit_code(findings: DataFrame, fail_on: str = "high", failed_files: int = 0, strict: bool = False) -> int:
    """0 clean, 1 findings at the threshold or above, 3 where files failed and that is to count."""
    if strict and failed_files:
        return 3
    return int(triage.gate(findings, fail_on).first()["failing"] > 0)


def review(findings: DataFrame, reviewer: Callable[[list[dict]], list[str]], most: int = 200, up_to: str = "medium") -> DataFrame:
    """A reviewer (rows of findings -> a reply to each, text around one JSON object with a ``verdict``, or a bare word)
    may suppress findings of low confidence, the first ``most`` in order. Only 'false_positive' does; an error or any
    other word keeps a finding."""
    from weirflow.functions.scalars import confidence_rank, severity_rank

    rank = confidence_rank(F.col("confidence"))
    asked = findings.where((rank > 0) & (rank <= confidence_rank(F.lit(up_to))) & ~F.col("suppressed"))
    asked = asked.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "col", "rule_id").limit(most)
    jobs = [r.asDict() for r in asked.select("rule_id", "sink", "callee", "file", "line", "message").collect()]  # ``most`` rows
    try:
        said = list(reviewer(jobs))
    except Exception:
        said = []
    gone = [(j["rule_id"], j["sink"]) for j, s in zip(jobs, said) if (verdict(str(s)) or str(s)).strip().lower() in ("false_positive", "false-positive")]
    drop = F.broadcast(findings.sparkSession.createDataFrame(gone, "rule_id string, sink string").withColumn("_gone", F.lit(True)))
    j = findings.join(drop, ["rule_id", "sink"], "left")
    hit = F.coalesce("_gone", F.lit(False))
    return j.withColumn("reason", F.when(hit, "reviewer").otherwise(F.col("reason"))).withColumn("suppressed", hit | F.col("suppressed")).drop("_gone")


def rules_test(findings: DataFrame, expected: dict[str, int]) -> dict[str, tuple[int, int]]:
    """{rule: (expected at least, found)} of what a sample should give and doesn't, and of what it shouldn't and does."""
    found = {r["rule_id"]: r["n"] for r in findings.where("NOT suppressed").groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    return {r: (expected.get(r, 0), found.get(r, 0)) for r in {*found, *expected} if found.get(r, 0) < expected.get(r, 0) or r not in expected}
