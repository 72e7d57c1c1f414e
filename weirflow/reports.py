"""Findings as JSON, SARIF and HTML documents, and the baseline file.

A report is one document, so the findings in it come to the driver: they are what a
person reads. ``rows`` writes findings of any number as a table instead."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import humanised, sarif_level, sarif_score, severity_rank
from weirflow.operators import lines, triage

TOOL = "weirflow"


def ordered(findings: DataFrame) -> list[dict]:
    """Severity first, then place; unknown places last."""
    keys = [severity_rank(F.col("severity")).desc(), F.asc_nulls_last("file"), F.asc_nulls_last("line"), F.asc_nulls_last("col"), F.asc("rule_id"), F.asc("sink")]
    cols = findings.withColumns({"level": sarif_level(F.col("severity")), "score": sarif_score(F.col("severity"))})
    return [r.asDict(recursive=True) for r in cols.orderBy(*keys).collect()]


def rows(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").parquet(path)


def as_json(findings: DataFrame) -> str:
    out = []
    for f in ordered(findings):
        one = {k: f.get(k) for k in ("rule_id", "severity", "confidence", "cwe", "message", "fn", "callee", "file", "line", "col", "fingerprint", "suppressed", "reason")}
        if len(f.get("steps") or []) > 1:
            one["path"] = f["steps"]
        out.append(one)
    return json.dumps({"tool": TOOL, "schemaVersion": "1", "findings": out}, indent=2, sort_keys=True)


_PLACE = re.compile(r"(.*):(\d+):(\d+):\d+")


def place(step: str) -> str:
    """A step for a reader: file:line:col where it is a place."""
    m = _PLACE.fullmatch(step)
    return ":".join(m.groups()) if m else step


def _location(step: str) -> dict:
    m = _PLACE.fullmatch(step)
    out: dict = {"message": {"text": place(step)}}
    if m:
        out["physicalLocation"] = {"artifactLocation": {"uri": m.group(1)}, "region": {"startLine": max(int(m.group(2)), 1), "startColumn": max(int(m.group(3)), 1)}}
    return out


def as_text(findings: DataFrame) -> str:
    """Active findings in order, then how many were suppressed and why."""
    every = ordered(findings)
    active = [f for f in every if not f.get("suppressed")]
    out = [f"{f['severity'].upper()} {f['rule_id']} {f.get('file') or '<unknown>'}:{f.get('line') or '?'}:{f.get('col') or '?'} {f.get('message') or ''}".rstrip() for f in active]
    why: dict[str, int] = {}
    for f in every:
        if f.get("suppressed"):
            why[f.get("reason") or "?"] = why.get(f.get("reason") or "?", 0) + 1
    out += [f"{n} suppressed: {r}" for r, n in sorted(why.items())]
    return "\n".join([*out, f"{len(active)} findings"])


def coverage_line(coverage: DataFrame) -> str:
    """What a scan saw of each language; a failed file is not a clean one."""
    rows_ = coverage.orderBy("lang").collect()  # a row for each language
    return ", ".join(f"{r.lang}: {r.converted} of {r.files} files" + (f" ({r.failed} failed)" if r.failed else "") for r in rows_) or "no source files"


def as_sarif(findings: DataFrame) -> str:
    rules: dict[str, int] = {}
    results, described = [], []
    for f in ordered(findings):
        if f["rule_id"] not in rules:
            rules[f["rule_id"]] = len(rules)
            described.append({"id": f["rule_id"], "shortDescription": {"text": f.get("message") or f["rule_id"]}, "properties": {"security-severity": f["score"], "tags": [t for t in [f.get("cwe")] if t]}})
        r = {"ruleId": f["rule_id"], "ruleIndex": rules[f["rule_id"]], "level": f["level"], "message": {"text": f.get("message") or f["rule_id"]}, "partialFingerprints": {"primary/v1": f.get("fingerprint") or ""}}
        if f.get("file"):
            r["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": f["file"]}, "region": {"startLine": max(f.get("line") or 1, 1), "startColumn": max(f.get("col") or 1, 1)}}}]
        if len(f.get("steps") or []) > 1:
            r["codeFlows"] = [{"threadFlows": [{"locations": [{"location": _location(s)} for s in f["steps"]]}]}]
        if f.get("suppressed"):
            r["suppressions"] = [{"kind": "inSource" if f.get("reason") == "inline" else "external", "justification": f.get("reason") or ""}]
        results.append(r)
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": TOOL, "rules": described}}, "results": results}]}, indent=2)


def as_html(findings: DataFrame, text: DataFrame | None = None, coverage: DataFrame | None = None, seconds: dict[str, float] | None = None) -> str:
    """One page without scripts: counts, rules, findings with their code and the way of the taint, diagnostics.
    text: (file, text) for the code; coverage: (lang, files, converted, failed, bytes); seconds: by phase."""
    found = ordered(findings)
    e = lambda x: html.escape(str(x if x is not None else ""))
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    head = lambda *names: "<thead><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr></thead>"
    active = findings.where("NOT suppressed")
    count = {r["severity"]: r["n"] for r in active.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    cells = "".join(f"<li class='{s}'>{s}: {count.get(s, 0)}</li>" for s in ("critical", "high", "medium", "low", "info"))
    total = max(sum(count.values()), 1)
    rules = "".join(row(e(r["rule_id"]), r["n"], f"{100 * r['n'] / total:.1f} %") for r in triage.rule_rows(active).orderBy("place").collect())
    code: dict[tuple, list[str]] = {}
    if text is not None:
        at = findings.where("line IS NOT NULL").select("file", "line").distinct()
        for r in lines.snippets(at, lines.numbered(text, ["file"], "text"), 2).orderBy("file", "line", "_line").collect():  # five lines a finding
            mark = ">" if r["_line"] == r["line"] else " "
            code.setdefault((r["file"], r["line"]), []).append(f"{mark}{r['_line']:>5} {r['text']}")
    body = ""
    for f in found:
        snippet = "\n".join(code.get((f.get("file"), f.get("line")), []))
        steps = f.get("steps") or []
        more = (f"<pre>{e(snippet)}</pre>" if snippet else "") + ("<ol>" + "".join(f"<li>{e(place(s))}</li>" for s in steps) + "</ol>" if len(steps) > 1 else "")
        where = f"{e(f.get('file') or '<unknown>')}:{e(f.get('line'))}"
        body += f"<tr class='{e(f['severity'])}'>" + row(e(f["severity"]), e(f["rule_id"]), where + more, e(f.get("callee")), e(f.get("confidence")), e(f.get("reason") if f.get("suppressed") else ""))[4:]
    panel = ""
    if coverage is not None:
        took = sum((seconds or {}).values())
        cols = coverage.columns
        shown = coverage.withColumn("_size", humanised(F.col("bytes")) if "bytes" in cols else F.lit("")).orderBy("lang").collect()
        panel = "<h2>Diagnostics</h2><table>" + head("language", "files", "converted", "failed", "size") + "".join(row(e(r["lang"]), r["files"], r["converted"], r["failed"], r["_size"]) for r in shown) + "</table>"
        panel += "<table>" + head("phase", "seconds") + "".join(row(e(k), f"{v:.2f}") for k, v in (seconds or {}).items()) + "</table>"
        if took and "lines" in cols:
            panel += f"<p>{sum(r['lines'] or 0 for r in shown) / took:.0f} lines a second</p>"
    return (
        "<!doctype html><html><head><meta charset='utf-8'><meta http-equiv='Content-Security-Policy' content=\"default-src 'none'\">"
        f"<title>{TOOL}</title></head><body><h1>Findings</h1><ul>{cells}</ul><h2>Rules</h2><table>{head('rule', 'findings', 'share')}<tbody>{rules}</tbody></table>"
        f"<h2>Places</h2><table>{head('severity', 'rule', 'place', 'callee', 'confidence', 'suppressed')}<tbody>{body}</tbody></table>{panel}</body></html>"
    )


def write_baseline(findings: DataFrame, path: str) -> None:
    """Fingerprints of what isn't suppressed, sorted; copies count."""
    prints = [r.fingerprint for r in findings.where("NOT suppressed").select("fingerprint").orderBy("fingerprint").collect()]
    Path(path).write_text(json.dumps({"tool": TOOL, "fingerprints": prints}, indent=1))


def read_baseline(spark, path: str) -> DataFrame:
    return spark.read.schema("fingerprints array<string>").json(path, multiLine=True).select(F.explode("fingerprints").alias("fingerprint"))
