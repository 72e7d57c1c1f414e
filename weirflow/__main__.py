"""python -m weirflow PATH: scan a tree, report, and end with the gate's code: 0 clean, 1 findings, 2 wrong usage or
configuration, 3 files that failed (with --strict)."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from weirflow import api, reports
from weirflow.functions.scalars import SEVERITIES
from weirflow.rules import RuleError, build, read
from weirflow.sources import inventory


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weirflow", description=__doc__)
    p.add_argument("path")
    p.add_argument("--rules", help="a file or folder of rules instead of the shipped ones")
    p.add_argument("--config", help="a configuration file instead of the one of the tree")
    p.add_argument("--baseline", help="findings known before")
    p.add_argument("--write-baseline", metavar="FILE")
    p.add_argument("--changed-files", metavar="FILE", help="a list of files, or - for the standard input")
    p.add_argument("--format", choices=("text", "json", "sarif", "html"), default="text")
    p.add_argument("--output", metavar="FILE")
    p.add_argument("--fail-on", choices=SEVERITIES)
    p.add_argument("--strict", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        inventory.target(args.path)
        config = api.Config.load(args.config or (args.path if Path(args.path).is_dir() else Path(args.path).parent))
        rules = build(read(args.rules)) if args.rules else None
    except (OSError, ValueError, ImportError, RuleError) as e:
        print(f"weirflow: {e}", file=sys.stderr)
        return 2
    fail_on = args.fail_on or config.fail_on
    if fail_on not in SEVERITIES:
        print(f"weirflow: {fail_on!r} is no severity", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("weirflow").getOrCreate()
    changed = None
    if args.changed_files == "-":
        changed = [x.strip().removeprefix("./") for x in sys.stdin if x.strip()]
    elif args.changed_files:
        changed = api.changed_files(spark, args.changed_files)
    began = time.time()
    found = api.written(api.scan(spark, args.path, rules, config, args.baseline, changed))
    seconds = {"scan": time.time() - began}
    cover = api.written(api.coverage(spark, args.path))
    if args.write_baseline:
        reports.write_baseline(found, args.write_baseline)
    if args.format == "html":
        doc = reports.as_html(found, api.sources(spark, args.path), cover, seconds)
    else:
        doc = {"text": reports.as_text, "json": reports.as_json, "sarif": reports.as_sarif}[args.format](found)
    if args.output:
        Path(args.output).write_text(doc)
    else:
        print(doc)
    print(reports.coverage_line(cover), file=sys.stderr)
    failed = sum(r.failed for r in cover.collect())  # a row for each language
    return api.exit_code(found, fail_on, failed, args.strict)


if __name__ == "__main__":
    sys.exit(main())
