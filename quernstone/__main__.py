"""Command line: build, validate, list-templates."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from quernstone import settings as S
from quernstone.operators import validate
from quernstone.pipeline import Pipeline
from quernstone.plans import reports, templates
from quernstone.sources import datasets


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernstone")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build a dataset on a topic from a table of pages")
    b.add_argument("topic")
    b.add_argument("--pages", help="Parquet of (page_id, url, html)")
    b.add_argument("--format", dest="fmt")
    b.add_argument("--max-samples", type=int)
    b.add_argument("--max-cost", type=float)
    b.add_argument("--output")
    b.add_argument("--config", default="quernstone.toml")
    b.add_argument("--template", choices=list(templates.TEMPLATES))
    b.add_argument("--dry-run", action="store_true")
    v = sub.add_parser("validate", help="validate a JSONL file")
    v.add_argument("path")
    v.add_argument("--format", dest="fmt", default="reasoning", choices=validate.available_formats())
    sub.add_parser("list-templates")
    a = p.parse_args(argv)
    if a.command == "list-templates":
        for k, (about, fmt, pages, samples, _, _) in templates.TEMPLATES.items():
            print(f"{k:<14} {fmt:<10} {pages:>3} pages {samples:>4} samples  {about}")
        return 0
    spark = spark or SparkSession.builder.appName("quernstone").getOrCreate()
    if a.command == "validate":
        return _validate(spark, a.path, a.fmt)
    s = S.load(a.config, ".env")
    if a.fmt is not None:
        s = replace(s, generate=replace(s.generate, default_format=a.fmt))
    if a.max_samples is not None:
        s = replace(s, generate=replace(s.generate, max_samples=a.max_samples))
    if a.max_cost is not None:
        s = replace(s, budget=replace(s.budget, max_cost_usd=a.max_cost))
    if a.output is not None:
        s = replace(s, output_dir=a.output)
    pipeline = Pipeline(spark, s)
    if a.dry_run:
        print(reports.console_summary(pipeline.dry_run(a.template)))
        return 0
    try:
        found = pipeline.run(a.topic, pages=spark.read.parquet(a.pages))
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    print(reports.console_summary(found.metrics))
    return 0


def _validate(spark: SparkSession, path: str, fmt: str) -> int:
    try:
        lines = datasets.read_lines(spark, path)
        bad = lines.where("NOT ok").count()
        for r in lines.where("NOT ok").orderBy("file", "line").limit(20).collect():
            print(f"Line {r['line']}: skipped, no JSON", file=sys.stderr)
        records = datasets.indexed(lines.where("ok"))
        if records.isEmpty():
            print("no valid record", file=sys.stderr)
            return 1
    except Exception as e:
        print(f"can't read {path}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    print(reports.console_summary(validate.report(records, fmt).first().asDict() | {"unreadable_lines": bad}))
    for r in validate.errors(records, fmt).orderBy("idx", "kind", "key").limit(20).collect():
        print(f"Record {r['idx']}: {r['kind']} {r['key'] or ''} {r['detail'] or ''}".rstrip())
    for r in validate.lineage_warnings(records).orderBy("idx").limit(10).collect():
        print(f"Record {r['idx']}: {r['kind']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
