"""Command line: init, scan, status, context, impact, bench. Exit codes: 0 done, 1 error, 2 usage, 3 planned but not there yet."""

from __future__ import annotations

import argparse
import json
import math
import sys


PLANNED = ("ask", "graph", "analyze", "migrate", "export")


def _number(value: str) -> float:
    x = float(value)
    if not math.isfinite(x):
        raise argparse.ArgumentTypeError("a finite number is needed")
    return x


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("--quiet", action="store_true", help="no word on what is being done")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true", help="replace a configuration that is there")
    sub.add_parser("scan").add_argument("--rebuild", action="store_true")
    sub.add_parser("status")
    c = sub.add_parser("context")
    c.add_argument("task")
    c.add_argument("--budget", type=_number)
    c.add_argument("--max-hops", type=_number)
    c.add_argument("--include", action="append", default=[])
    c.add_argument("--include-from")
    c.add_argument("--raw", action="store_true", help="print the package alone, for a pipe")
    c.add_argument("--explain", action="store_true", help="say why each entity is in")
    i = sub.add_parser("impact")
    i.add_argument("symbol")
    i.add_argument("--max-hops", type=_number, default=3)
    i.add_argument("--min-confidence", type=_number, default=0.3)
    sub.add_parser("bench").add_argument("--limit", type=int, default=20)
    for name in PLANNED:
        sub.add_parser(name, add_help=False)
    a, rest = p.parse_known_args(argv)
    if a.command in PLANNED:
        print(f"{a.command} is planned and not there yet", file=sys.stderr)
        return 3
    if rest:
        p.error(f"unknown arguments: {' '.join(rest)}")

    from pyspark.sql import SparkSession

    from corvane import render
    from corvane.api import Project
    from corvane.sources.scan import include_list

    spark = SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    project = Project(spark, a.root)
    try:
        if a.command == "init":
            out = str(project.init(a.force))
        elif a.command == "scan":
            if not a.quiet:
                print(f"scanning {a.root}", file=sys.stderr)
            out = project.scan(a.rebuild)
        elif a.command == "status":
            out = project.status() | {"stale": project.freshness().count()}
        elif a.command == "context":
            listed = [r["path"] for r in include_list(spark, a.include_from).collect()] if a.include_from else []
            found = project.context(a.task, int(a.budget) if a.budget else None, int(a.max_hops) if a.max_hops is not None else None, a.include + listed)
            out = found["package"] if a.raw else found if a.json else render.context(found, a.explain)
        elif a.command == "impact":
            found = project.impact(a.symbol, int(a.max_hops), a.min_confidence)
            out = found if a.json else render.impact(found)
        else:
            found = project.bench(a.limit)
            out = found if a.json else render.bench(found)
    except (ValueError, LookupError, FileExistsError) as error:
        print(error, file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
