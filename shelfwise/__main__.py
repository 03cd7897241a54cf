"""Command line: list the reports, or run one over a data folder into a report sink.

    python -m shelfwise list
    python -m shelfwise run <report> --data /path/sf --out /path/reports [--format csv|parquet]

A run is the reference's request -> report cycle without the mail transport:
registry lookup by name, a lazy DataFrame, Catalyst, and a write to
``<out>/run_ts=<stamp>/report=<name>/sheet=main``.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shelfwise")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("report")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--format", default="csv", choices=("csv", "parquet"))
    args = ap.parse_args(argv)

    from shelfwise.plans.registry import load_all

    reports = load_all()
    if args.cmd == "list":
        for name, r in reports.items():
            print(f"{name:32s} {','.join(r.covers):40s} {r.doc.splitlines()[0] if r.doc else ''}")
        return 0
    if args.report not in reports:
        print(f"unknown report {args.report}", file=sys.stderr)
        return 2
    from shelfwise.session import get_spark
    from shelfwise.sources.sinks import run_stamp, write_report
    from shelfwise.sources.tables import Tables

    spark = get_spark(f"shelfwise-{args.report}")
    df = reports[args.report].build(Tables(spark, args.data))
    path = write_report(df, args.out, args.report, "main", run_stamp(), fmt=args.format)
    print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
