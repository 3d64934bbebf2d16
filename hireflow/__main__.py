"""Command line: list, run or check the registered queries.

    python -m hireflow list
    python -m hireflow run NAME --sf-dir DIR [--out PATH] [--format parquet|csv|show]
    python -m hireflow check [NAMES...] --sf-dir DIR        (Spark vs DuckDB oracle)
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="hireflow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--sf-dir", required=True)
    run.add_argument("--out")
    run.add_argument("--format", default="show", choices=("parquet", "csv", "show"))
    run.add_argument("--master")
    chk = sub.add_parser("check")
    chk.add_argument("names", nargs="*")
    chk.add_argument("--sf-dir", required=True)
    args = ap.parse_args(argv)

    from .plans import registry
    if args.cmd == "list":
        sql = registry.oracle_sql()
        for name in registry.queries():
            print(f"{name}\t{'oracle' if name in sql else 'rows-only'}")
        return 0
    if args.cmd == "check":
        from .plans.compare import main as compare_main
        return compare_main(["--sf-dir", args.sf_dir, *args.names])
    from .session import build_session
    spark = build_session(args.master)
    df = registry.queries()[args.name](spark, args.sf_dir)
    if args.format == "show":
        df.show(50, truncate=False)
    elif not args.out:
        ap.error("--out is required for parquet/csv")
    else:
        df.write.mode("errorifexists").format(args.format).option("header", True).save(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
