"""Command line: list and run queries, show settings, check tables."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import load_settings
from .errors import EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dialoom")
    p.add_argument("--config", help="a TOML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("config", help="show the settings")
    sub.add_parser("list", help="list the queries")
    run = sub.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="write the result here as Parquet instead of showing rows")
    run.add_argument("--rows", type=int, default=20)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    """0: done, 1: a known error, 2: wrong usage."""
    args = parser().parse_args(argv)
    try:
        settings = load_settings(args.config)
        if args.command == "config":
            print(settings.as_json())
            return 0
        from .plans.catalogue import queries

        known = queries()
        if args.command == "list":
            print("\n".join(sorted(known)))
            return 0
        if args.query not in known:
            print(f"no query {args.query}", file=sys.stderr)
            return 2
        frame = known[args.query](SparkSession.builder.appName("dialoom").getOrCreate(), args.tables)
        if args.out:
            frame.write.mode("errorifexists").parquet(args.out)
        else:
            frame.show(args.rows, truncate=80)
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
