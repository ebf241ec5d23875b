"""python -m quarry.cli {query,index,history} ..."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .operators.printers import print_human, print_json
from .operators.search import run_query
from .sources.history import History
from .sources.store import check_catalog, info, open_catalog, open_or_build, write_catalog


def session() -> SparkSession:
    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    home = os.environ.get("QUARRY_HOME", os.path.expanduser("~/.quarry"))
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--catalog", default=f"{home}/catalog")
    p.add_argument("--history", default=f"{home}/history.ndjson")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("-n", "--limit", type=int, default=20)
    q.add_argument("--json", action="store_true")
    q.add_argument("--color", action="store_true")
    q.add_argument("-q", "--quiet", action="store_true")
    q.add_argument("--mode", choices=["indexed", "faithful"], default="indexed")
    i = sub.add_parser("index")
    i.add_argument("action", choices=["build", "info"])
    i.add_argument("--root", default=os.path.expanduser("~"))
    i.add_argument("--force", action="store_true", help="accepted; a build always rescans")
    h = sub.add_parser("history")
    h.add_argument("-n", "--limit", type=int, default=20)
    h.add_argument("--clear", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=os.environ.get("QUARRY_LOG", "WARNING").upper())
    history = History(args.history)
    if args.command == "history" and args.clear:
        history.clear()
        return 0
    spark = session()
    if args.command == "history":
        for r in history.recent(spark, args.limit).collect():
            print(r.timestamp, r.raw_query, r.hits, sep="\t")
        return 0
    try:
        if args.command == "query":
            ready = check_catalog(spark, args.catalog) == "ok"  # whatever its root: it was built on purpose
            files = (open_catalog(spark, args.catalog) if ready else open_or_build(spark, args.catalog, os.path.expanduser("~")))["files"]
            result = run_query(files, args.text, args.limit, history=history, mode=args.mode)
            if args.json:
                print_json(result, quiet=args.quiet)
            else:
                print_human(result, color=args.color, quiet=args.quiet)
        elif args.action == "build":
            from pyspark.sql import functions as F

            from .operators.catalog import build_catalog, regular_files
            from .sources.fs import scan

            records = regular_files(scan(spark, args.root)).withColumn("fid", F.xxhash64("abs_path"))
            write_catalog(build_catalog(records, args.root), args.catalog, args.root)
        else:
            try:
                open_catalog(spark, args.catalog)
            except FileNotFoundError as e:
                print(e, file=sys.stderr)
                return 1
            for k, v in info(spark, args.catalog).items():
                print(f"{k}: {v}")
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
