"""Results as text or as one JSON object per line."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GREEN, PLAIN = "\x1b[32m", "\x1b[0m"


def as_json_rows(numbered: DataFrame, query: str) -> DataFrame:
    """Distributed form: one JSON string per hit."""
    return numbered.select(F.to_json(F.struct(F.lit("hit").alias("kind"), F.lit(query).alias("query"), "rank", "path")).alias("value"))


def print_human(result, out=sys.stdout, err=sys.stderr, color: bool = False, quiet: bool = False) -> None:
    for r in result.rows:
        out.write(f"{GREEN}{r['path']}{PLAIN}\n" if color else f"{r['path']}\n")
    if result.total > len(result.rows):
        out.write(f"... and {result.total - len(result.rows)} more results\n")
    if not quiet:
        err.write(f"{result.total} results in {result.seconds.get('total', 0) * 1000:.1f} ms\n")


def print_json(result, out=sys.stdout, err=sys.stderr, quiet: bool = False) -> None:
    for r in result.rows:
        out.write(json.dumps({"kind": "hit", "query": result.query, "rank": r["rank"], "path": r["path"]}, ensure_ascii=False) + "\n")
    if not quiet:
        err.write(json.dumps({"kind": "summary", "query": result.query, "total": result.total, "duration_ms": int(result.seconds.get("total", 0) * 1000)}) + "\n")
