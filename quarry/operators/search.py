"""Search: parse, filter, path order, rank, number.

    hits = search(files, "ext:rs order", limit=20, now=1706616000)

The result is lazy: rank, fid, path, score. A limit becomes TakeOrderedAndProject, so no
full sort happens; ties in the score go to the smaller fid.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import quick_score, total_score
from ..plans.adaptive import compile_adaptive
from ..plans.compiler import compile_filter, path_order
from ..plans.parser import ordered_terms, parse, text_terms

# When ranking takes two passes, and how many hits the first one keeps.
TWO_PASS_HITS, TWO_PASS_RATIO, KEEP_FACTOR = 1000, 10, 3


def score_terms(expr) -> list[str]:
    return [t.text.lower() for t in text_terms(expr) if t.text]


def matches(files: DataFrame, expr, now: int, mode: str = "indexed", **options) -> DataFrame:
    """Catalogue rows that satisfy the tree, before the path-order filter."""
    if mode == "indexed":
        return files.filter(compile_filter(expr, now, **options))
    if mode != "faithful":
        raise ValueError(f"unknown mode {mode!r}")
    return files.filter(compile_adaptive(files, expr, now, options.get("documented_sign", False)))


def hits(files: DataFrame, query: str, now: int, mode: str = "indexed", **options) -> DataFrame:
    expr = parse(query)
    return matches(files, expr, now, mode, **options).filter(path_order(ordered_terms(expr)))


def rank(found: DataFrame, terms: list[str], now: int, limit: int | None, exact: bool = False) -> DataFrame:
    """Top hits by score. Beyond 1,000 hits and 10 times the limit, a first pass keeps the
    3 * limit best by the parts that need no term; exact=True always ranks in one pass."""
    if limit == 0:
        return found.limit(0).withColumn("score", F.lit(0))
    if limit is not None and not exact:
        n = found.limit(max(TWO_PASS_HITS, TWO_PASS_RATIO * limit + limit) + 1).count()
        if n > TWO_PASS_HITS and n // limit > TWO_PASS_RATIO:
            found = found.withColumn("_quick", quick_score(now)).orderBy(F.desc("_quick"), "fid").limit(KEEP_FACTOR * limit).drop("_quick")
    ranked = found.withColumn("score", total_score(terms, now)).orderBy(F.desc("score"), "fid")
    return ranked if limit is None else ranked.limit(limit)


def numbered(ranked: DataFrame) -> DataFrame:
    """rank from 1, fid, display path (with a leading slash), score; only over the kept rows."""
    path = F.when(F.startswith("abs_path", F.lit("/")), F.col("abs_path")).otherwise(F.concat(F.lit("/"), "abs_path"))
    return ranked.select(F.row_number().over(Window.orderBy(F.desc("score"), "fid")).alias("rank"), "fid", path.alias("path"), "score")


def search(files: DataFrame, query: str, limit: int | None = 20, now: int | None = None, *, mode: str = "indexed", exact_rank: bool = False, **options) -> DataFrame:
    """Ranked hits. options: glob (wildcards in names), documented_sign (-7d is the past)."""
    now = int(time.time()) if now is None else now
    expr = parse(query)
    found = matches(files, expr, now, mode, **options).filter(path_order(ordered_terms(expr)))
    ranked = rank(found, score_terms(expr), now, limit, exact_rank)
    if limit is not None:
        return numbered(ranked)
    return ranked.select("fid", F.col("abs_path").alias("path"), "score")


@dataclass
class Result:
    """Hits on the driver, as the service returns them (at most `limit` rows)."""

    query: str
    rows: list
    total: int
    seconds: dict = field(default_factory=dict)


def run_query(files: DataFrame, query: str, limit: int = 20, now: int | None = None, ranked: bool = True, history=None, **options) -> Result:
    """Run a query to its end: hits, the number before the limit, stage times, history."""
    now = int(time.time()) if now is None else now
    marks = [time.perf_counter()]
    expr = parse(query)
    marks.append(time.perf_counter())
    mode = options.pop("mode", "indexed")
    if ranked:
        found = hits(files, query, now, mode, **options)
        total = found.count()
        marks.append(time.perf_counter())
        rows = numbered(rank(found, score_terms(expr), now, limit)).collect()
    else:  # id order, without the path-order filter
        found = matches(files, expr, now, mode, **options)
        total = found.count()
        marks.append(time.perf_counter())
        rows = numbered(found.withColumn("score", F.lit(0)).orderBy("fid").limit(limit)).collect()
    marks.append(time.perf_counter())
    seconds = dict(zip(("parse", "execute", "rank"), (b - a for a, b in zip(marks, marks[1:])))) | {"total": marks[-1] - marks[0]}
    if history is not None:
        history.append(query, total, int(seconds["total"] * 1000))
    return Result(query, rows, total, seconds)
