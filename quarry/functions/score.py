"""Relevance of a file for a query: name + path + recency + depth + type - noise."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import noise
from .text import byte_offset

# The weights of the score.
NAME_EQUAL, NAME_PREFIX, NAME_WITHIN, NAME_LEAST = 120, 80, 40, 10
PATH_PART, PATH_WITHIN = 30, 15
RECENCY = [(86400, 40), (7 * 86400, 25), (30 * 86400, 10)]
DEPTH_FREE, DEPTH_STEP, DEPTH_MOST = 8, 2, 30
NOISE_COST = {noise.SYSTEM: 60, noise.BUILD: 90, noise.CACHE: 70, noise.HASHY: 40, noise.DEEP: 10, noise.APP_DATA: 50, noise.LOG: 40}
TYPES = {
    20: ["pdf", "doc", "docx", "txt", "md", "rst", "rtf", "odt"],
    15: [
        "rs", "py", "js", "ts", "jsx", "tsx", "go", "java", "c", "cpp", "h", "hpp", "rb", "php", "swift", "kt", "scala",
        "hs", "ml", "ex", "exs", "clj", "cs", "fs", "lua", "sh", "bash", "zsh", "fish", "pl", "r", "sql", "zig", "nim",
        "v", "d", "cr",
    ],
    5: ["json", "yaml", "yml", "toml", "ini", "cfg", "conf", "xml", "env"],
    -20: ["exe", "dll", "so", "dylib", "o", "a", "lib", "bin", "class", "pyc", "pyo", "wasm"],
}

_STALE = noise.BUILD | noise.CACHE | noise.APP_DATA | noise.LOG


def _has(mask: int) -> Column:
    return F.col("noise_flags").bitwiseAND(F.lit(mask)) != 0


def _sum(parts: list[Column]) -> Column:
    return reduce(add, parts, F.lit(0))


def name_score(terms: list[str]) -> Column:
    name = F.col("name_lc")
    return _sum([
        F.when(name == t, NAME_EQUAL)
        .when(F.startswith(name, F.lit(t)), NAME_PREFIX)
        .when(F.contains(name, F.lit(t)), F.greatest(NAME_WITHIN - byte_offset(name, t), F.lit(NAME_LEAST)))
        .otherwise(0)
        for t in terms
    ])


def path_score(terms: list[str]) -> Column:
    path = F.col("abs_lc")
    return _sum([F.when(F.array_contains(F.split(path, "/", -1), t), PATH_PART).when(F.contains(path, F.lit(t)), PATH_WITHIN).otherwise(0) for t in terms])


def recency_score(now: int) -> Column:
    age = F.lit(now).cast("long") - F.col("mtime")
    tier = F.when(_has(_STALE), 0)
    for seconds, points in RECENCY:
        tier = tier.when(age < seconds, points)
    return tier.otherwise(0)


def depth_score() -> Column:
    over = F.greatest(F.col("path_depth") - DEPTH_FREE, F.lit(0))
    return -F.least(over * DEPTH_STEP, F.lit(DEPTH_MOST))


def type_score() -> Column:
    """A third, cut towards zero, in noisy and system places."""
    full, third = F.lit(0), F.lit(0)
    for points, exts in TYPES.items():
        full = F.when(F.col("ext").isin(exts), points).otherwise(full)
        third = F.when(F.col("ext").isin(exts), int(points / 3)).otherwise(third)
    return F.when(_has(_STALE | noise.SYSTEM), third).otherwise(full)


def noise_score() -> Column:
    return _sum([F.when(_has(bit), cost).otherwise(0) for bit, cost in NOISE_COST.items()])


def quick_score(now: int) -> Column:
    """What needs no query term; the first pass of two-pass ranking sorts by it."""
    return recency_score(now) + type_score() + depth_score() - noise_score()


def total_score(terms: list[str], now: int) -> Column:
    return name_score(terms) + path_score(terms) + quick_score(now)
