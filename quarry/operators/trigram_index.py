"""Inverted lists in long form: one row per (trigram, file).

The table is written sorted by trigram, so the few trigrams of a query touch a few
row groups; an array per trigram would put a third of all ids into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import python_trigrams, trigrams


def file_trigrams(files: DataFrame) -> DataFrame:
    """(tri, fid) of visible files, from relative paths."""
    return files.filter("visible").select(F.explode(trigrams(F.col("rel_path"))).alias("tri"), "fid")


def directory_trigrams(dirs: DataFrame) -> DataFrame:
    return dirs.select(F.explode(trigrams(F.col("name"))).alias("tri"), F.col("rel_path").alias("dir_path"))


def posting_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("tri").agg(F.count("*").alias("n"))


def write_index(postings: DataFrame, path: str, partitions: int = 64) -> None:
    postings.repartitionByRange(partitions, "tri", "fid").sortWithinPartitions("tri", "fid").write.mode("overwrite").parquet(path)


def candidates(postings: DataFrame, needle: str) -> DataFrame:
    """fid of the files that hold every trigram of needle: a superset of its matches."""
    tris = python_trigrams(needle)
    if not tris:
        return postings.select("fid").distinct()
    hits = postings.filter(F.col("tri").isin([bytearray(t) for t in tris]))
    return hits.groupBy("fid").agg(F.count_distinct("tri").alias("n")).filter(F.col("n") == len(tris)).select("fid")
