"""Algebra of id sets. Each side is a DataFrame with a column fid; none has nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("fid"), "fid", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("fid"), "fid", "left_anti")


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """On multisets: the smaller count of each id."""
    return a.select("fid").intersectAll(b.select("fid"))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """On multisets: counts of a less counts of b."""
    return a.select("fid").exceptAll(b.select("fid"))
