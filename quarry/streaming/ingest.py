"""Continuous ingest: walk records arriving as files become catalogue rows.

An extension: a batch build rescans everything. The latest record of a path wins when
the written log is read back, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalog import build_catalog


def stream_catalog(spark: SparkSession, source: str, schema: str, root: str, **options: str) -> DataFrame:
    """Streaming catalogue rows of the JSON records that land in a folder."""
    return build_catalog(spark.readStream.schema(schema).options(**options).json(source), root)


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def latest(files: DataFrame) -> DataFrame:
    """The newest row of each path, from an append-only log."""
    w = Window.partitionBy("abs_path").orderBy(F.desc("mtime"), F.desc("fid"))
    return files.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
