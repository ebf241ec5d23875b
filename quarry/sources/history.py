"""Query history: one JSON object per line, appended by the driver, read by Spark."""

from __future__ import annotations

import json
import logging
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

SCHEMA = "version int, timestamp string, raw_query string, hits bigint, duration_ms bigint"
DISABLE_ENV = "QUARRY_HISTORY"


class History:
    def __init__(self, path: str):
        self.path = path

    @property
    def enabled(self) -> bool:
        return os.environ.get(DISABLE_ENV, "1").strip().lower() not in ("0", "false")

    def append(self, raw_query: str, hits: int, duration_ms: int, timestamp: str | None = None) -> None:
        """Never fails a query: errors are logged only."""
        if not self.enabled:
            return
        stamp = timestamp or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        line = json.dumps({"version": 1, "timestamp": stamp, "raw_query": raw_query, "hits": hits, "duration_ms": duration_ms})
        try:
            os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(line + "\n")
        except OSError as e:
            log.warning("history was not written: %s", e)

    def read(self, spark: SparkSession) -> DataFrame:
        """Valid events in file order (line_no); a missing file has none."""
        if not os.path.exists(self.path):
            return spark.createDataFrame([], SCHEMA + ", line_no bigint")
        lines = spark.read.text(f"file://{os.path.abspath(self.path)}").coalesce(1).withColumn("line_no", F.monotonically_increasing_id())
        parsed = lines.withColumn("e", F.from_json("value", SCHEMA))
        return parsed.filter("e.version is not null and e.raw_query is not null and e.hits is not null").select("e.*", "line_no")

    def recent(self, spark: SparkSession, n: int = 20) -> DataFrame:
        return self.read(spark).orderBy(F.desc("line_no")).limit(n)

    def count(self, spark: SparkSession) -> int:
        return self.read(spark).count()

    def clear(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)
