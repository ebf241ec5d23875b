"""What both vector searches share: usable rows, queries against blocks of rows, merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Components of a block of rows (16 MB of doubles): what a task holds, in a few copies.
BLOCK_VALUES = 1 << 21


def finite(v: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def one_dimension(rows: DataFrame) -> DataFrame:
    """The rows (vec_id, v) of the most common dimension (the smaller one on a tie)."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (top.d if top else 0))


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def in_blocks(rows: DataFrame, size: dict[int, int], block_rows: int) -> tuple[DataFrame, Column]:
    """rows (vec_id, v, part) with `block`, by hash, of about block_rows rows each, and the number
    of blocks of a row's part, for queries. size: rows of each part, as many as parts."""
    counts = [-(-size.get(p, 0) // block_rows) or 1 for p in range(max(size, default=0) + 1)]
    n = F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("part") + 1)
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), n).cast("int")), n


def search_blocks(rows: DataFrame, queries: DataFrame, blocks: Column, build: Callable, call: Callable, k: int, score: str, dtype, at_once: int) -> DataFrame:
    """Each query's k best rows: query_id, rank, vec_id, score.

    rows: vec_id, v, part, block; queries: query_id, q and a part to be searched, sent to all
    blocks of it. Every row is shuffled once. A task holds one block: built = build(row ids,
    rows), then call(built, query ids, queries) -> (query ids, row ids, scores) for at_once
    queries at a time, however many there are."""
    kind = pa.float64() if score == "double" else pa.int64()
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    both = rows.select("part", "block", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v")
    both = both.unionByName(sent.select("part", "block", F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v")))

    def run(batches):
        key, ids, held, built = None, [], [], None
        for b in batches:
            part, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            asks = b.column(2).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *edge], [*edge, b.num_rows]) if b.num_rows else ():
                if key != (part[i], block[i]):
                    key, ids, held, built = (part[i], block[i]), [], [], None
                own, x = b.column(3).slice(i, j - i).to_numpy(), matrix(b.column(4).slice(i, j - i), dtype)
                if not asks[i]:
                    ids.append(own)
                    held.append(x)
                    continue
                if built is None and held:
                    built = build(np.concatenate(ids), np.concatenate(held))
                    ids, held = [], []
                for c in range(0, len(own) if built is not None else 0, at_once):
                    who, found, value = call(built, own[c : c + at_once], x[c : c + at_once])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(found), pa.array(value, kind)], ["query_id", "vec_id", "score"])

    met = both.repartition("part", "block").sortWithinPartitions("part", "block", "asks", "id")
    hits = met.mapInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
