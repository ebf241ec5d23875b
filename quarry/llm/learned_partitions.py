"""Approximate nearest neighbours by learned partitions.

A sample of the vectors (at most `sample` rows, by hash) gives a graph of nearest
neighbours; it is cut into parts of about equal size with few edges between them: one for
PART_ROWS rows of the table, 32 at least, and one for 16 rows of the sample at most.
A small network learns the parts of a vector's neighbours from the vector alone; an offset
for each part, set on the sample, keeps the parts even for rows it has not seen. It puts
every row into its most probable part, and sends a query to its `probes` most probable
parts, where all cosines are computed. `probes` is the smallest number that finds
`recall` of the neighbours in the sample itself, so it follows the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import BLOCK_VALUES, finite, in_blocks, matrix, one_dimension, search_blocks

SAMPLE, PARTS, PART_ROWS, NEIGHBOURS, RECALL = 8192, 32, 1024, 10, 0.97
#: Queries that are compared with a block at a time.
QUERIES = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Indices of the k nearest other rows of each row (x of unit length), in blocks."""
    out = []
    for i in range(0, len(x), block):
        c = x[i : i + block] @ x.T
        c[np.arange(len(c)), np.arange(i, i + len(c))] = -2
        out.append(np.argpartition(-c, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.05) -> np.ndarray:
    """Part of each row: halved along leading directions, then rows move to the part of most
    of their neighbours where that part has room."""
    n = len(x)
    part = np.zeros(n, np.int64)
    for level in range(int(np.log2(parts))):
        for p in range(1 << level):
            at = np.flatnonzero(part == p)
            y = x[at] - x[at].mean(axis=0)
            direction = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = np.argsort(y @ direction, kind="stable")
            part[at[order[len(at) // 2 :]]] += 1 << level
    most = int(np.ceil((1 + slack) * n / parts))
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[wish[i]] < most:
                size[part[i]] -= 1
                size[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer and a softmax over the parts, then an offset for each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d) * np.sqrt(d), np.zeros(hidden), rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
        self.offset = np.zeros(p)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                a, y = x[order[i : i + 256]], target[order[i : i + 256]]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                e = (self._softmax(h @ self.w[2] + self.w[3]) - y) / len(a)
                back = (e @ self.w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Score of each part: log odds and offset."""
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3] + self.offset

    def balance(self, x: np.ndarray, rounds: int = 200, step: float = 0.1) -> "Router":
        """Set the offsets so that the parts of x are about even; those of the evenest round stay."""
        score, p = self(x), len(self.offset)
        offset, kept, least = np.zeros(p), np.zeros(p), len(x) + 1
        for _ in range(rounds):
            size = np.bincount((score + offset).argmax(axis=1), minlength=p)
            if size.max() < least:
                least, kept = size.max(), offset.copy()
            offset -= step * np.log((size + 1) / (len(x) / p + 1))
        self.offset += kept
        return self


def fit(x: np.ndarray, parts: int = PARTS, neighbours: int = NEIGHBOURS, recall: float = RECALL, k: int = 5) -> tuple[Router, int]:
    """(router, probes) from sampled vectors. A sample too small for that many parts has fewer."""
    x = unit(x)
    while parts > 1 and len(x) < 16 * parts:
        parts //= 2
    if parts == 1:
        return Router(x[:1], np.ones((1, 1)), epochs=0), 1
    graph = neighbour_graph(x, neighbours)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), neighbours), part[graph].ravel()), 1.0)
    target[np.arange(len(x)), part] += 1
    held = np.arange(len(x)) % 5 == 0  # tells how many probes a vector it has not seen needs
    train = Router(x[~held], target[~held] / (neighbours + 1)).balance(x[~held])
    placed = train(x).argmax(axis=1)
    chance = train(x[held])
    near = neighbour_graph(x, k)[held]
    place = (-chance).argsort(axis=1).argsort(axis=1)[np.arange(len(chance))[:, None], placed[near]]
    probes = int(np.quantile(place, recall, method="higher")) + 1
    return Router(x, target / (neighbours + 1)).balance(x), min(probes, parts)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _nearest(k: int):
    def call(built, who: np.ndarray, q: np.ndarray):
        ids, x, directions = built
        near = unit(q) @ directions.T
        near[who[:, None] == ids[None, :]] = -np.inf
        top = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - top, axis=1)[:, -top]
        i, j = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
        # every row near the k-th place again, by one formula, so that equal vectors tie
        score = cosines(q[i], x[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        good = place < k
        return who[i[good]], ids[j[good]], score[good]

    return call


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL, probes: int | None = None, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of embeddings (vec_id, embedding) found
    for each row of queries (vec_id, embedding), other than the row of its own id.

    Every query gets k rows, or all there are if fewer. Vectors that are null, zero, of
    another dimension than most, or hold null or non-finite components take no part on
    either side. vec_id is taken to be unique; rows without one take no part. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    v = F.col("embedding").cast("array<double>")
    usable = finite(v) & F.col("vec_id").isNotNull() & F.exists(v, lambda x: x != 0)
    rows = one_dimension(embeddings.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")))
    asked = queries.filter(usable).select(F.col("vec_id").cast("bigint").alias("query_id"), v.alias("q"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    empty = spark.createDataFrame([], f"query_id bigint, rank int, vec_id bigint, score double")
    if not picked.num_rows:
        return empty
    x = matrix(picked["v"], np.float64)
    asked = asked.filter(F.size("q") == x.shape[1])
    if parts is None:
        parts = 1 << max(PARTS, min(rows.count() // PART_ROWS, sample // 16)).bit_length() - 1
    router, own = fit(x, parts, recall=recall, k=k)
    shared = spark.sparkContext.broadcast(router)
    n_parts = len(router.offset)
    probes = min(probes or own, n_parts)

    def place(batches):
        for b in batches:
            part = shared.value(unit(matrix(b.column(1), np.float64))).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], ["vec_id", "v", "part"])

    index = scratch.save(rows.mapInArrow(place, "vec_id bigint, v array<double>, part int"), "index")
    size = np.zeros(n_parts, np.int64)
    for r in index.groupBy("part").count().collect():  # one row per part
        size[r.part] = r["count"]

    def route(batches):
        for b in batches:
            chance = shared.value(unit(matrix(b.column(1), np.float64))) if b.num_rows else np.zeros((0, n_parts))
            order = (-chance).argsort(axis=1, kind="stable")
            # on to further parts while those before hold k + 1 rows at most: the query's own may be one
            before = np.cumsum(size[order], axis=1) - size[order]
            wanted = (np.arange(n_parts) < probes) | (before <= k)
            i, c = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(order[i, c].astype(np.int32))], ["query_id", "q", "part"])

    routed = asked.mapInArrow(route, "query_id bigint, q array<double>, part int")
    left, n = in_blocks(index, dict(enumerate(map(int, size))), block_rows or max(1, BLOCK_VALUES // x.shape[1]))
    return search_blocks(left, routed, n, lambda ids, v: (ids, v, unit(v)), _nearest(k), k, "double", np.float64, QUERIES)


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """The exact answer, for tests and for recall."""
    out = {}
    for q in queries:
        s = cosines(np.broadcast_to(x[ids == q][0], x.shape), x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out
