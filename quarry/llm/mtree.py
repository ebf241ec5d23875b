"""Exact top-k inner products by best-first search of M-trees.

Vectors are integers. The top page is one for the whole table: at most PAGE routing vectors
from the sample, each row below the nearest; covering radii, largest norms and sizes come
from one aggregation, and a query is sent only to those entries that it may need. Below it
rows are dealt into blocks by hash, each bulk-loaded once into an M-tree over the Euclidean
distance: pages of at most PAGE entries, where an entry keeps its routing vector (inner
pages) or its row (leaves), its distance to the vector of its page, and inner ones the
covering radius and the largest norm below them. With d >= |d(q, page) - d(entry, page)|
- radius from stored distances alone, and 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2, an entry
whose upper bound is below a query's k-th score so far is passed over before its distance
is computed. Pages are visited best bound first, for a block of queries at a time: a page
is compared with those queries that it may still serve.

Scores are sums of integers, exact in 64 bits; bounds are doubles with a margin, and only
exclude what lies strictly below. The k-th best score within a small fixed set of rows
(`seeds` rows, by hash) is where each query starts, as it is a lower bound of its result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import BLOCK_VALUES, finite, in_blocks, kth_best, matrix, one_dimension, search_blocks

PAGE, SEEDS = 64, 1024
#: Rows that are worth an entry of the top page; queries searched for at a time.
ENTRY_ROWS, QUERIES = 1024, 1024
MARGIN = 1e-6
LOWEST = np.iinfo(np.int64).min + 1


def spread_out(x: np.ndarray, want: int, first: int) -> tuple[list[int], np.ndarray]:
    """(rows far from each other, number of the nearest of them for each row); fewer if rows are equal."""
    chosen = [first]
    near = ((x - x[first]) ** 2).sum(axis=1)
    owner = np.zeros(len(x), np.int64)
    for c in range(1, want):
        far = int(near.argmax())
        if near[far] == 0:
            break
        d = ((x - x[far]) ** 2).sum(axis=1)
        owner[d < near] = c
        near = np.minimum(near, d)
        chosen.append(far)
    return chosen, owner


def upper_bounds(square: np.ndarray, product: np.ndarray, to: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product of each query (its square, its products with and distances
    to the routing vectors) with any row below each entry."""
    gap = np.maximum(to - radius, 0)
    upper = np.minimum((square[:, None] + norm - gap**2) / 2, product + np.sqrt(square)[:, None] * radius)
    return upper + MARGIN * (1 + np.abs(upper))


def distances(square: np.ndarray, product: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(square[:, None] + (pivots**2).sum(axis=1) - 2 * product, 0))


class Page:
    """vector: of the page; rows: of its whole subtree; children: pages, or none for a leaf."""

    __slots__ = ("vector", "rows", "children", "pivots", "radius", "parent", "norm", "points")

    def __init__(self, x: np.ndarray, square: np.ndarray, rows: np.ndarray, vector: np.ndarray, rng):
        self.vector, self.rows = vector, rows
        if len(rows) <= PAGE:
            self.children, self.points = [], x[rows]
            self.parent = np.sqrt(((self.points - vector) ** 2).sum(axis=1))
            self.norm = square[rows]
            return
        # as many routing vectors as pages are needed, each far from those before it
        want = min(PAGE, -(-len(rows) // (PAGE // 2)))
        chosen, owner = spread_out(x[rows], want, int(rng.integers(len(rows))))
        if len(chosen) == 1:  # equal rows: pages by count
            owner = np.arange(len(rows)) * want // len(rows)
        groups = [rows[owner == c] for c in range(owner.max() + 1)]
        groups = [g for g in groups if len(g)]
        vectors = [x[rows[chosen[c]]] if len(chosen) > 1 else x[rows[0]] for c in range(len(groups))]
        self.children = [Page(x, square, g, v, rng) for g, v in zip(groups, vectors)]
        self.pivots = np.stack(vectors)
        self.parent = np.sqrt(((self.pivots - vector) ** 2).sum(axis=1))
        self.radius = np.array([np.sqrt(((x[g] - v) ** 2).sum(axis=1)).max() for g, v in zip(groups, vectors)])
        self.norm = np.array([square[g].max() for g in groups])


class Tree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 0):
        self.ids, self.x = ids, x.astype(np.float64)
        self.square = (self.x**2).sum(axis=1)
        self.exact = x
        self.root = Page(self.x, self.square, np.arange(len(ids)), self.x[0], np.random.default_rng(seed))
        self.computed = 0  # distances and products that no bound spared

    def search(self, who: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        """(query ids, row ids, scores) of each query's k best rows that reach its floor, other
        than the row of its own id."""
        n = len(who)
        qf = q.astype(np.float64)
        square = (qf**2).sum(axis=1)
        # sums that stay below 2**52 are exact in doubles as well
        small = np.sqrt(square.max(initial=0)) * np.sqrt(self.square.max()) < 2.0**52
        left, right = (qf, self.x) if small else (q, self.exact)
        best = np.full((n, k), LOWEST)
        owner = np.full((n, k), np.iinfo(np.int64).max)
        floor = floor.copy()
        start = np.sqrt(np.maximum(((qf - self.root.vector) ** 2).sum(axis=1), 0))
        heap, turn = [(-np.inf, 0, self.root, np.full(n, np.inf), start)], 0
        while heap:
            _, _, page, bound, distance = heapq.heappop(heap)
            live = np.flatnonzero(bound >= floor)
            if not len(live):
                continue
            d = distance[live][:, None]
            radius = 0 if not page.children else page.radius
            gap = np.maximum(np.abs(d - page.parent) - radius, 0)
            upper = (square[live][:, None] + page.norm - gap**2) / 2
            upper += MARGIN * (1 + np.abs(upper))
            may = upper >= floor[live][:, None]
            entries = np.flatnonzero(may.any(axis=0))
            if not len(entries):
                continue
            self.computed += int(may[:, entries].sum())
            if not page.children:
                rows = page.rows[entries]
                score = left[live] @ right[rows].T
                ok = may[:, entries] & (score >= floor[live][:, None]) & (who[live][:, None] != self.ids[rows][None, :])
                some = np.flatnonzero(ok.any(axis=1))
                if not len(some):
                    continue
                at = live[some]
                s = np.concatenate([best[at], np.where(ok[some], score[some].astype(np.int64), LOWEST)], axis=1)
                o = np.concatenate([owner[at], np.where(ok[some], self.ids[rows][None, :], np.iinfo(np.int64).max)], axis=1)
                order = np.lexsort((o, -s), axis=1)[:, :k]
                best[at] = np.take_along_axis(s, order, axis=1)
                owner[at] = np.take_along_axis(o, order, axis=1)
                full = owner[at, k - 1] != np.iinfo(np.int64).max
                floor[at[full]] = np.maximum(floor[at[full]], np.nextafter(best[at[full], k - 1].astype(np.float64), -np.inf))
                continue
            pivots = page.pivots[entries]
            product = qf[live] @ pivots.T
            to = distances(square[live], product, pivots)
            upper = upper_bounds(square[live], product, to, page.radius[entries], page.norm[entries])
            upper[~may[:, entries]] = -np.inf
            for c, e in enumerate(entries):
                down, where = np.full(n, -np.inf), np.zeros(n)
                down[live], where[live] = upper[:, c], to[:, c]
                turn += 1
                heapq.heappush(heap, (-float((down - np.where(np.isfinite(floor), floor, 0)).max()), turn, page.children[e], down, where))
        i, c = np.nonzero(owner != np.iinfo(np.int64).max)
        return who[i], owner[i, c], best[i, c]


def _floor(who: np.ndarray, q: np.ndarray, seeds, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best score, from the sampled rows."""
    ids, rows = seeds
    score = (q @ rows.T).astype(np.float64)
    score[who[:, None] == ids[None, :]] = -np.inf
    return np.nextafter(kth_best(score, k), -np.inf)


def _top(k: int, seeds):
    def call(tree: Tree, who: np.ndarray, q: np.ndarray):
        return tree.search(who, q, k, _floor(who, q, seeds.value, k))

    return call


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, seeds: int = SEEDS, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * embedding) of
    each row of queries (vec_id, embedding) with the rows of embeddings, except its own.

    Ties go to the smaller vec_id; a query gets all rows if there are fewer than k. Vectors
    that are null, of another dimension than most, or hold null or non-finite components
    take no part on either side (zero vectors do). vec_id is taken to be unique; rows
    without one take no part. Other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("bigint"))
    usable = finite(v) & F.col("vec_id").isNotNull()
    rows = one_dimension(embeddings.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v")))
    asked = queries.filter(usable).select(F.col("vec_id").cast("bigint").alias("query_id"), whole.alias("q"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(seeds).toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    start = matrix(picked["v"], np.int64)
    shared = spark.sparkContext.broadcast((picked["vec_id"].to_numpy(), start))
    asked = asked.filter(F.size("q") == start.shape[1])
    want = max(1, min(PAGE, rows.count() // ENTRY_ROWS))
    pivots = start[spread_out(start.astype(np.float64), want, 0)[0]].astype(np.float64)

    def place(batches):
        for b in batches:
            x = matrix(b.column(1), np.float64).reshape(b.num_rows, pivots.shape[1])
            square = (x**2).sum(axis=1)
            part = distances(square, x @ pivots.T, pivots).argmin(axis=1)
            away = np.sqrt(((x - pivots[part]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32)), pa.array(away), pa.array(square)], ["vec_id", "v", "part", "away", "square"])

    index = Scratch(spark, "mtree").save(rows.mapInArrow(place, "vec_id bigint, v array<bigint>, part int, away double, square double"), "rows")
    radius, norm, size = np.zeros(len(pivots)), np.full(len(pivots), -np.inf), {}
    for r in index.groupBy("part").agg(F.max("away").alias("away"), F.max("square").alias("square"), F.count("*").alias("n")).collect():  # at most PAGE rows
        radius[r.part], norm[r.part], size[r.part] = r.away, r.square, r.n

    def route(batches):
        for b in batches:
            for i in range(0, b.num_rows, QUERIES):
                c = b.slice(i, QUERIES)
                q = matrix(c.column(1), np.int64)
                qf = q.astype(np.float64)
                square, product = (qf**2).sum(axis=1), qf @ pivots.T
                upper = upper_bounds(square, product, distances(square, product, pivots), radius, norm)
                at, p = np.nonzero(upper >= _floor(c.column(0).to_numpy(), q, shared.value, k)[:, None])
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(at)), c.column(1).take(pa.array(at)), pa.array(p.astype(np.int32))], ["query_id", "q", "part"])

    routed = asked.mapInArrow(route, "query_id bigint, q array<bigint>, part int")
    left, n = in_blocks(index.select("vec_id", "v", "part"), size, block_rows or max(1, BLOCK_VALUES // start.shape[1]))
    return search_blocks(left, routed, n, Tree, _top(k, shared), k, "bigint", np.int64, QUERIES)


SQL = """
with e as (select vec_id, embedding from embeddings where embedding is not null and vec_id is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(embedding) > 0),
v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from e),
s as (select q.vec_id query_id, r.vec_id, cast(list_inner_product(q.v, r.v) as bigint) score from v q, v r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id),
n as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s)
select query_id, cast("rank" as integer) "rank", vec_id, score from n where "rank" <= 5
"""
