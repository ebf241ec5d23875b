"""Both vector searches against brute force: clustered tables, many blocks, ties, odd rows."""

import numpy as np
import pytest

from quarry.llm import learned_partitions, mtree


def clustered(n=4000, centres=80, d=24, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, d)) * 4
    return middle[rng.integers(centres, size=n)] + rng.standard_normal((n, d)) * 0.4


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def exact(ids, v, asked, k):
    out = []
    for q in asked:
        s = v @ v[ids == q][0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(int(q), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("block_rows", [None, 97])
def test_mtree_in_blocks(spark, block_rows):
    x = clustered(2500)
    x[1000:1400] = x[1000]  # ties, in one entry of the top page
    ids = np.arange(len(x))
    e = frame(spark, ids, x)
    got = mtree.search(e, e.filter("vec_id % 50 = 0"), block_rows=block_rows).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == exact(ids, np.floor(256 * x).astype(np.int64), ids[ids % 50 == 0], 5)


def test_mtree_bounds_spare_work():
    v = np.floor(256 * clustered()).astype(np.int64)
    ids = np.arange(len(v))
    tree = mtree.Tree(ids, v)
    asked = ids[::50]
    who, found, score = tree.search(asked, v[asked], 5, np.full(len(asked), -np.inf))
    want = exact(ids, v, asked, 5)
    assert sorted(zip(who, found, score)) == sorted((q, i, s) for q, _, i, s in want)
    assert tree.computed < 0.5 * len(v) * len(asked)


def test_mtree_large_sums():
    v = np.array([[2**30, 1], [2**30, 2], [2**30, 3], [2**30, 0], [2**30, 2]], np.int64)
    who, found, score = mtree.Tree(np.arange(5), v).search(np.array([2]), v[2:3], 3, np.full(1, -np.inf))
    assert list(found) == [1, 4, 0] and list(score) == [2**60 + 6, 2**60 + 6, 2**60 + 3]


def test_mtree_edge_cases(spark):
    kind = "vec_id long, embedding array<float>, part string, score int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0]), (None, [1.0, 1.0])]
    e = spark.createDataFrame([(*r, "p", 1) for r in rows], kind)
    got = [tuple(r) for r in mtree.search(e, e.filter("vec_id in (0, 2, 4, 7)")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 0), (0, 3, 3, -65536), (2, 1, 0, 0), (2, 2, 1, 0), (2, 3, 3, 0)]
    none = spark.createDataFrame([], kind)
    assert mtree.search(none, none).count() == 0


@pytest.mark.parametrize("block_rows", [None, 50])
def test_partitions_of_clusters(spark, block_rows):
    """Recall of 0.9, with well below half of all rows compared."""
    x = clustered()
    ids = np.arange(len(x))
    e = frame(spark, ids, x)
    got = learned_partitions.search(e, e.filter("vec_id % 50 = 0"), block_rows=block_rows).collect()
    want = learned_partitions.brute_force(ids, x, ids[ids % 50 == 0], 5)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == 5 * len(want)
    assert sum((q, i) in found for q, near in want.items() for i, _ in near) >= 0.9 * 5 * len(want)


def test_partitions_are_even_and_few_are_probed():
    x = clustered(4000)
    router, probes = learned_partitions.fit(x[::2], 32)
    size = np.bincount(router(learned_partitions.unit(x)).argmax(axis=1), minlength=32)
    assert size.max() < 3 * len(x) / 32
    assert probes <= 12
