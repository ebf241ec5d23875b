"""Learned partitions against brute force, and quality votes on labels that were held out."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import learned_partitions, quality_knn
from quarry.llm.queries import queries

SF = "/root/testdata/sf0.01"


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    good = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows.embedding]
    rows = rows[good]
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float64)
    want = learned_partitions.brute_force(ids, x, ids[ids % 50 == 0], 5)
    got: dict[int, list[tuple[int, float]]] = {}
    for r in queries()["op2_learned_partitions"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    at = {i: j for j, i in enumerate(ids)}
    for q, found in got.items():
        exact = learned_partitions.cosines(np.broadcast_to(x[at[q]], (len(found), x.shape[1])), x[[at[i] for i, _ in found]])
        assert np.allclose([s for _, s in found], exact, rtol=0, atol=1e-12)


def test_vector_edge_cases(spark):
    kind = "vec_id long, embedding array<float>, label string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [2.0, 0.0], "c"), (3, [0.0, 1.0], None), (4, None, None), (5, [0.0, 0.0], None), (6, [nan, 1.0], None), (7, [inf, 1.0], None), (8, [1.0, None], None), (9, [], None), (10, [1.0], None), (None, [1.0, 1.0], None)]
    e = spark.createDataFrame(rows, kind)
    got = [tuple(r) for r in learned_partitions.search(e, e.filter("vec_id in (0, 4, 5)")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    none = spark.createDataFrame([], kind)
    assert learned_partitions.search(none, none).count() == 0


def test_held_out_accuracy(spark):
    got = queries()["op7_quality_knn"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality in (0, 1)").select("doc_id", "quality")
    seen = got.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert seen[1] > 50 and seen[0] > 0.97
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "", 1), (2, None, 2), (3, "good words here", 3), (3, "good words here", 3), (None, "x", 4), (5, "a " * 200000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (5, 0), (1, 1), (2, 7), (None, 0)], "doc_id long, quality int")
    got = quality_knn.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 3]
    assert same[0] == same[1]
    nothing = quality_knn.score(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert quality_knn.score(docs.limit(0), labels).count() == 0


def test_votes_against_brute_force(spark):
    """Terms, weights, projection, cosines and votes one by one, for every document of a table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_knn.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_knn.score(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        raw = (r.text or "").encode()
        count = np.zeros(quality_knn.TERMS)
        for i in range(len(raw) - 2):
            count[((int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1) % 2**32) >> 20] = 1
        last = {}
        for i, w in enumerate(raw.split()):
            gap = min((i - last[w]).bit_length() - 1, 14) if w in last else 15
            count[quality_knn.CLASSES + gap * 16 + min(len(w), 15)] += 1
            last[w] = i
        weighed = np.log1p(count) * model.rarity
        weighed /= max(np.linalg.norm(weighed), 1e-30)
        v = weighed @ model.axes
        cosine = model.vectors @ v / max(np.linalg.norm(v), 1e-30)
        least = max(sorted(cosine)[-quality_knn.K], 1e-6)
        votes = [(c**quality_knn.SHARPNESS, y) for c, y in zip(cosine, model.labels) if c >= least]
        want = sum(c * y for c, y in votes) / sum(c for c, _ in votes) if votes else model.prior
        assert abs(got[r.doc_id] - want) < 0.05, r.doc_id  # single precision may change the last neighbour


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, "x", 2.5), (2, None, None, None, None)], "doc_id long, text string, score int, predicted string, held_out double")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality_knn.score(docs, labels, columns=docs.columns).columns == ["doc_id", "held_out", "score", "predicted", "doc_id_", "text", "score_", "predicted_", "held_out_"]
    assert sorted(map(tuple, quality_knn.accepted(docs, labels).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_driver_holds_no_dense_sample(spark):
    """Fitting takes less of the driver's memory than one table of the labelled sample's counts would."""
    r = random.Random(3)
    n, words = 3000, ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=30))) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    tracemalloc.start()
    model = quality_knn.fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.vectors) > n / 2
    assert most < len(model.vectors) * quality_knn.TERMS * np.dtype(np.float32).itemsize


def test_short_texts_have_a_bound_too():
    """Ten thousand short texts in one batch are not held with all terms at once."""
    batch = pa.record_batch({"quality": pa.array([1] * 10_000, pa.int32()), "text": [f"text {i}" for i in range(10_000)]})
    tracemalloc.start()
    assert sum(b.num_rows for b in quality_knn._sample_rows([batch])) == 10_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2000 * quality_knn.TERMS * np.dtype(np.float32).itemsize
