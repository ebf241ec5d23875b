import random

import numpy as np
import pytest

from quarry.llm import lm_scoring
from quarry.llm.lm_scoring import brute_force, cross_entropy_difference
from quarry.llm.queries import op1_lm_scoring


@pytest.mark.parametrize("sizes", [(1, 64, 50), (4, 500, 100), (lm_scoring.HEAD, lm_scoring.HOLD, lm_scoring.BUCKET)])
def test_against_brute_force(spark, sizes):
    r = random.Random(4)
    words = ["the", "The", "of", "été", "x.", "***", "日本", *(f"w{i}" for i in range(30))]
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) + r.choice(["", "\n", " \t"]) for _ in range(80)] + ["", None, "  ", "a" * 5000, " lead"]
    good = [i % 3 == 0 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(4)
    ids = spark.createDataFrame([(i,) for i, g in enumerate(good) if g], "doc_id long")
    got = {r.doc_id: r for r in cross_entropy_difference(docs, ids, *sizes).collect()}
    for i, (n, score) in enumerate(brute_force(texts, good)):
        assert got[i].n_tokens == n
        assert abs(got[i].score - score) < 1e-9, texts[i]


def test_target_like_texts_score_lower(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad noise there ") * 5) for i in range(40)] + [(None, "good words"), (3, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id long")
    rows = cross_entropy_difference(docs, ids).collect()
    assert len(rows) == 42
    assert max(r.score for r in rows if r.doc_id and r.doc_id % 2 and r.n_tokens > 1) < min(r.score for r in rows if r.doc_id is not None and r.doc_id % 2 == 0)


def test_every_good_label_is_target(spark, tmp_path):
    n = 24_000
    spark.range(n).selectExpr("id as doc_id", "concat('w', id % 50, ' x', id % 7) as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id as doc_id", "int(id % 8 <> 0) as quality", "if(id % 40 = 1, 1, if(id % 3 = 0, null, 0)) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    good = [i % 8 != 0 and i % 40 != 1 for i in range(n)]
    assert sum(good) > 20_000
    want = brute_force([f"w{i % 50} x{i % 7}" for i in range(n)], good)
    got = {r.doc_id: r.score for r in op1_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == n
    assert all(abs(got[i] - score) < 1e-9 for i, (_, score) in enumerate(want))


def test_packed_tokens():
    r = np.random.default_rng(1)
    key, row, good = np.sort(r.integers(0, 1 << 36, 1001)), r.integers(0, 1 << 20, 1001), r.random(1001) < 0.3
    assert all((a == b).all() for a, b in zip(lm_scoring.unpack(1001, lm_scoring.pack(key, row, good)), (key, row, good)))


def test_empty_table(spark):
    assert cross_entropy_difference(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).count() == 0
