"""Each stage of the pipeline on a small table, and the whole of it with every edge case."""

import hashlib
import random

import pytest

import corpus_pipeline
from quarry.llm import order_minhash, sentencepiece_fst, suffix_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(r.randint(60, 120))]
        if i % 10 == 0:
            words[20:20] = passage
        if i % 7 == 3:
            words = [x + "%%%" for x in words]
        rows.append((i, " ".join(words), "en", r.choice(["web", "book", None]), 0, i, "s"))
    rows += [(200 + i, rows[i][1] + " more", "en", "web", 0, i, "near") for i in range(0, 40, 2)]
    rows += [rows[5], (300, None, None, None, None, None, None), (301, "", "en", "web", 0, 1, "s"), (None, rows[9][1], "en", "web", 0, 1, "s"), (1, "another text " * 20, "en", "web", 0, 1, "s")]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score int, spans string")
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 7 != 3), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(row):
    return str(tuple(row))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept.append((docs.collect(), out.collect()))
        docs = spark.createDataFrame(kept[-1][1], docs.schema)
    # the classifier takes whole rows away, those marked bad first of all
    before, after = kept[0]
    assert set(map(key, after)) <= set(map(key, before))
    assert not any("%%%" in (r.text or "") for r in after) and sum("%%%" in (r.text or "") for r in before) > 10
    assert len(after) >= 0.95 * sum("%%%" not in (r.text or "") for r in before)
    # one row of each class stays: no two rows left are similar, and each row that went is similar to one left
    import numpy as np

    before, after = kept[1]
    code: dict[str, int] = {}
    seq = lambda t: np.array([code.setdefault(w, len(code)) for w in (t or "").split()], np.uint32)
    left = [seq(r.text) for r in after]
    same = lambda a, b: len(a) == len(b) == 0 or order_minhash.similar(a, b, 0.8)
    assert not any(same(a, b) for i, a in enumerate(left) for b in left[:i])
    assert all(any(same(seq(r.text), b) for b in left) for r in before) and set(map(key, after)) <= set(map(key, before))
    # later copies of passages of 51 words go: what is left is what brute force over word codes leaves
    before, after = kept[2]
    before = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    coded = [b"".join(hashlib.sha256(w.encode()).digest()[:8] for w in (r.text or "").split()) for r in before]
    want = [round(len(t) / 8) for t, _ in suffix_dedup.brute_force(coded, 51 * 8, "first")]
    got = {r.doc_id: len((r.text or "").split()) for r in after}
    assert {r.doc_id: n for r, n in zip(before, want) if n or not (r.text or "").split()} == got
    # the mix emits rows of its input only
    before, after = kept[3]
    assert set(map(key, after)) <= set(map(key, before)) and len(after) > 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "ids", "n_tokens"]
    rows = out.collect()
    assert len(rows) > 50 and all(len(r.ids or []) == r.n_tokens for r in rows)
    decoded = sentencepiece_fst.decode(out, columns=["doc_id"]).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    whole = sum(r.text == texts[r.doc_id] for r in decoded if r.doc_id in texts)
    assert whole > 0.5 * len(rows)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
