import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm.suffix_dedup import brute_force, digest, longest_previous, suffix_dedup, without_repeats


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    prose = lambda m: " ".join(word() for _ in range(m))
    passage, other = prose(20), prose(11)
    texts = []
    for i in range(n):
        t = prose(r.randint(0, 60))
        if i % 3 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 5 == 0:
            t += other + other
        if i % 7 == 0:
            t += "ab " * r.randint(5, 80)
        if i % 11 == 0:
            t += (prose(4) + "\n") * r.randint(2, 9)
        texts.append(t)
    texts += [texts[0], texts[9], "", None, "xyz" * 100, "xyz" * 40, prose(3000) + passage]
    return texts


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("length,k,group_rows", [(60, 16, 4096), (60, 16, 3), (40, 30, 4096), (33, 1, 5), (20, 19, 7)])
def test_against_brute_force(spark, keep, length, k, group_rows):
    texts = corpus(length)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, rid int").repartition(5)
    got = {r.doc_id: r for r in digest(suffix_dedup(docs, length, keep, k, group_rows)).collect()}
    raw = [(t or "").encode() for t in texts]
    want = brute_force(raw, length, keep)
    assert len(got) == len(texts)
    assert any(got[i].n_removed for i in got)
    for i, (kept, spans) in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw[i]), len(raw[i]) - len(kept), spans), (i, texts[i])
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_passages_in_words(spark):
    """Passages of 51 words go, of 50 stay, whatever their length in bytes and their white space."""
    r = random.Random(2)
    fresh = lambda m: [f"é{r.randrange(10**9)}" for _ in range(m)]
    short = [r.choice("abcdefgh") for _ in range(51)]
    long = [w * 9 for w in fresh(60)]
    fifty = [w * 9 for w in fresh(50)]
    texts, want = [], []
    for passage, gone in ((short, True), (long, True), (fifty, False)):
        for copy in range(3):
            a, b = fresh(9), fresh(7)
            texts.append(" ".join(a) + "\n" + ("  " if copy == 2 else " ").join(passage) + " " + " ".join(b))
            want.append(" ".join(a) + "\n" + " ".join(b) if gone and copy else texts[-1])
    texts += [" ".join(short), "", None, " \n"]
    want += [None, "", None, " \n"]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: r for r in without_repeats(docs, corpus_pipeline.PASSAGE_WORDS).collect()}
    assert set(got) == set(range(len(texts))) - {9}
    for i, row in got.items():
        assert row.text == want[i], i
        assert row.n_chars == len(want[i] or "")


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id bigint, text string")
    first = {(r.doc_id, r.n_removed) for r in digest(suffix_dedup(docs, 50, "first", 10)).collect()}
    assert first == {(1, 0), (1, len(t)), (None, len(t)), (2, 0)}
    none = sorted((r.n_removed for r in digest(suffix_dedup(docs, 50, "none", 10)).collect()))
    assert none == [0, len(t), len(t), len(t)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert digest(suffix_dedup(docs)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_longest_previous_factors(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab" if seed % 2 else "abcd") for _ in range(r.randint(1, 80)))
    agree = lambda i, j: next((m for m in range(len(text)) if max(i, j) + m == len(text) or text[i + m] != text[j + m]), 0)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = np.array([0] + [agree(i, j) for i, j in zip(order, order[1:])])
    got = longest_previous(np.array(order), lcp)
    assert got.tolist() == [max((agree(i, j) for j in range(i)), default=0) for i in order]


def test_clashing_columns(spark):
    t = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, t, "a", 5, 1.5, "x"), (2, "x " + t, "b", 6, 2.5, "y")], "doc_id long, text string, spans string, rid int, cut double, kept string")
    assert [(r.doc_id, r.text, r.spans, r.rid, r.cut) for r in without_repeats(docs).orderBy("doc_id").collect()] == [(1, t, "a", 5, 1.5), (2, "x ", "b", 6, 2.5)]
    got = suffix_dedup(docs, 50, k=16, columns=["kept", "rid"]).orderBy("doc_id").collect()
    assert [(r.kept_, r.rid, bytes(r.kept)) for r in got] == [("x", 5, t.encode()), ("y", 6, b"x ")]


def test_long_text_with_many_spans(spark):
    """Thousands of runs in one text, and a cut between the bytes of one character."""
    r = random.Random(4)
    lines = ["é".join(str(r.randrange(10**9)) for _ in range(6)) for _ in range(4000)]
    texts = ["".join(lines), "".join(x + str(i) for i, x in enumerate(lines)), "é" * 40 + "ê", "x" + "é" * 40 + "è"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in digest(suffix_dedup(docs, 50, "first", 16)).collect()}
    raw = [t.encode() for t in texts]
    for i, (kept, spans) in enumerate(brute_force(raw, 50, "first")):
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw[i]) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    assert got[1].n_spans > 3000
