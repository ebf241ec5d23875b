import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.order_minhash import COVERED, K, SIMILARITY, SKETCHES, _bucket_rows, _deal_rows, _text_rows, banded_distance, classes, common_words, keep_one


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 30))
def test_banded_distance(a, b, most):
    want = plain_distance(a, b)
    assert banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(want, most + 1)


@pytest.mark.parametrize("columns", [2, 2048])
@pytest.mark.parametrize("dense", [1, 3, 100])
def test_common_words(dense, columns, monkeypatch):
    monkeypatch.setattr("quarry.llm.order_minhash.COLUMNS", columns)
    r = np.random.default_rng(dense)
    texts = [r.integers(0, r.integers(2, 60), r.integers(0, 40)).astype(np.uint32) for _ in range(30)]
    got = common_words(texts, dense)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if i < j:
                assert got[i, j] == sum(min((a == w).sum(), (b == w).sum()) for w in np.unique(a))


def edited(r, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], [f"e{r.random()}"], [f"e{r.random()}"]])
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts, group = [], []
    for g in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(30, 300))]
        if g % 2:
            base[5:5] = passage
        for c in range(r.choice([1, 1, 2, 5, 60])):
            texts.append(" ".join(edited(r, base, 0.06 * (c > 0) * r.random())))
            group.append(g)
    return texts, group


def test_against_brute_force(spark, corpus):
    texts, _ = corpus
    words = [t.split() for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    code = {w: i for i, w in enumerate({w for ws in words for w in ws})}
    seq = [np.array([code[w] for w in ws], np.uint32) for ws in words]
    for i in range(len(texts)):
        for j in range(i):
            most = int((1 - 0.8) * max(len(seq[i]), len(seq[j])) + 1e-9)
            if root(i) != root(j) and abs(len(seq[i]) - len(seq[j])) <= most and banded_distance(seq[i], seq[j], most) <= most:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, label int").repartition(5)
    got = {r.doc_id: r.class_id for r in classes(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert {r.doc_id for r in keep_one(docs).collect()} == set(got.values())


def test_pairs_far_apart_in_a_bucket(spark):
    """Texts that share a long passage and nothing else, and near copies among them whose only
    common keys are those of the passage."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(110)]
    fresh = lambda m: [f"t{r.random()}" for _ in range(m)]
    texts, group = [], []
    for g in range(120):
        tail = fresh(40)
        texts.append(passage + tail)
        group.append(g)
        if g % 12 == 0:  # 24 edits in 150 words: no five of the tail in a row are left
            texts.append(passage + [w if i % 5 in (0, 2) else f"t{r.random()}" for i, w in enumerate(tail)])
            group.append(g)
    order = r.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, " ".join(texts[k])) for i, k in enumerate(order)], "doc_id long, text string").repartition(5)
    first = {}
    for i, k in enumerate(order):
        first.setdefault(group[k], i)
    got = {r.doc_id: r.class_id for r in classes(docs).collect()}
    assert got == {i: first[group[k]] for i, k in enumerate(order)}


def test_large_group_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.order_minhash.CELL", 16)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [edited(r, base, 0.2 * r.random()) for _ in range(80)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert {r.class_size for r in classes(docs).collect()} == {len(texts)}


@pytest.mark.parametrize("edits", ["random", "one in five"])
@pytest.mark.parametrize("n", [20, 40, 100, 200, 240, 250, 251, 400])
@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_recall_near_the_limit(n, similarity, edits):
    """At least 0.95 of pairs at the limit have an equal key at places that allow a link."""
    r = random.Random(n)
    most = int((1 - similarity) * n + 1e-9)
    texts = []
    for t in range(100):
        base = [f"w{t}-{i}" for i in range(n)]
        at = r.sample(range(n), most) if edits == "random" else range(2, n, 5)[:most]
        copy = list(base)
        for i in at:
            copy[i] = f"e{t}-{i}"
        texts += [base, copy]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.binary()), pa.array([" ".join(t) for t in texts])], ["row", "doc_id", "digest", "text"])
    keys = []
    for out in _text_rows(K, SKETCHES, SIMILARITY)([batch]):
        for key, place in zip(out.column("keys").to_pylist(), out.column("places").to_pylist()):
            keys.append(dict(zip(np.frombuffer(key, np.uint64).tolist(), np.frombuffer(place, np.int32).tolist())))
    found = sum(any(abs(p - b[key]) <= most for key, p in a.items() if key in b) for a, b in zip(keys[::2], keys[1::2]))
    assert found >= 95


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(20000))
    rows = [(1, ""), (2, None), (3, "  "), (4, "a b"), (5, "a b"), (6, "a c"), (7, long), (8, long + " y"), (None, "a b"), (None, None), (7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.class_id, r.class_size) for r in classes(docs).collect()))
    assert got == [(0, 1, 3), (0, 4, 3), (1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 6, 1), (7, 7, 3), (7, 7, 3), (8, 7, 3)]
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 3, 4, 6, 7]
    lost = spark.createDataFrame([(None, "a"), (None, "b"), (None, "a")], "doc_id long, text string")
    assert sorted(r.text for r in keep_one(lost).collect()) == ["a", "b"]


def test_empty_table(spark):
    assert keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_buckets_against_brute_force(seed):
    """Every text of a bucket meets its first one, or one that a task chose beside it; small
    buckets have all pairs, large ones all texts as members; copies of a text are one."""
    r = random.Random(seed)
    texts = [(r.randrange(60), [r.choice([1, 2, 3, r.randrange(40)]) for _ in range(4)]) for _ in range(40)]
    chosen = [r.randrange(40) for _ in range(150)]  # copies have equal keys
    rows, batches = [], []
    for c in range(0, 150, 30):
        part = chosen[c : c + 30]
        keys = [sorted(set(texts[t][1])) for t in part]
        batch = pa.record_batch(
            [pa.array(part, pa.int64()), pa.array(range(c, c + 30), pa.int64()), pa.array([10] * 30, pa.int32()),
             pa.array([np.array(k, np.int64).tobytes() for k in keys], pa.binary()), pa.array([np.zeros(len(k), np.int32).tobytes() for k in keys], pa.binary())],
            ["d", "nid", "n", "keys", "places"],
        )
        rows += [x for out in _deal_rows(0.8, hold=25, local=4)([batch]) for x in out.to_pylist()]
    rows.sort(key=lambda x: (x["key"], x["d"], x["nid"]))
    size = r.choice([1, 3, 7, 1000])
    kinds = [("key", pa.int64()), ("d", pa.int64()), ("nid", pa.int64()), ("n", pa.int32()), ("p", pa.int32()), ("lead", pa.int64())]
    batches = [pa.RecordBatch.from_pylist([{k: x[k] for k, _ in kinds} for x in rows[i : i + size]], pa.schema(kinds)) for i in range(0, len(rows), size)]
    out = [x for b in _bucket_rows(0.8)(batches) for x in b.to_pylist()]
    pairs = {(chosen[x["a"]], chosen[x["b"]]) for x in out if x["b"] is not None}
    pairs |= {(b, a) for a, b in pairs}
    members = {}
    for x in out:
        if x["b"] is None:
            members.setdefault(x["key"], set()).add(chosen[x["a"]])
    for key in {k for _, keys in texts for k in keys}:
        bucket = sorted({t for t in chosen if key in texts[t][1]})
        if len(bucket) > COVERED:
            assert members[key] == set(bucket)
            assert all(any((t, o) in pairs for o in bucket) for t in bucket)
        else:
            assert key not in members or members[key] <= set(bucket)
            linked = {(a, b) for a in bucket for b in bucket if a < b}
            assert linked <= pairs or members.get(key) == set(bucket)
