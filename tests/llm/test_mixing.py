import random

from oracle import compare, connect

from quarry.llm.mixing import SQL, digest, emit, mix
from quarry.llm.queries import queries


def water(sizes, weights, most=3):
    """The contract's loop: share the excess again until no source is above its cap."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        for s in free:
            target[s] = rest * w[s] / sum(w[x] for x in free)
        new = {s for s in free if target[s] > most * sizes[s]}
        if not new:
            return target | {s: most * sizes[s] for s in capped}
        capped |= new


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    assert compare(spark, connect(d), queries()["op9_mixing"], SQL, d) == 1000


def test_targets_copies_and_reruns(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(0, 40)), r.choice(["a", "b", "b", "b", "c", "d", None, "é"]), i) for i in range(3000)]
    rows += [(9001, "x y", "tiny", 0), (9002, None, "none", 0), (9003, "", None, 0), (None, "q q q", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(7)
    got = digest(mix(docs)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for g in got:
        sizes[g.source] = sizes.get(g.source, 0) + g.size
        assert g.taken <= 3 * g.size and 0 <= g.copies <= 3
    want = water(sizes, (5, 2, 1))
    for s, t in want.items():
        mine = [g for g in got if g.source == s]
        assert all(abs(g.target - t) < 1e-6 for g in mine)
        assert abs(sum(g.taken for g in mine) - t) <= 3 * max(g.size for g in mine)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, digest(mix(docs.repartition(3))).collect()))
    assert emit(docs).count() == sum(g.copies for g in got)


def test_emit_by_row(spark):
    """Repeated ids and rows, null ids and clashing columns: each row has its own copies."""
    rows = [(1, "w " * 30, "big", 5, "a"), (1, "v " * 4, "big", 6, "b"), (None, "u " * 9, "big", 7, "c"), (2, "x", "small", 8, "d"), (2, "x", "small", 8, "d"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, row string")
    want = {}
    for g in mix(docs).collect():
        want[g.doc_id, g.source, g.size] = want.get((g.doc_id, g.source, g.size), 0) + g.copies
    got = {}
    for r in emit(docs).collect():
        assert tuple(r) in rows
        at = (r.doc_id, r.source, len((r.text or "").split()))
        got[at] = got.get(at, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert emit(docs.limit(0)).columns == docs.columns and emit(docs.limit(0)).count() == 0


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
