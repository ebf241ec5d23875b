"""Parser, predicates, noise flags and search modes on handmade cases."""

import pytest

from quarry.functions.noise import noise_flags, path_depth
from quarry.operators.catalog import build_catalog
from quarry.operators.search import hits, run_query, search
from quarry.plans.ast import TRUE, Absolute, And, Macro, Not, Or, Predicate, Relative, Text
from quarry.plans.parser import parse
from quarry.plans.predicates import parse_relative, parse_size, resolve_time
from quarry.sources.fs import scan
from quarry.sources.history import History
from quarry.sources.store import check_catalog, open_catalog, write_catalog

NOW = 1706616000

QUERIES = {
    "": TRUE,
    "foo bar baz": And((Text("foo"), Text("bar"), Text("baz"))),
    "foo OR bar AND baz": Or((Text("foo"), And((Text("bar"), Text("baz"))))),
    "NOT NOT foo": Text("foo"),
    "not foo": Not(Text("foo")),
    "AND foo": And((TRUE, Text("foo"))),
    "foo OR": Or((Text("foo"), TRUE)),
    "a ) b": Text("a"),
    "a||b": Text("a||b"),
    "a || b": Or((Text("a"), Text("b"))),
    "12:30": And((Text("12"), Text(":"), Text("30"))),
    "xyz:foo": Text("xyz:foo"),
    "ext:.RS": Predicate("ext", "=", "rs"),
    "ext:>rs": Predicate("ext", "=", ">"),
    "size:>10MB": Predicate("size", ">", 10485760),
    "size:>10Mb": Predicate("size", ">", 1310720),
    "size:1.5MB": Text("size:1.5MB"),
    'size:"!=10"': Predicate("size", "!=", 10),
    "size:!=10": And((Text("size:!"), Text("="), Text("10"))),
    "modified:7d": Predicate("modified", ">=", Relative(7, "d")),
    "modified:-7d": Predicate("modified", ">=", Relative(-7, "d")),
    "modified:<7d": Predicate("modified", "<", Relative(7, "d")),
    "modified:today": Predicate("modified", ">=", Macro("today")),
    "modified:>today": Text("modified:> today"),
    'modified:"today"': Text("modified:today"),
    "modified:3m": Text("modified:3m"),
    "created:2024-01-01": Predicate("created", ">=", Absolute(1704067200)),
    "Cargo*.toml": Text("Cargo*.toml", glob=True),
    '"a b': Text("a b", phrase=True),
}


@pytest.mark.parametrize("query", QUERIES)
def test_parse(query):
    assert parse(query) == QUERIES[query]


def test_values():
    assert [parse_size(s) for s in ("1", "1k", "1KiB", "1b", "2T", "8Kb", "8kb", "", "k", "-1", "1x", "99999999999999999999")] == [
        1, 1024, 1024, 1, 2 * 1024**4, 1024, 8192, None, None, None, None, None,
    ]
    assert parse_size("18446744073709551615T") == 2**64 - 1
    assert parse_relative("2é") is None and parse_relative("d") is None and parse_relative("--2d") == Relative(2, "d")
    want = {"today": 1706572800, "yesterday": 1706486400, "this_week": 1706486400, "last_week": 1705881600, "this_month": 1704067200, "last_month": 1701388800}
    assert {m: resolve_time(Macro(m), NOW) for m in want} == want


PATHS = {
    "/home/u/proj/src/main.rs": (0, 5), "/home/u/proj/target/debug/app": (66, 6), "/home/u/proj/node_modules/x/index.js": (2, 6),
    "/home/u/.bashrc": (0, 3), "/home/u/.mozilla/firefox/prof/prefs.js": (32, 6), "/home/u/.config/app.toml": (0, 4),
    "/home/u/.cache/pip/http/a": (36, 6), "/usr/share/doc/README.md": (1, 4), "/usrlocal/x.txt": (0, 2), "/var/log/syslog": (65, 3),
    "/home/u/build": (2, 3), "/home/u/Build/x.o": (0, 4), "/home/u/c7653396db1f627dc568685e0043c4f8": (8, 3),
    "/home/u/6186feed-abb5-4bb6-b116-f0178b81fa0f/f.txt": (8, 4), "/home/u/0123456789abcdef0zzz": (0, 3), "/home/u/0123456789abcdef0ffz": (8, 3),
    "/home/u/abcdefabcdefabcdef.bin": (0, 3), "/a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p.txt": (16, 16), "/home/u/a.": (0, 3),
    "/home/u/noext": (0, 3), "/home/u/Café/École.PDF": (0, 4),
}


def test_noise_flags(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = {r.p: (r.f, r.d) for r in df.select("p", noise_flags(df.p).alias("f"), path_depth(df.p).alias("d")).collect()}
    assert got == PATHS


def files(spark, paths, root="/data"):
    return build_catalog(spark.createDataFrame([(i, p, 1, 0) for i, p in enumerate(paths)], "fid long, abs_path string, size long, mtime long"), root)


def found(df):
    return sorted(r.fid for r in df.collect())


def test_scope_depends_on_candidates_in_faithful_mode(spark):
    few = files(spark, [f"/data/zeta/f{i}.txt" for i in range(2000)])
    many = files(spark, [f"/data/zeta/f{i}.txt" for i in range(100)] + [f"/data/o/g{i}.txt" for i in range(1901)])
    assert found(hits(few, "zeta", NOW, "faithful")) == []
    assert len(found(hits(many, "zeta", NOW, "faithful"))) == 100
    assert len(found(hits(few, "zeta", NOW))) == 2000


def test_hidden_files_are_found_by_scans_only(spark):
    df = files(spark, ["/data/.env_prod.toml", "/data/env_prod.toml"])
    assert found(hits(df, "ext:toml", NOW)) == found(hits(df, "pr", NOW)) == [0, 1]
    assert found(hits(df, "prod", NOW)) == [1]


def test_two_passes_can_lose_a_name_match(spark):
    df = files(spark, ["/data/target/needle"] + [f"/data/needle_{i}.md" for i in range(1200)])
    assert 0 not in found(search(df, "needle", 20, NOW))
    assert search(df, "needle", 20, NOW, exact_rank=True).count() == 20
    result = run_query(df, "needle", 5, NOW)
    assert (len(result.rows), result.total) == (5, 1201)


def test_walk_store_history(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    for name, body in (("a.txt", "x"), ("sub/b.tar.GZ", "xyz"), (".hidden", ""), ("sub/_c", "")):
        (root / name).write_text(body)
    rows = {r.abs_path[len(str(root)) + 1 :]: r for r in scan(spark, str(root)).collect()}
    assert set(rows) == {"a.txt", "sub", "sub/b.tar.GZ", ".hidden", "sub/_c"}
    assert rows["sub"].is_dir and rows["sub"].size == 0 and rows[".hidden"].is_hidden
    assert (rows["a.txt"].ext, rows["sub/b.tar.GZ"].ext, rows[".hidden"].ext, rows["sub/b.tar.GZ"].size) == ("txt", "gz", None, 3)
    path = f"file://{tmp_path}/catalog"
    assert check_catalog(spark, path) == "missing"
    write_catalog(files(spark, ["/data/x/a.rs", "/data/b.md"]), path, "/data", now=5)
    assert check_catalog(spark, path, "/data") == "ok" and check_catalog(spark, path, "/etc") == "root-mismatch"
    tables = open_catalog(spark, path)
    assert tables["files"].count() == 2 and [r.rel_path for r in tables["dirs"].collect()] == ["x"]
    write_catalog(files(spark, ["/data/c.rs"]), path, "/data", now=6)
    assert open_catalog(spark, path)["files"].count() == 1
    (root / "build").mkdir()
    (root / "build" / "x").write_text("")
    walked = {r.name for r in scan(spark, str(root), defaults="true").collect()}
    assert "build" in walked and "x" not in walked and "b.tar.GZ" in walked
    h = History(str(tmp_path / "h.ndjson"))
    h.append("one", 1, 2)
    with open(h.path, "a") as f:
        f.write("not json\n")
    h.append("two", 3, 4)
    assert [r.raw_query for r in h.recent(spark, 5).collect()] == ["two", "one"] and h.count(spark) == 2
    h.clear()
    assert h.count(spark) == 0
