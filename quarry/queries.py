"""The queries of the driver contract and, for each, the same result as DuckDB SQL.

The SQL is written from the rules of the query language by hand, not generated from the
compiler, so that the two can disagree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import NOW, catalog, source_sql
from .functions import score
from .functions.text import sparse_trigrams
from .operators import catalog as cat
from .operators import setops, trigram_index
from .operators.filters import IgnorePatterns, under_any
from .operators.printers import as_json_rows
from .operators.search import hits, matches, search
from .plans.parser import parse

Query = Callable[[SparkSession, str], DataFrame]

FILES_CTE = f"""
with src as ({source_sql("duckdb")}),
named as (select fid, rel rel_path, concat('/data/', rel) abs_path, split_part(rel,'/',-1) "name", size, mtime, greatest(mtime - fid % 9 * 86400, 0) ctime from src),
files as (select *,
  case when instr(substr(name,2),'.')=0 then '' else lower(split_part(name,'.',-1)) end ext,
  not starts_with(name,'.') visible,
  list_filter(string_split(abs_path,'/'), lambda x: x <> '') parts,
  lower(name) name_lc, lower(rel_path) rel_lc, lower(abs_path) abs_lc from named)
"""

NOISE_SQL = """(
  case when starts_with(abs_path,'/usr/') or starts_with(abs_path,'/lib/') or starts_with(abs_path,'/lib64/') or starts_with(abs_path,'/opt/')
    or starts_with(abs_path,'/snap/') or starts_with(abs_path,'/flatpak/') or starts_with(abs_path,'/var/') or starts_with(abs_path,'/etc/')
    or starts_with(abs_path,'/sys/') or starts_with(abs_path,'/proc/') then 1 else 0 end
  + case when list_has_any(parts, ['node_modules','target','build','dist','out','.next','.git','.hg','.svn','.venv','venv','site-packages','.tox','vendor','.cargo']) then 2 else 0 end
  + case when list_has_any(parts, ['.cache','cache','.gradle','.m2','.npm','.pip','caches','__pycache__']) then 4 else 0 end
  + case when len(list_filter(parts, lambda x: regexp_matches(x, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
      or (strlen(x) between 16 and 64 and not regexp_matches(x, '[-_.]') and 100 * length(regexp_replace(x, '[^0-9a-fA-F]', '', 'g')) > 85 * strlen(x)))) > 0 then 8 else 0 end
  + case when len(parts) > 15 then 16 else 0 end
  + case when coalesce(list_position(list_transform(parts, lambda x: starts_with(x,'.') and x not in ('.','..')), true), 0) between 1 and len(parts) - 2 then 32 else 0 end
  + case when list_has_any(parts, ['logs','log','debug','sessionstore-logs','crash-reports','crashreporter','telemetry','diagnostics']) then 64 else 0 end)"""

FILES_FULL = FILES_CTE + f", full_files as (select *, {NOISE_SQL} noise_flags, least(len(parts),255) path_depth from files)\n"

_STALE = "(noise_flags & 102) <> 0"
_RECENCY = f"case when {_STALE} then 0 when {NOW} - mtime < 86400 then 40 when {NOW} - mtime < 604800 then 25 when {NOW} - mtime < 2592000 then 10 else 0 end"
_BASE = """case when ext in ('pdf','doc','docx','txt','md','rst','rtf','odt') then 20
  when ext in ('rs','py','js','ts','jsx','tsx','go','java','c','cpp','h','hpp','rb','php','swift','kt','scala','hs','ml','ex','exs','clj','cs','fs','lua','sh','bash','zsh','fish','pl','r','sql','zig','nim','v','d','cr') then 15
  when ext in ('json','yaml','yml','toml','ini','cfg','conf','xml','env') then 5
  when ext in ('exe','dll','so','dylib','o','a','lib','bin','class','pyc','pyo','wasm') then -20 else 0 end"""
_TYPE = f"(case when (noise_flags & 103) <> 0 then ({_BASE}) // 3 else ({_BASE}) end)"
_DEPTH = "(-least(greatest(path_depth - 8, 0) * 2, 30))"
_NOISE = """(case when noise_flags & 1 <> 0 then 60 else 0 end + case when noise_flags & 2 <> 0 then 90 else 0 end + case when noise_flags & 4 <> 0 then 70 else 0 end
  + case when noise_flags & 8 <> 0 then 40 else 0 end + case when noise_flags & 16 <> 0 then 10 else 0 end + case when noise_flags & 32 <> 0 then 50 else 0 end
  + case when noise_flags & 64 <> 0 then 40 else 0 end)"""
_QUICK = f"({_RECENCY} + {_TYPE} + {_DEPTH} - {_NOISE})"


def _name_sql(t: str) -> str:
    return f"(case when name_lc = '{t}' then 120 when starts_with(name_lc,'{t}') then 80 when contains(name_lc,'{t}') then greatest(40 - strlen(substr(name_lc,1,instr(name_lc,'{t}')-1)), 10) else 0 end)"


def _path_sql(t: str) -> str:
    return f"(case when list_contains(string_split(abs_lc,'/'),'{t}') then 30 when contains(abs_lc,'{t}') then 15 else 0 end)"


def _total_sql(terms: list[str]) -> str:
    return " + ".join([_QUICK, *(_name_sql(t) for t in terms), *(_path_sql(t) for t in terms)])


def _fids(where: str) -> str:
    return FILES_CTE + f"select fid from files where {where}"


#: name -> (query text, the same condition as SQL over the files CTE)
FILTERS: dict[str, tuple[str, str]] = {
    "pred_ext_eq": ("ext:.RS", "ext = 'rs'"),
    "pred_ext_operator": ("ext:>rs", "ext = '>'"),
    "pred_size_gt": ("size:>150000", "size > 150000"),
    "pred_size_ge": ("size:>=51200", "size >= 51200"),
    "pred_size_lt": ("size:<2048", "size < 2048"),
    "pred_size_le": ("size:<=10240", "size <= 10240"),
    "pred_size_eq": ("size:10240", "size = 10240"),
    "pred_size_ne": ('size:"!=10240"', "size <> 10240"),
    "pred_size_units": ("size:>100KiB", "size > 102400"),
    "pred_size_bits": ("size:>1Mb", "size > 131072"),
    "pred_size_overflow": ("size:<99999999999T", "true"),
    "pred_size_bad": ("size:1.5MB", "visible and contains(rel_lc, 'size:1.5mb')"),
    "pred_modified_absolute": ("modified:>2024-01-10", "mtime > 1704844800"),
    "pred_modified_relative": ("modified:7d", f"mtime >= {NOW - 7 * 86400}"),
    "pred_modified_hours": ("modified:<36h", f"mtime < {NOW - 36 * 3600}"),
    "pred_modified_negative_relative": ("modified:-7d", f"mtime >= {NOW + 7 * 86400}"),
    "pred_modified_today": ("modified:today", "mtime >= 1706572800"),
    "pred_modified_yesterday": ("modified:yesterday", "mtime >= 1706486400"),
    "pred_modified_this_week": ("modified:this_week", "mtime >= 1706486400"),
    "pred_modified_last_week": ("modified:lastweek", "mtime >= 1705881600"),
    "pred_modified_this_month": ("modified:thismonth", "mtime >= 1704067200"),
    "pred_modified_last_month": ("modified:last_month", "mtime >= 1701388800"),
    "pred_created_absolute": ("created:2024-01-01", "ctime >= 1704067200"),
    "text_short_name_scan": ("er", "contains(name_lc, 'er')"),
    "text_indexed": ("Order", "visible and contains(rel_lc, 'order')"),
    "text_last_segment": ("commands/evt_12", "visible and contains(rel_lc, 'evt_12') and true"),
    "text_trailing_slash": ("docs/", "true"),
    "text_glob_literal": ("order_*.rs", "visible and contains(rel_lc, 'order_*.rs')"),
    "text_phrase": ('"evt_77"', "visible and contains(rel_lc, 'evt_77')"),
    "bool_and": ("order ext:json", "visible and contains(rel_lc, 'order') and ext = 'json'"),
    "bool_or": ("ext:rs OR ext:py || ext:md", "ext in ('rs', 'py', 'md')"),
    "bool_not": ("ext:log NOT purchase", "ext = 'log' and not (visible and contains(rel_lc, 'purchase'))"),
    "bool_double_not": ("NOT NOT ext:toml", "ext = 'toml'"),
    "bool_nested": ("(ext:rs OR ext:log) AND NOT (size:<100KB OR modified:<2024-01-05)", "ext in ('rs', 'log') and not (size < 102400 or mtime < 1704412800)"),
    "query_empty_all": ("", "true"),
    "query_stray_paren": ("ext:md ) ext:rs", "ext = 'md'"),
    "query_trailing_or": ("ext:md OR", "true"),
    "query_leading_and": ("AND ext:md", "ext = 'md'"),
    "query_not_alone": ("NOT", "false"),
    "pure_text_and": ("docs en 1", "visible and contains(rel_lc,'docs') and contains(rel_lc,'en') and contains(rel_lc,'1') and regexp_matches(abs_lc, 'docs.*en.*1')"),
    "pure_text_and_short": ("er 9", "contains(name_lc,'er') and contains(abs_lc,'9') and regexp_matches(abs_lc, 'er.*9')"),
    "path_order": ("orders 17 ext:md", "visible and contains(rel_lc,'orders') and contains(name_lc,'17') and ext = 'md' and regexp_matches(abs_lc, 'orders.*17')"),
    "path_order_reversed": ("md docs ext:md", "contains(name_lc,'md') and visible and contains(rel_lc,'docs') and ext = 'md' and regexp_matches(abs_lc, 'md.*docs')"),
    "path_order_or_first_branch": (
        "(orders 11) or ext:toml",
        "((visible and contains(rel_lc,'orders') and contains(rel_lc,'11')) or ext = 'toml') and regexp_matches(abs_lc, 'orders.*11')",
    ),
}

_SETS = {"a": ("ext = 'log'", "ext = 'log'"), "b": ("size > 50000", "size > 50000")}


def _filter(text: str) -> Query:
    return lambda spark, d: hits(catalog(spark, d), text, NOW).select("fid")


def _on_files(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(catalog(spark, d))


def _two(op) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        files = catalog(spark, d)
        return op(files.filter(_SETS["a"][0]).select("fid"), files.filter(_SETS["b"][0]).select("fid"))

    return run


def _ranked(text: str, limit: int | None, **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search(catalog(spark, d), text, limit, NOW, **options)

    return run


def _hex(c: str):
    return F.lower(F.hex(c))


RANKED = {
    "rank_single_pass": ("ext:rs order", 20, ["order"], "visible and contains(rel_lc,'order') and ext = 'rs'"),
    "rank_two_pass": ("order", 20, ["order"], "visible and contains(rel_lc,'order')"),
    "rank_negated_term": ("ext:md NOT order_1", 15, ["order_1"], "ext = 'md' and not (visible and contains(rel_lc,'order_1'))"),
    "rank_no_term": ("ext:log modified:7d", 25, [], f"ext = 'log' and mtime >= {NOW - 7 * 86400}"),
}


def _ranked_sql(where: str, terms: list[str], limit: int) -> str:
    total = _total_sql(terms)
    return FILES_FULL + f""", found as (select *, {_QUICK} quick, count(*) over () n from full_files where {where}),
first_pass as (select *, row_number() over (order by quick desc, fid) r from found),
kept as (select * from first_pass where not (n > 1000 and n // {limit} > 10) or r <= {3 * limit}),
scored as (select fid, abs_path, {total} score from kept)
select row_number() over (order by score desc, fid) "rank", fid, abs_path "path", score from scored order by score desc, fid limit {limit}"""


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _filter(text) for name, (text, _) in FILTERS.items()}
    out |= {
        "scan_catalog": _on_files(lambda f: f.select("fid", "name", "rel_path", "abs_path", "ext", "size", "mtime", "visible")),
        "visible_files": _on_files(lambda f: f.filter("visible").select("fid")),
        "path_depth": _on_files(lambda f: f.select("fid", "path_depth")),
        "noise_flags": _on_files(lambda f: f.select("fid", "noise_flags")),
        "text_glob": _on_files(lambda f: hits(f, "order_1*7.md", NOW, glob=True).select("fid")),
        "pred_documented_sign": _on_files(lambda f: hits(f, "modified:-7d", NOW, documented_sign=True).select("fid")),
        "unranked": _on_files(lambda f: matches(f, parse("md docs ext:md"), NOW).select("fid")),
        "faithful_name_scope": _on_files(lambda f: hits(f, "ext:toml part", NOW, "faithful").select("fid")),
        "faithful_selective": _on_files(lambda f: hits(f, "urgent", NOW, "faithful").select("fid")),
        "faithful_broad": _on_files(lambda f: hits(f, "order", NOW, "faithful").select("fid")),
        "faithful_text_and": _on_files(lambda f: hits(f, "urgent 77", NOW, "faithful").select("fid")),
        "faithful_impossible": _on_files(lambda f: hits(f, "order zqx", NOW, "faithful").select("fid")),
        "set_intersect": _two(setops.intersect),
        "set_union": _two(setops.union),
        "set_difference": _two(setops.difference),
        "set_intersect_all": _two(setops.intersect_all),
        "set_except_all": _two(setops.except_all),
        "exclude_prefix": _on_files(lambda f: f.filter(~under_any(F.col("abs_path"), ["/data/logs", "/data/logs/click", "/data/doc"])).select("fid")),
        "ignore_patterns": _on_files(lambda f: f.filter(~IgnorePatterns(["node_modules/", "*.log", "!evt_1*.log"], "/data").column(F.col("abs_path"), F.lit(False))).select("fid")),
        "ext_postings": _on_files(lambda f: cat.extension_postings(f).select("ext", "n_files", F.array_join(F.transform("fids", lambda x: x.cast("string")), ",").alias("fids"))),
        "ext_counts": _on_files(lambda f: f.groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"))),
        "trigram_postings": _on_files(lambda f: trigram_index.posting_counts(trigram_index.file_trigrams(f)).select(_hex("tri").alias("tri"), "n")),
        "trigram_candidates": _on_files(lambda f: trigram_index.candidates(trigram_index.file_trigrams(f), "urgent")),
        "trigram_sparse": _on_files(lambda f: f.filter("ext = 'toml'").select("fid", F.explode(sparse_trigrams(F.col("name"))).alias("t")).select("fid", _hex("t").alias("tri"))),
        "dirs_tree": _on_files(cat.directories),
        "dir_trigrams": _on_files(lambda f: trigram_index.posting_counts(trigram_index.directory_trigrams(cat.directories(f))).select(_hex("tri").alias("tri"), "n")),
        "index_info": _on_files(cat.catalog_info),
        "score_name": _on_files(lambda f: f.select("fid", score.name_score(["order", "md"]).alias("score"))),
        "score_path": _on_files(lambda f: f.select("fid", score.path_score(["orders", "en"]).alias("score"))),
        "score_recency": _on_files(lambda f: f.select("fid", score.recency_score(NOW).alias("score"))),
        "score_depth": _on_files(lambda f: f.select("fid", score.depth_score().alias("score"))),
        "score_type": _on_files(lambda f: f.select("fid", score.type_score().alias("score"))),
        "score_noise": _on_files(lambda f: f.select("fid", score.noise_score().alias("score"))),
        "score_total": _on_files(lambda f: f.select("fid", score.total_score(["order"], NOW).alias("score"))),
        "rank_all": _ranked("ext:json", None),
        "rank_limit_zero": _ranked("order", 0),
        "rank_exact": _ranked("order", 20, exact_rank=True),
        "total_before_limit": _on_files(lambda f: hits(f, "orders 1", NOW).agg(F.count("*").alias("total"))),
        "json_rows": _on_files(lambda f: as_json_rows(search(f, "ext:rs order", 10, NOW), "ext:rs order")),
    }
    out |= {name: _ranked(text, limit) for name, (text, limit, _, _) in RANKED.items()}
    return out


_TRI = "list_distinct(list_transform(range(1, strlen({c}) - 1), lambda i: substr(lower({c}), i, 3)))"


def oracle_sql() -> dict[str, str]:
    a, b = _SETS["a"][1], _SETS["b"][1]
    dirs = FILES_CTE + """, d as (select distinct unnest(list_transform(range(1, len(string_split(rel_path,'/'))), lambda n: array_to_string(string_split(rel_path,'/')[1:n], '/'))) rel_path from files),
dirs as (select rel_path, split_part(rel_path,'/',-1) "name", case when contains(rel_path,'/') then regexp_replace(rel_path,'/[^/]*$','') end parent from d)
"""  # fmt: skip
    tri = lambda table, col, where: f", t as (select fid, unnest({_TRI.format(c=col)}) tri from {table} where strlen({col}) >= 3 and {where})\n"
    part = lambda x: f"select fid, {x} score from full_files"
    out = {name: _fids(where) for name, (_, where) in FILTERS.items()}
    out |= {
        "scan_catalog": FILES_CTE + "select fid, name, rel_path, abs_path, ext, size, mtime, visible from files",
        "visible_files": _fids("visible"),
        "path_depth": FILES_FULL + "select fid, path_depth from full_files",
        "noise_flags": FILES_FULL + "select fid, noise_flags from full_files",
        "text_glob": _fids("visible and regexp_matches(name_lc, '^order_1.*7\\.md$')"),
        "pred_documented_sign": _fids(f"mtime >= {NOW - 7 * 86400}"),
        "unranked": _fids("contains(name_lc,'md') and visible and contains(rel_lc,'docs') and ext = 'md'"),
        "faithful_name_scope": FILES_CTE + ", n as (select count(*) c from files where ext = 'toml') select fid from files, n where ext = 'toml' and case when c <= 2000 then contains(name_lc, 'part') else visible and contains(abs_lc, 'part') end",
        "faithful_selective": FILES_CTE + ", n as (select count(*) c from files) select fid from files, n where case when c <= 2000 then contains(name_lc, 'urgent') else visible and contains(abs_lc, 'urgent') end",
        "faithful_broad": FILES_CTE + ", n as (select count(*) c, count(*) filter (where visible and contains(rel_lc,'ord')) o, count(*) filter (where visible and contains(rel_lc,'rde')) r, count(*) filter (where visible and contains(rel_lc,'der')) d from files) select fid from files, n where case when c <= 2000 then contains(name_lc, 'order') when least(o, r, d) <= floor(0.3 * c) then visible and contains(abs_lc, 'order') else contains(abs_lc, 'order') end",
        "faithful_text_and": FILES_CTE + ", n as (select count(*) c from files) select fid from files, n where case when c <= 2000 then contains(name_lc, 'urgent') else visible and contains(abs_lc, 'urgent') end and contains(abs_lc, '77') and regexp_matches(abs_lc, 'urgent.*77')",
        "faithful_impossible": _fids("false"),
        "set_intersect": _fids(f"{a} and {b}"),
        "set_union": _fids(f"{a} or {b}"),
        "set_difference": _fids(f"{a} and not ({b})"),
        "set_intersect_all": FILES_CTE + f"select fid from files where {a} intersect all select fid from files where {b}",
        "set_except_all": FILES_CTE + f"select fid from files where {a} except all select fid from files where {b}",
        "exclude_prefix": _fids("not starts_with(abs_path, '/data/logs/') and not starts_with(abs_path, '/data/doc/')"),
        "ignore_patterns": _fids("not starts_with(rel_path, 'node_modules/') and not (name like '%.log' and not (name like 'evt\\_1%.log' escape '\\'))"),
        "ext_postings": FILES_CTE + "select ext, count(*) n_files, string_agg(cast(fid as varchar), ',' order by fid) fids from files where ext <> '' group by ext",
        "ext_counts": FILES_CTE + "select ext, count(*) n_files, cast(sum(size) as bigint) total_bytes from files group by ext",
        "trigram_postings": FILES_CTE + tri("files", "rel_path", "visible") + "select lower(hex(tri)) tri, count(*) n from t group by 1",
        "trigram_candidates": FILES_CTE + tri("files", "rel_path", "visible") + "select fid from t where tri in ('urg','rge','gen','ent') group by fid having count(distinct tri) = 4",
        "trigram_sparse": FILES_CTE + ", t as (select fid, unnest(list_distinct(list_transform(list_concat(range(1, strlen(name) - 1, 3), [strlen(name) - 2]), lambda i: substr(lower(name), i, 3)))) tri from files where ext = 'toml' and strlen(name) >= 3) select fid, lower(hex(tri)) tri from t",
        "dirs_tree": dirs + "select rel_path, name, parent from dirs",
        "dir_trigrams": dirs + f", t as (select unnest({_TRI.format(c='name')}) tri from dirs where strlen(name) >= 3) select lower(hex(tri)) tri, count(*) n from t group by 1",
        "index_info": dirs + "select (select count(*) from files) n_files, (select cast(sum(size) as bigint) from files) total_bytes, (select count(*) from files where visible) n_visible, (select count(*) from dirs) n_dirs",
        "score_name": FILES_FULL + part(f"{_name_sql('order')} + {_name_sql('md')}"),
        "score_path": FILES_FULL + part(f"{_path_sql('orders')} + {_path_sql('en')}"),
        "score_recency": FILES_FULL + part(_RECENCY),
        "score_depth": FILES_FULL + part(_DEPTH),
        "score_type": FILES_FULL + part(_TYPE),
        "score_noise": FILES_FULL + part(_NOISE),
        "score_total": FILES_FULL + part(_total_sql(["order"])),
        "rank_all": FILES_FULL + f"select fid, abs_path \"path\", {_QUICK} score from full_files where ext = 'json'",
        "rank_limit_zero": FILES_FULL + ", z as (select 1 r, fid, abs_path p, 0 s from full_files where false) select r \"rank\", fid, p \"path\", s score from z",
        "rank_exact": FILES_FULL + f", s as (select fid, abs_path, {_total_sql(['order'])} score from full_files where visible and contains(rel_lc,'order')) select row_number() over (order by score desc, fid) \"rank\", fid, abs_path \"path\", score from s order by score desc, fid limit 20",
        "total_before_limit": FILES_CTE + "select count(*) total from files where visible and contains(rel_lc,'orders') and contains(rel_lc,'1') and regexp_matches(abs_lc, 'orders.*1')",
        "json_rows": "select concat('{\"kind\":\"hit\",\"query\":\"ext:rs order\",\"rank\":', \"rank\", ',\"path\":\"', \"path\", '\"}') \"value\" from (" + _ranked_sql(RANKED["rank_single_pass"][3], ["order"], 10) + ")",
    }
    out |= {name: _ranked_sql(where, terms, limit) for name, (_, limit, terms, where) in RANKED.items()}
    return out
