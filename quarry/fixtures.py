"""A file catalogue mapped from the test tables, and the same mapping as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.catalog import build_catalog

ROOT = "/data"
NOW = 1706616000  # 2024-01-30 12:00:00 UTC

SOURCES = """
select 1000000000 + o_orderkey fid,
       concat('orders/', lower(replace(o_orderpriority,' ','_')), '/', lower(o_orderstatus), '/order_', cast(o_orderkey as string),
              case o_orderkey % 8 when 0 then '.json' when 1 then '.md' when 2 then '.rs' when 3 then '.py'
                   when 4 then '.log' when 5 then '.bin' when 6 then '.PDF' else '' end) rel,
       cast(floor(o_totalprice) as bigint) size, <EPOCH:o_orderdate> mtime from orders
union all
select 2000000000 + event_id, concat('logs/', event_type, '/user_', cast(user_id as string), '/evt_', cast(event_id as string), '.log'),
       cast(floor(value * 1024) as bigint), <EPOCH:ts> from events
union all
select 3000000000 + doc_id, concat('docs/', source, '/', lang, '/doc_', cast(doc_id as string), case when doc_id % 2 = 0 then '.md' else '.txt' end),
       n_chars, 0 from documents
union all
select 4000000000 + p_partkey, concat('node_modules/', lower(p_type), '/', lower(replace(p_brand,'#','_')), '/',
              case when p_size % 10 = 0 then '.' else '' end, replace(p_name,' ','_'), '.', cast(p_partkey as string), '.toml'),
       cast(p_size as bigint) * 1024, 0 from part
union all
select 5000000000 + page_id, concat('web/', regexp_replace(regexp_replace(regexp_replace(url,'[?#].*$',''),'^https?://',''),'/+$','')),
       cast(length(html) as bigint), 0 from pages
union all
select 6000000000 + s_suppkey, concat(
         case s_suppkey % 7 when 0 then repeat('d/', cast(s_suppkey % 20 as int)) when 1 then '.cache/pip/http/' when 2 then '.config/app/data/'
           when 3 then 'objects/0123456789abcdef0123/' when 4 then 'home/6186feed-abb5-4bb6-b116-f0178b81fa0f/' when 5 then 'src/build/' else 'var/logs/debug/' end,
         'sup_', cast(s_suppkey as string), case s_suppkey % 5 when 0 then '.o' when 1 then '.docx' when 2 then '.log' when 3 then '.yaml' else '.py' end),
       s_suppkey * 512, 1706616000 - s_suppkey * 7200 from supplier
"""

TABLES = ("orders", "events", "documents", "part", "pages", "supplier")


def source_sql(engine: str) -> str:
    epoch = "unix_seconds(cast({} as timestamp))" if engine == "spark" else "cast(floor(epoch({})) as bigint)"
    sql = SOURCES
    for c in ("o_orderdate", "ts"):
        sql = sql.replace(f"<EPOCH:{c}>", epoch.format(c))
    return sql


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of a test folder; ctime is some days before mtime where a table has a time."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"quarry_{t}")
    sql = source_sql("spark")
    for t in TABLES:
        sql = sql.replace(f"from {t}\n", f"from quarry_{t}\n")
    records = spark.sql(sql).select("fid", F.concat(F.lit(ROOT + "/"), "rel").alias("abs_path"), "size", "mtime", F.expr("greatest(mtime - fid % 9 * 86400, 0)").alias("ctime"))
    return build_catalog(records, ROOT)
