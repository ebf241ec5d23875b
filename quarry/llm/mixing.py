"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source size times. With the documents of
a source in order of size, the prefix sums of that number, shifted by one random offset,
cross integers; a document is taken once per integer crossed. Neighbours in that order
are about equally long, so the words taken come near the target, and no document is
taken more often than its expectation rounded up.

A source is never numbered in one task: rows are range-partitioned by (source, size,
doc_id), counted per partition and source, and numbered from those counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def text_size(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target of each source (source, source_size): its share by weight of all words, at most
    `most` times its size, the excess going to the others by weight.

    With the sources in order of cap / weight, the first k are at their cap, where k is the
    smallest number for which the level of the rest lies below the next one's cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    df = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    }).withColumn("capped", F.col("cap") * F.col("left_w") < F.col("w") * F.col("left"))
    # capped holds for a prefix of the order; the first source without it has the level of all the rest
    df = df.withColumn("first", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("left"), F.col("left_w")))).over(everything))
    level = F.col("w") * F.col("first.left") / F.col("first.left_w")
    return df.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """One number from [0, 1) per source."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0"))).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _number(batches):
    """Running number of each row within its partition and source (rows are sorted)."""
    seen: dict[object, int] = {}
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(b.schema.get_field_index("source")).dictionary_encode()
        which = pc.fill_null(code.indices, -1).to_numpy()
        names = code.dictionary.to_pylist()
        number = np.zeros(len(which), np.int64)
        for k in np.unique(which):
            at = np.flatnonzero(which == k)
            name = None if k < 0 else names[k]
            number[at] = seen.get(name, 0) + np.arange(len(at))
            seen[name] = seen.get(name, 0) + len(at)
        from pyspark import TaskContext

        part = np.full(len(which), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(number)], [*b.schema.names, "part", "number"])


def _copies(slim: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """The rows of slim (doc_id, source, size and any more, in a written table) with source_size,
    target and copies."""
    order = [F.col("source").asc_nulls_last(), "size", "doc_id"]
    numbered = scratch.save(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema) + ", part int, number bigint"), "numbered")
    parts = numbered.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy("source").agg(F.sum("s").alias("source_size"))
    plan = targets(whole, weights, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("shift", offset_of(F.col("source"), seed))
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("source", "part", "base")
    base = base.alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source")).select("b.source", "part", "base", "source_size", "target", "rate", "shift")
    # a row per partition and source: bounded by the number of partitions, not by the data
    j = numbered.alias("n").join(base.alias("b"), F.expr("n.part = b.part and n.source <=> b.source"))
    i = F.col("base") + F.col("number")
    crossed = F.floor(F.col("shift") + (i + 1) * F.col("rate")) - F.floor(F.col("shift") + i * F.col("rate"))
    return j.select(*(f"n.{c}" for c in slim.columns), "source_size", "target", crossed.cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each row.

    A null text has size 0; a null source is a source of its own, after all others; rows
    alike in doc_id, source and size share out their copies in any order, which gives the
    same multiset of rows each time. Sources of size 0, and an empty table, get target 0.
    Other columns of docs take no part.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.save(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", text_size(F.col("text")).alias("size")), "sizes")
    return _copies(slim, scratch, weights, most, seed)


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """Rows of docs, each as often as the mix takes it: repeated rows and rows with one doc_id
    (or none) each by its own number of copies.

    Nulls and empty tables are as in mix(). All columns are passed on, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    base = scratch.save(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "base")
    where = {c.lower(): x for c, x in zip(docs.columns, inner)}
    slim = base.select(F.col(where["doc_id"]).cast("bigint").alias("doc_id"), F.col(where["source"]).alias("source"), text_size(F.col(where["text"])).alias("size"), "row")
    taken = _copies(scratch.save(slim, "sizes"), scratch, weights, most, seed).filter("copies > 0").select("row", "copies")
    taken = scratch.save(taken, "taken")
    scratch.drop("sizes")
    scratch.drop("numbered")
    return base.hint("merge").join(taken, "row").withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))"))).select(*inner).toDF(*docs.columns)


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


SQL = """
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)] w, 3 * source_size cap from s),
l as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over p, 0) as bigint) rest, cast(sum(w) over () - coalesce(sum(w) over p, 0) as bigint) rest_w from w
  window p as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
c as (select *, cap * rest_w < w * rest capped from l),
f as (select *, first_value(rest) over q rest1, first_value(rest_w) over q w1 from c window q as (order by capped, cap / w, source is null, source)),
t as (select source, source_size, case when capped then cast(cap as double) else cast(w * rest1 as double) / w1 end target,
  cast(('0x' || substr(md5('0:' || coalesce(source, chr(0))), 1, 8)) as bigint) / 4294967296.0::double shift from f),
n as (select d.*, t.source_size, t.target, t.shift, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end rate,
  row_number() over (partition by d.source order by d.size, d.doc_id) - 1 i from d join t on d.source is not distinct from t.source),
k as (select *, cast(floor(shift + (i + 1) * rate) - floor(shift + i * rate) as bigint) copies from n)
select doc_id, size, source_size, target, copies * size taken, source, copies from k
"""
