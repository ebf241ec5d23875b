"""A catalogue on disk: files, dirs and trigrams as Parquet, plus one row of metadata.

Each build goes to a version folder of its own and becomes current when the small file
`current` names it, so a reader sees the old catalogue or the new one, never a mix.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import build_catalog, catalog_info, directories, regular_files
from ..operators.trigram_index import file_trigrams, write_index

VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    return "\n".join(r.value for r in spark.read.text(path).collect()) if fs.exists(p) else None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename over it."""
    fs, target = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, target, options)  # one step: a reader finds the old file or the new one


def write_catalog(files: DataFrame, path: str, root: str, now: int | None = None, trigrams: bool = True) -> str:
    """Write a new version and make it current; returns its folder."""
    spark = files.sparkSession
    folder = f"{path}/{uuid.uuid4().hex}"
    files.repartitionByRange("ext", "fid").sortWithinPartitions("ext", "fid").write.parquet(f"{folder}/files")
    stored = spark.read.parquet(f"{folder}/files")
    directories(stored).write.parquet(f"{folder}/dirs")
    if trigrams:
        write_index(file_trigrams(stored), f"{folder}/trigrams")
    meta = {"version": VERSION, "root": root, "created_secs": int(time.time()) if now is None else now}
    _write_text(spark, f"{folder}/meta.json", json.dumps(meta))
    _write_text(spark, f"{path}/current", folder.rsplit("/", 1)[-1])
    return folder


def check_catalog(spark: SparkSession, path: str, root: str | None = None) -> str:
    """ok, missing, corrupt, version-mismatch or root-mismatch."""
    name = _read_text(spark, f"{path}/current")
    if not name:
        return "missing"
    try:
        meta = json.loads(_read_text(spark, f"{path}/{name}/meta.json") or "")
        version, built_for = meta["version"], meta["root"]
    except (ValueError, KeyError, TypeError):
        return "corrupt"
    fs, done = _fs(spark, f"{path}/{name}/files/_SUCCESS")
    if not fs.exists(done):
        return "corrupt"
    if version != VERSION:
        return "version-mismatch"
    return "root-mismatch" if root is not None and root != built_for else "ok"


def open_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    state = check_catalog(spark, path)
    if state != "ok":
        raise FileNotFoundError(f"no usable catalogue at {path}: {state}")
    folder = f"{path}/{_read_text(spark, f'{path}/current')}"
    out = {t: spark.read.parquet(f"{folder}/{t}") for t in ("files", "dirs")}
    out["meta"] = spark.createDataFrame([json.loads(_read_text(spark, f"{folder}/meta.json"))], "version int, root string, created_secs bigint")
    fs, tri = _fs(spark, f"{folder}/trigrams")
    return out | ({"trigrams": spark.read.parquet(f"{folder}/trigrams")} if fs.exists(tri) else {})


def open_or_build(spark: SparkSession, path: str, root: str, **scan_options: str) -> dict[str, DataFrame]:
    """Open a current catalogue of this root, or walk root and write one first."""
    if check_catalog(spark, path, root) != "ok":
        from .fs import scan

        records = regular_files(scan(spark, root, **scan_options)).withColumn("fid", F.xxhash64("abs_path"))
        write_catalog(build_catalog(records, root), path, root)
    return open_catalog(spark, path)


def info(spark: SparkSession, path: str) -> dict:
    """Place, root, counts and bytes on disk."""
    tables = open_catalog(spark, path)
    fs, p = _fs(spark, path)
    row = catalog_info(tables["files"]).first()
    return {"path": path, "root": tables["meta"].first().root, "disk_bytes": fs.getContentSummary(p).getLength(), **row.asDict()}
