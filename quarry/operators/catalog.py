"""The catalogue: one row per file with everything that search and ranking read.

Derived columns are computed once, when the catalogue is built, and written as
columnar files; queries then touch only the columns they name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.text import extension, file_name, relative_to

# Bits of file_flags.
DIRECTORY, SYMLINK, SPECIAL, HIDDEN, TRASH, GLOB_IGNORED, USER_EXCLUDED = 1, 2, 4, 8, 16, 32, 64
FLAG_BITS = {
    "is_dir": DIRECTORY, "is_symlink": SYMLINK, "is_special": SPECIAL, "is_hidden": HIDDEN,
    "is_trash": TRASH, "is_ignored": GLOB_IGNORED, "is_excluded": USER_EXCLUDED,
}
INVISIBLE = HIDDEN | TRASH | GLOB_IGNORED | USER_EXCLUDED | SPECIAL

COLUMNS = [
    "fid", "name", "rel_path", "abs_path", "ext", "size", "mtime", "ctime", "atime", "file_flags", "visible",
    "noise_flags", "path_depth", "name_lc", "rel_lc", "abs_lc",
]


def file_flags() -> Column:
    """Seven booleans as one integer."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c), bit).otherwise(0) for c, bit in FLAG_BITS.items()])


def is_visible(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(INVISIBLE)) == 0


def regular_files(records: DataFrame) -> DataFrame:
    return records.filter("not is_dir and not is_symlink and not is_special")


def clamp_seconds(c: Column) -> Column:
    """Epoch seconds in unsigned 32 bits; missing and earlier times are 0."""
    return F.least(F.greatest(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0)), F.lit(2**32 - 1)).cast("long")


def build_catalog(records: DataFrame, root: str) -> DataFrame:
    """Catalogue rows of walk records.

    records: fid, abs_path, size and optionally mtime, ctime, atime and the booleans of
    FLAG_BITS (is_hidden defaults to a name that begins with a dot). fid must be a
    deterministic key, since ties in the ranking go to the smaller one.
    """
    have = set(records.columns)
    df = records.withColumn("name", file_name(F.col("abs_path")))
    for c in FLAG_BITS:
        if c not in have:
            df = df.withColumn(c, F.startswith("name", F.lit(".")) if c == "is_hidden" else F.lit(False))
    for c in ("mtime", "ctime", "atime"):
        df = df.withColumn(c, clamp_seconds(F.col(c)) if c in have else F.lit(0).cast("long"))
    df = df.withColumns({
        "rel_path": relative_to(F.col("abs_path"), root),
        "ext": extension(F.col("name")),
        "file_flags": file_flags(),
        "noise_flags": noise.noise_flags(F.col("abs_path")),
        "path_depth": noise.path_depth(F.col("abs_path")),
    })
    df = df.withColumns({
        "visible": is_visible(F.col("file_flags")),
        "name_lc": F.lower("name"), "rel_lc": F.lower("rel_path"), "abs_lc": F.lower("abs_path"),
    })
    return df.select(*COLUMNS)


def directories(files: DataFrame) -> DataFrame:
    """Every ancestor directory once: rel_path, name, parent (null right below the root)."""
    parts = F.split("rel_path", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    dirs = files.filter(F.contains("rel_path", F.lit("/"))).select(F.explode(prefixes).alias("rel_path")).distinct()
    cut = F.length("rel_path") - F.length("name") - 1
    return dirs.withColumn("name", file_name(F.col("rel_path"))).withColumn("parent", F.when(cut > 0, F.substring(F.col("rel_path"), F.lit(1), cut)))


def extension_postings(files: DataFrame) -> DataFrame:
    """ext, number of files, their ids in order. One array per extension: for inspection; queries filter the ext column."""
    return files.filter("ext <> ''").groupBy("ext").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("fid")).alias("fids"))


def catalog_info(files: DataFrame) -> DataFrame:
    """Files, directories and bytes of a catalogue, in one row."""
    n_dirs = directories(files).agg(F.count("*").alias("n_dirs"))
    totals = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if("visible").alias("n_visible"))
    return totals.join(n_dirs)  # one row each
