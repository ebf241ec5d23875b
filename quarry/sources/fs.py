"""File records from a directory tree, as a Python data source named "filetree".

One partition per directory of the first levels; hidden directories are entered, links
are not followed, what cannot be read is skipped with a warning. The built-in binary
reader is no substitute, as it leaves out names that begin with a dot or underscore.
"""

from __future__ import annotations

import logging
import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.filters import DEFAULT_IGNORE, SYSTEM_SKIP, Excludes

log = logging.getLogger(__name__)

SCHEMA = (
    "abs_path string, name string, ext string, size bigint, mtime bigint, ctime bigint, atime bigint, "
    "is_dir boolean, is_symlink boolean, is_special boolean, is_hidden boolean, is_trash boolean, is_ignored boolean, is_excluded boolean"
)


def extension_of(name: str) -> str | None:
    stem, dot, ext = name.rpartition(".")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in ext) if dot and stem else None


def seconds(t: float | None) -> int:
    """Whole epoch seconds; unknown and earlier times are 0."""
    return max(0, int(t)) if t else 0


def record(path: str, ex: Excludes) -> tuple | None:
    """One file's row, or None if it cannot be read or its name is no UTF-8."""
    name = os.path.basename(path)
    try:
        name.encode()
        st = os.lstat(path)
    except (UnicodeEncodeError, OSError) as e:
        log.warning("skipped %r: %s", path, e)
        return None
    is_dir, is_link = stat.S_ISDIR(st.st_mode), stat.S_ISLNK(st.st_mode)
    special = not (is_dir or is_link or stat.S_ISREG(st.st_mode))
    size, times = (0, (0, 0, 0)) if is_dir else (st.st_size, (seconds(st.st_mtime), seconds(getattr(st, "st_birthtime", None)), seconds(st.st_atime)))
    return (path, name, extension_of(name), size, *times, is_dir, is_link, special, name.startswith("."), ex.in_trash(path), ex.is_ignored(path, is_dir), ex.is_excluded(path))


def entries(folder: str, ex: Excludes):
    """(row, whether to go down) of each entry of a folder."""
    try:
        paths = [e.path for e in os.scandir(folder)]
    except OSError as e:
        log.warning("skipped %r: %s", folder, e)
        return
    for path in sorted(paths):
        row = record(path, ex)
        if row:
            down = row[7] and not (row[8] or row[11] or row[12] or row[13])
            yield row, down


def walk(folder: str, ex: Excludes):
    """All rows below a folder, without recursion in Python."""
    todo = [folder]
    while todo:
        for row, down in entries(todo.pop(), ex):
            yield row
            if down:
                todo.append(row[0])


class _Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options["path"].split(os.pathsep) if r]
        self.split_depth = int(options.get("splitDepth", "2"))
        ignore, exclude = options.get("ignore", "").splitlines(), options.get("exclude", "").splitlines()
        if options.get("defaults", "false").lower() == "true":
            ignore, exclude = DEFAULT_IGNORE + ignore, SYSTEM_SKIP + exclude
        self.ex = Excludes(ignore, exclude, options.get("trash", "").splitlines())

    def partitions(self):
        """Folders above splitDepth list only themselves; those at it take their subtree."""
        out, level = [], self.roots
        for _ in range(self.split_depth):
            out += [_Subtree(f, False) for f in level]
            level = [row[0] for f in level for row, down in entries(f, self.ex) if down]
        return out + [_Subtree(f, True) for f in level]

    def read(self, part):
        yield from walk(part.folder, self.ex) if part.deep else (row for row, _ in entries(part.folder, self.ex))


class FileTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Walk records below root. options: splitDepth, ignore, exclude, trash (lines), defaults
    ("true" puts the default ignore patterns and skipped roots in front)."""
    spark.dataSource.register(FileTreeSource)
    return spark.read.format("filetree").options(path=root, **options).load()
