"""String and byte expressions over paths; all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other character stays as it is."""
    return F.translate(c, _UPPER, _LOWER)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; '' for none and for a leading dot alone."""
    return F.when(F.instr(F.substring(name, 2, 2**31 - 1), ".") == 0, "").otherwise(ascii_lower(F.substring_index(name, ".", -1)))


def relative_to(path: Column, root: str) -> Column:
    """The path below root, or the path itself if it lies elsewhere."""
    head = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, len(head) + 1, 2**31 - 1)).otherwise(path)


def join_root(root: str, rel: Column) -> Column:
    """Exactly one separator between root and rel."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(rel, F.lit("/")))


def trigrams(c: Column) -> Column:
    """Distinct 3-byte windows (binary) of the ASCII-folded text; none below 3 bytes."""
    b = F.encode(ascii_lower(c), "utf-8")
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(b) - 2, F.lit(1)))
    return F.when(F.octet_length(b) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(b, i, F.lit(3))))).otherwise(F.array().cast("array<binary>"))


def sparse_trigrams(c: Column) -> Column:
    """Distinct windows at every third byte, and the last one: a subset of trigrams()."""
    b = F.encode(ascii_lower(c), "utf-8")
    last = F.greatest(F.octet_length(b) - 2, F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(3)), F.array(last)))
    return F.when(F.octet_length(b) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(b, i, F.lit(3))))).otherwise(F.array().cast("array<binary>"))


def python_trigrams(s: str) -> list[bytes]:
    """The same windows of a query term, on the driver, sorted."""
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in s.encode())
    return sorted({b[i : i + 3] for i in range(len(b) - 2)})


def byte_offset(haystack: Column, needle: str) -> Column:
    """0-based byte position of the first occurrence (for haystacks that have one)."""
    return F.octet_length(F.substring(haystack, F.lit(1), F.instr(haystack, needle) - 1))
