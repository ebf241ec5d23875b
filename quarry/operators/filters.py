"""Which paths a walk leaves out: trash, ignore patterns and excluded folders."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ignore patterns and skipped roots.
DEFAULT_IGNORE = [
    "venv/", ".venv/", "build/", ".cache/", "dist/", ".DS_Store", ".git/", ".hg/", ".svn/", "node_modules/", "target/",
    "Thumbs.db", "vendor/", "lost+found/",
]
SYSTEM_SKIP = ["/proc", "/sys", "/dev", "/run", "/var/run", "/var/tmp", "/private/tmp"]


def trash_root() -> str:
    home = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local/share")
    return os.path.join(home, "Trash")


def collapse(roots: list[str]) -> list[str]:
    """Roots without those that lie below another one."""
    out: list[str] = []
    for r in sorted({r.rstrip("/") or "/" for r in roots}):
        if not any(under(r, o) for o in out):
            out.append(r)
    return out


def under(path: str, root: str) -> bool:
    """Whole components: /a/bc is not under /a/b."""
    return path == root or path.startswith(root.rstrip("/") + "/")


def under_any(path: Column, roots: list[str]) -> Column:
    """The same test as a Column."""
    out = F.lit(False)
    for r in collapse(roots):
        out = out | (path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/"))
    return out


class IgnorePatterns:
    """Patterns in the usual ignore-file syntax; the last one that fits decides."""

    def __init__(self, lines: list[str], root: str = ""):
        self.root = root
        self.rules = [rule for line in lines if (rule := self._rule(line))]

    @staticmethod
    def _rule(line: str):
        line = line.rstrip("\n")
        if not line.strip() or line.startswith("#"):
            return None
        keep = line.startswith("!")
        body = line[keep:].rstrip()
        only_dir = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
                inner = body[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(body[i]) or re.escape(body[i])
                i += 1
        return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S), only_dir, keep

    def _verdict(self, rel: str, is_dir: bool) -> bool:
        for regex, only_dir, keep in reversed(self.rules):
            if (is_dir or not only_dir) and regex.match(rel):
                return not keep
        return False

    def match(self, path: str, is_dir: bool = False) -> bool:
        """True if the path, or a folder above it, is ignored."""
        rel = path[len(self.root) :].strip("/") if path.startswith(self.root) else path.strip("/")
        parts = rel.split("/")
        return any(self._verdict("/".join(parts[:n]), is_dir or n < len(parts)) for n in range(1, len(parts) + 1))

    def column(self, path: Column, is_dir: Column) -> Column:
        """Over a DataFrame, in Arrow batches: globs with negation have no built-in form."""
        rules = self

        @F.pandas_udf("boolean")
        def ignored(p: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series([x is not None and rules.match(x, bool(y)) for x, y in zip(p, d)], dtype=bool)

        return ignored(path, is_dir)


class Excludes:
    """All three tests for a walker; empty lists switch a test off."""

    def __init__(self, ignore: list[str] = (), exclude: list[str] = (), trash: list[str] = (), root: str = ""):
        self.patterns = IgnorePatterns(list(ignore), root)
        self.roots = collapse([r for r in exclude if r])
        self.trash = collapse([r for r in trash if r] or [trash_root()])

    def in_trash(self, path: str) -> bool:
        return any(under(path, r) for r in self.trash)

    def is_ignored(self, path: str, is_dir: bool = False) -> bool:
        return bool(self.patterns.rules) and self.patterns.match(path, is_dir)

    def is_excluded(self, path: str) -> bool:
        return any(under(path, r) for r in self.roots)
