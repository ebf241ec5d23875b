"""Tree -> one boolean Column over the catalogue (mode "indexed": no statistics, one job).

Column conjuncts on ext, size, mtime and ctime reach the file scan; text is a data filter.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ast import And, Not, Or, Predicate, Text
from .predicates import resolve_time

_COLUMN = {"size": "size", "modified": "mtime", "created": "ctime"}


def needle(term: Text) -> str:
    """What is looked for: the part after the last slash, lower case."""
    return term.text.rsplit("/", 1)[-1].lower()


def is_short(term: Text) -> bool:
    return len(term.text.rsplit("/", 1)[-1].encode()) < 3


def has(column: str, what: str) -> Column:
    return F.contains(F.col(column), F.lit(what))


def glob_regex(pattern: str) -> str:
    """Whole-name regular expression of a pattern with * and ?."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def compare(column: Column, op: str, value) -> Column:
    return {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]


def predicate(p: Predicate, now: int, documented_sign: bool = False) -> Column:
    if p.field == "ext":
        return F.col("ext") == p.value
    value = p.value if isinstance(p.value, int) else resolve_time(p.value, now, documented_sign)
    # sizes beyond 63 bits compare like the largest long, which no file has
    return compare(F.col(_COLUMN[p.field]), p.op, F.lit(min(max(value, -(2**63)), 2**63 - 1)).cast("long"))


def text_leaf(term: Text, glob: bool = False) -> Column:
    if glob and term.glob:
        return F.col("visible") & F.rlike(F.col("name_lc"), F.lit(glob_regex(needle(term))))
    if is_short(term):
        return has("name_lc", needle(term))
    return F.col("visible") & has("rel_lc", needle(term))


def all_text(terms: tuple[Text, ...]) -> Column:
    """AND of text terms only: one long needle makes all of them path matches."""
    needles = [needle(t) for t in terms]
    if all(is_short(t) for t in terms):
        return reduce(and_, [has("name_lc", needles[0]), *(has("abs_lc", n) for n in needles[1:])])
    return reduce(and_, [has("rel_lc", n) for n in needles], F.col("visible"))


def compile_filter(expr, now: int, *, glob: bool = False, documented_sign: bool = False) -> Column:
    def go(e) -> Column:
        if isinstance(e, Text):
            return text_leaf(e, glob)
        if isinstance(e, Predicate):
            return predicate(e, now, documented_sign)
        if isinstance(e, Not):
            return ~go(e.child)
        if isinstance(e, Or):
            return reduce(or_, map(go, e.children))
        if not e.children:
            return F.lit(True)
        if len(e.children) > 1 and all(isinstance(c, Text) for c in e.children) and not (glob and any(c.glob for c in e.children)):
            return all_text(e.children)
        # predicates first: they are cheaper than text and reach the scan
        return reduce(and_, map(go, sorted(e.children, key=lambda c: not isinstance(c, Predicate))))

    return go(expr)


def path_order(terms: list[str]) -> Column:
    """Two or more terms must follow each other in the path without overlap."""
    if len(terms) < 2:
        return F.lit(True)
    quoted = [r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms]
    return F.rlike(F.col("abs_lc"), F.lit("(?s)" + ".*?".join(quoted)))


def and_children_are_text(e) -> bool:
    return isinstance(e, And) and len(e.children) > 1 and all(isinstance(c, Text) for c in e.children)
