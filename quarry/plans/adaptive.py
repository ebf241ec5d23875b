"""Mode "faithful": the scope of a text term depends on how many files are left.

Candidate sets are boolean Columns; each decision takes the count of one of them, so a
query costs a few counting jobs before its result is defined. Statistics of all the
query's trigrams come from one aggregation.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, python_trigrams
from .ast import Not, Or, Predicate, Text
from .compiler import and_children_are_text, has, is_short, needle, predicate
from .parser import text_terms

# Thresholds and costs of the evaluator.
SMALL_CANDIDATES, EARLY_VERIFY, TRIGRAM_SHARE, MOST_TRIGRAMS, BROAD_SHARE = 2000, 256, 0.30, 3, 0.6
LINEAR_SCAN, VERY_BAD, EMPTY_COST = (2**64 - 1) // 2, (2**64 - 1) // 3, 5
SIMPLE_COST = {"ext": 10, "size": 20, "created": 25, "modified": 25}
INDEX_COST = {"ext": 1, "size": 2, "created": 3, "modified": 3}


class Adaptive:
    def __init__(self, files: DataFrame, now: int, documented_sign: bool = False):
        self.files, self.now, self.documented_sign = files, now, documented_sign
        self.postings: dict[bytes, int] = {}
        self.n_files = 0

    def compile(self, expr) -> Column:
        tris = sorted({t for term in text_terms(expr) for s in (term.text, needle(term)) for t in python_trigrams(s)})
        folded = F.encode(ascii_lower(F.col("rel_path")), "utf-8")
        counts = [F.count_if(F.col("visible") & F.contains(folded, F.lit(bytearray(t)))).alias(f"t{i}") for i, t in enumerate(tris)]
        row = self.files.agg(F.count("*").alias("n"), *counts).first()
        self.n_files, self.postings = row["n"], {t: row[f"t{i}"] for i, t in enumerate(tris)}
        return self.eval(expr, F.lit(True))

    def count(self, where: Column) -> int:
        return self.files.filter(where).count()

    # costs

    def term_cost(self, term: Text) -> int:
        tris = python_trigrams(term.text)
        if not tris:
            return LINEAR_SCAN
        lengths = [self.postings[t] for t in tris]
        if self.n_files == 0 or 0 in lengths:  # the directory lists are empty: directories are not catalogued
            return 0
        return sum(n for n in lengths if n <= int(self.n_files * TRIGRAM_SHARE)) or VERY_BAD

    def simple_cost(self, e) -> int:
        if isinstance(e, Predicate):
            return SIMPLE_COST[e.field]
        if isinstance(e, Text):
            n = len(e.text)
            return LINEAR_SCAN if n < 3 else 10 + (30 - min(n, 40)) % 2**64
        if isinstance(e, Not):
            return self.simple_cost(e.child) + 1
        return min(map(self.simple_cost, e.children), default=EMPTY_COST)

    def index_cost(self, e) -> int:
        if isinstance(e, Predicate):
            return INDEX_COST[e.field] * self.n_files
        if isinstance(e, Text):
            return self.term_cost(e)
        if isinstance(e, Not):
            return self.index_cost(e.child) + 1
        return min(map(self.index_cost, e.children), default=EMPTY_COST)

    # evaluation: the result is always a part of the candidates

    def eval(self, e, among: Column) -> Column:
        if isinstance(e, Predicate):
            return among & predicate(e, self.now, self.documented_sign)
        if isinstance(e, Text):
            return self.text(e, among)
        if isinstance(e, Not):
            return among & ~self.eval(e.child, among)
        if isinstance(e, Or):
            return reduce(or_, [self.eval(c, among) for c in e.children])
        if and_children_are_text(e):
            return self.text_and(e.children, among)
        cost = self.index_cost if sum(isinstance(c, Text) for c in e.children) >= 2 else self.simple_cost
        for child in sorted(e.children, key=cost):
            among = self.eval(child, among)
        return among

    def text(self, term: Text, among: Column) -> Column:
        n = needle(term)
        if is_short(term) or self.count(among) <= SMALL_CANDIDATES:
            return among & has("name_lc", n)
        lengths = {t: self.postings[t] for t in python_trigrams(n)}
        if 0 in lengths.values():
            return F.lit(False)
        selective = sorted((k, t) for t, k in lengths.items() if k <= int(self.n_files * TRIGRAM_SHARE))
        if not selective:
            return among & has("abs_lc", n)
        folded = F.encode(ascii_lower(F.col("rel_path")), "utf-8")
        found = among & F.col("visible")
        for i, (_, t) in enumerate(selective[:MOST_TRIGRAMS]):
            found = found & F.contains(folded, F.lit(bytearray(t)))
            if i + 1 < min(len(selective), MOST_TRIGRAMS) and self.count(found) <= EARLY_VERIFY:
                break
        return found & has("abs_lc", n)

    def text_and(self, terms: tuple[Text, ...], among: Column) -> Column:
        costs = [self.term_cost(t) for t in terms]
        if 0 in costs:
            return F.lit(False)
        ranked = sorted(zip(costs, range(len(terms)), terms))
        narrow = [x for x in ranked if x[0] <= int(self.n_files * BROAD_SHARE)]
        seed = (narrow or ranked)[0][2]
        return reduce(and_, [has("abs_lc", needle(t)) for t in terms], self.text(seed, among))


def compile_adaptive(files: DataFrame, expr, now: int, documented_sign: bool = False) -> Column:
    return Adaptive(files, now, documented_sign).compile(expr)


