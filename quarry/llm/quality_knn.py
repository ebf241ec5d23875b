"""Quality by nearest-neighbour votes in latent-semantic space.

A text's terms are its byte trigrams, hashed into CLASSES and present or not, and, counted,
how far back each word last occurred (in powers of two; new words have a bin of their own)
by its length. log(1 + count) is weighted by rarity and scaled to length 1. A truncated SVD of labelled documents gives the axes.
Labelled vectors and axes are broadcast (their sizes are parameters); every document is
projected and its cosines with all labelled vectors are computed in blocks, exactly. The score is the share of label 1 among the k
nearest, weighted by cosine.

Only the labelled sample is bounded (`per_label` documents of each label, by hash); the
model learns from nothing else and every document is scored on its whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, blocks, free_names, frugal, rows
from .lm_scoring import _BLANK
from .suffix_dedup import Hasher

CLASSES = 4096
#: Bins of the distance to the last occurrence of a word (the last one: none), and of word lengths.
GAPS, LENGTHS = 16, 16
TERMS = CLASSES + GAPS * LENGTHS
BLOCK = 1 << 18
K, AXES, PER_LABEL = 25, 96, 3000
SHARPNESS = 4
#: Rows that are held with all TERMS at once, whatever their length.
SAMPLE_ROWS = 256


def held_out(doc_id):
    """The remainder of crc32(doc_id as text) by 3 is 1; such labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def term_counts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Counts (documents x TERMS) of consecutive texts in a buffer."""
    text, off = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, TERMS), np.float32)
    doc = np.repeat(np.arange(n), size)
    if len(text) > 2:
        wide = text.astype(np.uint32)
        term = ((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(20)
        same = doc[:-2] == doc[2:]
        out[:, :CLASSES] = np.bincount(doc[:-2][same] * CLASSES + term[same], minlength=n * CLASSES).reshape(n, CLASSES) > 0
    full = np.append(~_BLANK[text], False)
    first = full.copy()
    first[1:] &= ~full[:-1]
    first[off] = full[off]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(np.append(False, full[:-1] & (~full[1:] | first[1:])))
    sums = hasher.prefix(text)
    h, owner = (sums[ends] - sums[starts]) * hasher.down[starts], doc[starts]
    order = np.lexsort((h, owner))  # of equal words the earlier first
    again = np.append(False, (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1]))[: len(order)]
    gap = np.full(len(order), GAPS - 1)
    gap[again] = np.minimum(np.frexp(np.diff(order)[again[1:]])[1] - 1, GAPS - 2)
    kind = gap * LENGTHS + np.minimum(ends - starts, LENGTHS - 1)[order]
    out[:, CLASSES:] = np.bincount(owner[order] * (GAPS * LENGTHS) + kind, minlength=n * GAPS * LENGTHS).reshape(n, -1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; those without a length stay 0."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class Counts:
    """Counts (documents x TERMS) of which only those above 0 are held."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.offsets, self.terms, self.values = offsets, terms, values

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, order: np.ndarray) -> Counts:
        out = Counts(np.append(0, np.cumsum(np.diff(self.offsets)[order])), np.empty_like(self.terms), np.empty_like(self.values))
        for i, x in enumerate(order):
            new, old = slice(*out.offsets[i : i + 2]), slice(*self.offsets[x : x + 2])
            out.terms[new], out.values[new] = self.terms[old], self.values[old]
        return out

    def dense(self, step: int = SAMPLE_ROWS):
        """(rows as a slice, their places in terms and values, row and term of each, all counts)."""
        for i in range(0, len(self), step):
            own = self.offsets[i : i + step + 1]
            place = slice(own[0], own[-1])
            row, term = np.repeat(np.arange(len(own) - 1), np.diff(own)), self.terms[place]
            x = np.zeros((len(own) - 1, TERMS), np.float32)
            x[row, term] = self.values[place]
            yield slice(i, i + step), place, (row, term), x

    def times(self, y: np.ndarray) -> np.ndarray:
        """This matrix by y."""
        out = np.empty((len(self), y.shape[1]), np.float32)
        for at, _, _, x in self.dense():
            out[at] = x @ y
        return out

    def turned_times(self, y: np.ndarray) -> np.ndarray:
        """This matrix, transposed, by y."""
        out = np.zeros((TERMS, y.shape[1]), np.float32)
        for at, _, _, x in self.dense():
            out += x.T @ y[at]
        return out


class Model:
    """Term weights, axes and labelled vectors. Beside the sample itself, fitting holds
    SAMPLE_ROWS rows of all terms at a time, so that a driver's memory has a bound."""

    def __init__(self, counts: Counts, labels: np.ndarray, axes: int = AXES, seed: int = 0):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = np.zeros(TERMS, np.int64)
        for _, _, _, x in counts.dense():
            seen += (x > 0).sum(axis=0)
        self.rarity = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 0.1
        weight = np.empty(len(counts.values), np.float32)
        for _, place, cell, x in counts.dense():
            weight[place] = self.weigh(x)[cell]
        sample = Counts(counts.offsets, counts.terms, weight)
        rng = np.random.default_rng(seed)
        axes = min(axes, len(sample), TERMS)
        probe = sample.times(rng.standard_normal((TERMS, min(axes + 16, len(sample)))).astype(np.float32))
        for _ in range(3):  # power iterations towards the leading axes
            probe = sample.times(sample.turned_times(np.linalg.qr(probe)[0])) if axes else probe
        if axes:
            basis = np.linalg.qr(probe)[0]
            self.axes = np.ascontiguousarray(np.linalg.svd(sample.turned_times(basis).T, full_matrices=False)[2][:axes].T)
        else:
            self.axes = np.zeros((TERMS, 1), np.float32)
        self.vectors = unit(sample.times(self.axes))

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.rarity)

    def project(self, weighed: np.ndarray) -> np.ndarray:
        return unit(weighed @ self.axes)

    def score(self, counts: np.ndarray, k: int = K, block: int = 256) -> np.ndarray:
        """Weighted share of label 1 among the k nearest labelled vectors; equally near ones
        all vote. Texts without terms, or without a positive cosine, get the sample's share."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        vectors = self.project(self.weigh(counts))
        k = min(k, len(self.labels))
        for i in range(0, len(counts), block):
            cosine = vectors[i : i + block] @ self.vectors.T
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k]
            row, col = np.nonzero(cosine >= np.maximum(least, 1e-6)[:, None])
            vote = cosine[row, col].astype(np.float64) ** SHARPNESS
            total = np.bincount(row, vote, len(cosine))
            good = np.bincount(row, vote * self.labels[col], len(cosine))
            some = total > 0
            out[i : i + len(cosine)][some] = good[some] / total[some]
        return np.clip(out, 0, 1)


@frugal
def _sample_rows(batches):
    """Sparse counts of the labelled texts."""
    hasher = Hasher()
    for b in batches:
        quality = b.column(0)
        data, offsets = binary(b.column(1))
        for i, j in blocks(offsets, BLOCK, SAMPLE_ROWS):
            counts = term_counts(data, offsets[i : j + 1], hasher)
            terms = [np.flatnonzero(c) for c in counts]
            yield rows(
                ["quality", "terms", "counts"],
                quality.slice(i, j - i),
                pa.array([t.astype(np.uint16).tobytes() for t in terms], pa.binary()),
                pa.array([c[t].tobytes() for c, t in zip(counts, terms)], pa.binary()),
            )


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, axes: int = AXES) -> Model:
    """Learn from at most per_label documents of each label that are not held out; of several
    texts with one doc_id, from one."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("quality = 0").orderBy(*order).limit(per_label).unionByName(known.filter("quality = 1").orderBy(*order).limit(per_label))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")
    got = texts.mapInArrow(_sample_rows, "quality int, terms binary, counts binary").toArrow()  # at most 2 * per_label documents
    if not got.num_rows:
        return Model(Counts(np.zeros(1, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.float32)), np.zeros(0), axes)
    (term, at), (count, end) = binary(got["terms"]), binary(got["counts"])
    label = got["quality"].to_numpy()
    key = [hashlib.md5(term[at[i] : at[i + 1]].tobytes() + count[end[i] : end[i + 1]].tobytes()).digest() for i in range(len(label))]
    turn = np.array(sorted(range(len(label)), key=lambda i: (label[i], key[i])))  # the same order in every run
    counts = Counts(at // 2, term[: at[-1]].view(np.uint16), count[: end[-1]].view(np.float32))
    return Model(counts.take(turn), label[turn], axes)


def score(docs: DataFrame, labels: DataFrame, k: int = K, per_label: int = PER_LABEL, columns: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), with `columns`, which
    get an underscore behind a name that the result has already.

    A null text is empty; it gets the sample's share of label 1. Rows alike get the same
    score. A null doc_id is scored and not held out. Without labels every score is 0.5.
    Labels other than 0 and 1 are not learned; a document labelled both ways counts as 1.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, per_label))
    inner = [f"c{i}" for i in range(len(columns))]
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), *(F.col(f"`{c}`").alias(x) for c, x in zip(columns, inner)), "text")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema if f.name != "text")

    def run(batches):
        hasher = Hasher()
        for b in batches:
            last = b.num_columns - 1
            data, offsets = binary(b.column(last))
            for i, j in blocks(offsets, BLOCK, SAMPLE_ROWS):
                s = model.value.score(term_counts(data, offsets[i : j + 1], hasher), k)
                head = [b.column(c).slice(i, j - i) for c in range(last)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names[:last], "score", "predicted"])

    own = ["doc_id", "held_out", "score", "predicted"]
    out = source.mapInArrow(frugal(run), kinds + "score double, predicted int")
    return out.select(*own, *inner).toDF(*own, *free_names(own, *columns))


def accepted(docs: DataFrame, labels: DataFrame, k: int = K, per_label: int = PER_LABEL) -> DataFrame:
    """Rows of docs whose predicted label is 1, with all their columns, whatever their names.
    Nulls, repeated rows and empty tables are as in score()."""
    voted = score(docs, labels, k, per_label, docs.columns).filter("predicted = 1")
    return voted.select(*(F.col(f"`{c}`") for c in voted.columns[4:])).toDF(*docs.columns)
