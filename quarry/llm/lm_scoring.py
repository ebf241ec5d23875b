"""Cross-entropy difference of two matched bigram models.

Both models have the same vocabulary, order and smoothing; they differ in the texts they
count: the target (labelled documents of good quality) and the background (all documents).
The score of a document is the mean over its tokens of its loss under the target model
less its loss under the background model: the lower, the more it is like the target.

The vocabulary is 2**18 classes of words (lower case in ASCII, split at white space), by
hash: closed, the same for both models, and of one size for any corpus. With counts c of a
model, N its tokens and V classes,
    p(w)     = (c(w) + 1) / (N + V)
    p(w | v) = (c(v, w) + PRIOR p(w)) / (c(v) + PRIOR)
A document is <s> w1 ... wn </s>; <s> is never predicted.

A first pass sums class counts and the bigrams that are frequent in some HOLD tokens. The
head, bigrams with at least 1 in HEAD of all tokens (so HEAD at most, at any size of the
corpus, and every bigram beyond 2 in HEAD), is counted exactly by a second pass and
broadcast. A third pass scores what is in the head at once and sends all other tokens, once,
to buckets by bigram: the tokens of a bucket are all there are of its bigrams, so that they
give the counts of both models and the losses in one place. No bucket gets a hot bigram.
Tokens go as packed arrays, one for each bucket and HOLD tokens, and sums over the tokens of
each document come back as one packed array for each, to where the HOLD tokens are together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary, blocks, mix, ragged, rows, sweep
from .suffix_dedup import Hasher

BITS = 18
CLASSES = 1 << BITS
BEGIN, END = 0, 1
PRIOR = 16.0
HEAD = 1 << 18
BLOCK = 1 << 20
#: Tokens that a task holds at a time, and that a bucket has; rows of the batches it sends.
HOLD, BUCKET, CHUNK = 2 << 20, 2 << 20, 1 << 16
#: Bytes of a bigram's key (2 * BITS bits) and of a row's place that are packed.
KEY_BYTES, ROW_BYTES = 5, 4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def bigrams(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(keys, tokens per document): key = context class << BITS | word class."""
    base = offsets[0]
    text = _FOLD[data[base : offsets[-1]]]
    off = offsets - base
    full = np.zeros(len(text) + 1, bool)
    full[:-1] = ~_BLANK[text]
    first = full.copy()
    first[1:] &= ~full[:-1]
    first[off] = full[off]
    starts = np.flatnonzero(first)
    last = np.zeros(len(text) + 1, bool)
    last[1:] = full[:-1] & (~full[1:] | first[1:])
    ends = np.flatnonzero(last)
    sums = hasher.prefix(text)
    h = (sums[ends] - sums[starts]) * hasher.down[starts] + (ends - starts).astype(np.uint64)
    word = (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
    word[word < 2] += 2  # 0 and 1 are <s> and </s>
    counts = np.diff(np.searchsorted(starts, off))
    # <s> and </s> around the words of every document
    sized = counts + 2
    begin = np.cumsum(sized) - sized
    line = np.full(int(sized.sum()), END, np.int64)
    line[begin] = BEGIN
    line[ragged(begin + 1, counts)] = word
    keys = (line[:-1] << BITS) | line[1:] if len(line) else line
    inner = np.ones(len(line), bool)
    inner[begin] = False
    return keys[inner[1:]], counts + 1


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)


def _frequent(held: list[np.ndarray], share: int):
    """Bigrams with 1 in `share` of these tokens or more, and their counts."""
    keys = np.sort(np.concatenate(held))
    begin = _runs(keys)
    n = np.diff(np.append(begin, len(keys)))
    often = n * share >= len(keys)
    key, n = keys[begin[often]], n[often]
    for i in range(0, len(key), CHUNK):
        yield rows(["key", "b", "t"], key[i : i + CHUNK], n[i : i + CHUNK], np.zeros(len(n[i : i + CHUNK]), np.int64))


def _count_rows(share: int, hold: int):
    """(key, background, target): classes of words as -1 - class, exact; frequent bigrams of every
    `hold` tokens, without a target count."""

    def run(batches):
        hasher = Hasher()
        held, count = [], 0
        one = np.zeros((2, CLASSES), np.int64)
        for b in batches:
            data, offsets = binary(b.column(0))
            good = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets, BLOCK):
                keys, counts = bigrams(data, offsets[i : j + 1], hasher)
                word = keys & (CLASSES - 1)
                one[0] += np.bincount(word, minlength=CLASSES)
                one[1] += np.bincount(word[np.repeat(good[i:j], counts)], minlength=CLASSES)
                one[:, BEGIN] += j - i, int(good[i:j].sum())
                held.append(keys)
                count += len(keys)
                if count > hold:
                    yield from _frequent(held, share)
                    held, count = [], 0
        if held:
            yield from _frequent(held, share)
        used = np.flatnonzero(one[0])
        for i in range(0, len(used), CHUNK):
            u = used[i : i + CHUNK]
            yield rows(["key", "b", "t"], -1 - u, one[0][u], one[1][u])

    return run


def _head_rows(head):
    """(place in the head, background, target) of a task's tokens."""

    def run(batches):
        hasher, table = Hasher(), _table(head)
        n = len(head.value[0])
        sums = np.zeros((2, n), np.int64)
        for b in batches:
            data, offsets = binary(b.column(0))
            good = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets, BLOCK):
                keys, counts = bigrams(data, offsets[i : j + 1], hasher)
                found, place = table.find(keys)
                place = place[found].astype(np.int64)
                sums[0] += np.bincount(place, minlength=n)
                sums[1] += np.bincount(place[np.repeat(good[i:j], counts)[found]], minlength=n)
        used = np.flatnonzero(sums[0])
        for i in range(0, len(used), CHUNK):
            u = used[i : i + CHUNK]
            yield rows(["place", "b", "t"], u, sums[0][u], sums[1][u])

    return run


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each value: all first bytes, then all second ones, and so on."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _unplanes(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = data.reshape(n, -1).T
    return out.view("<u8").ravel().astype(np.int64)


def pack(key: np.ndarray, row: np.ndarray, good: np.ndarray) -> bytes:
    """Tokens in order of their keys: steps between keys, rows, and bits that tell targets."""
    return _planes(np.diff(key, prepend=0), KEY_BYTES) + _planes(row, ROW_BYTES) + np.packbits(good).tobytes()


def unpack(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(blob, np.uint8)
    a, b = n * KEY_BYTES, n * (KEY_BYTES + ROW_BYTES)
    return np.cumsum(_unplanes(data[:a], KEY_BYTES)), _unplanes(data[a:b], ROW_BYTES), np.unpackbits(data[b:], count=n).astype(bool)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


class Table:
    """Look-up of values by key: open addressing, all keys of a batch side by side."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, max(2 * len(keys) - 1, 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -(1 << 62), np.int64)
        self.values = np.zeros(1 << self.bits)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.values[slots] = keys[left[placed]], values[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) per key."""
        at = self._slot(keys)
        found = self.keys[at] == keys
        value = np.where(found, self.values[at], 0.0)
        open_ = np.flatnonzero(~found & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            here = self.keys[at[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = True
            value[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return found, value


_TABLES: dict[object, Table] = {}


def _table(head) -> Table:
    """The table of a broadcast, built once in a worker process."""
    key = getattr(head, "_path", None) or id(head)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Table(*head.value)
    return _TABLES[key]


class Classes:
    """Class counts of both models and what follows from them."""

    def __init__(self, background: np.ndarray, target: np.ndarray):
        self.c = np.stack([background, target]).astype(np.float64)
        words = self.c.copy()
        words[:, BEGIN] = 0  # never predicted
        self.p = (words + 1) / (words.sum(axis=1, keepdims=True) + CLASSES)

    def loss_difference(self, keys: np.ndarray, background, target) -> np.ndarray:
        """Loss under the target less loss under the background, for bigrams with these counts."""
        v, w = keys >> BITS, keys & (CLASSES - 1)
        p = [(c + PRIOR * self.p[m][w]) / (self.c[m][v] + PRIOR) for m, c in ((0, background), (1, target))]
        return np.log(p[0] / p[1])


def pack_sums(row: np.ndarray, d: np.ndarray) -> bytes:
    return _planes(row, ROW_BYTES) + d.astype("<f8").tobytes()


def unpack_sums(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(blob, np.uint8)
    return _unplanes(data[: n * ROW_BYTES], ROW_BYTES), np.frombuffer(blob, "<f8", n, n * ROW_BYTES)


_SENT = ["bucket", "first", "row", "doc_id", "d", "n", "blob"]
_BACK = _SENT[1:]


def _score_rows(head, buckets: int, hold: int):
    """Per document its number of tokens and the loss difference of those in the head; and all
    other tokens, packed, n of them. `first` is the first row of those held together, from
    which packed rows count."""

    def send(first, key, row, good):
        key, row, good = map(np.concatenate, (key, row, good))
        bucket = _bucket(key, buckets)
        order = np.lexsort((key, bucket))
        bucket, key, row, good = bucket[order], key[order], row[order] - first, good[order]
        begin = _runs(bucket)
        ends = np.append(begin[1:], len(bucket))
        for s in range(0, len(begin), 1024):
            some = list(zip(begin[s : s + 1024], ends[s : s + 1024]))
            blob = pa.array([pack(key[i:j], row[i:j], good[i:j]) for i, j in some], pa.binary())
            n, none = len(some), pa.nulls(len(some), pa.int64())
            yield rows(_SENT, bucket[begin[s : s + 1024]], np.full(n, first), none, none, np.zeros(n), np.array([j - i for i, j in some]), blob)

    def run(batches):
        hasher, table = Hasher(), _table(head)
        held, count, first = ([], [], []), 0, 0
        for b in batches:
            row, doc = b.column(0).to_numpy(), b.column(1)
            data, offsets = binary(b.column(2))
            good = b.column(3).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets, BLOCK):
                keys, counts = bigrams(data, offsets[i : j + 1], hasher)
                at = np.repeat(np.arange(j - i), counts)
                found, loss = table.find(keys)
                own = row[i:j]
                if not count:
                    first = int(own[0])
                yield rows(_SENT, own % buckets, np.full(j - i, first), own, doc.slice(i, j - i), np.bincount(at, loss, j - i), counts, pa.nulls(j - i, pa.binary()))
                sent = np.flatnonzero(~found)
                for h, x in zip(held, (keys[sent], own[at[sent]], good[i:j][at[sent]])):
                    h.append(x)
                count += len(sent) + j - i
                if count > hold:
                    yield from send(first, *held)
                    held, count = ([], [], []), 0
        if count:
            yield from send(first, *held)

    return run


def _loss_rows(shared):
    """In place of the tokens of each packed array, sums of their losses by row. Rows come in order
    of buckets; documents' own pass."""

    def settle(classes, first, tokens):
        key, row, good = (np.concatenate(x) for x in zip(*tokens))
        order = np.argsort(key, kind="stable")
        key, good = key[order], good[order]
        begin = _runs(key)
        n = np.diff(np.append(begin, len(key)))
        loss = np.zeros(len(key))
        loss[order] = np.repeat(classes.loss_difference(key[begin], n, np.add.reduceat(good.astype(np.int64), begin)), n)
        row |= np.repeat(np.arange(len(tokens)), [len(t[0]) for t in tokens]) << 8 * ROW_BYTES
        order = np.argsort(row, kind="stable")
        row = row[order]
        begin = _runs(row)
        d, row = np.add.reduceat(loss[order], begin), row[begin]
        edge = np.searchsorted(row, np.arange(len(tokens) + 1) << 8 * ROW_BYTES)
        row &= (1 << 8 * ROW_BYTES) - 1
        blob = pa.array([pack_sums(row[i:j], d[i:j]) for i, j in zip(edge, edge[1:])], pa.binary())
        m, none = len(tokens), pa.nulls(len(tokens), pa.int64())
        yield rows(_BACK, np.array(first), none, none, np.zeros(m), np.diff(edge), blob)

    def run(batches):
        classes, last, first, tokens = Classes(*shared.value), None, [], []
        for b in batches:
            own = b.column(6).is_null()
            whole = b.filter(own)
            if whole.num_rows:
                yield pa.RecordBatch.from_arrays(whole.columns[1:], _BACK)
            packed = b.filter(pc.invert(own))
            bucket, chunk, n = (packed.column(c).to_numpy() for c in (0, 1, 5))
            for i in range(packed.num_rows):
                if bucket[i] != last and tokens:
                    yield from settle(classes, first, tokens)
                    first, tokens = [], []
                last = bucket[i]
                tokens.append(unpack(int(n[i]), packed.column(6)[i].as_py()))
                first.append(int(chunk[i]))
        if tokens:
            yield from settle(classes, first, tokens)

    return run


def _sum_rows(batches):
    """(doc_id, n_tokens, score) of each document, from rows in order of `first`."""
    names = ["doc_id", "n_tokens", "score"]

    def settle(first, own, packed):
        own = pa.Table.from_batches(own)
        row = own["row"].to_numpy()
        total = np.zeros(int(row.max()) - first + 1)
        for n, blob in packed:
            at, d = unpack_sums(n, blob)
            total[at] += d
        n = own["n"].to_numpy()
        doc, score = own["doc_id"].combine_chunks(), (own["d"].to_numpy() + total[row - first]) / n
        for i in range(0, len(n), CHUNK):
            yield rows(names, doc.slice(i, CHUNK), n[i : i + CHUNK], score[i : i + CHUNK])

    last, own, packed = None, [], []
    for b in batches:
        chunk = b.column(0).to_numpy()
        edge = _runs(chunk)
        for i, j in zip(edge, np.append(edge[1:], len(chunk))):
            if chunk[i] != last and own:
                yield from settle(last, own, packed)
                own, packed = [], []
            last = int(chunk[i])
            part = b.slice(i, j - i)
            whole = part.column(5).is_null()
            if (x := part.filter(whole)).num_rows:
                own.append(x.select(["row", "doc_id", "d", "n"]))
            part = part.filter(pc.invert(whole))
            packed += zip(part.column(4).to_pylist(), part.column(5).to_pylist())
    if own:
        yield from settle(last, own, packed)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, head_share: int = HEAD, hold: int = HOLD, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens (words and the end mark), score of each row of docs (doc_id, text).

    target_ids: doc_id of the target documents, of any number (see targets); they meet the
    texts by a shuffle. A null or empty text has one token, its end. A null
    doc_id is scored and never in the target; repeated rows are counted and scored each.
    Without target rows its model is uniform. Other columns take no part; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    # always by shuffle: ids grow with the input; rows without doc_id would all meet in one task
    marked = base.filter("doc_id is not null").hint("merge").join(ids.withColumn("good", F.lit(True)), "doc_id", "left")
    marked = marked.select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    marked = scratch.save(marked.unionByName(base.filter("doc_id is null").withColumn("good", F.lit(False))), "marked")
    sweep(spark)
    texts = marked.select("text", "good")
    parts = texts.mapInArrow(_count_rows(head_share, hold), "key bigint, b bigint, t bigint")
    counts = scratch.save(parts.groupBy("key").agg(F.sum("b").alias("b"), F.sum("t").alias("t")), "counts")
    one = np.zeros((2, CLASSES))
    got = counts.filter("key < 0").toArrow()  # at most 2**18 rows
    one[:, -1 - got["key"].to_numpy()] = got["b"].to_numpy(), got["t"].to_numpy()
    shared = spark.sparkContext.broadcast((one[0], one[1]))
    tokens = int(one[0].sum() - one[0, BEGIN])
    got = counts.filter((F.col("key") >= 0) & (F.col("b") * head_share >= tokens)).select("key").toArrow()  # at most head_share rows
    keys = np.sort(got["key"].to_numpy()).astype(np.int64)
    places = spark.sparkContext.broadcast((keys, np.arange(len(keys), dtype=np.float64)))
    sums = np.zeros((2, len(keys)))
    exact = texts.mapInArrow(_head_rows(places), "place bigint, b bigint, t bigint").groupBy("place").agg(F.sum("b").alias("b"), F.sum("t").alias("t")).toArrow()
    sums[:, exact["place"].to_numpy()] = exact["b"].to_numpy(), exact["t"].to_numpy()
    head = spark.sparkContext.broadcast((keys, Classes(*one).loss_difference(keys, sums[0], sums[1])))
    scratch.drop("counts")
    buckets = -(-tokens // bucket) or 1
    rest = marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "good")
    rest = rest.mapInArrow(_score_rows(head, buckets, hold), "bucket bigint, first bigint, row bigint, doc_id bigint, d double, n bigint, blob binary")
    met = rest.repartition("bucket").sortWithinPartitions("bucket")
    met = met.mapInArrow(_loss_rows(shared), "first bigint, row bigint, doc_id bigint, d double, n bigint, blob binary")
    return met.repartition("first").sortWithinPartitions("first").mapInArrow(_sum_rows, "doc_id bigint, n_tokens bigint, score double")


def targets(labels: DataFrame) -> DataFrame:
    """doc_id of all documents labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def brute_force(texts: list[str], good: list[bool]) -> list[tuple[int, float]]:
    """The same scores from plain dictionaries; for tests."""
    from collections import Counter
    from math import log

    hasher = Hasher()
    lines = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        keys, _ = bigrams(data, np.array([0, len(data)]), hasher)
        lines.append([(int(k) >> BITS, int(k) & (CLASSES - 1)) for k in keys])
    out = []
    pair, uni, ctx = ([Counter(), Counter()] for _ in range(3))
    for line, g in zip(lines, good):
        for m in (0, 1) if g else (0,):
            pair[m].update(line)
            uni[m].update(w for _, w in line)
            ctx[m].update(v for v, _ in line)

    def p(m, v, w):
        return (pair[m][v, w] + PRIOR * (uni[m][w] + 1) / (sum(uni[m].values()) + CLASSES)) / (ctx[m][v] + PRIOR)

    for line in lines:
        out.append((len(line), sum(log(p(0, v, w)) - log(p(1, v, w)) for v, w in line) / len(line)))
    return out
