"""Near-duplicates by Order MinHash.

A text is the sequence of its words. Its k-mers (k words in a row; 3, in texts of up to
SHORT words 2, so that edits near the limit leave enough of them) are labelled with how
often they have occurred before, so the labelled ones are distinct. For each of `sketches`
random orders the 2 smallest labelled k-mers are taken in the order of the text and hashed
to one key: unlike a set of minima, equal keys say that two k-mers come in the same order.
Texts with an equal key whose lengths and positions allow it are candidates, and a pair is
a link if 1 - edits / longer length >= `similarity`, by banded alignment of the words.

Classes are the connected components of the links. A bucket is the texts with one key, in
one order that is the same in all buckets. Each text meets the first one of each of its
buckets, so that in a group of copies most buckets name the same pairs. It is aligned with
the one that it shares most keys with, then with the others as far as the links found so
far leave them apart. In a bucket of more than COVERED texts that are still in several
components, all other pairs of different components are compared, in cells of a fixed number
of rows: by the words they have in common, which never rule out a link, and what that leaves
by alignment. So each pair with an equal key that may be a link is in one class. That last
step grows with the square of the number of unlike texts in a bucket; only links leave it.

Rows of docs are numbered once, in a written table; copies of a text, found by 128-bit
digest, are one node. Tasks settle keys that many of their own texts share before the
shuffle, so a bucket gets one row of each such run, however many texts have its key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary, blocks, free_names, frugal, mix, ragged, rows, slices, sweep
from .components import components
from .lm_scoring import _BLANK
from .suffix_dedup import Hasher

K, SKETCHES, SIMILARITY = 3, 64, 0.8
#: Texts up to SHORT words have k-mers of SHORT_K words at most.
SHORT_K, SHORT = 2, 200
MEMBERS = 1024
#: All pairs of buckets up to this size are candidates.
COVERED = 4
CELL = 1024
#: Words that one matrix product covers.
COLUMNS = 2048
#: Texts whose keys a task holds at a time, and how many of them may share a key before it is settled there.
HOLD, LOCAL = 1 << 13, 64
BLOCK = 1 << 20
TOP = np.iinfo(np.uint64).max


def word_hashes(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, words per text) of consecutive texts."""
    text, off = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    full = np.append(~_BLANK[text], False)
    first = full.copy()
    first[1:] &= ~full[:-1]
    first[off] = full[off]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(np.append(False, full[:-1] & (~full[1:] | first[1:])))
    sums = hasher.prefix(text)
    return mix((sums[ends] - sums[starts]) * hasher.down[starts] + (ends - starts).astype(np.uint64)), np.diff(np.searchsorted(starts, off))


def labelled_kmers(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mers, k-mers per text); a text of fewer than k words is one k-mer, an empty one none."""
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    padded = np.append(words, np.zeros(k, np.uint64))
    at = ragged(begin, sizes)
    text = np.repeat(np.arange(len(counts)), sizes)
    length = np.minimum(counts, k)[text]
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = np.where(i < length, h * np.uint64(0x9FB21C651E98DF25) + padded[at + i], h)
    turn = np.lexsort((h, text))
    same = np.append(False, (h[turn][1:] == h[turn][:-1]) & (text[turn][1:] == text[turn][:-1]))
    if same.any():
        run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        nth = np.empty(len(h), np.uint64)
        nth[turn] = run.astype(np.uint64)
        h = h + nth * np.uint64(0xA0761D6478BD642F)
    return mix(h), sizes


def sketch(kmers: np.ndarray, sizes: np.ndarray, sketches: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the earlier k-mer), texts x sketches, of texts with k-mers."""
    n = len(sizes)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(n), sizes)
    factors = np.random.default_rng(seed).integers(0, 2**63, sketches, np.uint64) * np.uint64(2) + np.uint64(1)
    keys, places = np.empty((n, sketches), np.uint64), np.empty((n, sketches), np.int32)

    def smallest(h):
        at = np.flatnonzero(h == np.minimum.reduceat(h, begin)[text])
        return at[np.append(True, text[at][1:] != text[at][:-1])]

    for j, f in enumerate(factors):
        h = kmers * f
        one = smallest(h)
        h[one] = TOP
        two = np.where(sizes > 1, smallest(h), one)
        early, late = np.minimum(one, two), np.maximum(one, two)
        keys[:, j] = mix(kmers[early] * np.uint64(0x8EBC6AF09C88C6E3) + kmers[late] + np.uint64(j))
        places[:, j] = early - begin
    return keys, places


def _kinds(counts: np.ndarray, k: int, similarity: float):
    """(k, texts with words) for each kind of k-mers. A text whose partners may be on both sides
    of SHORT has both kinds, so every pair within the limit has one kind in common."""
    if k <= SHORT_K:
        return [(k, np.flatnonzero(counts))]
    return [(SHORT_K, np.flatnonzero((counts > 0) & (counts * similarity <= SHORT + 1e-9))), (k, np.flatnonzero(counts > SHORT))]


def _text_rows(k: int, sketches: int, similarity: float):
    """(row, doc_id, digest, text) in; the text's words (4 bytes each), keys (8) and places (4) out."""
    names = ["row", "doc_id", "digest", "n", "words", "keys", "places"]

    def run(batches):
        hasher = Hasher()
        for b in batches:
            data, offsets = binary(b.column("text"))
            for i, j in blocks(offsets, BLOCK):
                words, counts = word_hashes(data, offsets[i : j + 1], hasher)
                begin = np.cumsum(counts) - counts
                found = np.zeros(j - i, np.int64)
                parts = []
                for size, some in _kinds(counts, k, similarity):
                    if len(some):
                        kmers, sizes = labelled_kmers(words[ragged(begin[some], counts[some])], counts[some], size)
                        parts.append((np.repeat(some, sketches), *(x.ravel() for x in sketch(kmers, sizes, sketches))))
                        found[some] += sketches
                owner, keys, places = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.uint64, np.int32)))
                turn = np.argsort(owner, kind="stable")
                lists = [(words >> np.uint64(32)).astype(np.uint32), keys[turn], places[turn].astype(np.int32)]
                ends = [np.cumsum(c) * x.itemsize for c, x in zip((counts, found, found), lists)]
                yield rows(names, *(b.column(c).slice(i, j - i) for c in names[:3]), counts.astype(np.int32), *(slices(x, np.append(0, e)[:-1], int(e[-1])) for x, e in zip(lists, ends)))

    return frugal(run)


def _allowed(n, p, n2, p2, similarity):
    """Whether the lengths and the places of an equal key leave a link possible."""
    longer = np.maximum(n, n2)
    slack = np.floor((1 - similarity) * longer + 1e-9)
    return (longer - np.minimum(n, n2) <= slack) & (np.abs(p - p2) <= slack)


DEALT = "deal bigint, key bigint, d bigint, nid bigint, n int, p int, lead bigint"


def _deal_rows(similarity: float, hold: int = HOLD, local: int = LOCAL):
    """A row for each key of each text. Of `hold` texts at a time, copies (equal d) go, and a key
    that more than LOCAL of them have is settled here: its first text stands for them as the
    bucket's row (lead = its own nid), the others are sent past the bucket, with lead = the
    first one's nid, or -1 if lengths or places rule that pair out."""

    def settle(parts):
        d, nid, n, sizes, keys, places = (np.concatenate(x) for x in zip(*parts))
        first = np.unique(d, return_index=True)[1]  # in order of d; rows come in order of nid
        begin = np.cumsum(sizes) - sizes
        at = ragged(begin[first], sizes[first])
        own = np.repeat(first, sizes[first])
        key, p = keys[at], places[at]
        turn = np.argsort(key, kind="stable")
        key, p, own = key[turn], p[turn], own[turn]
        opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(opens, len(key)))
        lead = np.repeat(opens, size)
        hot = np.repeat(size > local, size)
        past = hot & (lead != np.arange(len(key)))
        fits = _allowed(n[own], p, n[own[lead]], p[lead], similarity)
        other = np.where(past & ~fits, -1, nid[own[lead]])
        deal = np.where(past, mix(nid[own].astype(np.uint64)).view(np.int64), key)
        for i in range(0, len(key), 1 << 16):
            c = slice(i, i + (1 << 16))
            o = own[c]
            yield rows(["deal", "key", "d", "nid", "n", "p", "lead"], deal[c], key[c], d[o], nid[o], n[o], p[c], pa.array(other[c], mask=~hot[c]))

    def run(batches):
        held, count = [], 0
        for b in batches:
            d, nid, n = (b.column(c).to_numpy() for c in ("d", "nid", "n"))
            keys, off = binary(b.column("keys"))
            places, _ = binary(b.column("places"))
            lo = off[0]
            held.append((d, nid, n, np.diff(off) // 8, np.frombuffer(keys[lo : off[-1]].tobytes(), np.int64), np.frombuffer(places[lo // 2 : off[-1] // 2].tobytes(), np.int32)))
            count += len(d)
            if count >= hold:
                yield from settle(held)
                held, count = [], 0
        if held:
            yield from settle(held)

    return frugal(run)


def _bucket_rows(similarity: float):
    """Rows of _deal_rows sorted by (key, d, nid) in; out: candidate pairs (a < b), with the later
    one in order of d; and as members (b null) the rows of buckets of more than COVERED texts.
    Of a bucket only its first COVERED rows are carried from batch to batch."""
    names = ["a", "b", "late", "key"]

    def pairs(a, b):
        return rows(names, np.minimum(a, b), np.maximum(a, b), b, pa.nulls(len(a), pa.int64()))

    def members(key, nid):
        return rows(names, nid, pa.nulls(len(nid), pa.int64()), pa.nulls(len(nid), pa.int64()), key)

    def run(batches):
        carry, seen, large_before, last = None, 0, False, 0
        for b in batches:
            if not b.num_rows:
                continue
            key, d, nid, n, p = (b.column(c).to_numpy() for c in ("key", "d", "nid", "n", "p"))
            lead = b.column("lead").fill_null(-2).to_numpy()
            past = (lead != -2) & (lead != nid)
            if past.any():
                met = past & (lead >= 0)
                yield pairs(lead[met], nid[met])
                yield members(key[past], nid[past])
                key, d, nid, n, p, lead = (x[~past] for x in (key, d, nid, n, p, lead))
                if not len(key):
                    continue
            skip, hot = 0, lead == nid
            if carry is not None and carry[0][-1] == key[0]:
                skip = len(carry[0])
                key, d, nid, n, p, hot = (np.concatenate([x, y]) for x, y in zip(carry, (key, d, nid, n, p, hot)))
            else:
                seen, large_before = 0, False
            copy = np.append(False, (key[1:] == key[:-1]) & (d[1:] == d[:-1]))
            copy[skip] = skip > 0 and last == d[skip]
            last = d[-1]
            if hot.any():  # the mark of one row, even of a copy, is the bucket's
                bucket = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
                hot = (np.bincount(bucket, hot) > 0)[bucket]
            key, d, nid, n, p, hot = (x[~copy] for x in (key, d, nid, n, p, hot))
            at = np.arange(len(key))
            opens = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(opens)
            size = np.diff(np.append(begin, len(key)))
            first = np.repeat(begin, size)
            rank = at - first
            rank[skip : size[0]] += seen - skip if skip else 0
            fresh = at >= skip
            for back in (None, 1, 2):  # the first row; the two before, among the first COVERED rows
                other = first if back is None else at - back
                ok = fresh & (rank > 0) if back is None else fresh & (rank < COVERED) & (rank > back)
                i, j = other[ok], at[ok]
                fits = _allowed(n[i], p[i], n[j], p[j], similarity)
                if fits.any():
                    yield pairs(nid[i[fits]], nid[j[fits]])
            large = np.maximum.reduceat((rank >= COVERED) | hot, begin)
            large[0] |= large_before
            send = np.repeat(large, size) & (fresh | np.repeat(np.append(not large_before, np.zeros(len(begin) - 1, bool)), size))
            if send.any():
                yield members(key[send], nid[send])
            tail = begin[-1]
            seen, large_before = int(rank[-1]) + 1, bool(large[-1])
            carry = [x[tail : tail + COVERED] for x in (key, d, nid, n, p, hot)]

    return frugal(run)


def _unequal_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences without what they begin and end with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits between two sequences, or most + 1 if there are more.

    Only the 2 * most + 1 diagonals around the main one are computed; a column of that band
    is one integer, whose bits hold the differences between cells one above the other. The
    score runs along the lowest diagonal to the last row and then along that row."""
    a, b = _unequal_ends(a, b)
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, return_indices=True)
    if max(m, n) - int(np.minimum(ca[ia], cb[ib]).sum()) > most:
        return most + 1  # fewer words in common than `most` edits leave
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    top = 2 * most
    ones = (1 << (top + 1)) - 1
    plus, minus = ones & ~((1 << most) - 1), 0
    score, slope = min(m, most), max(m - most, 0)
    for j, x in enumerate(b.tolist(), 1):
        bits, low = where.get(x, 0), j - most - 1
        eq = (bits >> low if low >= 0 else bits << -low) & ones
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diag | plus)
        down = diag & plus
        if j <= slope:
            score += not (diag >> top) & 1
            if score - (n - slope) > most:
                return most + 1
        else:
            row = top - (j + most - m)
            score += ((up >> row) & 1) - ((down >> row) & 1)
        shifted = (diag & ones) >> 1
        plus = (down | ~(shifted | up)) & ones
        minus = shifted & up & ones
    return min(score, most + 1)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    most = int(np.floor((1 - similarity) * max(len(a), len(b)) + 1e-9))
    return banded_distance(a, b, most) <= most


def common_words(texts: list[np.ndarray], dense: int = 32) -> np.ndarray:
    """How many words each two texts have in common, repeats counted: words of more than `dense`
    texts by a matrix product, the others by their pairs."""
    m = len(texts)
    size = np.array([len(t) for t in texts])
    word, text = np.concatenate([*texts, np.zeros(0, np.uint32)]).astype(np.uint64), np.repeat(np.arange(m), size)
    turn = np.lexsort((word, text))
    word, text = word[turn], text[turn]
    at = np.arange(len(word))
    opens = np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))[: len(word)]
    word |= (at - np.maximum.accumulate(np.where(opens, at, 0))).astype(np.uint64) << np.uint64(32)  # the nth of its text
    _, word = np.unique(word, return_inverse=True)
    turn = np.argsort(word, kind="stable")
    word, text = word[turn], text[turn]
    held = np.bincount(word)
    often = held > dense
    column = np.cumsum(often) - 1
    some = often[word]
    out = np.zeros((m, m), np.float32)
    row, col = text[some], column[word[some]]  # in order of col
    for lo in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(col, [lo, lo + COLUMNS])
        table = np.zeros((m, int(col[j - 1]) - lo + 1), np.float32)
        table[row[i:j], col[i:j] - lo] = 1
        out += table @ table.T
    out = out.astype(np.int32).ravel()
    text, word = text[~some], word[~some]
    last = np.cumsum(held * ~often)[word]
    for back in range(1, dense):  # pairs of the rows of one word, by their distance
        first = np.flatnonzero(np.arange(len(text)) + back < last)
        if not len(first):
            break
        out += np.bincount(text[first] * m + text[first + back], minlength=m * m).astype(np.int32)
    return out.reshape(m, m)


def _cell_links(left, right, similarity):
    """Links (a, b) that join different components, of rows (nid, label, n, words) on the left with
    rows on the right, or of all pairs if right is None. Only pairs with enough words in common
    are aligned, and only while no link found here has joined them."""
    nid, label, n, words = left if right is None else [np.concatenate(x) for x in zip(left, right)]
    top = len(left[0])
    if len(np.unique(label)) < 2:
        return nid[:0], nid[:0]
    longer = np.maximum(n[:top, None], n[None, :])
    most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int32)
    ok = (label[:top, None] != label[None, :]) & (longer - np.minimum(n[:top, None], n[None, :]) <= most)
    ok &= np.arange(len(n))[None, :] > (np.arange(top)[:, None] if right is None else top - 1)
    if ok.any():
        ok &= common_words(list(words))[:top] >= longer - most
    parent = {x: x for x in label.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, j in zip(*np.nonzero(ok)):
        x, y = root(int(label[i])), root(int(label[j]))
        if x != y and banded_distance(words[i], words[j], int(most[i, j])) <= most[i, j]:
            parent[max(x, y)] = min(x, y)
            found.append((nid[i], nid[j]))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return np.minimum(a, b), np.maximum(a, b)


def _cell_rows(similarity: float):
    """Rows (lead, i, j, salt, nid, label, words) sorted by cell (lead, i, j) in; links out."""

    def settle(held):
        lead, i, j, salt, nid, label = (np.concatenate([h[c] for h in held]) for c in range(6))
        words = np.empty(len(nid), object)
        words[:] = [w for h in held for w in h[6]]
        n = np.array([len(w) for w in words], np.int32)
        parts = [[x[salt == s] for x in (nid, label, n, words)] for s in ((i[0],) if i[0] == j[0] else (i[0], j[0]))]
        return rows(["a", "b"], *_cell_links(parts[0], parts[1] if len(parts) > 1 else None, similarity))

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("lead", "i", "j", "salt", "nid", "label")]
            cols.append([np.frombuffer(w, np.uint32) for w in batch.column("words").to_pylist()])
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)) + 1
            if held and any(h[-1] != x[0] for h, x in zip(held[-1][:3], cols[:3])):
                yield settle(held)
                held = []
            edges = np.concatenate([[0], new])
            for s, e in zip(edges, np.append(new, len(cols[0]))):
                if s:
                    yield settle(held)
                    held = []
                held.append([x[s:e] for x in cols])
        if held:
            yield settle(held)

    return frugal(run)


def _verify_rows(similarity: float):
    """(a, part, b, words) sorted, the row without b first: its words are compared with the others'."""

    def run(batches):
        lead, mine = None, None
        for batch in batches:
            a, part, b = (batch.column(c).fill_null(0).to_numpy() for c in ("a", "part", "b"))
            data, offsets = binary(batch.column("words"))
            first = ~batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                words = np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), np.uint32)
                if first[i]:
                    lead, mine = (a[i], part[i]), words
                elif lead == (a[i], part[i]):
                    good[i] = similar(mine, words, similarity)
            yield rows(["a", "b"], a[good], b[good])

    return frugal(run)


def _links(pairs: DataFrame, words: DataFrame, scratch: Scratch, name: str, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar. The pairs of one text, if there are more than MEMBERS,
    are dealt out in parts, each with a copy of its words."""
    pairs = scratch.save(pairs.select("a", "b"), f"{name}-pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > MEMBERS)
    many = scratch.save(many.select("a", F.ceil(F.col("m") / MEMBERS).cast("int").alias("parts")), f"{name}-many")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    other = dealt.join(words, dealt.b == words.nid).select("a", "part", "b", "words")
    own = dealt.select("a", "part").distinct().join(words, F.col("a") == words.nid).select("a", "part", F.lit(None).cast("bigint").alias("b"), "words")
    both = own.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = scratch.save(both.mapInArrow(_verify_rows(similarity), "a bigint, b bigint"), name)
    scratch.drop(f"{name}-many")
    return out


def _labelled(df: DataFrame, label: DataFrame, column: str) -> DataFrame:
    """df with the component of a column's node as l<column>; a node without links is its own."""
    known = label.select(F.col("node").alias(column), F.col("label").alias(f"l{column}"))
    return df.join(known, column, "left").withColumn(f"l{column}", F.coalesce(f"l{column}", column))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    return _labelled(_labelled(pairs.select("a", "b"), label, "a"), label, "b").filter("la <> lb").select("a", "b")


def _joined(label: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components of label after more links: those between components are contracted first."""
    between = _labelled(_labelled(links.select("a", "b"), label, "a"), label, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    up = components(between, scratch, name).select(F.col("node").alias("label"), F.col("label").alias("up"))
    moved = label.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    new = up.select(F.col("label").alias("node"), F.col("up").alias("label")).join(label, "node", "left_anti")
    return scratch.save(moved.unionByName(new), f"{name}-all")


def _others(large: DataFrame, label: DataFrame, words: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Links (a, b) between the components of the rows (a, key) of large buckets. Buckets with the
    same smallest row are united, as copies and shared passages fill many buckets alike, and
    dealt out to cells of about CELL rows a side."""
    member = scratch.save(_labelled(large.select("a", "key"), label, "a"), "members")
    mixed = member.groupBy("key").agg(F.min("a").alias("lead"), F.min("la").alias("low"), F.max("la").alias("high")).filter("low <> high")
    mixed = scratch.save(mixed.select("key", "lead"), "mixed")
    united = scratch.save(member.join(mixed, "key").select("lead", "a", "la").distinct(), "united")
    parts = scratch.save(united.groupBy("lead").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")), "parts")
    dealt = united.join(parts, "lead").join(words, F.col("a") == words.nid)
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("a", F.lit(7)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("lead", F.least("salt", "t").alias("i"), F.greatest("salt", "t").alias("j"), "salt", "nid", F.col("la").alias("label"), "words")
    cells = cells.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    return cells.mapInArrow(_cell_rows(similarity), "a bigint, b bigint")


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _members(docs: DataFrame, scratch: Scratch, k: int, sketches: int, similarity: float) -> DataFrame:
    """doc_id, digest, label of each row of docs: rows of one class have the same label."""
    kinds = "row bigint, doc_id bigint, digest binary, n int, words binary, keys binary, places binary"
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.save(source.mapInArrow(_text_rows(k, sketches, similarity), kinds), "texts")
    # copies of a text are one node, the first row's
    slim = texts.select("row", "doc_id", "digest")
    first = scratch.save(slim.groupBy("digest").agg(F.min("row").alias("nid"), F.count("*").alias("m")).filter("m > 1").select("digest", "nid"), "copies")
    slim = scratch.save(slim.join(first, "digest", "left").select("row", "doc_id", "digest", F.coalesce("nid", "row").alias("nid")), "slim")

    keyed = texts.filter("n > 0").select(F.xxhash64("digest").alias("d"), F.col("row").alias("nid"), "n", "keys", "places").mapInArrow(_deal_rows(similarity), DEALT)
    buckets = keyed.repartition("deal").sortWithinPartitions("key", "d", "nid")
    met = scratch.save(buckets.mapInArrow(_bucket_rows(similarity), "a bigint, b bigint, late bigint, key bigint"), "met")
    pairs = scratch.save(met.filter("b is not null").groupBy("a", "b").agg(F.max("late").alias("late"), F.count("*").alias("m")), "pairs")
    large = met.filter("b is null")
    nodes = scratch.save(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).union(large.select("a")).distinct(), "nodes")
    # in buckets, as three joins meet the words; never broadcast: what meets them grows with the input
    sweep(docs.sparkSession)
    words = scratch.save_bucketed(texts.select(F.col("row").alias("nid"), "words"), nodes, "words", "nid").hint("merge")
    # a copy that was settled beside its bucket is a node of its own: it is linked unseen
    same = slim.filter("row <> nid").join(nodes.select(F.col("nid").alias("row")), "row", "left_semi").select(F.col("nid").alias("a"), F.col("row").alias("b"))
    scratch.drop("texts")

    # each text with the one before it in order of d that it shares most keys with
    best = pairs.groupBy("late").agg(F.max(F.struct("m", "a", "b")).alias("x")).select("x.a", "x.b")
    links = _links(best, words, scratch, "best", similarity)
    label = components(links.unionByName(same), scratch, "label-best")
    # pairs that these leave apart
    tried = scratch.load("best-pairs")
    links = _links(_apart(pairs, label).join(tried, ["a", "b"], "left_anti"), words, scratch, "more", similarity)
    label = _joined(label, links, scratch, "label-more")
    # whatever is still apart in a large bucket
    links = scratch.save(_others(large, label, words, scratch, similarity), "others")
    label = _joined(label, links, scratch, "label-others")
    for name in ("met", "pairs", "nodes", "words", "members", "mixed", "united", "parts", "best-pairs", "more-pairs"):
        scratch.drop(name)
    out = slim.join(label, slim.nid == label.node, "left").select("doc_id", "digest", F.coalesce("label", "nid").alias("label"))
    return scratch.save(out, "out")


def classes(docs: DataFrame, k: int = K, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest (MD5 of the text), class_id, class_size of each row of docs (doc_id, text).

    class_id is the smallest doc_id of the class; class_size counts its rows. A null text is
    empty; texts without words are near-duplicates of exact copies only, texts of fewer
    than k words are one k-mer. Repeated rows stay. Rows without doc_id belong to their
    class like others, and class_id is null if no row of it has one. Other columns take no
    part; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "omh")
    member = _members(docs, scratch, k, sketches, similarity)
    size = scratch.save(member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "size")
    return member.join(size, "label").select("doc_id", "digest", "class_id", "class_size")


def keep_one(docs: DataFrame, k: int = K, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of docs with one row of each class: that with the smallest doc_id (null comes last),
    of several texts with it the one of the smallest digest, of repeated rows any one.

    All columns of docs are passed on, whatever their names. Null and empty texts are copies
    of each other, so one of their rows stays; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "omh")
    member = _members(docs, scratch, k, sketches, similarity)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "m")
    row = member.groupBy("label", "doc_id", "digest").agg(F.count("*").alias("m"))
    own, id_, digest, m = free_names(docs.columns, "_own", "_id", "_digest", "_m")
    kept = row.groupBy("label").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias(id_), F.col("x.digest").alias(digest), F.col("x.m").alias(m))
    kept = scratch.save(kept, "kept")
    marked = docs.withColumn(own, _digest(F.col("text")))
    chosen = lambda which: marked.join(kept.filter(which), F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest)), "left_semi")
    repeated = chosen(F.col(m) > 1).dropDuplicates(["doc_id", own])
    return chosen(F.col(m) == 1).unionByName(repeated).drop(own)
