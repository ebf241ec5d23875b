"""Suffix-array dedup: text of `length` bytes that also starts somewhere else.

Sorting every suffix of the corpus is not needed to find matches of `length` bytes. Of
each window of that length, the k-byte string with the smallest hash is its anchor, so
equal windows have equal anchors at equal offsets, and each window belongs to one anchor.
Only suffixes around anchors that occur twice are sorted:

1. anchors of every document (about 2 of each length - k + 2 positions), counted;
2. the bytes around repeated anchors, gathered by anchor;
3. per anchor and per number o of bytes before it: the suffix order of the windows that
   begin there, from one order of the bytes to the right and one of those to the left, its
   LCPs, and the longest-previous-factor array by previous and next smaller text positions.
   A window is a later copy if its LPF reaches `length`; with text positions negated the
   same array tells which windows have a later copy;
4. intervals joined back to their document.

An anchor of more than `group_rows` places is taken apart first. Each place is compared
byte by byte with the first one in the text: windows equal to one of it are settled so.
Every other window holds the first unequal byte to the right or to the left of the anchor,
and so do its equals, at the same distance: places go on in groups by that distance and
byte, with the windows concerned, until the groups are small.

Rows of docs are numbered once, in a written table. Text order is (doc_id with null last,
row, position). Copies of a whole text are settled by their digest: one of them stands for
all in the steps above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary, blocks, free_names, frugal, mix, ragged, rows, slices

K = 64
#: Places of an anchor that one task sorts; more are taken apart first.
GROUP_ROWS = 8192
#: Rows whose words are coded at once.
CODE_ROWS = 512
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
INTERVAL = "rid bigint, start bigint, stop bigint"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of all strings of one length in a buffer, from prefix sums modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            self.up, self.down = _powers(BASE, len(data) + 1), _powers(BASE_INV, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return sums

    def windows(self, data: np.ndarray, k: int) -> np.ndarray:
        n = len(data) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = self.prefix(data)
        return mix((sums[k:] - sums[:n]) * self.down[:n])

    def at(self, sums: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        return mix((sums[starts + k] - sums[starts]) * self.down[starts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: one running minimum from each side of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int, hasher: Hasher):
    """(row, position in the row, hash) of the leftmost smallest k-string of each window, and how
    far before it the first and the last of its windows begin."""
    w = length - k + 1
    base = int(offsets[0])
    text = data[base : int(offsets[-1])]
    sizes = np.diff(offsets)
    h = hasher.windows(text, k)
    none = np.zeros(0, np.int64)
    if len(h) < w:
        return none, none, np.zeros(0, np.uint64), none, none
    low = np.uint64(0xFFFFFFFF)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w)
    starts = ragged(offsets[:-1] - base, np.maximum(sizes - length + 1, 0))
    picked = (least[starts] & low).astype(np.int64)
    opens = np.append(True, picked[1:] != picked[:-1])[: len(picked)]  # argmins never go back inside a document
    closes = np.append(picked[1:] != picked[:-1], True)[: len(picked)]
    most, least_ = picked[opens] - starts[opens], picked[closes] - starts[closes]
    picked = picked[opens]
    row = np.searchsorted(offsets - base, picked, "right") - 1
    return row, picked - (offsets[row] - base), h[picked], most, least_


def periodic(text: np.ndarray, pos: np.ndarray, h: np.ndarray, length: int):
    """Runs of a document that repeat themselves at a short distance.

    Returns (mask of anchors that are still needed, [(start, stop, period)]): every window
    inside start..stop has an equal one a period away, and those in the first period keep
    their anchors, so the others need none."""
    keep, runs = np.ones(len(pos), bool), []
    if len(pos) < 5:
        return keep, runs
    gap = np.diff(pos)
    chain = np.append((h[1:] == h[:-1])[:-1] & (h[2:] == h[1:-1]) & (gap[1:] == gap[:-1]), False)
    i, n = 0, len(chain)
    while i < n:
        if not chain[i]:
            i += 1
            continue
        j = i
        while j < n and chain[j]:
            j += 1
        first, last, period = int(pos[i]), int(pos[j + 1]), int(gap[i])
        same = text[:-period] == text[period:]
        if j - i >= 3 and same[first : last - period].all():
            before = np.flatnonzero(~same[:first])
            after = np.flatnonzero(~same[last - period :])
            start = int(before[-1]) + 1 if len(before) else 0
            stop = (last - period + int(after[0]) if len(after) else len(same)) + period
            if stop - start - period >= length:
                runs.append((start, stop, period))
                keep[i + 2 : j + 2] = pos[i + 2 : j + 2] + length > stop
        i = j + 1
    return keep, runs


def _made(batches, code):
    """Batches as code makes them, a few rows at a time; as they are without it."""
    for b in batches:
        step = CODE_ROWS if code else max(1, b.num_rows)
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            yield code(part) if code else part


def _anchor_rows(length: int, k: int, first_stays: bool, code=None):
    def run(batches):
        hasher = Hasher()
        for b in _made(batches, code):
            rid = b.column("rid").to_numpy()
            data, offsets = binary(b.column("text"))
            for i, j in blocks(offsets):
                off = offsets[i : j + 1]
                row, pos, h, far, close = anchors(data, off, length, k, hasher)
                keep, found = np.ones(len(row), bool), []
                edges = np.searchsorted(row, np.arange(j - i + 1))
                same = np.append(h[1:] == h[:-1], False)
                for r in np.unique(row[same]) if same.any() else ():
                    lo, hi = edges[r], edges[r + 1]
                    keep[lo:hi], runs = periodic(data[off[r] : off[r + 1]], pos[lo:hi], h[lo:hi], length)
                    found += [(rid[i + r], s + first_stays * p, e) for s, e, p in runs]
                row, pos, h, far, close = (x[keep] for x in (row, pos, h, far, close))
                yield rows(["rid", "pos", "h", "far", "close", "stop"], rid[i + row], pos, h.view(np.int64), far.astype(np.int32), close.astype(np.int32), pa.nulls(len(row), pa.int64()))
                if found:
                    a = np.array(found, np.int64)
                    none = (pa.nulls(len(a), kind) for kind in (pa.int64(), pa.int32(), pa.int32()))
                    yield rows(["rid", "pos", "h", "far", "close", "stop"], a[:, 0], a[:, 1], *none, a[:, 2])

    return frugal(run)


CONTEXT = "h bigint, rid bigint, key bigint, pos bigint, left int, ctx binary"


def _context_rows(length: int, code=None):
    """The bytes around each listed anchor of a document that its own windows cover."""

    def run(batches):
        for b in _made(batches, code):
            rid, key = b.column("rid").to_numpy(), b.column("key")
            data, offsets = binary(b.column("text"))
            lists = b.column("marks")
            off = lists.offsets.to_numpy()
            pos, h, far, close = (lists.values.field(c).to_numpy() for c in ("pos", "h", "far", "close"))
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            pos, h, far, close = (x[off[0] : off[-1]] for x in (pos, h, far, close))
            for a in range(0, len(row), 2048):
                r, p = row[a : a + 2048], pos[a : a + 2048]
                at = offsets[r] + p
                left = far[a : a + 2048].astype(np.int64)
                size = left + length - close[a : a + 2048]
                ctx = data[ragged(at - left, size)]
                ends = np.cumsum(size)
                yield rows(["h", "rid", "key", "pos", "left", "ctx"], h[a : a + 2048], rid[r], key.take(pa.array(r)), p, left.astype(np.int32), slices(ctx, ends - size, int(ends[-1])))

    return frugal(run)


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def _split_rows(length: int, first_stays: bool):
    """Places of groups, each beside the group's first place, in; intervals (start, stop) and
    places of smaller groups (ctx) out."""

    def child(h, side, at, byte):
        x = np.array([np.uint64(h & 0xFFFFFFFFFFFFFFFF) ^ np.uint64((side << 40) | (at << 8) | byte)], np.uint64)
        return int((mix(x) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)[0])

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("h", "rid", "key", "pos", "left", "ctx", "start", "stop")}

            def put(**values):
                for c, column in out.items():
                    column.append(values.get(c))

            for r in b.to_pylist():
                left, ctx, left0, ctx0 = r["left"], r["ctx"], r["left0"], r["ctx0"]
                before, after = ctx[:left][::-1], ctx[left:]
                low, high = length - len(after), left  # offsets of the place's own windows
                if (r["rid"], r["pos"]) == (r["rid0"], r["pos0"]):
                    continue
                same_l, same_r = _agree(before, ctx0[:left0][::-1]), _agree(after, ctx0[left0:])
                a, z = max(low, length - same_r), min(high, same_l)
                if a <= z:
                    put(rid=r["rid"], start=r["pos"] - z, stop=r["pos"] - a + length)
                    if not first_stays:
                        put(rid=r["rid0"], start=r["pos0"] - z, stop=r["pos0"] - a + length)
                place = {c: r[c] for c in ("rid", "key", "pos")}
                a, z = low, min(high, length - same_r - 1)
                if a <= z:
                    put(**place, h=child(r["h"], 1, same_r, after[same_r]), left=z, ctx=ctx[left - z : left + length - a])
                a, z = max(low, length - same_r, same_l + 1), high
                if a <= z:
                    put(**place, h=child(r["h"], 2, same_l, before[same_l]), left=z, ctx=ctx[left - z : left + length - a])
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()] + [pa.int64()] * 2
            yield rows(list(out), *(pa.array(c, k) for c, k in zip(out.values(), kinds)))

    return frugal(run)


def longest_previous(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest-previous-factor array in suffix order, from the text position of each suffix and
    its LCP with its predecessor (the first one's counts as 0).

    A suffix agrees longest with an earlier one at its previous or at its next smaller
    position. Both are found for all suffixes at once, by jumps over larger positions."""
    n = len(rank)
    best = np.zeros(n, np.int64)
    for back in (False, True):
        at = rank[::-1] if back else rank
        low = np.append(0, lcp[:0:-1] if back else lcp[1:]).astype(np.int64)[:n]
        smaller = np.arange(n) - 1
        while len(go := np.flatnonzero((low > 0) & (at[smaller] >= at))):  # low is 0 where there is none
            over = smaller[go]
            low[go] = np.minimum(low[go], low[over])
            smaller[go] = smaller[over]
        best = np.maximum(best, low[::-1] if back else low)
    return best


class RangeMin:
    """Minima of ranges of an array, from those of its stretches of 1, 2, 4, ..."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            y, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(y[:-half], y[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of x[first..last], both included."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp(last - first + 1)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out


def _boundaries(order: np.ndarray, group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """LCP of each member with its predecessor in an order; -1 where a group begins."""
    if not len(order):
        return np.zeros(0, np.int32)
    differ = side[order[1:]] != side[order[:-1]]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1]).astype(np.int32)
    lcp[group[order[1:]] != group[order[:-1]]] = -1
    return np.append(np.int32(-1), lcp)


def equal_windows(group, left, left_size, right, right_size, rank, length: int, first_stays: bool):
    """For members of anchor groups: flags[member, o] says whether the window that begins o bytes
    before the anchor is removed. rank is the members' order in the text."""
    n, w = left.shape
    flags = np.zeros((n, w + 1), bool)

    def order(side):
        text = np.ascontiguousarray(side).view(f"S{side.shape[1]}").ravel()
        by_text = np.argsort(text, kind="stable")
        return by_text[np.argsort(group[by_text], kind="stable")]

    by_right, by_left = order(right), order(left)
    lcp_right, lcp_left = _boundaries(by_right, group, right), _boundaries(by_left, group, left)
    least = RangeMin(lcp_right)
    place, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    place[by_right] = np.arange(n)
    alive = by_right  # in order of the bytes to the right
    for o in range(w + 1):
        class_l[by_left] = np.cumsum(lcp_left < o)
        if o % 8 == 0:  # alone on the left side: no match at this or a larger offset
            alive = alive[np.bincount(class_l[alive], minlength=1)[class_l[alive]] > 1]
        if not len(alive):
            break
        live = alive[(left_size[alive] >= o) & (right_size[alive] >= length - o)]
        if len(live) < 2:
            continue
        # suffixes from o bytes before the anchor: by these bytes, then by those from the anchor on
        live = live[np.argsort(class_l[live], kind="stable")]
        same = np.flatnonzero(class_l[live[1:]] == class_l[live[:-1]]) + 1
        lcp = np.zeros(len(live), np.int64)
        lcp[same] = o + least(place[live[same - 1]] + 1, place[live[same]])
        lcp[lcp < length] = 0  # LPF counts from `length` on
        some = lcp > 0
        some[:-1] |= lcp[1:] > 0
        live, lcp = live[some], lcp[some]
        if not len(live):
            continue
        at = rank[live]
        longest = longest_previous(at, lcp)
        if not first_stays:
            longest = np.maximum(longest, longest_previous(-at, lcp))
        flags[live, o] = longest >= length
    return flags


def _spans(flags: np.ndarray):
    """(row, first, last) of the runs of True in each row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, first, after - 1


def _group_rows(length: int, k: int, first_stays: bool, most: int = 8192):
    """Contexts, sorted by group, in; intervals out."""
    w = length - k

    def settle(t: pa.Table):
        t = t.combine_chunks()
        n = t.num_rows
        h, rid, pos = (t.column(c).to_numpy() for c in ("h", "rid", "pos"))
        key = t.column("key")
        turn = np.lexsort((pos, rid, key.fill_null(0).to_numpy(), ~key.is_valid().to_numpy()))
        _, group = np.unique(h, return_inverse=True)
        # a place that two groups with one hash hold is no copy of itself
        rank = np.cumsum(np.append(False, (np.diff(pos[turn]) != 0) | (np.diff(rid[turn]) != 0)))
        data, offsets = binary(t.column("ctx"))
        offsets, size = offsets[:-1][turn], np.diff(offsets)[turn]
        left_size = t.column("left").to_numpy().astype(np.int64)[turn]
        right_size = size - left_size
        rid, pos, group = (x[turn] for x in (rid, pos, group))
        left, right = np.zeros((n, w), np.uint8), np.zeros((n, length), np.uint8)
        for i in range(n):
            at = offsets[i] + left_size[i]
            left[i, : left_size[i]] = data[offsets[i] : at][::-1]
            right[i, : right_size[i]] = data[at : offsets[i] + size[i]]
        row, first, last = _spans(equal_windows(group, left, left_size, right, right_size, rank, length, first_stays))
        return rows(["rid", "start", "stop"], rid[row], pos[row] - last, pos[row] - first + length)

    def run(batches):
        held, count, last = [], 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            if count >= most:  # close at the end of a group
                other = np.flatnonzero(t.column("h").to_numpy() != last)
                cut = int(other[0]) if len(other) else t.num_rows
                held.append(t.slice(0, cut))
                t = t.slice(cut)
                if t.num_rows:
                    yield settle(pa.concat_tables(held))
                    held, count = [], 0
            if t.num_rows:
                held.append(t)
                count += t.num_rows
                last = t.column("h")[-1].as_py()
        if held:
            yield settle(pa.concat_tables(held))

    return frugal(run)


def _taken_apart(places: DataFrame, scratch: Scratch, length: int, first_stays: bool, group_rows: int):
    """(places of groups of at most group_rows, [intervals]) of the places of larger groups."""
    order = F.struct(F.col("key").isNull(), "key", "rid", "pos", "left", "ctx")
    small, found, turn = [], [], 0
    while places.limit(1).count():
        first = places.groupBy("h").agg(F.min(order).alias("x")).select("h", F.col("x.rid").alias("rid0"), F.col("x.pos").alias("pos0"), F.col("x.left").alias("left0"), F.col("x.ctx").alias("ctx0"))
        first = scratch.save(first, f"first-{turn}")
        beside = places.join(first, "h").select("h", "rid", "key", "pos", "left", "ctx", "rid0", "pos0", "left0", "ctx0")
        split = scratch.save(beside.mapInArrow(_split_rows(length, first_stays), f"{CONTEXT}, start bigint, stop bigint"), f"split-{turn}")
        found.append(split.filter("ctx is null").select("rid", "start", "stop").distinct())
        rest = split.filter("ctx is not null").drop("start", "stop")
        size = scratch.save(rest.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), f"size-{turn}")
        rest = rest.join(size, "h")
        small.append(rest.filter(F.col("m") <= group_rows).drop("m"))
        scratch.drop(f"large-{turn}")
        turn += 1
        places = scratch.save(rest.filter(F.col("m") > group_rows).drop("m"), f"large-{turn}")
    return small, found


def repeated_intervals(docs: DataFrame, scratch: Scratch, length: int = 400, keep: str = "first", k: int = K, group_rows: int = GROUP_ROWS, code=None) -> DataFrame:
    """rid, start, stop: the parts of the texts of docs (rid, key, text) that go. They may overlap,
    and pass the end of a text that is a copy as a whole. rid is unique, and docs a written
    table. With code, a function of batches, the bytes are those that it makes of the texts."""
    if not 1 <= k < length or keep not in ("first", "none"):
        raise ValueError("k must be below length; keep is 'first' or 'none'")
    first_stays = keep == "first"
    if code is None:
        docs = docs.filter(F.octet_length("text") >= length)
    # copies of whole texts: the first in text order stands for all
    slim = scratch.save(docs.select("rid", "key", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.octet_length("text").cast("bigint").alias("size")).filter("size > 0"), "slim")
    order = F.struct(F.col("key").isNull(), "key", "rid")
    lead = slim.groupBy("digest").agg(F.min(order).alias("lead"), F.count("*").alias("copies")).filter("copies > 1").select("digest", F.col("lead.rid").alias("lead_rid"))
    copied = scratch.save(slim.join(scratch.save(lead, "lead"), "digest").select("rid", "lead_rid", "size", F.lit(1 << 60).alias("most")), "copied")
    others = copied.filter("rid <> lead_rid").select("rid")
    whole = copied.filter("rid <> lead_rid") if first_stays else copied
    whole = whole.select("rid", F.lit(0).cast("bigint").alias("start"), F.col("size" if code is None else "most").alias("stop"))

    found = scratch.save(docs.select("rid", "text").mapInArrow(_anchor_rows(length, k, first_stays, code), "rid bigint, pos bigint, h bigint, far int, close int, stop bigint"), "anchors")
    marks = found.filter("h is not null").join(others, "rid", "left_anti")
    counts = scratch.save(marks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    lists = marks.join(counts.select("h"), "h", "left_semi").groupBy("rid").agg(F.collect_set(F.struct("pos", "h", "far", "close")).alias("marks"))
    lists = scratch.save(lists, "lists")
    local = scratch.save(found.filter("h is null").select("rid", F.col("pos").alias("start"), "stop"), "local")
    scratch.drop("anchors")
    # by shuffle at every size: the lists grow with the input
    around = docs.hint("merge").join(lists, "rid").select("rid", "key", "text", "marks").mapInArrow(_context_rows(length, code), CONTEXT)
    many = counts.filter(F.col("n") > group_rows).select("h", F.lit(True).alias("many"))
    places, cut = around, []
    if many.limit(1).count():
        around = scratch.save(around.join(many, "h", "left"), "around")
        small, cut = _taken_apart(around.filter("many").drop("many"), scratch, length, first_stays, group_rows)
        places = around.filter("many is null").drop("many")
        for part in small:
            places = places.unionByName(part)
    grouped = places.repartition("h").sortWithinPartitions("h")
    settled = scratch.save(grouped.mapInArrow(_group_rows(length, k, first_stays), INTERVAL), "settled")
    scratch.drop("around")
    scratch.drop("lists")
    for part in (whole, local, *cut):
        settled = settled.unionByName(part)
    return settled


def merge(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by intervals."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(stops[i])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@frugal
def _cut(batches):
    """Kept bytes and removed runs of each text; text and spans are the last columns."""
    for b in batches:
        m = b.num_columns - 2
        data, offsets = binary(b.column(m))
        lists = b.column(m + 1)
        off = lists.offsets.to_numpy()
        starts, stops = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
        kept, spans = [], []
        has = lists.is_valid().to_numpy(zero_copy_only=False)
        for i in range(b.num_rows):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            runs = merge(starts[off[i] : off[i + 1]], stops[off[i] : off[i + 1]]) if has[i] else []
            edges = [0, *(x for r in runs for x in r), len(text)]
            kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2])) if runs else text)
            spans.append([{"start": s, "stop": e} for s, e in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(kept, pa.binary()), pa.array(spans, kind)], [*b.schema.names[:m], "kept", "removed"])


def _spans_by_row(cuts: DataFrame, scratch: Scratch, rid: str) -> DataFrame:
    out = scratch.save(cuts.groupBy(F.col("rid").alias(rid)).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "cuts")
    for name in ("settled", "local", "copied", "slim", "lead"):
        scratch.drop(name)
    return out


def suffix_dedup(docs: DataFrame, length: int = 400, keep: str = "first", k: int = K, group_rows: int = GROUP_ROWS, columns: list[str] = ()) -> DataFrame:
    """doc_id, n_bytes, kept (binary), removed (array of start, stop byte offsets), columns.

    keep="first" removes later copies of a repeated passage; "none" removes all of them.
    A null text is empty. Repeated rows are copies of each other like any two documents. A
    null doc_id comes last in text order. Texts shorter than length are kept whole; an
    empty table gives an empty result. Other columns of docs take no part; those named in
    `columns` are passed on, with an underscore behind names that the result has already.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col("text"), F.lit(""))
    inner = [f"c{i}" for i in range(len(columns))]
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("key"), text.alias("text"), *(F.col(f"`{c}`").alias(x) for c, x in zip(columns, inner)))
    base = scratch.save(base, "base")
    cuts = _spans_by_row(repeated_intervals(base.select("rid", "key", "text"), scratch, length, keep, k, group_rows), scratch, "rid")
    joined = base.join(cuts, "rid", "left").select(F.col("key").alias("doc_id"), F.octet_length("text").cast("bigint").alias("n_bytes"), *inner, "text", "spans")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.select(*inner).schema) if inner else ""
    out = joined.mapInArrow(_cut, f"doc_id bigint, n_bytes bigint, {kinds}kept binary, removed array<struct<start: bigint, stop: bigint>>")
    own = ["doc_id", "n_bytes", "kept", "removed"]
    return out.select(*own, *inner).toDF(*own, *free_names(own, *columns))


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes), text (what is left; a
    character that was cut in two is replaced) of suffix_dedup()'s rows."""
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text)


def brute_force(texts: list[bytes], length: int, keep: str) -> list[tuple[bytes, int]]:
    """Kept bytes and number of removed runs, by comparing every window; for tests."""
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((d, p))
    gone = [np.zeros(len(t) + 2, bool) for t in texts]
    for places in seen.values():
        for d, p in places[keep == "first" :] if len(places) > 1 else ():
            gone[d][p + 1 : p + 1 + length] = True
    return [(np.frombuffer(t, np.uint8)[~g[1:-1]].tobytes(), int((np.diff(g.astype(int)) == 1).sum())) for t, g in zip(texts, gone)]



#: Bytes that stand for a word in passages counted in words.
WORD_BYTES = 8


def _words(text: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(starts, 64-bit hashes) of the words between white space."""
    full = np.pad(~_BLANK[text], 1)
    edge = np.diff(full.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = hasher.prefix(text)
    return starts, mix((sums[ends] - sums[starts]) * hasher.down[starts] + (ends - starts).astype(np.uint64))


def _coded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with each word of the column text as WORD_BYTES bytes, its hash."""
    hasher = Hasher()
    data, offsets = binary(batch.column("text"))
    coded = [_words(data[s:e], hasher)[1].tobytes() for s, e in zip(offsets, offsets[1:])]
    return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(coded, pa.binary()))


@frugal
def _without_words(batches):
    """Texts (third from the end) without the words that spans (second; byte offsets in coded words)
    cover, and the white space after them; the last column tells which texts were cut."""
    hasher = Hasher()
    for b in batches:
        m = b.num_columns - 2
        data, offsets = binary(b.column(m))
        lists = b.column(m + 1)
        off = lists.offsets.to_numpy()
        starts, stops = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
        # part of a word at the end of a match is chance, not a repeated word
        starts, stops = -(-starts // WORD_BYTES), stops // WORD_BYTES
        out = b.column(m).to_pylist()
        cut = np.diff(off) > 0
        for i in np.flatnonzero(cut):
            text = data[offsets[i] : offsets[i + 1]]
            edges = np.append(_words(text, hasher)[0], len(text))
            raw, kept, last, most = text.tobytes(), [], 0, len(edges) - 1
            for s, e in merge(starts[off[i] : off[i + 1]], stops[off[i] : off[i + 1]]):
                kept.append(raw[last : edges[min(s, most)]])
                last = edges[min(e, most)]
            out[i] = b"".join([*kept, raw[last:]]).decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(out, pa.string()), pa.array(cut)], [*b.schema.names[:m], "text", "cut"])


def without_repeats(docs: DataFrame, words: int = 51, k: int = K, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs with later copies of passages of `words` words cut from the column text, whatever their
    length in bytes and the white space between them; n_chars, if there is one, follows. Rows of
    which only white space is left go; rows that had no more before stay as they are.

    Null and short texts stay as they are, repeated rows are copies like any others, a null
    doc_id comes last in text order, and all columns are passed on whatever their names; an
    empty table gives an empty result. The suffix orders are those of the texts' words, each
    coded as WORD_BYTES bytes."""
    scratch = Scratch(docs.sparkSession, "repeats")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    base = scratch.save(docs.toDF(*inner).withColumn("rid", F.monotonically_increasing_id()), "base")
    where = {c.lower(): x for c, x in zip(docs.columns, inner)}
    text, doc_id, size = F.col(where["text"]), F.col(where["doc_id"]).cast("bigint"), where.get("n_chars")
    texts = base.select("rid", doc_id.alias("key"), text.alias("text")).filter(F.octet_length("text") >= 2 * words - 1)
    cuts = _spans_by_row(repeated_intervals(texts, scratch, words * WORD_BYTES, "first", k, group_rows, _coded), scratch, "rid")
    spans = F.coalesce("spans", F.array().cast("array<struct<start: bigint, stop: bigint>>")).alias("spans")
    rest = [x for x in inner if x != where["text"]]
    joined = base.join(cuts, "rid", "left").select(*rest, text.alias("text"), spans)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in joined.select(*rest).schema)
    out = joined.mapInArrow(_without_words, f"{kinds}text string, cut boolean").filter("not cut or trim(text) <> ''").withColumnRenamed("text", where["text"])
    if size:
        out = out.withColumn(size, F.when(F.col("cut"), F.length(where["text"])).otherwise(F.col(size)).cast(base.schema[size].dataType))
    return out.select(*inner).toDF(*docs.columns)
