"""SentencePiece encoding and decoding by shortest paths of a weighted transducer.

The transducer reads bytes. Its lexicon is a trie of the pieces in which the normaliser is
already composed (a space stands for the word mark, which begins every non-empty text),
with the negated score of a piece as its weight; a character that no piece spells alone
has an arc of the model's lowest score less 10, which writes its byte pieces. Composed
with an input this gives an acyclic graph over its positions, and the best segmentation is
the shortest path in the tropical semiring (min, +), found from left to right. On equal
weights the path that enters a position from further left wins.

No piece goes on behind the end of a word, so words are independent components of the
graph: each distinct one is composed once, many side by side in numpy.

Weights are those in the model file, added in double precision. For a unigram model the
ids are SentencePiece's own. A BPE model's scores are its merge ranks; here they are weights like any others, so the
ids are those of the same pieces declared as unigram model, not those of the merges.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import binary, blocks, frugal, ragged
from .words import WordCoder, list_array, per_row

MARK = "▁"
SPACE, NEWLINE = 0x20, 0x0A
#: Fixed value: what an unknown character costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0
BLOCK = 4 << 20


class Transducer:
    """Lexicon, weights and byte fallback of a model file."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise NotImplementedError("only identity normalisers without white-space removal")
        if any(p.type == kind.Value("USER_DEFINED") for p in proto.pieces):
            raise NotImplementedError("user-defined pieces")
        self.prefix = norm.add_dummy_prefix
        self.byte_id = np.full(256, -1, np.int32)
        pieces: dict[int, bytes] = {}
        self.weight = np.zeros(len(proto.pieces))
        self.out: list[bytes] = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.Value("BYTE"):
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.Value("UNKNOWN"):
                self.unknown_id = i
            elif p.type == kind.Value("NORMAL"):
                if MARK in p.piece.lstrip(MARK):
                    raise NotImplementedError("pieces across words")
                pieces[i] = self.out[i] = p.piece.replace(MARK, " ").encode()
                self.weight[i] = -p.score
        self.fallback = bool((self.byte_id >= 0).all())
        self.unknown_weight = max(self.weight[list(pieces)]) + UNKNOWN_PENALTY
        self._compile(pieces)
        self.out_size = np.array([len(b) for b in self.out], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)

    def _compile(self, pieces: dict[int, bytes]) -> None:
        """Dense transitions: step[state, class of byte], 0 where there is none; 1 is the start."""
        used = sorted({b for p in pieces.values() for b in p})
        self.klass = np.zeros(256, np.int32)
        self.klass[used] = np.arange(1, len(used) + 1)
        ids, table = {b"": 1}, []
        accept = {}
        for i, p in pieces.items():
            for n in range(1, len(p) + 1):
                if p[:n] not in ids:
                    ids[p[:n]] = len(ids) + 1
                    table.append((ids[p[: n - 1]], self.klass[p[n - 1]], ids[p[:n]]))
            accept[ids[p]] = i
        self.step = np.zeros((len(ids) + 1, len(used) + 1), np.int32)
        a = np.array(table, np.int64)
        self.step[a[:, 0], a[:, 1]] = a[:, 2]
        self.accept = np.full(len(ids) + 1, -1, np.int32)
        self.accept[list(accept)] = list(accept.values())

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per word) of the shortest paths."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 8192 and (j - i + 1) * sizes[order[j]] <= 1 << 20 and sizes[order[j]] <= sizes[order[i]] + 2:
                j += 1
            found.append(self._paths([words[k] for k in order[i:j]], sizes[order[i:j]]))
            i = j
        counts = np.zeros(len(words), np.int64)
        counts[order] = np.concatenate([c for _, c in found])
        flat = np.concatenate([ids for ids, _ in found])
        begins = np.cumsum(counts[order]) - counts[order]
        back = np.empty(len(words), np.int64)
        back[order] = begins
        return flat[ragged(back, counts)], counts

    def _paths(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(words), int(size.max())
        text = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(n, most)
        klass = self.klass[text]
        cost = np.full((n, most + 1), np.inf)
        cost[:, 0] = 0
        came, piece = np.zeros((n, most + 1), np.int32), np.full((n, most + 1), -1, np.int32)
        wide = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        begins = (text & 0xC0) != 0x80
        for i in range(most):
            live = np.flatnonzero(begins[:, i] & (size > i) & np.isfinite(cost[:, i]))
            if not len(live):
                continue
            here = cost[:, i]
            char = np.minimum(wide[live, i], size[live] - i)
            lone = np.zeros(n, bool)
            row, state, at = live, np.ones(len(live), np.int32), i
            while len(row) and at < most:
                state = self.step[state, klass[row, at]]
                keep = (state > 0) & (size[row] > at)
                row, state = row[keep], state[keep]
                at += 1
                id_ = self.accept[state]
                ends = id_ >= 0
                r, p = row[ends], id_[ends]
                c = here[r] + self.weight[p]
                better = c < cost[r, at]
                r, p = r[better], p[better]
                cost[r, at], came[r, at], piece[r, at] = c[better], i, p
                lone[row[ends]] |= wide[row[ends], i] == at - i
            odd = ~lone[live]
            r, to = live[odd], i + char[odd]
            c = here[r] + self.unknown_weight
            better = c < cost[r, to]
            r, to = r[better], to[better]
            cost[r, to], came[r, to], piece[r, to] = c[better], i, -1
        # back from the end of each word; an unknown character becomes its bytes
        row, at, trail = np.arange(n), size.copy(), []
        while len(row):
            trail.append((row, came[row, at], at, piece[row, at]))
            at = came[row, at].astype(np.int64)
            row, at = row[at > 0], at[at > 0]
        row, start, stop, id_ = (np.concatenate([t[k] for t in trail[::-1]]) for k in range(4))
        turn = np.argsort(row, kind="stable")
        row, start, stop, id_ = row[turn], start[turn].astype(np.int64), stop[turn], id_[turn]
        width = np.where((id_ < 0) & self.fallback, stop - start, 1)
        ids = np.repeat(id_, width)
        unknown = ids < 0
        if self.fallback:
            flat = text[np.repeat(row, width), ragged(start, width)]
            ids[unknown] = self.byte_id[flat[unknown]]
        else:
            ids[unknown] = self.unknown_id
        return ids, np.bincount(row, width, n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of id lists; the mark in front of a text is dropped."""
        size = self.out_size[ids]
        flat = self.out_bytes[ragged(self.out_start[ids], size)]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        if not self.prefix:
            return flat, ends
        first = ends[:-1][counts > 0]
        first = first[flat[first] == SPACE]
        keep = np.ones(len(flat), bool)
        keep[first] = False
        return flat[keep], ends - np.searchsorted(first, ends)


class Encoder:
    """Texts to ids and back, batch by batch."""

    def __init__(self, model: str):
        self.fst = Transducer(model)
        self.words = WordCoder(self.fst.paths)
        self.cut_lines = not self.fst.klass[NEWLINE]

    def encode(self, column: pa.Array):
        """(first row, last row + 1, all ids, ids per row) of parts of a string column."""
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        raw, offsets = binary(column)
        for i, j in blocks(offsets, BLOCK):
            part = column.slice(i, j - i)
            mark = MARK.encode()
            if mark in raw[offsets[i] : offsets[j]].tobytes():
                part = pc.replace_substring(part, mark, b" ")
            if self.fst.prefix:
                part = pc.if_else(pc.equal(pc.binary_length(part), 0), part, pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), part, pa.scalar(b"", pa.large_binary())))
            data, off = binary(part)
            text = data[off[0] : off[-1]]
            off = off - off[0]
            cut = np.zeros(len(text) + 1, bool)
            space = text == SPACE
            cut[1:-1] = space[1:] & ~space[:-1]
            if self.cut_lines:
                lines = np.flatnonzero(text == NEWLINE)
                cut[lines] = cut[lines + 1] = True
            cut[off] = True
            starts = np.flatnonzero(cut[:-1])
            ids, sizes = self.words(text, starts, len(text))
            yield i, j, ids, per_row(starts, sizes, off)


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(model: str) -> Encoder:
    """One encoder per worker process: the words it knows serve its next tasks too."""
    if model not in _ENCODERS:
        _ENCODERS[model] = Encoder(model)
    return _ENCODERS[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, columns: list[str] = ("doc_id",), digest: bool = False) -> DataFrame:
    """ids (array of int) and n_tokens of each row's text, beside `columns`; or, with digest,
    n_tokens, n_bytes, ids_crc32 (of the ids as little-endian 32-bit integers) and
    round_trip: whether decoding gives the text back.

    A null or empty text has no ids. A word mark in a text is read as a space, as
    SentencePiece does, and such a text does not round-trip. Long texts are encoded whole;
    rows keep their order and multiplicity; an empty table gives an empty result.
    """
    columns = list(columns)
    source = docs.select(*columns, "text")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "text")
    path = model

    def run(batches):
        coder = worker_encoder(path or default_model())
        for b in batches:
            texts = b.column(b.num_columns - 1)
            raw, offsets = binary(texts)
            for i, j, ids, counts in coder.encode(texts):
                head = [b.column(c).slice(i, j - i) for c in range(len(columns))]
                if not digest:
                    yield pa.RecordBatch.from_arrays([*head, list_array(ids, counts), pa.array(counts)], [*columns, "ids", "n_tokens"])
                    continue
                ends = np.append(0, np.cumsum(counts))
                little = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(little[s:e]) for s, e in zip(ends[:-1], ends[1:])]
                data, off = coder.fst.decode(ids, counts)
                want = offsets[i : j + 1]
                size = np.diff(want)
                same = np.diff(off) == size
                if same.all():
                    wrong = np.append(0, np.cumsum(data != raw[want[0] : want[-1]]))
                    same = np.diff(wrong[off]) == 0
                else:
                    same = np.array([data[off[r] : off[r + 1]].tobytes() == raw[want[r] : want[r + 1]].tobytes() for r in range(j - i)])
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(counts), pa.array(size), pa.array(crc, pa.int64()), pa.array(same)],
                    [*columns, "n_tokens", "n_bytes", "ids_crc32", "round_trip"],
                )

    tail = "n_tokens bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean" if digest else "ids array<int>, n_tokens bigint"
    return source.mapInArrow(frugal(run), kinds + tail)


def decode(coded: DataFrame, model: str | None = None, columns: list[str] = ("doc_id",)) -> DataFrame:
    """text of each row's ids, beside `columns`; bytes that are no UTF-8 are replaced."""
    columns = list(columns)
    source = coded.select(*columns, "ids")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "ids")

    def run(batches):
        fst = Transducer(model or default_model())
        for b in batches:
            lists = pc.fill_null(b.column(len(columns)), [])
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = fst.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(columns))), pa.array(texts, pa.string())], [*columns, "text"])

    return source.mapInArrow(frugal(run), kinds + "text string")
