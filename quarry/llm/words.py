"""Encode texts by their distinct words: each is coded once and its ids are gathered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import binary, ragged, slices

#: Distinct words whose ids a worker keeps; beyond that it starts afresh.
POOL_WORDS = 1 << 20


def byte_strings(a: pa.Array) -> list[bytes]:
    """Values of a binary array; several times faster than to_pylist()."""
    data, offsets = binary(a)
    raw, off = data.tobytes(), offsets.tolist()
    return [raw[s:e] for s, e in zip(off, off[1:])]


class WordCoder:
    """code(list of bytes) -> (all ids, ids per word) is called for words not seen yet."""

    def __init__(self, code: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.code = code
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _learn(self, words: list[bytes]) -> None:
        ids, sizes = self.code(words)
        n, m = len(self.known), len(words)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.starts, self.sizes = self._room(self.starts, n + m), self._room(self.sizes, n + m)
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(n, n + m)))
        self.used += len(ids)

    def __call__(self, data: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per word) of the consecutive words that begin at starts."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = slices(data, starts, end).dictionary_encode()
        words = byte_strings(coded.dictionary)
        if len(self.known) + len(words) > POOL_WORDS:
            self._reset()
        if fresh := [w for w in words if w not in self.known]:
            self._learn(fresh)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = self.sizes[which]
        return self.ids[ragged(self.starts[which], sizes)], sizes


def per_row(starts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ids per document, from the words' starts and the documents' offsets."""
    total = np.append(0, np.cumsum(sizes))
    return np.diff(total[np.searchsorted(starts, offsets)])


def list_array(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids, pa.int32()))
