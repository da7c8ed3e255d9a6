"""Token ids of whole texts through a bounded cache of their pieces.

Texts repeat their words. A text is cut where the tokenizer's own pre-tokenizer
always cuts, each distinct piece is encoded once, and the ids of a text are
gathered from one flat array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: What a piece takes besides its letters: the string's head, its place in the index, its start and size.
PIECE_BYTES = 180


class _Index(dict):
    """piece -> number; a new piece gets the next number and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.held = 0  # bytes, about

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class PieceCache:
    """Ids of texts; ``encode(pieces)`` gives (all ids in one array, number of ids of each piece).

    ``limit``: bytes that the pieces and their ids may hold when a call begins; beyond it the cache starts empty.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable, limit: int) -> None:
        self.split, self.encode, self.limit = split, encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        if self.index.held + 4 * self.used > self.limit:
            self._clear()
        at, counts, get = [], np.zeros(len(texts), np.int64), self.index.__getitem__
        for i, t in enumerate(texts):
            if t:
                pieces = self.split(t)
                counts[i] = len(pieces)
                at.extend(map(get, pieces))
        return self._gathered(np.array(at, np.int64), counts)

    def ids_of(self, texts: pa.Array, mark: str = " ") -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of an Arrow column whose texts are cut at every ``mark``; null counts as empty.

        Arrow cuts and counts the distinct pieces, so a piece that repeats inside the column is looked up once.
        """
        if self.index.held + 4 * self.used > self.limit:
            self._clear()
        parts = pc.split_pattern(pc.fill_null(texts, ""), mark)
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        return self._gathered(number[coded.indices.to_numpy()], parts.value_lengths().to_numpy())

    def ids_of_parts(self, parts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of texts that are cut already: all their parts, and how many each text has."""
        if self.index.held + 4 * self.used > self.limit:
            self._clear()
        return self._gathered(np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts)), counts)

    def _gathered(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that have ``counts`` pieces each, ``at`` their numbers; new pieces are encoded first."""
        if self.index.new:
            self._add(self.index.new)
            self.index.new = []
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]
        return ids, np.r_[0, np.r_[0, ends][np.cumsum(counts)]].astype(np.int64)

    def _add(self, pieces: list[str]) -> None:
        ids, sizes = self.encode(pieces)
        n = len(self.index)
        self.index.held += PIECE_BYTES * len(pieces) + 2 * sum(map(len, pieces))
        self.flat = _grown(self.flat, self.used + len(ids))
        self.start, self.size = _grown(self.start, n), _grown(self.size, n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n - len(pieces) : n] = sizes
        self.start[n - len(pieces) : n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
