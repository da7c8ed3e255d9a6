"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

All new words of a step lie in one flat array of symbols. A round looks up the
rank of every adjacent pair by binary search over the sorted pair keys, takes
the lowest rank in each word, merges every occurrence of that pair from left
to right, and looks up only the pairs that changed. Words without a known pair
leave the array, so the work falls from round to round.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_rows, texts_of
from .pieces import PieceCache

# The pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+(?![^WS])|[WS]+"
# Code points with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_NONE = np.iinfo(np.int32).max
#: Bytes that a task's cache of encoded pieces holds at most between two steps.
CACHE_BYTES = 48 << 20
#: Text bytes of one step: decoding needs some 30 times as many for its indices.
STEP_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class NumpyBPE:
    """A tokenizer file's vocabulary and merges as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        self.width = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.byte_size = np.fromiter(map(len, token_bytes), np.int64, size)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.byte_flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        words = PATTERN.replace("[WS]", f"[{WHITE}]").replace("[^WS]", f"[^{WHITE}]").replace("[^WS", f"[^{WHITE}")
        self._words = regex.compile(words)
        self._rare = re.compile(f"[{WHITE}]".replace("\\t-\\r ", "\\t\\x0b-\\r"))
        self._cut = regex.compile(f" (?=[^{WHITE}])")
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def new_cache(self, limit: int = CACHE_BYTES) -> PieceCache:
        return PieceCache(self._pieces, self._encode_pieces, limit)

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text that no pre-token crosses: a pre-token starts at each space before a visible character."""
        if self._special and "<|" in text and self._special.search(text):
            return [p for part in self._special.split(text) if part for p in ([part] if part in self.special else self._pieces_plain(part))]
        return self._pieces_plain(text)

    def _pieces_plain(self, text: str) -> list[str]:
        odd = "  " in text or " \n" in text or text[-1] == " " or self._rare.search(text)
        out = [" " + p for p in (self._cut.split(text) if odd else text.split(" "))]
        out[0] = out[0][1:]
        return out

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, per = [], np.zeros(len(pieces), np.int64)
        fixed: dict[int, int] = {}
        stops = {".", ","}
        for i, p in enumerate(pieces):
            if p in self.special:
                fixed[len(words)] = self.special[p]
                words.append(b"\0")
                per[i] = 1
            elif p[1:].isalpha() and p[0] == " ":
                words.append(p.encode())
                per[i] = 1
            elif p[-1:] in stops and p[1:-1].isalpha() and p[0] == " ":
                words += (p[:-1].encode(), p[-1].encode())
                per[i] = 2
            else:
                found = self._words.findall(p)
                per[i] = len(found)
                words += [w.encode() for w in found]
        ids, sizes = self.merge(words)
        ends = np.cumsum(sizes)
        for w, i in fixed.items():
            ids[ends[w] - 1] = i
        bound = np.r_[0, ends][np.r_[0, np.cumsum(per)]]
        return ids, np.diff(bound)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each word): the merge rounds. Empty words have no ids."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        done_word, done_sym = [], []
        rank = np.full(len(sym), _NONE, np.int32)
        if len(sym) > 1:
            same = word[1:] == word[:-1]
            rank[:-1] = np.where(same, self._rank(sym[:-1], sym[1:]), _NONE)
        while len(sym):
            starts = np.r_[0, np.flatnonzero(word[1:] != word[:-1]) + 1]
            sizes = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            over = low == _NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done_word.append(word[gone])
                done_sym.append(sym[gone])
                sym, rank, word = sym[~gone], rank[~gone], word[~gone]
                low, sizes = low[~over], sizes[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            joined = np.r_[False, np.diff(at) == 1]
            if joined.any():  # a run of one symbol: every other pair, from the left
                run = np.arange(len(at))
                run -= np.maximum.accumulate(np.where(joined, 0, run))
                at = at[run % 2 == 0]
            sym[at] = self.merged[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, rank, word = sym[stay], rank[stay], word[stay]
            at -= np.arange(len(at))
            touched = np.zeros(len(sym) + 1, bool)
            touched[at] = touched[at - 1] = True
            touched[-1] = False
            at = np.flatnonzero(touched)
            rank[at] = _NONE
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self._rank(sym[at], sym[at + 1])
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.new_cache().ids(texts)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of bytes of each id), gathered from one flat table."""
        size = self.byte_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.byte_flat[np.repeat(self.byte_start[ids] - (ends - size), size) + np.arange(total)], size

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids)[0].tobytes().decode("utf-8", errors="replace")


_LOADED: dict[str, NumpyBPE] = {}


def loaded(path: str) -> NumpyBPE:
    """One table for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = NumpyBPE(path)
    return _LOADED[path]


def _packed(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binaries of little-endian unsigned 32-bit integers, cut at ``ends``."""
    raw = flat.astype("<u4").tobytes()
    return pa.array([raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _texts(model: NumpyBPE, flat: np.ndarray, ends: np.ndarray) -> list[str]:
    """The text of each span of ids."""
    raw, size = model.decode_bytes(flat)
    at = np.r_[0, np.cumsum(size)][ends]
    raw = raw.tobytes()
    return [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``, the token ids of ``text`` as little-endian unsigned 32-bit integers (binary).

    Null and empty texts give empty binaries; special tokens written out in a
    text become their id. Rows (repeated ones too), order inside a partition and other columns
    stay; a column already named like ``ids`` is replaced. No shuffle.
    """
    at = df.columns.index(text)

    def make():
        cache = loaded(path).new_cache()
        return lambda batch: [_packed(*cache.ids(texts_of(batch, at)))]

    return map_rows(df, make, [field(ids, T.BinaryType())], text, step=STEP_BYTES)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``, the text of the binary ``ids``; special tokens are kept. Null ids give an empty text; a column named like ``text`` is replaced."""
    at = df.columns.index(ids)

    def make():
        model = loaded(path)

        def fn(batch: pa.RecordBatch):
            parts = [x or b"" for x in batch.column(at).to_pylist()]
            flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
            return [pa.array(_texts(model, flat, np.cumsum([0, *(len(x) // 4 for x in parts)])), pa.string())]

        return fn

    return map_rows(df, make, [field(text, T.StringType())], ids, step=STEP_BYTES)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", exact: str | None = "exact") -> DataFrame:
    """``encode`` and ``decode`` in one step, so that a task has one Python worker and a text crosses to it once.

    ``text`` gives way to ``ids``, ``decoded`` (the text decoded from them) and ``exact`` (whether that is the text, null
    counting as empty); the last two may be None and are left out then. Columns of those names are replaced, others stay.
    """
    at = df.columns.index(text)
    kinds = ((ids, T.BinaryType()), (decoded, T.StringType()), (exact, T.BooleanType()))
    fields = [field(name, kind) for name, kind in kinds if name]

    def make():
        model, cache = loaded(path), loaded(path).new_cache()

        def fn(batch: pa.RecordBatch):
            texts = texts_of(batch, at)
            flat, ends = cache.ids(texts)
            out, back = [_packed(flat, ends)], _texts(model, flat.astype(np.int64), ends)
            if decoded:
                out.append(pa.array(back, pa.string()))
            if exact:
                out.append(pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_()))
            return out

        return fn

    return map_rows(df, make, fields, text, (text,), STEP_BYTES)
