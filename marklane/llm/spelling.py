"""Spelling variants by full neighbourhood generation.

For every word of the vocabulary all distinct strings with one code point deleted, replaced or inserted are formed, over the
alphabet that the vocabulary uses. A candidate that equals a word of the vocabulary is near by construction, so a hash join
finds all near words and no distance is ever computed.

A word of length n has about (2 n + 1) * |alphabet| candidates, nearly all of which are no words. They are formed as 64-bit
hashes, in blocks of numpy arrays; what a filter of the vocabulary's hashes rules out is dropped where it was formed, and
only the rest is spelled out and shuffled to the exact join of strings. The filter's size is bounded; a vocabulary that is
too large for it costs more shuffled candidates, never a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# What a run of letters is, and the letters that are lowered.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in MISPRINT loses a code point; the least length and number of occurrences of a word; how much commoner a form is.
MISPRINT, LEAST_LENGTH, LEAST_COUNT, COMMONER = 31, 7, 2, 10
#: Bits of the filter: BITS_PER_WORD for each word of the vocabulary, between these powers of two (128 KB and 16 MB).
BITS_PER_WORD, LEAST_BITS, MOST_BITS = 32, 20, 27
#: Hashes that a task forms at once, and words for each task: about 20 million candidates.
BLOCK, WORDS_PER_TASK = 1 << 21, 20_000


def runs(docs: DataFrame) -> DataFrame:
    """(word): every run of letters of whole texts as it is counted: A-Z in lower case, with a code point less if the crc32 of ``<doc_id>:<run>`` is a multiple of 31.

    Which one goes is the crc32 modulo the run's length. Null texts have no runs; a null doc_id counts as an empty one. A row that is repeated counts again.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("w"))
    hashed = each.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    short = F.concat(F.substring("w", F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
    return hashed.select(F.when(F.col("h") % MISPRINT == 0, short).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct results of ``runs`` of 7 code points and more that occur twice and more. Counts are summed before the shuffle."""
    return runs(docs).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def alphabet(words: DataFrame) -> list[int]:
    """The code points that the words use, in order; as many as scripts have, not as the corpus has words."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    return sorted(ord(r["c"]) for r in letters.collect())


class _Hashes:
    """Hashes of words and of all their neighbours: the sum of value(code point) * FACTOR ** position, modulo 2 ** 64."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, letters: list[int], longest: int):
        self.letters = np.array(letters, np.uint32)
        self.values = np.random.default_rng(len(letters)).integers(1, 2**63, len(letters), np.uint64)
        self.power = np.array([pow(self.FACTOR, i, 2**64) for i in range(longest + 2)], np.uint64)
        self.inverse = np.uint64(pow(self.FACTOR, -1, 2**64))

    def at(self, codes: np.ndarray) -> np.ndarray:
        """Index in the alphabet; code points outside of it must not occur."""
        return np.searchsorted(self.letters, codes)

    def of(self, index: np.ndarray) -> np.ndarray:
        """Hashes of the rows of a matrix of indices."""
        return (self.values[index] * self.power[: index.shape[1]]).sum(axis=1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash over the upper ones."""
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a filter of 2 ** size bits."""
    m = _mixed(h)
    return m >> np.uint64(64 - size), (m * np.uint64(0xFF51AFD7ED558CCD | 1)) >> np.uint64(64 - size)


def _matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, matrix of code points) for each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        text = "".join(words[i] for i in rows)
        yield rows, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), n)


def word_filter(words: DataFrame, letters: list[int], longest: int, size: int) -> np.ndarray:
    """The filter of the vocabulary's hashes: 2 ** size bits, two for each word, joined in Spark; 8 bytes for each 32 bits of it come back, 32 MB at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(letters, longest)
        for batch in batches:
            for _, codes in _matrices(batch.column(0).to_pylist()):
                at = np.concatenate(_bits(hashes.of(hashes.at(codes)), size))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int32)), pa.array((np.uint32(1) << (at & np.uint64(31)).astype(np.uint32)).view(np.int32))], names=["place", "bit"])

    cells = words.select("word").mapInArrow(places, "place int, bit int").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 5), np.uint32)
    out[cells.column("place").to_numpy()] = cells.column("bits").to_numpy().view(np.uint32)
    return out


def _passes(filter_: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    """Flat numbers of the hashes that the filter does not rule out."""
    first, second = _bits(h.ravel(), size)
    five, low = np.uint64(5), np.uint64(31)
    found = np.flatnonzero(filter_[(first >> five).astype(np.int64)] >> (first & low).astype(np.uint32) & np.uint32(1))
    second = second[found]
    return found[(filter_[(second >> five).astype(np.int64)] >> (second & low).astype(np.uint32) & np.uint32(1)).astype(bool)]


def _neighbours(index: np.ndarray, hashes: _Hashes, filter_: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrices of indices) of all distinct neighbours of the rows of ``index`` that the filter lets pass.

    Of equal results one is formed: of a run of equal letters the first is deleted, a letter is inserted behind no equal one,
    and replacements differ from the letter they replace.
    """
    m, n = index.shape
    a = len(hashes.letters)
    every = np.arange(a)
    value, power = hashes.values, hashes.power
    terms = value[index] * power[:n]
    before = np.zeros((m, n + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    behind = whole - before  # the terms from position i on

    fresh = np.ones((m, n), bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    found = _passes(filter_, size, before[:, :-1] + behind[:, 1:] * hashes.inverse)
    row, i = np.divmod(found, n)
    row, i = row[fresh[row, i]], i[fresh[row, i]]
    yield row, np.take_along_axis(index[row], np.arange(n - 1) + (np.arange(n - 1) >= i[:, None]), axis=1)

    h = (whole - terms)[:, :, None] + value * power[:n, None]
    found = _passes(filter_, size, h)
    row, i, c = np.unravel_index(found, h.shape)
    other = c != index[row, i]
    row, i, c = row[other], i[other], c[other]
    out = index[row]
    out[np.arange(len(row)), i] = every[c]
    yield row, out

    h = (before + behind * np.uint64(hashes.FACTOR))[:, :, None] + value * power[: n + 1, None]
    found = _passes(filter_, size, h)
    row, i, c = np.unravel_index(found, h.shape)
    new = (i == 0) | (c != index[row, np.maximum(i - 1, 0)])
    row, i, c = row[new], i[new], c[new]
    out = np.take_along_axis(np.pad(index[row], ((0, 0), (0, 1))), np.arange(n + 1) - (np.arange(n + 1) > i[:, None]), axis=1)
    out[np.arange(len(row)), i] = every[c]
    yield row, out


def candidates(words: DataFrame, letters: list[int], longest: int, filter_: np.ndarray, size: int) -> DataFrame:
    """(word, near): each word of ``words`` with every neighbour that may be a word; all that are words are among them, once."""
    shared = words.sparkSession.sparkContext.broadcast(filter_)  # 2 ** size bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(letters, longest)
        for batch in batches:
            given = batch.column(0).to_pylist()
            for numbers, codes in _matrices(given):
                index = hashes.at(codes)
                step = max(1, BLOCK // ((index.shape[1] + 1) * len(letters)))
                for k in range(0, len(index), step):
                    for row, near in _neighbours(index[k : k + step], hashes, shared.value, size):
                        if len(row):
                            spelled = hashes.letters[near].astype(np.uint32, order="C").view(f"<U{near.shape[1]}").ravel()
                            source = [given[numbers[k + r]] for r in row.tolist()]
                            yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(spelled.tolist(), pa.string())], names=["word", "near"])

    return words.select("word").mapInArrow(run, "word string, near string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words (word, n) that differ by one inserted, deleted or replaced code point, both ways round."""
    spark = words.sparkSession
    size = words.agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("word")).alias("longest")).first()
    if not size["n"]:
        return spark.createDataFrame([], "word string, near string, near_n long")
    bits = int(np.clip(np.ceil(np.log2(size["n"] * BITS_PER_WORD)), LEAST_BITS, MOST_BITS))
    letters = alphabet(words)
    dealt = words.select("word").repartition(-(-size["n"] // WORDS_PER_TASK))
    found = candidates(dealt, letters, size["longest"], word_filter(words, letters, size["longest"], bits), bits)
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) of each word end. Pointers are doubled, so 18 steps take 5 joins.

    A form is at least ten times as common as its word, so there are no circles, and no chain is longer than the digits of the largest count.
    """
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """A row per word of the vocabulary: word, form, root, n, n_near, form_n.

    ``n_near`` counts its near words. ``form`` is the commonest of them (ties: smallest in code point order), if it is at least ten times
    as common as the word, ``form_n`` its count; else both are null. ``root`` is where forms lead in the end, the word itself without one.
    Null and empty texts add nothing, without words the result is empty, and columns other than doc_id and text are ignored.
    """
    words = materialise(vocabulary(docs.select("doc_id", "text")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    commoner = -F.col("best.less") >= COMMONER * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(commoner, F.col("best.near")).alias("form"), F.when(commoner, -F.col("best.less")).alias("form_n"),
    )
    known = materialise(known)
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
