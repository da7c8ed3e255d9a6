"""Static range asymmetric numeral system (rANS) files of token ids.

One frequency table, counted over the whole corpus and scaled to a power of two,
is shared by all files. A file holds whole documents in ascending doc_id order;
its ids are cut into blocks that are coded independently of each other, each by
many interleaved lanes whose states share one stream of words. The directory of
a file gives the checkpoint of each block (its place, first id and checksum), so
blocks can be decoded alone and in parallel. A corpus is a folder that holds its
frequency table beside its files; every file names the table by its checksum.

File layout, little-endian: header (magic, table's checksum, blocks, documents, ids), directory
(one entry per block), documents (doc_id, validity, length), block bodies.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_characters
from .common import field, map_rows, materialise, scratch
from .pieces import PieceCache

MAGIC = b"RANS\x00\x02"
SCALE_BITS = 22
LANES = 1024
BLOCK_IDS = 1 << 18
#: Bytes that a worker's cache of encoded pieces holds at most between two steps.
CACHE_BYTES = 160 << 20
#: The same for its cache of encoded words, of which pieces are made.
WORD_BYTES = 48 << 20
#: Text bytes of one step of tokenising; a piece that repeats inside a step is looked up once.
STEP_BYTES = 8 << 20
FILE_IDS = 1 << 20
_LOW = np.uint64(1 << 31)
#: Ids (about) of a part, that is of one task's files; a file ends at FILE_IDS.
PART_IDS = 4 << 20
_HEAD = struct.Struct("<6sHIIQQ")
_ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("first", "<u8"), ("ids", "<u4"), ("lanes", "<u4"), ("crc", "<u4"), ("crc_ids", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u4")])

# The pre-tokenizer pattern of the word vocabulary, as it is for lower-case ASCII.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"

_TOKENIZERS: dict[str, PieceCache] = {}


def library_ids(path: str) -> PieceCache:
    """Ids by the tokenizers library, one encoding for each distinct word of the distinct space-separated pieces.

    Holds for tokenizers that compose and lower-case and whose pre-tokenizer is WORDS. Most pieces are cut into its words
    here, which go straight to the library's model: printable ASCII, and Latin letters with or without a stop. Others
    are encoded whole, many at once, parted by a control character that forms one id of its own.
    """
    if path in _TOKENIZERS:
        return _TOKENIZERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    mark = "\x01"
    (bar,) = tok.encode(f" {mark} ", add_special_tokens=False).ids
    step, model = 500, tok.model.tokenize
    shown_bytes, ascii_words = dict(enumerate(byte_characters())), re.compile(WORDS).findall

    def words(piece: str) -> list[str] | None:
        """The words of a piece as the model wants them, or None if only the library can tell."""
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            return ascii_words(piece.lower()) if piece.isprintable() and "<|" not in piece else None  # no special token
        low = unicodedata.normalize("NFC", piece).lower()
        stem, stop = (low[:-1], [low[-1]]) if low[-1] in ".," else (low, [])
        return [stem.encode().decode("latin-1").translate(shown_bytes), *stop] if stem.isalpha() and max(stem) < "\u0250" else None

    def encode_words(cut: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = [], [0]
        for w in cut:
            flat += [t.id for t in model(w)]
            ends.append(len(flat))
        return np.array(flat, np.int32), np.diff(ends)

    known = PieceCache(lambda t: [t], encode_words, WORD_BYTES)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cuts, counts, rest = [], [], []  # flat lists: a list for each piece would keep the garbage collector busy
        direct = np.ones(len(pieces), bool)
        for i, piece in enumerate(pieces):
            cut = words(piece)
            if cut is None:
                direct[i] = False
                rest.append(piece)
                continue
            cuts += cut
            counts.append(len(cut))
        flat, ends = known.ids_of_parts(cuts, np.array(counts, np.int64))
        rest_ids, rest_sizes = encode_joined(rest) if rest else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        sizes = np.empty(len(pieces), np.int64)
        sizes[direct], sizes[~direct] = np.diff(ends), rest_sizes
        out, of_direct = np.empty(int(sizes.sum()), np.int32), np.repeat(direct, sizes)
        out[of_direct], out[~of_direct] = flat, rest_ids
        return out, sizes

    def encode_joined(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = [i for i, p in enumerate(pieces) if mark in p]
        shown = ["" if mark in p else p for p in pieces] if alone else pieces
        joined = [f" {mark} ".join(shown[i : i + step]) + f" {mark} " for i in range(0, len(shown), step)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in tok.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == bar)
        if len(ends) != len(pieces):
            raise ValueError("the separator does not stand alone in this tokenizer")
        sizes = np.diff(np.r_[-1, ends]) - 1
        ids = ids[ids != bar]
        if alone:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in alone:
                parts[i] = np.array(tok.encode(pieces[i], add_special_tokens=False).ids, np.int32)
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes

    probe = "Don't WE'LL !'s x1y22 a-b. Été, ŒUVRE."
    if encode(probe.split(" "))[0].tolist() != tok.encode(probe, add_special_tokens=False).ids:
        raise ValueError("this tokenizer cuts or changes words by other rules")
    cache = _TOKENIZERS[path] = PieceCache(lambda t: t.split(" "), encode, CACHE_BYTES)
    cache.words = known
    return cache


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits; every id gets at least 1, so no id is without a code."""
    room = (1 << bits) - len(counts)
    if room <= 0:
        raise ValueError("more ids than slots")
    freq = 1 + (counts.astype(object) * room // max(1, int(counts.sum()))).astype(np.int64)
    freq[int(np.argmax(freq))] += (1 << bits) - int(freq.sum())
    return freq


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS) -> None:
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())  # names the table
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int) -> bytes:
        """Lane states, then the words in the order in which the decoder wants them."""
        state = np.full(lanes, _LOW, np.uint64)
        words, n = [], len(ids)
        for at in range((n - 1) // lanes * lanes, -1, -lanes):
            s = ids[at : at + lanes]
            x = state[: len(s)]
            full = x >= self.limit[s]
            if full.any():
                words.append(x[full].astype(np.uint32))
                x = np.where(full, x >> np.uint64(32), x)
            q, r = np.divmod(x, self.freq[s])
            state[: len(s)] = (q << self.bits) + r + self.cum[s]
        return state.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(words))

    def decode(self, body: bytes, n: int, lanes: int) -> np.ndarray:
        state = np.frombuffer(body, "<u8", lanes).astype(np.uint64)
        words = np.frombuffer(body, "<u4", offset=8 * lanes).astype(np.uint64)
        out, used, low = np.empty(n, np.uint32), 0, np.uint64((1 << int(self.bits)) - 1)
        for at in range(0, n, lanes):
            m = min(lanes, n - at)
            x = state[:m]
            slot = x & low
            s = self.symbol[slot]
            x = self.freq[s] * (x >> self.bits) + slot - self.cum[s]
            empty = np.flatnonzero(x < _LOW)
            if len(empty):
                x[empty] = (x[empty] << np.uint64(32)) | words[used : used + len(empty)]
                used += len(empty)
            state[:m] = x
            out[at : at + m] = s
        if used != len(words) or (state != _LOW).any():
            raise ValueError("block does not end in its initial state")
        return out


def write_file(coder: Coder, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One file image of whole documents."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    bodies, entries = [], []
    n_blocks = -(-len(ids) // BLOCK_IDS)
    offset = _HEAD.size + n_blocks * _ENTRY.itemsize + len(docs) * _DOC.itemsize
    for first in range(0, len(ids), BLOCK_IDS):
        block = ids[first : first + BLOCK_IDS]
        lanes = int(min(LANES, max(1, len(block) // 64)))
        body = coder.encode(block, lanes)
        entries.append((offset, len(body), first, len(block), lanes, zlib.crc32(body), zlib.crc32(block.astype("<u4").tobytes())))
        bodies.append(body)
        offset += len(body)
    table = np.array([(i or 0, i is None, len(x)) for i, x in docs], _DOC)
    return b"".join([_HEAD.pack(MAGIC, 0, coder.crc, n_blocks, len(docs), len(ids)), np.array(entries, _ENTRY).tobytes(), table.tobytes(), *bodies])


def _directory(coder: Coder, image: bytes) -> tuple[np.ndarray, int, int]:
    """(entries of the blocks, documents, ids) of a file; raises ValueError if it is none or was coded with another table."""
    if len(image) < _HEAD.size or image[: len(MAGIC)] != MAGIC:
        raise ValueError("not a rANS file")
    _, _, table, n_blocks, n_docs, n_ids = _HEAD.unpack_from(image)
    if table != coder.crc:
        raise ValueError("the file was coded with another frequency table")
    return np.frombuffer(image, _ENTRY, n_blocks, _HEAD.size), n_docs, n_ids


def read_block(coder: Coder, image: bytes, number: int) -> tuple[int, np.ndarray]:
    """(number of its first id in the file, ids) of one block, decoded by its checkpoint alone; raises ValueError if a checksum differs."""
    e = _directory(coder, image)[0][number]
    body = image[int(e["offset"]) : int(e["offset"] + e["size"])]
    if zlib.crc32(body) != e["crc"]:
        raise ValueError("block checksum differs")
    block = coder.decode(body, int(e["ids"]), int(e["lanes"]))
    if zlib.crc32(block.astype("<u4").tobytes()) != e["crc_ids"]:
        raise ValueError("decoded checksum differs")
    return int(e["first"]), block


def read_file(coder: Coder, image: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document; raises ValueError if a checksum or the layout is wrong."""
    entries, n_docs, n_ids = _directory(coder, image)
    docs = np.frombuffer(image, _DOC, n_docs, _HEAD.size + entries.nbytes)
    ids = np.empty(n_ids, np.uint32)
    for k in range(len(entries)):
        first, block = read_block(coder, image, k)
        ids[first : first + len(block)] = block
    ends = np.r_[0, np.cumsum(docs["ids"], dtype=np.int64)]
    for d, a, b in zip(docs, ends[:-1], ends[1:], strict=True):
        yield (None if d["null"] else int(d["id"])), ids[a:b]


def _kind(vocabulary: int) -> str:
    """The unsigned integer that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenise(df: DataFrame, path: str, end_id: int, vocabulary: int, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``: the library's ids of each whole text and ``end_id``, as unsigned 16-bit integers (32-bit for larger vocabularies), binary.

    Null and empty texts give the end id alone; an id outside of the vocabulary raises ValueError. A column named like ``ids`` is replaced, others
    and repeated rows stay. No shuffle.
    """
    at, kind = df.columns.index(text), _kind(vocabulary)

    def make():
        cache, end = library_ids(path), np.array([end_id], kind).tobytes()

        def fn(batch: pa.RecordBatch):
            flat, ends = cache.ids_of(pc.replace_substring(batch.column(at), "\n", " "))  # white space of either kind parts words
            if len(flat) and int(flat.max()) >= vocabulary:
                raise ValueError("an id lies outside of the vocabulary")
            flat = flat.astype(kind)
            return [pa.array([flat[a:b].tobytes() + end for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]

        return fn

    return map_rows(df, make, [field(ids, T.BinaryType())], text, step=STEP_BYTES)


def histogram(df: DataFrame, vocabulary: int, ids: str = "ids") -> np.ndarray:
    """Counts of all ids over all rows: one small vector per task, added up on the executors.

    What reaches the driver has ``vocabulary`` rows at most, whatever the input.
    """
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = df.select(ids).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_corpus(docs: DataFrame, path: str, end_id: int, vocabulary: int, folder: str | None = None) -> str:
    """Tokenise all documents and write them as rANS files in ascending doc_id order; returns the folder.

    The folder (a new one in the shared folder, if none is given) holds ``table`` (id, freq), ``files`` (part, file, first, n_ids, content)
    and ``parts`` (part, base: ids of all parts before it), so it can be read without anything else. Documents are range-partitioned
    by doc_id into parts of about PART_IDS ids, null doc_ids first; rows with equal doc_id follow each
    other by their ids, and even equal rows can lie in different parts. An empty table gives no files.
    """
    spark, kind, folder = docs.sparkSession, _kind(vocabulary), folder or scratch(docs.sparkSession)
    ids = materialise(tokenise(docs.select("doc_id", "text"), path, end_id, vocabulary).select("doc_id", "ids"))
    counts = histogram(ids, vocabulary)
    freq = scaled(counts)
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(freq)], "id int, freq long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        part = TaskContext.get().partitionId()
        held: list = []
        no, size, before = 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, no, size, before
            if held:
                numbers = [pa.array([x], pa.int64()) for x in (no, before, size)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *numbers, pa.array([write_file(coder, held)], pa.binary())], names=["part", "file", "first", "n_ids", "content"])
                held, no, size, before = [], no + 1, 0, before + size

        for batch in batches:
            for i, x in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                x = np.frombuffer(x, kind).astype(np.uint32)
                held.append((i, x))
                size += len(x)
                if size >= FILE_IDS:
                    yield from flush()
        yield from flush()

    order = [F.col("doc_id").asc_nulls_first(), F.length("ids"), F.xxhash64("ids")]
    total = int(counts.sum())
    parts = max(-(-total // PART_IDS), min(spark.sparkContext.defaultParallelism, -(-total // BLOCK_IDS)), 1)
    dealt = ids.repartitionByRange(parts, *order, F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions(*order, "ids")
    ordered.select("doc_id", "ids").mapInArrow(images, "part int, file long, first long, n_ids long, content binary").write.parquet(f"{folder}/files")
    sums = spark.read.parquet(f"{folder}/files").groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base")).write.parquet(f"{folder}/parts")  # a row per part
    return folder


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Decode all files of a folder: doc_id, start, n_tokens, ids (unsigned 32-bit, binary), of null doc_ids and repeated rows too.

    ``start`` counts the ids of all documents before: those of the parts before, of the part's earlier files, and of
    what comes before in the file.
    """
    table = spark.read.parquet(f"{folder}/table").orderBy("id").collect()  # the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r["freq"] for r in table], np.int64))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for part, first, image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = list(read_file(coder, image))
                size = np.fromiter((len(x) for _, x in found), np.int64, len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found), pa.int32()), pa.array([i for i, _ in found], pa.int64()), pa.array(np.cumsum(size) - size + first), pa.array(size), pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary())],
                    names=["part", "doc_id", "at", "n_tokens", "ids"],
                )

    files = spark.read.schema("part int, file long, first long, n_ids long, content binary").parquet(f"{folder}/files")
    docs = files.select("part", "first", "content").mapInArrow(documents, "part int, doc_id long, at long, n_tokens long, ids binary")
    return docs.join(spark.read.parquet(f"{folder}/parts"), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
