"""MPEG audio media columns.

The parser follows frame headers, finds its way back after damage, reads ID3
tags and the tables of variable-bitrate files, verifies frame checksums, and
stores exact durations (samples and rate, never a rounded quotient) and the
byte offset of every frame.

The writer stores any bytes losslessly: silent Layer III frames of 48 kHz carry
them in the part of a frame that follows its (empty) audio data. A decoder plays
silence of the exact length; the reader takes the bytes back.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field as dc_field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_rows

# Fixed values of the standard: kbit/s by (version is 1, layer), sampling rates of version 1, samples of a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
CRC_POLYNOMIAL = 0x8005

UNIT = 192
_RATE, _MONO = 48000, 3
_SIDE = 17
_BODY = 4 + 2 + _SIDE  # header, checksum, side information: what precedes the carried bytes
_LENGTHS = {i: 144_000 * BITRATES[True, 3][i] // _RATE for i in range(1, 15)}
_FULL = 14


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ (CRC_POLYNOMIAL if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of a frame over its protected bytes."""
    c, table = 0xFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    length: int
    samples: int
    rate: int
    layer: int
    version1: bool
    channels: int
    protected: bool
    side: int  # bytes of side information (Layer III)


@lru_cache(1 << 14)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (free-format bitrates count as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate_at, pad = four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or four[2] >> 4 in (0, 15) or rate_at == 3 or four[3] & 3 == 2:
        return None
    one = version == 3
    kbit, rate = BITRATES[one, layer][four[2] >> 4], RATES[rate_at] >> (0 if one else 1 if version == 2 else 2)
    samples, channels = SAMPLES[one, layer], 1 if four[3] >> 6 == 3 else 2
    length = (12 * kbit * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // rate + pad
    side = (17 if channels == 1 else 32) if one else 9 if channels == 1 else 17
    return Header(length, samples, rate, layer, one, channels, not four[1] & 1, side if layer == 3 else 0)


@dataclass
class Stream:
    """What the parser found in one file."""

    tags: dict[str, str] = dc_field(default_factory=dict)
    table: str | None = None  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = dc_field(default_factory=list)
    rate: int | None = None  # of the first frame
    samples: int = 0  # of all frames, less what the encoder added
    delay: int = 0  # samples that the encoder put before the sound, and behind it, as the table says
    padding: int = 0
    segments: list[tuple[int, int]] = dc_field(default_factory=list)  # (rate, samples) of stretches of one rate
    offsets: list[int] = dc_field(default_factory=list)  # of audio frames, the table's frame not counted
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    carried: bytes = b""


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(tags, first byte after leading ID3v2 tags, end before a trailing ID3v1 tag)."""
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
        stop, p = min(len(data), at + 10 + size), at + 10
        short = major == 2  # names and sizes of three bytes, no flags
        name_size, head = (3, 6) if short else (4, 10)
        if flags & 0x40 and not short and p + 4 <= stop:  # an extended header
            p += _syncsafe(data[p : p + 4]) if major >= 4 else 4 + int.from_bytes(data[p : p + 4], "big")
        while p + head <= stop and data[p : p + name_size].strip(b"\0"):
            length = data[p + name_size : p + 2 * name_size]
            n = _syncsafe(length) if major >= 4 else int.from_bytes(length, "big")
            if n <= 0 or p + head + n > stop:
                break
            name, body = data[p : p + name_size].decode("latin-1"), data[p + head : p + head + n]
            if name[0] == "T" and body:
                coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
                value = body[1:].decode(coding, "replace").rstrip("\0")
                if name in ("TXXX", "TXX") and "\0" in value:
                    key, value = value.split("\0", 1)
                    name = f"TXXX:{key}"
                tags[name] = value
            p += head + n
        at = at + 10 + size + (10 if flags & 0x10 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        old = data[end - 128 : end]
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if value := old[lo:hi].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(f"v1:{name}", value)
        end -= 128
    return tags, min(at, end), end


def _vbr_table(frame: bytes, h: Header, out: Stream) -> bool:
    """Read the table of a variable-bitrate file if this frame holds one."""
    at = 4 + 2 * h.protected + h.side
    mark = frame[at : at + 4]
    if mark in (b"Xing", b"Info"):
        out.table, flags, p = mark.decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc, p = list(frame[p : p + 100]), p + 100
        p += 4 * bool(flags & 8)
        if len(frame) >= p + 24 and frame[p : p + 4].isalnum():  # the encoder's name opens a block that states what it added
            both = int.from_bytes(frame[p + 21 : p + 24], "big")
            out.delay, out.padding = both >> 12, both & 0xFFF
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        n, scale, width = (int.from_bytes(frame[a : a + 2], "big") for a in (54, 56, 58))
        out.toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)] if width else []
        return True
    return False


def read_stream(data: bytes | None, carried: bool = False) -> Stream:
    """Parse a whole file; null and empty files have no frames.

    A header counts if its checksum holds, if the stream ends behind its frame, or if a frame follows that
    is of the same layer, version and rate, or of any if its own are those of the frames before. So a change of rate or layer is followed as soon as two frames
    agree, and a lone false header is not. Else the search goes on a byte further; skipped bytes are counted. A
    cut last frame is skipped. Checksums of Layer I and III frames are
    verified (in Layer II the protected span depends on decoded data).
    """
    out = Stream()
    if not data:
        return out
    out.tags, at, end = read_tags(data)
    parts, first, kind = [], True, None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        stop = at + h.length if h else 0
        checkable = h is not None and h.protected and h.layer != 2
        span = 0 if not checkable else h.side if h.layer == 3 else 16 * h.channels
        sound = checkable and crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + span]) == int.from_bytes(data[at + 4 : at + 6], "big")
        if not h or stop > end or not sound and stop + 4 <= end and not _agree(_kind(h), header(data[stop : stop + 4]), kind) or not sound and stop + 4 > end and kind not in (None, _kind(h)):
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        kind = _kind(h)
        out.checked += checkable
        out.bad += checkable and not sound
        if not (first and _vbr_table(data[at:stop], h, out)):
            out.rate = out.rate or h.rate
            out.offsets.append(at)
            out.samples += h.samples
            if out.segments and out.segments[-1][0] == h.rate:
                out.segments[-1] = (h.rate, out.segments[-1][1] + h.samples)
            else:
                out.segments.append((h.rate, h.samples))
            if carried:
                parts.append(data[at + 4 + 2 * h.protected + h.side : stop])
        elif out.rate is None:
            out.rate = h.rate
        first = False
        at = stop
    out.skipped += max(0, end - at)
    _trim(out)
    out.carried = b"".join(parts)
    return out


def _kind(h: Header) -> tuple[int, bool, int]:
    return h.layer, h.version1, h.rate


def _agree(own: tuple[int, bool, int], following: Header | None, before: tuple[int, bool, int] | None) -> bool:
    """Whether a frame of kind ``own`` is borne out by the header behind it and the kind of the frames before."""
    return following is not None and (own == before or _kind(following) == own)


def _trim(out: Stream) -> None:
    """Take what the encoder added from the first and the last stretch."""
    for add, at in ((out.delay, 0), (out.padding, -1)):
        while add and out.segments:
            rate, n = out.segments[at]
            cut = min(add, n)
            out.samples, add = out.samples - cut, add - cut
            out.segments[at] = (rate, n - cut)
            if add or n == cut:
                out.segments.pop(at)
    if not out.segments:
        out.samples = 0


def _frame_start(index: int) -> bytes:
    four = bytes([0xFF, 0xFA, index << 4 | RATES.index(_RATE) << 2, _MONO << 6])
    return four + crc16(four[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + f"{key}\0{value}".encode()
    return b"TXXX" + len(body).to_bytes(4, "big") + bytes(2) + body


def write_stream(payload: bytes, notes: dict[str, str] | None = None) -> bytes:
    """A variable-bitrate file that carries ``payload``; equal arguments give equal bytes.

    An empty closing tag is written only where the payload itself has ``TAG`` at the place of one.
    """
    room = _LENGTHS[_FULL] - _BODY
    whole, rest = divmod(len(payload), room)
    frames = np.zeros((whole, _LENGTHS[_FULL]), np.uint8)
    frames[:, :_BODY] = np.frombuffer(_frame_start(_FULL), np.uint8)
    frames[:, _BODY:] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
    last = b""
    if rest:
        index = min(i for i, n in _LENGTHS.items() if n - _BODY >= rest)
        last = (_frame_start(index) + payload[whole * room :]).ljust(_LENGTHS[index], b"\0")
    n, audio = whole + bool(rest), frames.nbytes + len(last)
    table_at = min(i for i, k in _LENGTHS.items() if k >= _BODY + 120)
    total = _LENGTHS[table_at] + audio
    starts = [_LENGTHS[table_at] + min(n * p // 100, whole) * _LENGTHS[_FULL] for p in range(100)]
    toc = bytes(min(255, 256 * s // total) for s in starts)
    table = (_frame_start(table_at) + b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc).ljust(_LENGTHS[table_at], b"\0")
    tags = b"".join(_text_frame(k, v) for k, v in {"payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload)), **(notes or {})}.items())
    size = len(tags)
    head = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127])
    out = head + tags + table + frames.tobytes() + last
    # what a reader would take for a closing tag is followed by one, an empty one
    return out + b"TAG".ljust(128, b"\0") if out[-128:-125] == b"TAG" else out


def read_payload(data: bytes | None) -> tuple[bytes, Stream]:
    """The carried bytes and the parsed stream; raises ValueError if a length or checksum differs."""
    s = read_stream(data, carried=True)
    size = s.tags.get("TXXX:payload_bytes", "")
    payload = s.carried[: int(size)] if size.isdecimal() else b""
    if s.bad or str(zlib.crc32(payload)) != s.tags.get("TXXX:payload_crc32") or s.table_frames != len(s.offsets):
        raise ValueError("the stored stream is damaged")
    return payload, s


MEDIA = [
    field("tags", T.MapType(T.StringType(), T.StringType())), field("vbr_table", T.StringType()), field("vbr_frames", T.LongType()), field("vbr_bytes", T.LongType()), field("toc", T.ArrayType(T.LongType())),
    field("sample_rate", T.IntegerType()), field("n_samples", T.LongType()), field("n_frames", T.LongType()), field("frame_offsets", T.ArrayType(T.LongType())), field("checksums", T.LongType()), field("bad_checksums", T.LongType()), field("skipped_bytes", T.LongType()),
    field("delay", T.LongType()), field("padding", T.LongType()), field("segments", T.ArrayType(T.StructType([field("sample_rate", T.IntegerType()), field("n_samples", T.LongType())]))),
]


def parse_column(df: DataFrame, media: str = "content") -> DataFrame:
    """Append the fields of MEDIA for each file in the binary column.

    The exact duration is the sum of n_samples / sample_rate over ``segments``, stretches of one rate, without the ``delay`` and ``padding`` that the
    encoder states; n_samples is their sum, and sample_rate that of the first. Null, empty and foreign contents get no frames and a null rate. Repeated
    rows are parsed like others. Replaces columns of the same names. No shuffle.
    """
    at = df.columns.index(media)

    def make():
        def fn(batch: pa.RecordBatch):
            s = [read_stream(x) for x in batch.column(at).to_pylist()]
            return [
                pa.array([list(x.tags.items()) for x in s], pa.map_(pa.string(), pa.string())), pa.array([x.table for x in s], pa.string()), pa.array([x.table_frames for x in s], pa.int64()), pa.array([x.table_bytes for x in s], pa.int64()), pa.array([x.toc for x in s], pa.list_(pa.int64())),
                pa.array([x.rate for x in s], pa.int32()), pa.array([x.samples for x in s], pa.int64()), pa.array([len(x.offsets) for x in s], pa.int64()), pa.array([x.offsets for x in s], pa.list_(pa.int64())), pa.array([x.checked for x in s], pa.int64()), pa.array([x.bad for x in s], pa.int64()), pa.array([x.skipped for x in s], pa.int64()),
                pa.array([x.delay for x in s], pa.int64()), pa.array([x.padding for x in s], pa.int64()), pa.array([[{"sample_rate": r, "n_samples": n} for r, n in x.segments] for x in s], pa.list_(pa.struct([("sample_rate", pa.int32()), ("n_samples", pa.int64())]))),
            ]

        return fn

    return map_rows(df, make, MEDIA, media)


def store_text(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Append ``media``: a stream that carries the UTF-8 text, padded with spaces to a positive multiple of UNIT bytes.

    Null texts are stored as empty ones. Equal texts, in repeated rows too, give equal streams. A column of the same name is replaced, others stay.
    """
    at = df.columns.index(text)

    def make():
        def fn(batch: pa.RecordBatch):
            out = []
            for t in batch.column(at).to_pylist():
                raw = (t or "").encode()
                padded = raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")
                out.append(write_stream(padded, {"text_bytes": str(len(raw))}))
            return [pa.array(out, pa.binary())]

        return fn

    return map_rows(df, make, [field(media, T.BinaryType())], text)


PAYLOAD = [field("payload", T.BinaryType()), field("n_bytes", T.LongType()), field("feature", T.StringType())]


def restore(df: DataFrame, media: str = "media") -> DataFrame:
    """Append payload, n_bytes (of the unpadded text) and feature (exact duration and seek table) read from stored streams.

    Null, empty, foreign and damaged cells give null in all three; repeated rows are read like others. Columns of the same names are replaced, others stay.
    """
    at = df.columns.index(media)

    def make():
        def fn(batch: pa.RecordBatch):
            found = [_restored(x) for x in batch.column(at).to_pylist()]
            return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.string()))]

        return fn

    return map_rows(df, make, PAYLOAD, media)


def _restored(data: bytes | None) -> tuple[bytes, int, str] | tuple[None, None, None]:
    try:
        payload, s = read_payload(data)
        n_bytes = int(s.tags.get("TXXX:text_bytes", ""))
    except ValueError:
        return None, None, None
    seek = np.array(s.offsets, "<i8")
    feature = f"{s.table} frames={len(seek)} samples={s.samples} rate={s.rate} first={seek[0]} last={seek[-1]} seek_crc32={zlib.crc32(seek.tobytes())}" if len(seek) else f"{s.table} frames=0"
    return payload, n_bytes, feature
