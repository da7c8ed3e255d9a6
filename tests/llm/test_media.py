"""MPEG audio as it is found: damaged cells, changes of format, stated delays, old tags."""

from __future__ import annotations

from fractions import Fraction

from marklane.llm import mpeg


def frame(rate_at=1, index=9, crc=False, fill=0):
    """A silent Layer III frame: rates 44100, 48000, 32000 by number, an unprotected header unless ``crc``."""
    four = bytes([0xFF, 0xFA if crc else 0xFB, index << 4 | rate_at << 2, 3 << 6])
    h = mpeg.header(four)
    start = four + (mpeg.crc16(four[2:] + bytes(17)).to_bytes(2, "big") if crc else b"")
    return start + bytes([fill]) * (h.length - len(start))


def test_cells_that_cannot_be_restored(spark):
    good = mpeg.write_stream(b"x" * 192, {"text_bytes": "3"})
    cells = [None, b"", b"foreign", b"\xff" * 500, good, good[:-30], good.replace(b"x" * 20, b"y" * 20), frame() * 3, b"ID3\x03\0\0\0\0\0\0", good]
    rows = spark.createDataFrame([(i, c, "clash", 7) for i, c in enumerate(cells)], "i int, media binary, feature string, other int")
    got = mpeg.restore(rows).orderBy("i").collect()
    assert [r["payload"] is not None for r in got] == [i in (4, 9) for i in range(len(cells))]
    assert all((r["n_bytes"], r["feature"]) == (None, None) for r in got if r["payload"] is None) and {r["other"] for r in got} == {7}
    assert bytes(got[4]["payload"]) == b"x" * 192 and got[4]["n_bytes"] == 3
    parsed = mpeg.parse_column(rows, "media").orderBy("i").collect()
    assert [r["n_frames"] for r in parsed][:4] == [0, 0, 0, 0] and parsed[0]["sample_rate"] is None and parsed[7]["n_frames"] == 3


def test_changes_of_rate_are_followed():
    s = mpeg.read_stream(frame(1) * 5 + frame(0) * 20 + frame(2) * 2)
    assert len(s.offsets) == 27 and s.skipped == 0 and s.rate == 48000
    assert s.segments == [(48000, 5 * 1152), (44100, 20 * 1152), (32000, 2 * 1152)]
    assert sum(Fraction(n, r) for r, n in s.segments) == Fraction(5 * 1152, 48000) + Fraction(20 * 1152, 44100) + Fraction(2 * 1152, 32000)


def test_false_headers_do_not_hold_the_stream():
    false = frame(0)[:4]
    for before in (false, false + bytes(9), frame(0)):  # the last is a whole frame of another rate, alone
        s = mpeg.read_stream(before + frame(1) * 10)
        assert len(s.offsets) == 10 and s.rate == 48000 and s.skipped == len(before)
    s = mpeg.read_stream(frame(1) * 4 + false + b"junk" + frame(1) * 4)
    assert len(s.offsets) >= 7 and s.rate == 48000 and s.segments[0][0] == 48000


def test_stated_delay_and_padding_shorten_the_duration():
    def table(delay, padding, quality=True):
        four = frame(1)[:4]
        fields = b"Info" + (15 if quality else 7).to_bytes(4, "big") + (10).to_bytes(4, "big") + (3840).to_bytes(4, "big") + bytes(100) + (bytes(4) if quality else b"")
        name = b"LAME3.100" + bytes(12) + (delay << 12 | padding).to_bytes(3, "big")
        return (four + bytes(17) + fields + name).ljust(len(frame(1)), b"\0")

    for quality in (True, False):
        s = mpeg.read_stream(table(576, 1105, quality) + frame(1) * 10)
        assert (s.table, s.delay, s.padding, s.samples, s.segments) == ("Info", 576, 1105, 11520 - 1681, [(48000, 9839)])
    assert mpeg.read_stream(table(4095, 4095) + frame(1)).samples == 0
    assert mpeg.read_stream(mpeg.write_stream(b"a" * 192)).delay == 0


def test_old_tags_and_extended_headers():
    body = b"TT2" + (6).to_bytes(3, "big") + b"\0title" + b"TXX" + (8).to_bytes(3, "big") + b"\0key\0val" + b"PIC" + (2).to_bytes(3, "big") + b"zz"
    old = b"ID3\x02\0\0" + bytes([0, 0, 0, len(body)]) + body
    s = mpeg.read_stream(old + frame() * 3)
    assert s.tags == {"TT2": "title", "TXXX:key": "val"} and len(s.offsets) == 3 and s.skipped == 0
    extended = (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (2).to_bytes(4, "big") + bytes(2) + b"\0t"
    s = mpeg.read_stream(b"ID3\x03\0\x40" + bytes([0, 0, 0, len(extended)]) + extended + frame() * 2)
    assert s.tags == {"TIT2": "t"} and len(s.offsets) == 2
