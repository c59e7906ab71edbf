"""One malformed file for each error code that parsing or decoding can give."""

from __future__ import annotations

from tessella.codec.container import segment, spiff_segment


def image(*segments, data=b"\xdb\x95\xf0", end=b"\xff\xd9"):
    return b"\xff\xd8" + b"".join(segments) + data + end


SOF = segment(0xF7, bytes.fromhex("020004000301011100"))
SOS = segment(0xDA, bytes.fromhex("010100000000"))
BAD = {
    4: image(SOF, SOS)[:-2],
    5: image(SOF, SOS, data=b"\x00" * 40),
    6: image(segment(0xC0, b"")),
    7: image(segment(0xF7, bytes.fromhex("020004000301012200"))),
    8: image(segment(0xE8, b"mrfx\x04")),
    9: image(segment(0xF8, b"\x05")),
    10: image(b"\x00"),
    11: b"\xff\xd9",
    13: image(segment(0x02, b"")),
    14: image(SOS),
    15: image(segment(0xF7, b"\x02\x00")),
    16: image(b"\xff\xd8"),
    17: image(SOF, SOF),
    18: image(segment(0xF7, bytes.fromhex("020004000302011100011100"))),
    19: image(data=b""),
    20: image(segment(0xF8, b"\x0e")),
    21: image(spiff_segment({"component_count": 1, "height": 4, "width": 3, "bits_per_sample": 2}), SOF, SOS),
    22: image(b"\xff\xd0"),
    23: image(SOF, segment(0xDD, b"\x00\x01"), SOS),
    24: image(SOF, SOS, end=b"\xff\xfe\x00\x02"),
    25: image(SOF, segment(0xDC, b"\x00\x04")),
    26: image(segment(0xF7, bytes.fromhex("020000000301011100")), SOS),
    27: image(SOF, segment(0xDA, bytes.fromhex("010905000000"))),
    28: image(spiff_segment({"component_count": 1, "height": 4, "width": 3, "bits_per_sample": 2}), segment(0xE8, b"\0\0\0\x01\xff\xd8"), segment(0xF8, b"\x02\x01\x01abc"), data=b""),
    29: image(SOF, segment(0xF8, bytes.fromhex("040200000003"))),
    30: image(SOF, segment(0xF8, bytes.fromhex("040200040000"))),
    31: image(segment(0xF7, bytes.fromhex("110004000301011100"))),
    32: image(segment(0xF7, bytes.fromhex("020004000300"))),
    33: image(SOF, segment(0xDA, bytes.fromhex("010100000200"))),
    34: image(SOF, segment(0xDA, bytes.fromhex("010100020000"))),
    35: image(SOF, segment(0xF8, bytes.fromhex("0100030009000000000000")), SOS),
    36: image(segment(0xE8, b"mrfx\x06")),
    37: image(segment(0xF8, b"\x02\x00\x01")),
    38: image(segment(0xF8, b"\x03\x01\x01")),
}
