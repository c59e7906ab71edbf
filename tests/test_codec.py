"""Scan coder and container: golden vectors, round trips, one malformed file for each error."""

import numpy as np
import pytest

from tessella.codec.container import Options, Reader, Scan, decode, encode, encode_tables, from_planes, read_all, read_header, segment, to_planes, transform_planes
from tessella.codec.scan import Presets, default_presets, is_default, resolve_presets, stuff, unstuff
from tessella.functions.errors import CODES, JlsError
from tessella.plans.malformed import BAD, SOS, image

H45 = bytes.fromhex("ffd8 fff7000b0200040003010111 00 fff8001102 0503 ffffff ff0000 00ff00 0000ff ffda000801010500 0000 db95f0 ffd9".replace(" ", ""))
H45_PIXELS = [[[0, 0, 1], [1, 1, 2], [2, 2, 3], [3, 3, 3]]]


def test_standard_example():
    header, planes = decode(H45)
    assert planes.tolist() == H45_PIXELS
    assert header.mapping_tables == [{"table_id": 5, "entry_size": 3, "data": bytes.fromhex("ffffffff000000ff000000ff")}]
    assert header.data_format == 1 and header.components[0]["table_id"] == 5
    out = encode(np.array(H45_PIXELS), 2, Options(table_ids=(5,), mapping_tables=[(5, 3, header.mapping_tables[0]["data"])]))
    assert len(out) == len(H45) and b"\xdb\x95\xf0\xff\xd9" == out[-5:] and decode(out)[1].tolist() == H45_PIXELS


@pytest.mark.parametrize("kind", (1, 2, 3))
@pytest.mark.parametrize("bits", (8, 16))
def test_transforms_invert(kind, bits):
    p = np.random.default_rng(0).integers(0, 1 << bits, (3, 50, 50))
    assert (transform_planes(transform_planes(p, kind, bits), kind, bits, True) == p).all()
    assert transform_planes(np.array([[[200]], [[10]], [[55]]]), 3, 8).ravel().tolist() == [4, 173, 62]


@pytest.mark.parametrize("bits", range(2, 17))
def test_round_trips(bits):
    r = np.random.default_rng(bits)
    for n, ilv in ((1, 0), (3, 0), (3, 1), (3, 2), (2, 2), (4, 2)):
        smooth = np.abs(np.cumsum(r.integers(-1, 2, (n, 9, 14)), 2)) % (1 << bits)
        for planes in (r.integers(0, 1 << bits, (n, 9, 14)), smooth):
            for near in {0, min(2, ((1 << bits) - 1) // 2)}:
                header, got = decode(encode(planes, bits, Options(near=near, ilv=ilv)))
                assert abs(got - planes).max() <= near
                assert (header.width, header.height, header.bits, len(header.components)) == (14, 9, bits, n)


def test_restarts_mixed_scans_presets_and_options():
    r = np.random.default_rng(3)
    p = r.integers(0, 256, (4, 12, 10))
    assert (decode(encode(p[:3], 8, Options(ilv=2, restart_interval=5)))[1] == p[:3]).all()
    assert (decode(encode(p[:3], 8, Options(ilv=1, transform=2, restart_interval=1)))[1] == p[:3]).all()
    mixed = Options(scans=[Scan(1, 0), Scan(3, 0, 2)])
    assert (decode(encode(p, 8, mixed))[1] == p).all()
    near = decode(encode(p, 8, Options(scans=[Scan(1, 0), Scan(1, 2), Scan(2, 10, 1)])))[0]
    assert [c["near"] for c in near.components] == [0, 2, 10, 10]
    own = Options(presets=Presets(255, 9, 9, 9, 31))
    header, got = decode(encode(p[:1], 8, own))
    assert header.presets == Presets(255, 9, 9, 9, 31) and (got == p[:1]).all()
    even = encode(p[:1], 8, Options(options=3, comments=[b"hi"], application_data=[(3, b"x" * 10)]))
    assert len(even) % 2 == 0 and (decode(even)[1] == p[:1]).all()
    marks = [(m, b) for _, m, b in read_all(even)[1]]
    assert (0xFE, b"hi") in marks and (0xE3, b"x" * 10) in marks
    spiff = encode(p[:1], 8, Options(spiff={}, spiff_entries=[(3, b"note")]))
    assert decode(spiff)[0].spiff["width"] == 10


def test_large_mapping_table_and_abbreviated_file():
    data = bytes(range(256)) * 600
    out = encode_tables(Options(mapping_tables=[(7, 3, data)]))
    header = read_header(out)
    assert header.data_format == 3 and header.mapping_tables[0]["data"] == data
    assert [b[0] for _, m, b in Reader_segments(out) if m == 0xF8] == [2, 3, 3]
    with pytest.raises(JlsError):
        encode_tables(Options())


def Reader_segments(content):
    reader = Reader(content)
    reader.read_header()
    return reader.segments


def test_raw_layouts():
    p = np.random.default_rng(1).integers(0, 4096, (3, 4, 5))
    for ilv in (0, 1):
        raw = from_planes(p, 12, ilv)
        assert (to_planes(raw, 5, 4, 12, 3, ilv) == p).all()
    padded = b"".join(from_planes(p[:1, y : y + 1], 12, 0) + b"??" for y in range(4))
    assert (to_planes(padded, 5, 4, 12, 1, 0, stride=12)[0] == p[0]).all()
    with pytest.raises(JlsError):
        to_planes(b"", 5, 4, 12, 1, 0)


def test_stuffing():
    assert stuff("1" * 8) == b"\xff\x00" and stuff("1" * 15) == b"\xff\x7f" and stuff("") == b""
    bits = "".join(np.random.default_rng(2).choice(list("01111"), 4000))
    assert unstuff(stuff(bits))[: len(bits)] == bits


def test_parameters():
    assert default_presets(255, 0) == Presets(255, 3, 7, 21, 64)
    assert default_presets(3, 0) == Presets(3, 2, 3, 3 if default_presets(3, 0).t3 == 3 else 4, 64)
    assert is_default(Presets(), 255, 0) and is_default(Presets(255, 3, 7, 21, 64), 255, 0) and not is_default(Presets(t1=4), 255, 0)
    assert resolve_presets(Presets(t1=300), 255, 0) is None and resolve_presets(Presets(reset=2), 255, 0) is None


@pytest.mark.parametrize("errc", sorted(BAD))
def test_malformed_files(errc):
    with pytest.raises(JlsError) as e:
        decode(BAD[errc])
    assert e.value.errc == errc and str(e.value) == CODES[errc][1]


def test_number_of_lines_after_the_scan():
    late = image(segment(0xF7, bytes.fromhex("020000000301011100")), SOS, end=segment(0xDC, b"\x00\x04") + b"\xff\xd9")
    assert decode(late)[1].tolist() == H45_PIXELS


def test_bad_arguments():
    p = np.zeros((1, 2, 2), int)
    for bits, o, name in ((1, {}, 104), (8, {"near": 200}, 107), (8, {"ilv": 1}, 106), (8, {"transform": 1}, 109), (8, {"options": 9}, 112), (8, {"presets": Presets(t1=999)}, 108)):
        with pytest.raises(JlsError) as e:
            encode(p, bits, Options(**o))
        assert e.value.errc == name
    with pytest.raises(JlsError) as e:
        decode(H45, max_bytes=3)
    assert e.value.errc == 1
    with pytest.raises(JlsError) as e:
        encode(p, 8, Options(max_bytes=20))
    assert e.value.errc == 3
    with pytest.raises(JlsError) as e:
        from_planes(p, 8, 0, stride=1)
    assert e.value.errc == 111


TENS = bytes(range(10, 90, 10))
ONES = b"".join(bytes([v, 1]) for v in TENS)
PAIRS = bytes(12) + bytes([1, 10, 1, 20, 1, 30, 1, 40, 1, 50, 1, 60])
#: Total sizes of small images: raw buffer, width and height, bits, components, interleave, transform, bytes.
SIZES = [
    (TENS, 2, 7, 2, 0, 0, 58), (TENS, 2, 7, 2, 1, 0, 47), (TENS, 2, 7, 2, 2, 0, 47), (TENS, 2, 8, 2, 0, 0, 53), (TENS, 2, 8, 2, 1, 0, 43), (TENS, 2, 8, 2, 2, 0, 43),
    (ONES, 2, 15, 2, 0, 0, 52), (ONES, 2, 15, 2, 1, 0, 43), (ONES, 2, 15, 2, 2, 0, 43), (ONES, 2, 16, 2, 0, 0, 52), (ONES, 2, 16, 2, 1, 0, 44), (ONES, 2, 16, 2, 2, 0, 44),
    (bytes([0, 10, 0, 20, 0, 30, 0, 40]), 2, 16, 1, 0, 0, 36), (TENS[:6], 1, 16, 3, 0, 0, 66), (TENS[:6], 1, 16, 3, 1, 0, 45), (PAIRS, 2, 16, 3, 2, 0, 51),
    (TENS[:6], 1, 16, 3, 1, 1, 59), (TENS[:6], 1, 16, 3, 1, 2, 59), (TENS[:6], 1, 16, 3, 1, 3, 55), (TENS[:6], 1, 16, 3, 2, 1, 59), (TENS[:6], 1, 16, 3, 2, 2, 59), (TENS[:6], 1, 16, 3, 2, 3, 55),
    (TENS[:4], 1, 8, 4, 0, 0, 75), (TENS[:4], 1, 8, 4, 1, 0, 47), (TENS[:4], 1, 8, 4, 2, 0, 47),
]


@pytest.mark.parametrize("case", SIZES)
def test_golden_sizes(case):
    raw, side, bits, n, ilv, transform, size = case
    planes = to_planes(raw, side, side, bits, n, ilv)
    out = encode(planes, bits, Options(ilv=ilv, transform=transform))
    assert (decode(out)[1] == planes).all() and len(out) == size


@pytest.mark.parametrize("ilv", (0, 1, 2))
def test_strides(ilv):
    p = np.random.default_rng(4).integers(0, 256, (3, 4, 5))
    raw = from_planes(p, 8, ilv, stride=20)
    assert len(raw) == (20 * 12 - 15 if ilv == 0 else 20 * 4 - 5)
    assert (to_planes(raw, 5, 4, 8, 3, ilv, stride=20) == p).all()


@pytest.mark.parametrize("near", (0, 2))
def test_byte_of_padding_before_the_end(near):
    r = np.random.default_rng(3)
    for i in range(60):
        p = r.integers(0, 256, (1, r.integers(1, 6), r.integers(1, 9)))
        data = encode(p, 8, Options(near=near))
        assert (decode(data[:-2] + b"\0\xff\xd9")[1] == decode(data)[1]).all(), i
        with pytest.raises(JlsError):
            decode(data[:-2] + b"\0\0\0\xff\xd9")


def test_claims_of_a_header_are_bounded():
    data = encode(np.zeros((1, 4, 4), int), 8)
    with pytest.raises(JlsError) as e:
        decode(data, max_bytes=15)
    assert e.value.errc == 1 and decode(data, max_bytes=16)[1].shape == (1, 4, 4)


def test_restart_markers_are_checked():
    from tessella.codec.container import decode_interval, intervals

    p = np.arange(3 * 6 * 5).reshape(3, 6, 5) % 256
    data = encode(p, 8, Options(ilv=1, transform=2, restart_interval=2))
    parts = intervals(data)
    assert [x["y0"] for x in parts] == [0, 2, 4] and all((decode_interval(x["data"], x) == p[:, x["y0"] : x["y0"] + 2]).all() for x in parts)
    at = data.index(b"\xff\xd0")
    filled = data[:at] + b"\xff\xff" + data[at:]
    assert len(intervals(filled)) == 3 and (decode(filled)[1] == p).all()
    with pytest.raises(JlsError):
        intervals(data[:at] + b"\xff\xd3" + data[at + 2 :])
