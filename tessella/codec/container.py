"""The marker-segment container: writing, parsing and whole-image coding."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from tessella import __version__
from tessella.codec.scan import LINE, PLANAR, SAMPLE, Presets, decode_scan, encode_scan, entropy_end, is_default, resolve_presets
from tessella.functions.errors import JlsError

#: Marker codes.
SOI, EOI, SOS, DNL, DRI, SOF55, LSE, APP8, COM = 0xD8, 0xD9, 0xDA, 0xDC, 0xDD, 0xF7, 0xF8, 0xE8, 0xFE
OTHER_FRAMES = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})
NAMES = {SOI: "SOI", EOI: "EOI", SOS: "SOS", DNL: "DNL", DRI: "DRI", SOF55: "SOF55", LSE: "LSE", COM: "COM"}
NAMES |= {0xE0 + i: f"APP{i}" for i in range(16)} | {0xD0 + i: f"RST{i}" for i in range(8)}
SPIFF_MAGIC = b"SPIFF\0"
TRANSFORM_MAGIC = b"mrfx"
LARGEST_SIDE = 100_000
#: Bytes of samples that decoding accepts unless told otherwise: three components of 7680 x 4320.
LARGEST_IMAGE = 7680 * 4320 * 3
TABLE_CHUNK = 65530
INTERCHANGE, ABBREVIATED_IMAGE, ABBREVIATED_TABLES = 1, 2, 3
OPTION_EVEN_SIZE, OPTION_VERSION_COMMENT, OPTION_PRESETS_OVER_12_BITS = 1, 2, 4


@dataclass(frozen=True)
class Scan:
    """Parameters of one scan: how many of the frame's components it takes, in order, and how it codes them."""

    components: int = 1
    near: int = 0
    ilv: int = PLANAR
    presets: Presets = Presets()
    table_ids: tuple[int, ...] = ()


@dataclass
class Options:
    """What encode() writes besides the samples."""

    near: int = 0
    ilv: int = PLANAR
    transform: int = 0
    presets: Presets = Presets()
    options: int = 0
    table_ids: tuple[int, ...] = ()
    spiff: dict[str, int] | None = None
    spiff_entries: Sequence[tuple[int, bytes]] = ()
    comments: Sequence[bytes] = ()
    application_data: Sequence[tuple[int, bytes]] = ()
    mapping_tables: Sequence[tuple[int, int, bytes]] = ()
    scans: Sequence[Scan] = ()
    restart_interval: int = 0
    strict: bool = False
    max_bytes: int | None = None


def segment(marker: int, payload: bytes) -> bytes:
    if len(payload) > 65533:
        raise JlsError("invalid_argument_size")
    return struct.pack(">BBH", 0xFF, marker, len(payload) + 2) + payload


def spiff_segment(h: dict[str, int]) -> bytes:
    body = struct.pack(
        ">BBBBIIBBBBII",
        2, 0, h.get("profile_id", 0), h["component_count"], h["height"], h["width"], h.get("color_space", 2), h["bits_per_sample"],
        h.get("compression_type", 6), h.get("resolution_units", 0), h.get("vertical_resolution", 1), h.get("horizontal_resolution", 1),
    )
    return segment(APP8, SPIFF_MAGIC + body)


def mapping_table_segments(table_id: int, entry_size: int, data: bytes) -> bytes:
    """The table's specification, and continuations for what does not fit into it."""
    if not 1 <= table_id <= 255 or not 1 <= entry_size <= 255:
        raise JlsError("invalid_argument")
    pieces = [data[i : i + TABLE_CHUNK] for i in range(0, len(data), TABLE_CHUNK)] or [b""]
    return b"".join(segment(LSE, bytes([2 if i == 0 else 3, table_id, entry_size]) + p) for i, p in enumerate(pieces))


def presets_segment(p: Presets) -> bytes:
    return segment(LSE, struct.pack(">BHHHHH", 1, p.maxval, p.t1, p.t2, p.t3, p.reset))


def check_frame(width: int, height: int, bits: int, components: int) -> None:
    for ok, name in ((1 <= width <= LARGEST_SIDE, "width"), (1 <= height <= LARGEST_SIDE, "height"), (2 <= bits <= 16, "bits_per_sample"), (1 <= components <= 255, "component_count")):
        if not ok:
            raise JlsError(f"invalid_argument_{name}")


def check_interleave(components: int, ilv: int, split: bool = False) -> None:
    """split: the components are dealt to several scans."""
    if ilv not in (PLANAR, LINE, SAMPLE) or (ilv != PLANAR and (components == 1 or (components > 4 and not split))):
        raise JlsError("invalid_argument_interleave_mode")


def check_near(near: int, maxval: int) -> None:
    if not 0 <= near <= min(255, maxval // 2):
        raise JlsError("invalid_argument_near_lossless")


def transform_allowed(components: int, bits: int, near: int, ilv: int) -> bool:
    return components == 3 and bits in (8, 16) and near == 0 and ilv != PLANAR


def transform_planes(planes: np.ndarray, kind: int, bits: int, inverse: bool = False) -> np.ndarray:
    """HP1, HP2 or HP3 (1..3) of three planes, or its inverse."""
    a, b, c = (p.astype(np.int64) for p in planes)
    top, half, quarter = (1 << bits) - 1, 1 << (bits - 1), 1 << (bits - 2)
    if kind == 3:
        if inverse:
            g = (a - ((b + c) >> 2) + quarter) & top
            return np.stack([(c + g - half) & top, g, (b + g - half) & top])
        v2, v3 = (c - b + half) & top, (a - b + half) & top
        return np.stack([(b + ((v2 + v3) >> 2) - quarter) & top, v2, v3])
    if inverse:
        r = (a + b - half) & top
        return np.stack([r, b, (c + (b if kind == 1 else (r + b) >> 1) - half) & top])
    return np.stack([(a - b + half) & top, b, (c - (b if kind == 1 else (a + b) >> 1) + half) & top])


def _misc(o: Options, frame: tuple[int, int, int, int] | None) -> bytes:
    out = b""
    if o.spiff is not None:
        w, h, bits, n = frame or (o.spiff["width"], o.spiff["height"], o.spiff["bits_per_sample"], o.spiff["component_count"])
        out += spiff_segment({"width": w, "height": h, "bits_per_sample": bits, "component_count": n, "color_space": 8 if n == 1 else 10} | o.spiff)
        for tag, data in o.spiff_entries:
            if tag == 1 or len(data) > 65528:
                raise JlsError("invalid_argument" if tag == 1 else "invalid_argument_size")
            out += segment(APP8, struct.pack(">I", tag) + data)
        out += segment(APP8, b"\0\0\0\x01\xff\xd8")
    if o.options & OPTION_VERSION_COMMENT:
        out += segment(COM, f"tessella {__version__}\0".encode())
    out += b"".join(segment(COM, c) for c in o.comments)
    for number, data in o.application_data:
        if not 0 <= number <= 15:
            raise JlsError("invalid_argument")
        out += segment(0xE0 + number, data)
    return out + b"".join(mapping_table_segments(*t) for t in o.mapping_tables)


def encode(planes: np.ndarray, bits: int, o: Options = Options()) -> bytes:
    """An image file of planes (component, y, x)."""
    n, height, width = planes.shape
    check_frame(width, height, bits, n)
    if not 0 <= o.options <= 7:
        raise JlsError("invalid_argument_encoding_options")
    check_interleave(n, o.ilv, bool(o.scans))
    scans = list(o.scans) or ([Scan(1, o.near, PLANAR, o.presets)] * n if o.ilv == PLANAR else [Scan(n, o.near, o.ilv, o.presets)])
    if sum(s.components for s in scans) != n:
        raise JlsError("invalid_argument_component_count")
    if not 0 <= o.transform <= 3 or (o.transform and not all(transform_allowed(n, bits, s.near, s.ilv) for s in scans)):
        raise JlsError("invalid_argument_color_transformation")
    top = (1 << bits) - 1
    resolved = []
    for s in scans:
        if (s.components == 1) != (s.ilv == PLANAR) or s.components > 4:
            raise JlsError("invalid_argument_interleave_mode")
        check_near(s.near, s.presets.maxval or top)
        presets = resolve_presets(s.presets, top, s.near)
        if presets is None:
            raise JlsError("invalid_argument_jpegls_pc_parameters")
        resolved.append(presets)
    out = bytearray(b"\xff\xd8" + _misc(o, (width, height, bits, n)))
    if o.transform:
        out += segment(APP8, TRANSFORM_MAGIC + bytes([o.transform]))
    large = width > 65535 or height > 65535
    out += segment(SOF55, struct.pack(">BHHB", bits, 0 if large else height, 0 if large else width, n) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    if large:
        out += segment(LSE, struct.pack(">BBII", 4, 4, height, width))
    if not is_default(scans[0].presets, top, scans[0].near) or (o.options & OPTION_PRESETS_OVER_12_BITS and bits > 12):
        out += presets_segment(resolved[0])
    if o.restart_interval:
        out += segment(DRI, struct.pack(">I", o.restart_interval))
    values = planes.astype(np.int64) & top
    if o.transform:
        values = transform_planes(planes, o.transform, bits)
    first = 0
    for s, presets in zip(scans, resolved, strict=True):
        ids = range(first, first + s.components)
        tables = s.table_ids or o.table_ids[first : first + s.components]
        selectors = b"".join(bytes([i + 1, tables[i - first] if i - first < len(tables) else 0]) for i in ids)
        out += segment(SOS, bytes([s.components]) + selectors + bytes([s.near, s.ilv, 0]))
        out += encode_scan([values[i] for i in ids], bits, s.near, s.ilv, presets, o.restart_interval, o.strict)
        first += s.components
    if o.options & OPTION_EVEN_SIZE and len(out) % 2:
        out += b"\xff"
    if o.max_bytes is not None and len(out) + 2 > o.max_bytes:
        raise JlsError("destination_too_small")
    return bytes(out + b"\xff\xd9")


def encode_tables(o: Options) -> bytes:
    """An abbreviated file of tables and other segments, without an image."""
    body = _misc(o, None)
    if not body:
        raise JlsError("invalid_operation")
    end = b"\xff" if o.options & OPTION_EVEN_SIZE and len(body) % 2 else b""
    return b"\xff\xd8" + body + end + b"\xff\xd9"


@dataclass
class ScanInfo:
    component_indices: list[int]
    table_ids: list[int]
    near: int
    ilv: int
    offset: int
    presets: Presets
    restart_interval: int


@dataclass
class Header:
    width: int = 0
    height: int = 0
    bits: int = 0
    components: list[dict[str, int]] = field(default_factory=list)
    presets: Presets = Presets()
    transform: int = 0
    restart_interval: int = 0
    spiff: dict[str, int] | None = None
    data_format: int = 0
    mapping_tables: list[dict[str, Any]] = field(default_factory=list)


def read_uint(data: bytes) -> int:
    return int.from_bytes(data, "big")


class Reader:
    """Parses a file segment by segment.  segments: (offset, marker, payload)."""

    def __init__(self, content: bytes):
        self.data, self.at = bytes(content), 0
        self.header, self.segments = Header(), []
        self.frame_seen = self.in_spiff = self.spiff_done = self.ended = False
        self.coded = 0

    # Markers and segments.

    def marker(self) -> int:
        data = self.data
        if self.at >= len(data):
            raise JlsError("need_more_data")
        if data[self.at] != 0xFF:
            raise JlsError("jpeg_marker_start_byte_not_found")
        while self.at < len(data) and data[self.at] == 0xFF:
            self.at += 1
        if self.at >= len(data):
            raise JlsError("need_more_data")
        self.at += 1
        return data[self.at - 1]

    def payload(self) -> bytes:
        if self.at + 2 > len(self.data):
            raise JlsError("need_more_data")
        size = read_uint(self.data[self.at : self.at + 2])
        if size < 2:
            raise JlsError("invalid_marker_segment_size")
        if self.at + size > len(self.data):
            raise JlsError("need_more_data")
        body = self.data[self.at + 2 : self.at + size]
        self.at += size
        return body

    def read_header(self) -> Header:
        """Everything up to the first scan's coded data, or to the end of a file of tables."""
        if self.marker() != SOI:
            raise JlsError("start_of_image_marker_not_found")
        self.segments.append((0, SOI, b""))
        self.until_scan()
        return self.header

    def until_scan(self) -> ScanInfo | None:
        """Reads segments up to and with the next SOS; None at the end of a file of tables."""
        while True:
            offset = self.at
            marker = self.marker()
            if marker == EOI:
                return self._end_without_scan(offset)
            self.check(marker)
            body = self.payload()
            self.segments.append((offset, marker, body))
            if self.in_spiff and marker != APP8:
                raise JlsError("missing_end_of_spiff_directory")
            if marker == SOF55:
                self._frame(body)
            elif marker == LSE:
                self._preset(body)
            elif marker == DRI:
                if len(body) not in (2, 3, 4):
                    raise JlsError("invalid_marker_segment_size")
                self.header.restart_interval = read_uint(body)
            elif marker == DNL:
                self._lines(body)
            elif marker == APP8:
                self._app8(body)
            elif marker == SOS:
                self.scan = self._scan(body)
                return self.scan

    def check(self, marker: int) -> None:
        """What may stand between segments here."""
        if marker == SOI:
            raise JlsError("duplicate_start_of_image_marker")
        if marker == SOS and not self.frame_seen:
            raise JlsError("unexpected_start_of_scan_marker")
        if marker == SOF55 and self.frame_seen:
            raise JlsError("duplicate_start_of_frame_marker")
        if marker == DNL and not self.coded:
            raise JlsError("unexpected_define_number_of_lines_marker")
        if marker in OTHER_FRAMES:
            raise JlsError("encoding_not_supported")
        if 0xD0 <= marker <= 0xD7:
            raise JlsError("unexpected_restart_marker")
        if marker not in NAMES:
            raise JlsError("unknown_jpeg_marker_found")

    def _end_without_scan(self, offset: int) -> None:
        h = self.header
        if self.frame_seen or self.in_spiff or not h.mapping_tables:
            raise JlsError("unexpected_end_of_image_marker")
        if h.spiff is not None:
            raise JlsError("abbreviated_format_and_spiff_header_mismatch")
        self.segments.append((offset, EOI, b""))
        h.data_format, self.ended = ABBREVIATED_TABLES, True

    # Segment bodies.

    def _size(self, ok: bool) -> None:
        if not ok:
            raise JlsError("invalid_marker_segment_size")

    def _dimension(self, name: str, value: int) -> None:
        """Sets a side once; 0 leaves it open."""
        if value:
            if getattr(self.header, name):
                raise JlsError(f"invalid_parameter_{name}")
            setattr(self.header, name, value)

    def _frame(self, body: bytes) -> None:
        self._size(len(body) >= 6)
        bits, height, width, n = struct.unpack(">BHHB", body[:6])
        if not 2 <= bits <= 16:
            raise JlsError("invalid_parameter_bits_per_sample")
        self._dimension("height", height)
        self._dimension("width", width)
        if n < 1:
            raise JlsError("invalid_parameter_component_count")
        self._size(len(body) == 6 + 3 * n)
        self.header.bits = bits
        for i in range(n):
            number, sampling = body[6 + 3 * i], body[7 + 3 * i]
            if any(c["id"] == number for c in self.header.components):
                raise JlsError("duplicate_component_id_in_sof_segment")
            if sampling != 0x11:
                raise JlsError("parameter_value_not_supported")
            self.header.components.append({"id": number, "near": 0, "table_id": 0, "ilv": 0})
        self.frame_seen = True

    def _preset(self, body: bytes) -> None:
        self._size(len(body) >= 1)
        kind = body[0]
        if kind == 1:
            self._size(len(body) == 11)
            self.header.presets = Presets(*struct.unpack(">HHHHH", body[1:]))
        elif kind in (2, 3):
            self._size(len(body) >= 3)
            self._table(kind, body[1], body[2], body[3:])
        elif kind == 4:
            self._size(len(body) >= 2)
            width = body[1]
            if width not in (2, 3, 4):
                raise JlsError("invalid_parameter_jpegls_preset_parameters")
            self._size(len(body) == 2 + 2 * width)
            self._dimension("height", read_uint(body[2 : 2 + width]))
            self._dimension("width", read_uint(body[2 + width :]))
        elif 5 <= kind <= 13:
            raise JlsError("jpegls_preset_extended_parameter_type_not_supported")
        else:
            raise JlsError("invalid_jpegls_preset_parameter_type")

    def _table(self, kind: int, number: int, entry_size: int, data: bytes) -> None:
        tables = self.header.mapping_tables
        known = next((t for t in tables if t["table_id"] == number), None)
        if kind == 2:
            if number == 0 or known:
                raise JlsError("invalid_parameter_mapping_table_id")
            tables.append({"table_id": number, "entry_size": entry_size, "data": data})
        elif known is None or known["entry_size"] != entry_size:
            raise JlsError("invalid_parameter_mapping_table_continuation")
        else:
            known["data"] += data

    def _lines(self, body: bytes) -> None:
        if len(body) not in (2, 3, 4):
            raise JlsError("invalid_marker_segment_size")
        if self.expected_lines is None or read_uint(body) != self.header.height:
            raise JlsError("unexpected_define_number_of_lines_marker")

    expected_lines: int | None = None

    def _app8(self, body: bytes) -> None:
        if self.in_spiff:
            if len(body) >= 4 and read_uint(body[:4]) == 1:
                self._size(len(body) == 6)
                self.in_spiff = False
            return
        if len(body) == 5 and body[:4] == TRANSFORM_MAGIC:
            if body[4] in (4, 5):
                raise JlsError("color_transform_not_supported")
            if body[4] > 5:
                raise JlsError("invalid_parameter_color_transformation")
            self.header.transform = body[4]
        elif len(self.segments) == 2 and len(body) >= 28 and body[:6] == SPIFF_MAGIC and body[6] <= 2:
            names = "profile_id component_count height width color_space bits_per_sample compression_type resolution_units vertical_resolution horizontal_resolution".split()
            self.header.spiff = dict(zip(names, struct.unpack(">BBIIBBBBII", body[8:30].ljust(22, b"\0")), strict=True))
            self.in_spiff = True

    def _scan(self, body: bytes) -> ScanInfo:
        h = self.header
        self._size(len(body) >= 1)
        n = body[0]
        if not 1 <= n <= min(4, len(h.components) - self.coded):
            raise JlsError("invalid_parameter_component_count")
        self._size(len(body) == 2 * n + 4)
        near, ilv, point = body[-3:]
        top = (1 << h.bits) - 1
        if near > min(255, (h.presets.maxval or top) // 2):
            raise JlsError("invalid_parameter_near_lossless")
        if ilv > 2 or (n == 1 and ilv != PLANAR) or (n > 1 and ilv == PLANAR):
            raise JlsError("invalid_parameter_interleave_mode")
        if point & 0x0F:
            raise JlsError("parameter_value_not_supported")
        indices, tables = [], []
        for i in range(n):
            number, table = body[1 + 2 * i], body[2 + 2 * i]
            at = next((j for j, c in enumerate(h.components) if c["id"] == number), None)
            if at is None:
                if near or ilv or table:
                    raise JlsError("unknown_component_id")
                at = min(self.coded + i, len(h.components) - 1)  # a scan of default values names nothing
            else:
                h.components[at] |= {"near": near, "table_id": table, "ilv": ilv}
            indices.append(at)
            tables.append(table)
        if h.height == 0:
            self._look_for_lines()
        if h.width == 0:
            raise JlsError("invalid_parameter_width")
        if h.transform and not transform_allowed(len(h.components), h.bits, near, ilv):
            raise JlsError("invalid_parameter_color_transformation")
        presets = resolve_presets(h.presets, top, near)
        if presets is None:
            raise JlsError("invalid_parameter_jpegls_preset_parameters")
        self.coded += n
        return ScanInfo(indices, tables, near, ilv, self.at, presets, h.restart_interval)

    def _look_for_lines(self) -> None:
        """The number of lines stands behind the first scan."""
        end = entropy_end(self.data, self.at)
        if self.data[end : end + 2] != bytes([0xFF, DNL]):
            raise JlsError("define_number_of_lines_marker_not_found")
        ahead = Reader(self.data)
        ahead.at = end + 2
        body = ahead.payload()
        if len(body) not in (2, 3, 4):
            raise JlsError("invalid_marker_segment_size")
        if read_uint(body) == 0:
            raise JlsError("invalid_parameter_height")
        self.header.height = self.expected_lines = read_uint(body)

    def next_scan(self, at: int) -> ScanInfo | None:
        """After a scan that ended at `at`: the next one, or None when all components are coded and the file ends."""
        self.at = at
        if self.coded < len(self.header.components):
            return self.until_scan()
        if self.expected_lines is not None and self.data[self.at : self.at + 2] == bytes([0xFF, DNL]):
            offset = self.at
            self.marker()
            self.segments.append((offset, DNL, self.payload()))
        if self.data[self.at : self.at + 1] == b"\0":
            self.at += 1
        offset = self.at
        if self.at >= len(self.data):
            raise JlsError("need_more_data")
        if self.data[self.at] != 0xFF or self.marker() != EOI:
            raise JlsError("end_of_image_marker_not_found")
        self.segments.append((offset, EOI, b""))
        defined = {t["table_id"] for t in self.header.mapping_tables}
        used = {c["table_id"] for c in self.header.components if c["table_id"]}
        self.header.data_format = INTERCHANGE if used <= defined else ABBREVIATED_IMAGE
        self.ended = True
        return None


def read_header(content: bytes) -> Header:
    return Reader(content).read_header()


def coded_end(data: bytes, at: int) -> int:
    """Where a scan's coded data ends, restart markers (and fill bytes before them) skipped."""
    end = entropy_end(data, at)
    while end < len(data):
        marker = end
        while data[marker : marker + 1] == b"\xff":
            marker += 1
        if marker >= len(data) or not 0xD0 <= data[marker] <= 0xD7:
            break
        end = entropy_end(data, marker + 1)
    return end


def read_all(content: bytes) -> tuple[Header, list[tuple[int, int, bytes]], list[ScanInfo]]:
    """Header, segments and scans, without decoding samples: coded data is skipped to the marker that ends it."""
    reader = Reader(content)
    header, scans = reader.read_header(), []
    scan = None if reader.ended else reader.scan
    while scan is not None:
        scans.append(scan)
        scan = reader.next_scan(coded_end(reader.data, scan.offset))
    return header, reader.segments, scans


def _check_size(header: Header, max_bytes: int | None) -> None:
    if max_bytes is not None and header.width * header.height * len(header.components) * ((header.bits + 7) // 8) > max_bytes:
        raise JlsError("not_enough_memory")


def decode(content: bytes, max_bytes: int | None = None, strict: bool = False) -> tuple[Header, np.ndarray]:
    """Header and planes (component, y, x) of an image file."""
    reader = Reader(content)
    header = reader.read_header()
    if reader.ended:
        raise JlsError("invalid_operation")
    n = len(header.components)
    _check_size(header, max_bytes)
    planes = np.zeros((n, header.height, header.width), np.int32)
    scan: ScanInfo | None = reader.scan
    while scan is not None:
        found, end = decode_scan(reader.data, scan.offset, len(scan.component_indices), header.width, header.height, header.bits, scan.near, scan.ilv, scan.presets, scan.restart_interval, strict)
        planes[scan.component_indices] = found
        scan = reader.next_scan(end)
    if header.transform:
        planes = transform_planes(planes, header.transform, header.bits, inverse=True).astype(np.int32)
    return header, planes


def intervals(content: bytes, max_bytes: int | None = None) -> list[dict[str, Any]]:
    """Every restart interval of every scan, with what its decoding needs; markers between them must count up from RST0."""
    header, _, scans = read_all(content)
    _check_size(header, max_bytes)
    out = []
    for s in scans:
        at, y, number = s.offset, 0, 0
        step = s.restart_interval or header.height
        while y < header.height:
            end = entropy_end(content, at)
            out.append({"components": s.component_indices, "y0": y, "height": min(step, header.height - y), "width": header.width, "bits": header.bits, "near": s.near, "ilv": s.ilv, "transform": header.transform, "pc": [*s.presets.__dict__.values()], "data": content[at:end]})
            y += step
            if y < header.height:
                at = end
                while content[at : at + 1] == b"\xff":  # fill bytes may stand before a marker
                    at += 1
                if at == end or content[at : at + 1] != bytes([0xD0 + number % 8]):
                    raise JlsError("restart_marker_not_found")
                at, number = at + 1, number + 1
    return out


def decode_interval(data: bytes, r: dict[str, Any]) -> np.ndarray:
    """Planes of one of intervals()."""
    planes, _ = decode_scan(data + b"\xff\xd9", 0, len(r["components"]), r["width"], r["height"], r["bits"], r["near"], r["ilv"], Presets(*r["pc"]))
    return transform_planes(planes, r["transform"], r["bits"], inverse=True).astype(np.int32) if r["transform"] else planes


def to_planes(buffer: bytes, width: int, height: int, bits: int, components: int, ilv: int, stride: int = 0) -> np.ndarray:
    """Planes of a raw buffer: planar for ilv 0, else pixel by pixel; samples over eight bits are little-endian 16-bit."""
    kind = np.dtype("u1") if bits <= 8 else np.dtype("<u2")
    line = width * kind.itemsize * (1 if ilv == PLANAR else components)
    rows = height * (components if ilv == PLANAR else 1)
    if stride and stride < line:
        raise JlsError("invalid_argument_stride")
    stride = stride or line
    if len(buffer) < stride * rows - (stride - line):
        raise JlsError("invalid_argument_size")
    raw = np.frombuffer(buffer.ljust(stride * rows, b"\0")[: stride * rows], np.uint8).reshape(rows, stride)[:, :line]
    values = np.ascontiguousarray(raw).view(kind)
    if ilv == PLANAR:
        return values.reshape(components, height, width)
    return values.reshape(height, width, components).transpose(2, 0, 1)


def from_planes(planes: np.ndarray, bits: int, ilv: int, stride: int = 0) -> bytes:
    """The raw buffer of planes, in the layout of to_planes; the last line is not padded to the stride."""
    values = planes if ilv == PLANAR else planes.transpose(1, 2, 0)
    raw = np.ascontiguousarray(values.astype("u1" if bits <= 8 else "<u2"))
    rows = raw.view(np.uint8).reshape(planes.shape[0] * planes.shape[1] if ilv == PLANAR else planes.shape[1], -1)
    if not stride or stride == rows.shape[1]:
        return rows.tobytes()
    if stride < rows.shape[1]:
        raise JlsError("invalid_argument_stride")
    padded = np.zeros((len(rows), stride), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.tobytes()[: stride * len(rows) - (stride - rows.shape[1])]
