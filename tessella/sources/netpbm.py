"""PNM (P5, P6) and PAM (P7) files, and 24-bit BMP, as planes."""

from __future__ import annotations

import struct

import numpy as np


def _samples(raw: bytes, width: int, height: int, n: int, maxval: int, order: str) -> np.ndarray:
    kind = np.dtype("u1") if maxval < 256 else np.dtype(f"{order}u2")
    need = width * height * n * kind.itemsize
    if len(raw) < need:
        raise ValueError("the file ends before its last sample")
    return np.frombuffer(raw[:need], kind).reshape(height, width, n).transpose(2, 0, 1).astype(np.int32)


def read_pnm(data: bytes) -> tuple[np.ndarray, int]:
    """Planes and bits a sample.  A header line is read up to its first token that is no positive integer, so comments are skipped; samples over eight bits are big-endian."""
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("no binary PGM or PPM file")
    numbers, at = [], 2
    while len(numbers) < 3:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the header ends early")
        for token in data[at:end].split():
            if not token.isdigit() or int(token) <= 0:
                break
            numbers.append(int(token))
        at = end + 1
    width, height, maxval = numbers[:3]
    return _samples(data[at:], width, height, 1 if data[:2] == b"P5" else 3, maxval, ">"), maxval.bit_length()


def write_pnm(planes: np.ndarray, bits: int) -> bytes:
    n, height, width = planes.shape
    if n not in (1, 3):
        raise ValueError("only images of 1 or 3 components have a PNM form")
    head = f"P{5 if n == 1 else 6}\n{width} {height}\n{(1 << bits) - 1}\n".encode()
    return head + planes.transpose(1, 2, 0).astype("u1" if bits <= 8 else ">u2").tobytes()


def read_pam(data: bytes, big_endian: bool = True) -> tuple[np.ndarray, int]:
    """Planes and bits a sample.  Samples over eight bits are big-endian as the format has them."""
    if not data.startswith(b"P7"):
        raise ValueError("no PAM file")
    head, mark, body = data.partition(b"ENDHDR\n")
    if not mark:
        raise ValueError("the header ends early")
    fields = {t[0]: t[1] for line in head.split(b"\n")[1:] if len(t := line.split()) >= 2 and not t[0].startswith(b"#")}
    width, height, n, maxval = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    return _samples(body, width, height, n, maxval, ">" if big_endian else "<"), maxval.bit_length()


def write_pam(planes: np.ndarray, bits: int) -> bytes:
    n, height, width = planes.shape
    kind = {1: "GRAYSCALE", 2: "GRAYSCALE_ALPHA", 3: "RGB", 4: "RGB_ALPHA"}.get(n, "")
    head = f"P7\nWIDTH {width}\nHEIGHT {height}\nDEPTH {n}\nMAXVAL {(1 << bits) - 1}\n" + (f"TUPLTYPE {kind}\n" if kind else "") + "ENDHDR\n"
    return head.encode() + planes.transpose(1, 2, 0).astype("u1" if bits <= 8 else ">u2").tobytes()


def read_bmp(data: bytes) -> tuple[np.ndarray, int]:
    """Uncompressed 24-bit images: bottom-up unless the height is negative, lines padded to four bytes, BGR."""
    if data[:2] != b"BM":
        raise ValueError("no BMP file")
    (offset,), (head, width, height, _, depth, compression) = struct.unpack("<I", data[10:14]), struct.unpack("<IiiHHI", data[14:34])
    if head < 40 or depth != 24 or compression:
        raise ValueError("only uncompressed 24-bit images are read")
    stride, lines = (width * 3 + 3) // 4 * 4, abs(height)
    if len(data) < offset + stride * lines:
        raise ValueError("the file ends before its last sample")
    raw = np.frombuffer(data[offset : offset + stride * lines], np.uint8).reshape(lines, stride)[:, : width * 3].reshape(lines, width, 3)
    return (raw[::-1] if height > 0 else raw)[:, :, ::-1].transpose(2, 0, 1).astype(np.int32), 8
