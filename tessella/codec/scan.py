"""Coding of one scan: adaptive context model, Golomb codes, runs and bit stuffing (ISO/IEC 14495-1, Annex A)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tessella.functions.errors import JlsError

#: The run-length orders J.
RUN_ORDERS = (0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CONTEXTS = 365
PLANAR, LINE, SAMPLE = 0, 1, 2
LARGEST_ERROR = 65535
#: Sums of a context beyond this are no valid data.
LARGEST_SUM = 65536 * 256
#: Bits that a look-up of a whole code word reads.
LOOK = 12


@dataclass(frozen=True)
class Presets:
    """Preset coding parameters; zeros mean defaults."""

    maxval: int = 0
    t1: int = 0
    t2: int = 0
    t3: int = 0
    reset: int = 0


def default_presets(maxval: int, near: int) -> Presets:
    def bounded(value: int, low: int) -> int:
        return low if value > maxval or value < low else value

    if maxval >= 128:
        factor = (min(maxval, 4095) + 128) // 256
        raw = [factor + 2, factor * 4 + 3, factor * 17 + 4]
    else:
        factor = 256 // (maxval + 1)
        raw = [3 // factor, 7 // factor, 21 // factor]
    out, low = [], near + 1
    for value, weight, least in zip(raw, (3, 5, 7), (2, 3, 4), strict=True):
        value += weight * near
        low = bounded(value if maxval >= 128 else max(least, value), low)
        out.append(low)
    return Presets(maxval, *out, 64)


def resolve_presets(p: Presets, bits_max: int, near: int) -> Presets | None:
    """Zeros replaced by defaults; None if a value is invalid."""
    if p.maxval > bits_max or p.maxval < 0:
        return None
    maxval = p.maxval or bits_max
    d = default_presets(maxval, near)
    t1, t2, t3, reset = p.t1 or d.t1, p.t2 or d.t2, p.t3 or d.t3, p.reset or d.reset
    for given, value, low, high in ((p.t1, t1, near + 1, maxval), (p.t2, t2, t1, maxval), (p.t3, t3, t2, maxval), (p.reset, reset, 3, max(255, maxval))):
        if given and not low <= value <= high:
            return None
    return Presets(maxval, t1, t2, t3, reset)


def is_default(p: Presets, bits_max: int, near: int) -> bool:
    d = default_presets(bits_max, near)
    return all(x in (0, y) for x, y in zip((p.maxval, p.t1, p.t2, p.t3, p.reset), (d.maxval, d.t1, d.t2, d.t3, d.reset), strict=True))


@lru_cache(maxsize=16)
def gradient_levels(bits: int, near: int, p: Presets) -> tuple[list[int], list[int], list[int]]:
    """-4..4 for every gradient of samples of so many bits, times 81, 9 and 1; negative gradients are negative indices."""
    gradient = np.concatenate([np.arange(1 << bits), np.arange(-(1 << bits) + 1, 0)])
    size = np.abs(gradient)
    level = np.where(size >= p.t3, 4, np.where(size >= p.t2, 3, np.where(size >= p.t1, 2, np.where(size > near, 1, 0)))) * np.sign(gradient)
    return (level * 81).tolist(), (level * 9).tolist(), level.tolist()


@lru_cache(maxsize=16)
def golomb_table(k: int) -> dict[str, tuple[int, int]]:
    """(error, length) of the code words of parameter k that the next LOOK bits hold wholly."""
    table = {}
    for value in range(1, 1 << LOOK):
        high = LOOK - value.bit_length()
        size = high + 1 + k
        if size <= LOOK:
            mapped = (high << k) + (value >> (LOOK - size) & ((1 << k) - 1))
            table[format(value, f"0{LOOK}b")] = (-(mapped + 1 >> 1) if mapped & 1 else mapped >> 1), size
    return table


@lru_cache(maxsize=1 << 16)
def golomb_word(k: int, mapped: int, escape: int, qbpp: int) -> str:
    """The code word of a mapped error; `escape` zeros announce a plain binary one."""
    high = mapped >> k
    if high < escape:
        return "0" * high + "1" + (format(mapped & ((1 << k) - 1), f"0{k}b") if k else "")
    return "0" * escape + "1" + format((mapped - 1) & ((1 << qbpp) - 1), f"0{qbpp}b")


class Model:
    """The adaptive state of a scan, and what its parameters imply.

    RANGE and LIMIT follow from the bits of a sample, also when MAXVAL is
    smaller; `strict` takes MAXVAL instead.  RESET counts modulo 256.
    """

    def __init__(self, bits: int, near: int, presets: Presets, strict: bool = False):
        self.maxval = presets.maxval if strict else (1 << bits) - 1
        self.near, self.step = near, 2 * near + 1
        self.range = (self.maxval + 2 * near) // self.step + 1
        self.qbpp = (self.range - 1).bit_length()
        self.limit = 2 * (bits + max(8, bits))
        self.reset = presets.reset & 0xFF
        self.span = self.range * self.step
        self.half = (self.range + 1) // 2
        self.levels = gradient_levels(bits, near, presets)
        self.restart()

    def restart(self) -> None:
        first = max(2, (self.range + 32) // 64)
        #: A, B, C and N of every context.
        self.state: list[tuple[int, int, int, int]] = [(first, 0, 0, 1)] * CONTEXTS
        self.run_a, self.run_n, self.run_nn = [first, first], [1, 1], [0, 0]

    def context(self, ra: int, rb: int, rc: int, rd: int) -> int:
        one, two, three = self.levels
        return one[rd - rb] + two[rb - rc] + three[rc - ra]

    def error(self, difference: int) -> int:
        """The quantised difference within RANGE values around 0."""
        near, step = self.near, self.step
        if near:
            difference = (difference + near) // step if difference > 0 else -((near - difference) // step)
        if difference < 0:
            difference += self.range
        return difference - self.range if difference >= self.half else difference

    def sample(self, px: int, e: int) -> int:
        """The sample reconstructed from a prediction and an error."""
        value = px + e * self.step
        if value < -self.near:
            value += self.span
        elif value > self.maxval + self.near:
            value -= self.span
        return min(max(value, 0), self.maxval)

    def run_order(self, kind: int) -> int:
        k, n, a = 0, self.run_n[kind], self.run_a[kind] + (self.run_n[kind] >> 1) * kind
        while n << k < a:
            k += 1
            if k > 32:
                raise JlsError("invalid_data")
        return k

    def run_update(self, kind: int, e: int, mapped: int) -> None:
        if e < 0:
            self.run_nn[kind] += 1
        self.run_a[kind] += (mapped + 1 - kind) >> 1
        if self.run_n[kind] == self.reset:
            self.run_a[kind] >>= 1
            self.run_n[kind] >>= 1
            self.run_nn[kind] >>= 1
        self.run_n[kind] += 1


def stuff(bits: str) -> bytes:
    """Bytes of a bit string; after a byte 0xFF only seven bits follow, and the end is padded with zeros."""
    out, at, lead = bytearray(), 0, ""
    while at < len(bits) or lead:
        chunk = lead + bits[at : at + 2048 - len(lead)]
        size = (len(chunk) + 7) // 8
        raw = int(chunk.ljust(8 * size, "0"), 2).to_bytes(size, "big")
        whole = raw.find(b"\xff") + 1
        out += raw[:whole] if whole else raw
        at += 8 * (whole or 256) - len(lead)
        lead = "0" if whole else ""
    return bytes(out)


def unstuff(data: bytes) -> str:
    """The bit string of stuffed bytes."""
    if not data:
        return ""
    raw = np.frombuffer(data, np.uint8)
    bits = np.unpackbits(raw).reshape(-1, 8)
    keep = np.ones_like(bits, bool)
    keep[1:, 0] = raw[:-1] != 0xFF
    return (bits[keep] + 48).astype(np.uint8).tobytes().decode("ascii")


def entropy_end(data: bytes, at: int) -> int:
    """Where coded data ends: at a byte 0xFF before one with its top bit set, or at the end of the data."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] & 0x80:
            return at
        at += 1


class _Coder:
    """Walks the lines of a scan; Encoder and Decoder say how symbols and samples meet."""

    def __init__(self, model: Model):
        self.model, self.run_index = model, 0

    def lines(self, planes: Sequence[list[list[int]]], width: int, height: int, ilv: int, interval: int) -> None:
        """Codes planes[component][y][x] in place: the encoder leaves what a decoder would see, the decoder fills them."""
        count = len(planes)
        y = 0
        while y < height:
            last = min(height, y + interval) if interval else height
            indices = [0] * count
            before = [[0] * (width + 2) for _ in range(count)]
            self.model.restart()
            self.begin()
            for y in range(y, last):
                now = [[0] * (width + 2) for _ in range(count)]
                for old, new in zip(before, now, strict=True):
                    old[width + 1] = old[width]
                    new[0] = old[1]
                if ilv == SAMPLE:
                    self.run_index = indices[0]
                    self.pixels(before, now, [p[y] for p in planes], width)
                    indices[0] = self.run_index
                else:
                    for i in range(count):
                        self.run_index = indices[i]
                        self.line(before[i], now[i], planes[i][y], width)
                        indices[i] = self.run_index
                for plane, new in zip(planes, now, strict=True):
                    plane[y] = new[1 : width + 1]
                before = now
            y = last
            self.end(y < height)

    def line(self, before: list[int], now: list[int], samples: list[int], width: int) -> None:
        one, two, three = self.model.levels
        regular, x = self.regular, 1
        ra, rb, rc = now[0], before[1], before[0]
        while x <= width:
            rd = before[x + 1]
            q = one[rd - rb] + two[rb - rc] + three[rc - ra]
            if q:
                ra = now[x] = regular(q, ra, rb, rc, samples[x - 1])
                rc, rb = rb, rd
                x += 1
                continue
            length = self.run(width - x + 1, [ra], [samples], x - 1)
            now[x : x + length] = [ra] * length
            x += length
            if x <= width:
                now[x] = self.interruption(ra, before[x], samples[x - 1])
                self.run_index = max(0, self.run_index - 1)
                x += 1
                ra, rb, rc = now[x - 1], before[x], before[x - 1]

    def pixels(self, before: list[list[int]], now: list[list[int]], samples: list[list[int]], width: int) -> None:
        context, x, parts = self.model.context, 1, range(len(before))
        while x <= width:
            q = [context(now[i][x - 1], before[i][x], before[i][x - 1], before[i][x + 1]) for i in parts]
            if any(q):
                for i in parts:
                    now[i][x] = self.regular(q[i], now[i][x - 1], before[i][x], before[i][x - 1], samples[i][x - 1])
                x += 1
                continue
            ra = [now[i][x - 1] for i in parts]
            length = self.run(width - x + 1, ra, samples, x - 1)
            for i in parts:
                now[i][x : x + length] = [ra[i]] * length
            x += length
            if x <= width:
                for i in parts:
                    now[i][x] = self.interrupt(0, ra[i], before[i][x], samples[i][x - 1])
                self.run_index = max(0, self.run_index - 1)
                x += 1

    def interruption(self, ra: int, rb: int, x: int) -> int:
        return self.interrupt(int(abs(ra - rb) <= self.model.near), ra, rb, x)


class Encoder(_Coder):
    """Writes symbols; out holds a bit string for each restart interval."""

    def begin(self) -> None:
        self.words: list[str] = []
        self.regular = self._regular()

    def end(self, more: bool) -> None:
        self.parts = [*getattr(self, "parts", []), stuff("".join(self.words))]

    def code(self, k: int, mapped: int, limit: int) -> None:
        self.words.append(golomb_word(k, mapped, limit - self.model.qbpp - 1, self.model.qbpp))

    def _regular(self) -> Callable[[int, int, int, int, int], int]:
        """The coding of a regular sample: prediction, code word and update, in one piece and with all that stays the same bound."""
        m = self.model
        state, maxval, span, half, lossless, append = m.state, m.maxval, m.range, m.half, not m.near, self.words.append
        escape, qbpp, error, sample, step, reset = m.limit - m.qbpp - 1, m.qbpp, m.error, m.sample, m.step, m.reset

        def regular(q: int, ra: int, rb: int, rc: int, x: int) -> int:
            index = q if q >= 0 else -q
            a, b, c, n = state[index]
            if rc < ra:
                px = ra + rb - rc if rc > rb else ra if ra > rb else rb
            elif rc < rb:
                px = ra + rb - rc
            else:
                px = ra if ra < rb else rb
            px += c if q >= 0 else -c
            if px < 0:
                px = 0
            elif px > maxval:
                px = maxval
            e = x - px if q >= 0 else px - x
            if lossless:
                if e < 0:
                    e += span
                if e >= half:
                    e -= span
            else:
                e = error(e)
            k = ((a - 1) // n).bit_length() if a else 0
            if k > 15:
                raise JlsError("invalid_data")
            folded = ~e if k == 0 and lossless and 2 * b + n <= 0 else e
            append(golomb_word(k, 2 * folded if folded >= 0 else -2 * folded - 1, escape, qbpp))
            a += e if e >= 0 else -e
            b += e * step
            if a >= LARGEST_SUM or not -LARGEST_SUM < b < LARGEST_SUM:
                raise JlsError("invalid_data")
            if n == reset:
                a >>= 1
                b >>= 1
                n >>= 1
            n += 1
            if b > 0:
                b -= n
                if b > 0:
                    b = 0
                if c < 127:
                    c += 1
            elif b + n <= 0:
                b += n
                if b <= -n:
                    b = 1 - n
                if c > -128:
                    c -= 1
            state[index] = a, b, c, n
            return x if lossless else sample(px, e if q >= 0 else -e)

        return regular

    def run(self, left: int, ra: list[int], samples: list[list[int]], at: int) -> int:
        near, length = self.model.near, 0
        while length < left and all(abs(s[at + length] - a) <= near for s, a in zip(samples, ra, strict=True)):
            length += 1
        rest = length
        while rest >= 1 << RUN_ORDERS[self.run_index]:
            self.words.append("1")
            rest -= 1 << RUN_ORDERS[self.run_index]
            self.run_index = min(31, self.run_index + 1)
        if length == left:
            if rest:
                self.words.append("1")
        else:
            self.words.append(format(rest, f"0{RUN_ORDERS[self.run_index] + 1}b"))
        return length

    def interrupt(self, kind: int, ra: int, rb: int, x: int) -> int:
        m = self.model
        sign = 1 if kind or rb >= ra else -1
        px = ra if kind else rb
        e = m.error(sign * (x - px))
        k = m.run_order(kind)
        n, nn = m.run_n[kind], m.run_nn[kind]
        bit = (k == 0 and e > 0 and 2 * nn < n) or (e < 0 and (2 * nn >= n or k != 0))
        mapped = 2 * abs(e) - kind - bit
        self.code(k, mapped, m.limit - RUN_ORDERS[self.run_index] - 1)
        m.run_update(kind, e, mapped)
        return m.sample(px, sign * e) if m.near else x


class Decoder(_Coder):
    """Reads symbols from the coded data of a scan; `position` is where it ends."""

    def __init__(self, model: Model, data: bytes, position: int):
        super().__init__(model)
        self.data, self.position, self.interval = data, position, 0

    def begin(self) -> None:
        end = entropy_end(self.data, self.position)
        self.bits, self.at = unstuff(self.data[self.position : end]), 0
        self.position = end
        self.regular = self._regular()

    def end(self, more: bool) -> None:
        if self.position >= len(self.data):
            raise JlsError("need_more_data")
        rest = self.bits[self.at :]
        if not more and 8 < len(rest) < 16 and self.data[self.position - 1 : self.position + 2] == b"\0\xff\xd9":
            self.position -= 1  # a byte of padding before the end of the image
            rest = rest[:-8]
        if len(rest) > 8 or "1" in rest:
            raise JlsError("restart_marker_not_found" if more else "invalid_data")
        if more:
            at = self.position
            while self.data[at : at + 1] == b"\xff":
                at += 1
            if at == self.position or self.data[at : at + 1] != bytes([0xD0 + self.interval % 8]):
                raise JlsError("restart_marker_not_found")
            self.interval += 1
            self.position = at + 1

    def read(self, n: int) -> int:
        word = self.bits[self.at : self.at + n]
        if len(word) < n:
            raise JlsError("invalid_data" if self.position < len(self.data) else "need_more_data")
        self.at += n
        return int(word, 2) if n else 0

    def decode(self, k: int, limit: int) -> int:
        one = self.bits.find("1", self.at)
        if one < 0:
            raise JlsError("invalid_data" if self.position < len(self.data) else "need_more_data")
        high, self.at = one - self.at, one + 1
        escape = limit - self.model.qbpp - 1
        if high < escape:
            return (high << k) + self.read(k)
        if high > escape:
            raise JlsError("invalid_data")
        return self.read(self.model.qbpp) + 1

    def _regular(self) -> Callable[[int, int, int, int, int], int]:
        """The decoding of a regular sample: prediction, code word and update, in one piece and with all that stays the same bound."""
        m, bits = self.model, self.bits
        state, maxval, step, span, near, limit, reset = m.state, m.maxval, m.step, m.span, m.near, m.limit, m.reset
        tables = [golomb_table(k).get for k in range(16)]

        def regular(q: int, ra: int, rb: int, rc: int, _: int) -> int:
            index = q if q >= 0 else -q
            a, b, c, n = state[index]
            if rc < ra:
                px = ra + rb - rc if rc > rb else ra if ra > rb else rb
            elif rc < rb:
                px = ra + rb - rc
            else:
                px = ra if ra < rb else rb
            px += c if q >= 0 else -c
            if px < 0:
                px = 0
            elif px > maxval:
                px = maxval
            k, at = ((a - 1) // n).bit_length() if a else 0, self.at
            if k > 15:
                raise JlsError("invalid_data")
            found = tables[k](bits[at : at + LOOK])
            if found is not None:
                e, size = found
                self.at = at + size
            else:
                mapped = self.decode(k, limit)
                e = -(mapped + 1 >> 1) if mapped & 1 else mapped >> 1
                if not -LARGEST_ERROR <= e <= LARGEST_ERROR:
                    raise JlsError("invalid_data")
            if k == 0 and near == 0 and 2 * b + n <= 0:
                e = ~e
            a += e if e >= 0 else -e
            b += e * step
            if a >= LARGEST_SUM or not -LARGEST_SUM < b < LARGEST_SUM:
                raise JlsError("invalid_data")
            if n == reset:
                a >>= 1
                b >>= 1
                n >>= 1
            n += 1
            if b > 0:
                b -= n
                if b > 0:
                    b = 0
                if c < 127:
                    c += 1
            elif b + n <= 0:
                b += n
                if b <= -n:
                    b = 1 - n
                if c > -128:
                    c -= 1
            state[index] = a, b, c, n
            value = px + e * step if q >= 0 else px - e * step
            if value < -near:
                value += span
            elif value > maxval + near:
                value -= span
            return 0 if value < 0 else maxval if value > maxval else value

        return regular

    def run(self, left: int, ra: list[int], samples: list[list[int]], at: int) -> int:
        length = 0
        while self.read(1):
            block, room = 1 << RUN_ORDERS[self.run_index], left - length
            length += min(block, room)
            if block <= room:  # only a full block raises the order
                self.run_index = min(31, self.run_index + 1)
            if length == left:
                return length
        length += self.read(RUN_ORDERS[self.run_index])
        if length > left:
            raise JlsError("invalid_data")
        return length

    def interrupt(self, kind: int, ra: int, rb: int, x: int) -> int:
        m = self.model
        k = m.run_order(kind)
        mapped = self.decode(k, m.limit - RUN_ORDERS[self.run_index] - 1)
        whole = mapped + kind
        size = (whole + 1) >> 1
        e = -size if (k != 0 or 2 * m.run_nn[kind] >= m.run_n[kind]) == bool(whole & 1) else size
        m.run_update(kind, e, mapped)
        sign = 1 if kind or rb >= ra else -1
        return m.sample(ra if kind else rb, sign * e)


def encode_scan(planes: Sequence[np.ndarray], bits: int, near: int, ilv: int, presets: Presets, interval: int = 0, strict: bool = False) -> bytes:
    """Coded data of a scan of component planes (y, x); with `interval`, restart markers after so many lines."""
    coder = Encoder(Model(bits, near, presets, strict))
    lists = [np.asarray(p).astype(np.int64).tolist() for p in planes]
    height, width = planes[0].shape
    coder.lines(lists, width, height, ilv, interval)
    out = bytearray()
    for i, part in enumerate(coder.parts):
        if i:
            out += bytes([0xFF, 0xD0 + (i - 1) % 8])
        out += part
    return bytes(out)


def decode_scan(data: bytes, position: int, count: int, width: int, height: int, bits: int, near: int, ilv: int, presets: Presets, interval: int = 0, strict: bool = False) -> tuple[np.ndarray, int]:
    """Planes (component, y, x) of a scan that starts at `position`, and where it ends."""
    coder = Decoder(Model(bits, near, presets, strict), data, position)
    planes = [[[0] * width for _ in range(height)] for _ in range(count)]
    coder.lines(planes, width, height, ilv, interval)
    return np.array(planes, np.int32), coder.position
