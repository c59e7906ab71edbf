"""The codec's integer functions as Column expressions.

All take and return INT columns (or literals) and stay in whole-stage
codegen.  Spark's `div` on integers and `%` truncate like the standard's
arithmetic, and >> is arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def div(a: Column, b: Column | int) -> Column:
    """Truncating integer division."""
    return F.call_function("div", a, col(b)).cast("int")


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    return F.least(F.greatest(x, col(low)), col(high))


def mask(sample: Column, bits: Column | int) -> Column:
    return sample.bitwiseAND(max_value(bits))


def max_value(bits: Column | int) -> Column:
    """2**bits - 1."""
    if isinstance(bits, int):
        return F.lit((1 << bits) - 1)
    return (F.call_function("shiftleft", F.lit(1), bits) - 1).cast("int")


def max_near(maxval: Column) -> Column:
    return F.least(F.lit(255), div(maxval, 2))


def log2_ceiling(n: Column) -> Column:
    """Smallest k with 2**k >= n, for n >= 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long")))).cast("int")


def byte_count(bits: Column) -> Column:
    return div(bits + 7, 8)


# Color transforms on bits-wide samples (8 or 16); triples of columns in and out.


def _wrap(x: Column, bits: int) -> Column:
    return x.bitwiseAND((1 << bits) - 1).cast("int")


def hp1(r: Column, g: Column, b: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    half = 1 << (bits - 1)
    return _wrap(r - g + half, bits), g, _wrap(b - g + half, bits)


def hp1_inverse(v1: Column, v2: Column, v3: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    half = 1 << (bits - 1)
    return _wrap(v1 + v2 - half, bits), v2, _wrap(v3 + v2 - half, bits)


def hp2(r: Column, g: Column, b: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    half = 1 << (bits - 1)
    return _wrap(r - g + half, bits), g, _wrap(b - F.shiftright(r + g, 1) + half, bits)


def hp2_inverse(v1: Column, v2: Column, v3: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    half = 1 << (bits - 1)
    r = _wrap(v1 + v2 - half, bits)
    return r, v2, _wrap(v3 + F.shiftright(r + v2, 1) - half, bits)


def hp3(r: Column, g: Column, b: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    half, quarter = 1 << (bits - 1), 1 << (bits - 2)
    v2, v3 = _wrap(b - g + half, bits), _wrap(r - g + half, bits)
    return _wrap(g + F.shiftright(v2 + v3, 2) - quarter, bits), v2, v3


def hp3_inverse(v1: Column, v2: Column, v3: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    half, quarter = 1 << (bits - 1), 1 << (bits - 2)
    g = _wrap(v1 - F.shiftright(v2 + v3, 2) + quarter, bits)
    return _wrap(v3 + g - half, bits), g, _wrap(v2 + g - half, bits)


# Prediction and context.


def med(ra: Column, rb: Column, rc: Column) -> Column:
    """Median edge detector."""
    low, high = F.least(ra, rb), F.greatest(ra, rb)
    return F.when(rc >= high, low).when(rc <= low, high).otherwise(ra + rb - rc)


def quantise_gradient(d: Column, t1: Column | int, t2: Column | int, t3: Column | int, near: Column | int = 0) -> Column:
    """-4..4 by the thresholds."""
    size = F.abs(d)
    level = F.when(size >= col(t3), 4).when(size >= col(t2), 3).when(size >= col(t1), 2).when(size > col(near), 1).otherwise(0)
    return (level * sign(d)).cast("int")


def sign(x: Column) -> Column:
    """-1 for negatives, else 1."""
    return F.when(x < 0, -1).otherwise(1)


def bit_sign(x: Column) -> Column:
    """-1 for negatives, else 0."""
    return F.shiftright(x.cast("int"), 31)


def apply_sign(x: Column, bit: Column) -> Column:
    """x, negated where bit is -1."""
    return (bit.bitwiseXOR(x) - bit).cast("int")


def context_id(q1: Column, q2: Column, q3: Column) -> Column:
    """Signed; its size is the context's index and its sign the error's."""
    return ((q1 * 9 + q2) * 9 + q3).cast("int")


def map_error(e: Column) -> Column:
    """Non-negative integers from errors: 0, -1, 1, -2, 2 -> 0, 1, 2, 3, 4."""
    return F.when(e >= 0, 2 * e).otherwise(-2 * e - 1).cast("int")


def unmap_error(m: Column) -> Column:
    return F.when(m % 2 == 0, F.shiftright(m, 1)).otherwise(-F.shiftright(m, 1) - 1).cast("int")


# Parameters.


def range_parameter(maxval: Column, near: Column) -> Column:
    return (div(maxval + 2 * near, 2 * near + 1) + 1).cast("int")


def limit_parameter(bits: Column) -> Column:
    return (2 * (bits + F.greatest(F.lit(8), bits))).cast("int")


def initial_a(range_: Column) -> Column:
    return F.greatest(F.lit(2), div(range_ + 32, 64))


def default_thresholds(maxval: Column, near: Column) -> tuple[Column, Column, Column]:
    """T1, T2, T3 for a MAXVAL and NEAR."""
    factor = div(F.least(maxval, F.lit(4095)) + 128, 256)
    step = F.greatest(F.lit(2), div(F.lit(256), maxval + 1))

    def one(wide: int, weight: int, low: int, before: Column) -> Column:
        large = factor * (wide - low) + low + weight * near
        small = F.greatest(F.lit(low), div(F.lit(wide), step) + weight * near)
        value = F.when(maxval >= 128, large).otherwise(small)
        return F.when((value > maxval) | (value < before), before).otherwise(value).cast("int")

    t1 = one(3, 3, 2, near + 1)
    t2 = one(7, 5, 3, t1)
    return t1, t2, one(21, 7, 4, t2)


DEFAULT_RESET = 64


def or_default(x: Column, default: Column | int) -> Column:
    """0 means default."""
    return F.coalesce(F.nullif(x, F.lit(0)), col(default))


def resolved_parameters(maxval: Column, t1: Column, t2: Column, t3: Column, reset: Column, bits_max: Column, near: Column) -> dict[str, Column]:
    """Preset coding parameters with zeros replaced by defaults, and whether they are valid."""
    m = or_default(maxval, bits_max)
    d1, d2, d3 = default_thresholds(m, near)
    r1, r2, r3, r = or_default(t1, d1), or_default(t2, d2), or_default(t3, d3), or_default(reset, DEFAULT_RESET)
    zero_or = lambda x, low, high: (x == 0) | ((x >= low) & (x <= high))
    valid = ((maxval == 0) | ((maxval >= 1) & (maxval <= bits_max))) & zero_or(t1, near + 1, m) & zero_or(t2, r1, m) & zero_or(t3, r2, m) & zero_or(reset, F.lit(3), F.greatest(F.lit(255), m))
    return {"maxval": m, "t1": r1, "t2": r2, "t3": r3, "reset": r, "valid": valid}


def is_default(maxval: Column, t1: Column, t2: Column, t3: Column, reset: Column, bits_max: Column, near: Column) -> Column:
    """Whether every parameter is 0 or the default of the sample range."""
    d1, d2, d3 = default_thresholds(bits_max, near)
    same = [(maxval, bits_max), (t1, d1), (t2, d2), (t3, d3), (reset, F.lit(DEFAULT_RESET))]
    out = F.lit(True)
    for x, d in same:
        out = out & ((x == 0) | (x == d))
    return out


# Errors and reconstruction.


def modulo_range(e: Column, range_: Column) -> Column:
    """An error brought into the RANGE values around 0."""
    up = F.when(e < 0, e + range_).otherwise(e)
    return F.when(up >= div(range_ + 1, 2), up - range_).otherwise(up).cast("int")


def modulo_lossless(e: Column, bits: int) -> Column:
    """The same for NEAR 0 and a full range: sign extension of the low bits."""
    return F.shiftright(F.call_function("shiftleft", e.cast("int"), F.lit(32 - bits)), 32 - bits)


def quantise(e: Column, near: Column) -> Column:
    step = 2 * near + 1
    return F.when(e > 0, div(e + near, step)).otherwise(-div(near - e, step)).cast("int")


def dequantise(e: Column, near: Column) -> Column:
    return (e * (2 * near + 1)).cast("int")


def reconstruct(px: Column, e: Column, near: Column, maxval: Column) -> Column:
    """The sample a decoder sees: wrapped by RANGE steps, then clamped."""
    step = 2 * near + 1
    span = range_parameter(maxval, near) * step
    value = px + e * step
    value = F.when(value < -near, value + span).when(value > maxval + near, value - span).otherwise(value)
    return clamp(value, 0, maxval).cast("int")


def is_near(a: Column, b: Column, near: Column | int) -> Column:
    return F.abs(a - b) <= near


# Golomb codes.


def golomb_k(n: Column, a: Column) -> Column:
    """Smallest k with n << k >= a, from 0 to 15; null beyond."""
    out = F.lit(None).cast("int")
    for k in range(15, -1, -1):
        out = F.when(n * (1 << k) >= a, k).otherwise(out)
    return out


def golomb_k_run(n: Column, a: Column, ri_type: Column) -> Column:
    return golomb_k(n, a + F.shiftright(n, 1) * ri_type)


def golomb_length(k: Column, mapped: Column, limit: Column, qbpp: Column) -> Column:
    """Bits of the code of a mapped error: unary part, end bit and k bits, or an escape of `limit` bits."""
    high = F.call_function("shiftright", mapped, k)
    return F.when(high < limit - qbpp - 1, high + 1 + k).otherwise(limit).cast("int")


def golomb_bits(k: Column, mapped: Column, limit: Column, qbpp: Column) -> Column:
    """The code's bits as a number (its leading zeros are implied by the length)."""
    high = F.call_function("shiftright", mapped, k)
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    low = mapped.cast("long").bitwiseAND(one(k) - 1)
    return F.when(high < limit - qbpp - 1, one(k).bitwiseOR(low)).otherwise(one(qbpp).bitwiseOR((mapped - 1).cast("long").bitwiseAND(one(qbpp) - 1)))


def run_map_bit(e: Column, k: Column, nn: Column, n: Column) -> Column:
    """Map bit of a run-interruption error."""
    return ((k == 0) & (e > 0) & (2 * nn < n)) | ((e < 0) & (2 * nn >= n)) | ((e < 0) & (k != 0))


# Sizes.


def estimated_size(width: Column, height: Column, components: Column, bits: Column) -> Column:
    """Bytes that an encoded image fits into, as a rule."""
    size = width.cast("long") * height * components * byte_count(bits)
    return size + F.call_function("div", size, F.lit(16)) + 1024 + 34


def destination_size(width: Column, height: Column, components: Column, bits: Column, stride: Column, planar: Column) -> Column:
    """Bytes of a decoded image; null for a stride below the minimum."""
    line = width.cast("long") * byte_count(bits)
    row = F.when(planar, line).otherwise(line * components)
    rows = F.when(planar, height.cast("long") * components).otherwise(height.cast("long"))
    return F.when(stride == 0, line * height * components).when(stride >= row, stride.cast("long") * rows - (stride - row))


def color_transform_allowed(components: Column, bits: Column, near: Column, ilv: Column) -> Column:
    return (components == 3) & bits.isin(8, 16) & (near == 0) & (ilv != 0)
