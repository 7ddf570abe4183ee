"""Bit and format functions on stored values (Column -> Column).

A value is the 64 raw bits of a store, held in a signed long; 32-bit stores are zero-extended. Everything is built from
native expressions, so a scan with these functions stays in whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name -> least trailing zeros of the mantissa for (64bits, 32bits); None: does not apply.
FORMATS = {"fp8_e4m3": (49, 20), "fp8_e5m2": (50, 21), "bf16": (45, 16), "fp16": (42, 13), "fp32": (29, None)}
FLIP = -(2**63)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit64(x: int) -> Column:
    return F.lit(x).cast("long")


def by_type(kind, wide, narrow, other=None) -> Column:
    return F.when(c(kind) == "64bits", wide).when(c(kind) == "32bits", narrow).otherwise(other)


def from_unsigned(x) -> Column:
    """Signed long with the bits of an unsigned number that came as decimal(20, 0)."""
    x = c(x).cast("decimal(20,0)")
    return F.when(x >= F.lit("9223372036854775808").cast("decimal(20,0)"), x - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x).cast("long")


def to_unsigned(x) -> Column:
    x = c(x)
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)")).cast("decimal(20,0)")


def from_hex(x) -> Column:
    """Signed long of up to 16 hexadecimal digits."""
    return F.conv(c(x), 16, -10).cast("long")


def hex_addr(x) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c(x))))


def unsigned_order(x) -> Column:
    """A long that sorts as the unsigned value does; its own inverse."""
    return c(x).bitwiseXOR(lit64(FLIP))


def unsigned_range(low, high) -> Column:
    """high - low of two unsigned_order() values."""
    return (c(high).cast("decimal(20,0)") - c(low).cast("decimal(20,0)")).cast("decimal(20,0)")


def biased_exp(kind, v) -> Column:
    return by_type(kind, F.shiftrightunsigned(c(v), 52).bitwiseAND(lit64(2047)), F.shiftrightunsigned(c(v), 23).bitwiseAND(lit64(255)))


def exp_bias(kind) -> Column:
    return by_type(kind, lit64(1023), lit64(127))


def exp_special(kind) -> Column:
    return by_type(kind, lit64(2047), lit64(255))


def unbiased_exp(kind, v) -> Column:
    return biased_exp(kind, v) - exp_bias(kind)


def is_normal(kind, v) -> Column:
    e = biased_exp(kind, v)
    return (e > 0) & (e < exp_special(kind))


def normal_exp(kind, v) -> Column:
    """Null for zero, subnormals, infinities and NaN."""
    return F.when(is_normal(kind, v), unbiased_exp(kind, v))


def mantissa(kind, v) -> Column:
    return by_type(kind, c(v).bitwiseAND(lit64((1 << 52) - 1)), c(v).bitwiseAND(lit64((1 << 23) - 1)))


def trailing_zeros(kind, v) -> Column:
    """Of the mantissa; its full width where it is zero."""
    m = mantissa(kind, v)
    return F.when(m == 0, by_type(kind, F.lit(52), F.lit(23))).otherwise(F.bit_count(m.bitwiseXOR(m - 1)) - 1)


def fits_format(fmt: str, kind, v) -> Column:
    wide, narrow = FORMATS[fmt]
    tz = trailing_zeros(kind, v)
    return by_type(kind, tz >= wide, tz >= narrow if narrow is not None else None)


def width_mask(kind) -> Column:
    return by_type(kind, lit64(-1), lit64(0xFFFFFFFF), lit64(-1))


def hamming(kind, a, b) -> Column:
    return F.bit_count(c(a).bitwiseXOR(c(b)).bitwiseAND(width_mask(kind)))


def log_delta(a, b) -> Column:
    """ceil(log2(|a - b| + 1)) of unsigned values, exactly: the bit length of the difference."""
    d = F.abs(unsigned_range(unsigned_order(a), unsigned_order(b)))
    return F.when(c(a) == c(b), lit64(0)).otherwise(F.length(F.bin(from_unsigned(d))).cast("long"))


def top_bits(v, k: int) -> Column:
    return F.shiftrightunsigned(c(v), 64 - k)


def magnitude(kind, v) -> Column:
    return by_type(kind, c(v).bitwiseAND(lit64(2**63 - 1)), c(v).bitwiseAND(lit64(2**31 - 1)))


def low32(v) -> Column:
    return c(v).bitwiseAND(lit64(0xFFFFFFFF))


def sign_extended(kind, v) -> Column:
    return by_type(kind, c(v), low32(v).cast("long") - F.when(low32(v) >= lit64(2**31), lit64(2**32)).otherwise(lit64(0)))


def fits_signed(k: int, kind, v) -> Column:
    """Two's complement of k bits at the type's width; 32 bits of a 32-bit store is no saving and false."""
    s = sign_extended(kind, v)
    ok = s.between(-(1 << (k - 1)), (1 << (k - 1)) - 1)
    return by_type(kind, ok, F.lit(False) if k >= 32 else ok)


def high_zero_low16(v) -> Column:
    return F.shiftrightunsigned(c(v), 16) == 0


def repeating_byte(kind, v) -> Column:
    byte = c(v).bitwiseAND(lit64(255))
    high = F.shiftleft(byte, 56).bitwiseOR(F.shiftleft(byte, 48)).bitwiseOR(F.shiftleft(byte, 40)).bitwiseOR(F.shiftleft(byte, 32))
    low = F.shiftleft(byte, 24).bitwiseOR(F.shiftleft(byte, 16)).bitwiseOR(F.shiftleft(byte, 8)).bitwiseOR(byte)
    return by_type(kind, c(v) == high.bitwiseOR(low), low32(v) == low)


def bit(v, i) -> Column:
    return F.getbit(c(v), F.lit(i) if isinstance(i, int) else i).cast("long")


def binary_entropy(p) -> Column:
    p = c(p)
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def posit_useful_bits(e) -> Column:
    return F.greatest(F.lit(0.0), 28 - F.abs(c(e)) / 2)


def required_exp_bits(low, high, least: int = 2) -> Column:
    return F.ceil(F.log2(F.greatest(c(high) - c(low) + 1, F.lit(least)).cast("double"))).cast("long")


def floor_log2(x) -> Column:
    """Exact for every positive long."""
    return F.length(F.bin(c(x))) - 1


def pow2_bucket(size) -> Column:
    return F.when(c(size) > 0, F.pow(F.lit(2.0), floor_log2(size)).cast("long"))


def line_id(offset, size: int = 64) -> Column:
    return F.floor(c(offset) / size) if size & (size - 1) else F.shiftright(c(offset), size.bit_length() - 1)


def slot_bytes(kind) -> Column:
    return by_type(kind, lit64(8), lit64(4))


def ratio(a, b) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def share(condition) -> Column:
    """The share of rows for which the condition holds, rounded to 9 digits."""
    return F.round(F.count_if(condition) / F.count("*"), 9)
