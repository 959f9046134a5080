"""Unsigned 64-bit arithmetic on BIGINT columns, and the hash mixers. ANSI mode stays on: nothing here overflows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two mixers.
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
STAR = 0x2545F4914F6CDD1D

_LOW = 0xFFFFFFFF
SIGN = -(1 << 63)


def _shr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _times32(a: Column, c: int) -> Column:
    """Low 32 bits of a * c for a and c below 2**32: 16-bit halves keep each product below 2**48."""
    return _and(_and(a, 0xFFFF) * F.lit(c).cast("long") + F.shiftleft(_and(_shr(a, 16) * F.lit(c).cast("long"), 0xFFFF), 16), _LOW)


def times(x: Column, c: int) -> Column:
    """x * c modulo 2**64."""
    low, high, c_low, c_high = _and(x, _LOW), _shr(x, 32), c & _LOW, c >> 32
    p0, p1 = _and(low, 0xFFFF) * F.lit(c_low).cast("long"), _shr(low, 16) * F.lit(c_low).cast("long")
    total = p0 + F.shiftleft(_and(p1, 0xFFFF), 16)
    carry = _shr(total, 32) + _shr(p1, 16)
    top = carry + _times32(high, c_low) + _times32(low, c_high)
    return F.shiftleft(_and(top, _LOW), 32).bitwiseOR(_and(total, _LOW))


def fmix64(x: Column) -> Column:
    x = times(x.bitwiseXOR(_shr(x, 33)), MIX_A)
    x = times(x.bitwiseXOR(_shr(x, 33)), MIX_B)
    return x.bitwiseXOR(_shr(x, 33))


def xorshift_star(x: Column) -> Column:
    x = x.bitwiseXOR(_shr(x, 12))
    x = x.bitwiseXOR(F.shiftleft(x, 25))
    return times(x.bitwiseXOR(_shr(x, 27)), STAR)


def hash_family(x: Column, t: int) -> Column:
    """fmix64(x) + t * xorshift_star(x) modulo 2**64; the sum is made in 32-bit halves."""
    a, b = fmix64(x), times(xorshift_star(x), t)
    low = _and(a, _LOW) + _and(b, _LOW)
    return F.shiftleft(_and(_shr(a, 32) + _shr(b, 32) + _shr(low, 32), _LOW), 32).bitwiseOR(_and(low, _LOW))


def unsigned_min(x: Column) -> Column:
    """Aggregate: the least of x, read as unsigned."""
    sign = F.lit(SIGN).cast("long")
    return F.min(x.bitwiseXOR(sign)).bitwiseXOR(sign)


def bucket_of(h: Column, ls: int) -> Column:
    """Top ls bits of the mixed hash."""
    return (_shr(fmix64(h), 64 - ls) if ls else F.lit(0)).cast("int")


def np_fmix64(x: np.ndarray) -> np.ndarray:
    s = np.uint64(33)
    x = (x ^ (x >> s)) * np.uint64(MIX_A)
    x = (x ^ (x >> s)) * np.uint64(MIX_B)
    return x ^ (x >> s)


def np_xorshift_star(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(12))
    x = x ^ (x << np.uint64(25))
    return (x ^ (x >> np.uint64(27))) * np.uint64(STAR)
