"""Rounding, clamping and wrapping arithmetic as Spark columns that no ANSI setting disturbs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = (1 << 32) - 1
#: The multipliers and the start of the position hash, and the linear congruence of seeds.
HASH_START, HASH_FIRST, HASH_SECOND = 0x517CC1B727220A95, 0x6C62272E07BB0142, 0x62A9D9ED799705F5
LCG_FACTOR, LCG_STEP = 1664525, 1013904223


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x: Column | str | float) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else col(x)


def half_up(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def to_places(x: Column, places: int) -> Column:
    """Rounded to so many decimals by the same rule; built-in rounding goes by decimal text and differs between engines."""
    k = float(10**places)
    rounded = half_up(x * k) / k
    return F.when(rounded == 0.0, 0.0).otherwise(rounded)  # no negative zero


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, num(low)), num(high))


def signed(x: int) -> int:
    """A 64-bit pattern as the long that Spark holds."""
    return x - (1 << 64) if x >> 63 else x


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once.

    An expression that names its argument several times is a tree of copies: nested, it grows beyond what the optimizer
    can handle, and filters that move below projections copy it again. A lambda's variable is one node wherever it stands.
    """
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _times(x: Column, factor: int, add: int = 0) -> Column:
    """x * factor + add modulo 2^64, in limbs whose products stay below 2^63."""
    m, half = F.lit(U32), F.lit(0xFFFF)
    c0, c1 = F.lit(factor & U32), F.lit(factor >> 32)
    low16, high16 = lambda v: v.bitwiseAND(half), lambda v: F.shiftright(v, 16)
    upper = lambda v, c: (low16(v) * c + F.shiftleft(low16(high16(v) * c), 16)).bitwiseAND(m)

    def of_halves(a: Column, b: Column) -> Column:
        def with_middle(q: Column) -> Column:
            low = low16(a) * c0 + F.shiftleft(low16(q), 16) + F.lit(add)
            high = lambda v: F.shiftrightunsigned(v, 32) + F.shiftright(q, 16) + upper(a, c1) + upper(b, c0)
            return let(low, lambda v: F.shiftleft(high(v).bitwiseAND(m), 32).bitwiseOR(v.bitwiseAND(m)))

        return let(high16(a) * c0, with_middle)

    return let(x, lambda v: let(v.bitwiseAND(m), lambda a: let(F.shiftrightunsigned(v, 32), lambda b: of_halves(a, b))))


def position_hash(t: Column, salt: Column | int) -> Column:
    """64 bits (as a long) of a time in tenths of milliseconds and a salt."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    bits = half_up(t * 10000.0).cast("long").bitwiseXOR(F.lit(signed(HASH_START))).bitwiseXOR(salt.cast("long"))
    first = let(_times(bits, HASH_FIRST, 1), lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 33)))
    return let(_times(first, HASH_SECOND), lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 28)))


def unsigned_mod(x: Column, m: Column | int) -> Column:
    """x modulo m with x read as unsigned."""
    m = F.lit(m) if isinstance(m, int) else m
    return ((F.shiftrightunsigned(x, 1) % m) * 2 + x.bitwiseAND(F.lit(1))) % m


def lcg(seed: Column) -> Column:
    """The next seed, modulo 2^32."""
    return (seed.cast("long") * F.lit(LCG_FACTOR) + F.lit(LCG_STEP)).bitwiseAND(F.lit(U32))


def wrapping32(seed: Column, factor: int) -> Column:
    return (seed.cast("long") * F.lit(factor)).bitwiseAND(F.lit(U32))


def mix32(x: Column) -> Column:
    """A 32-bit finaliser: shifts and odd multipliers, products cut to 32 bits in two halves."""

    def times(v: Column, factor: int) -> Column:
        return ((F.shiftright(v, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536) + v.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)).bitwiseAND(F.lit(U32))

    x = x.cast("long").bitwiseAND(F.lit(U32))
    x = times(x.bitwiseXOR(F.shiftright(x, 16)), 0x7FEB352D)
    x = times(x.bitwiseXOR(F.shiftright(x, 15)), 0x846CA68B)
    return x.bitwiseXOR(F.shiftright(x, 16))
