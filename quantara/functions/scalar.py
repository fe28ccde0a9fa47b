"""Column expressions: scaling, narrowing, quantising, space-filling order, ratios. All run inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantara.fields import ParticleError

#: Limits of integer types, for clipping.
LIMITS = {"tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1), "decimal(20,0)": (0, 2**64 - 1)}


def positive_scale(value: float) -> float:
    if not (value is not None and math.isfinite(value) and value > 0):
        raise ParticleError(f"the position scale must be a positive number, not {value!r}")
    return float(value)


def scaled(c: Column, scale: float) -> Column:
    """Source to logical units, in double precision."""
    return c.cast("double") / F.lit(float(scale)) if scale != 1 else c.cast("double")


def narrowed(c: Column) -> Column:
    return c.cast("float")


def cast_error(c: Column) -> Column:
    """What narrowing to single precision changes."""
    return F.abs(c.cast("float").cast("double") - c.cast("double"))


def unscaled(c: Column, scale: float, dtype: str) -> Column:
    """Logical to source units: half-even rounding and clipping for integers."""
    value = c.cast("double") * F.lit(float(scale))
    if dtype not in LIMITS:
        return value.cast(dtype)
    low, high = LIMITS[dtype]
    rounded = F.rint(value)
    # The largest longs are no doubles, so the limits are tested before the cast.
    return F.when(rounded <= float(low), F.lit(low).cast(dtype)).when(rounded >= float(high), F.lit(high).cast(dtype)).otherwise(rounded.cast(dtype))


def quantize(c: Column, low: float, bound: float) -> Column:
    """Code of a value in steps of twice the bound; 0 where the bound is 0, and null where it isn't finite."""
    if bound <= 0:
        return F.lit(0).cast("long")
    return F.rint((c.cast("double") - F.lit(low)) / F.lit(2.0 * bound)).cast("long")


def dequantize(q: Column, low: float, bound: float) -> Column:
    return F.lit(low) + q.cast("double") * F.lit(2.0 * bound)


def l2_axis_bound(bound: float) -> float:
    """Per-axis bound of a cubic lattice whose cells lie within ``bound`` of their centre."""
    return bound / math.sqrt(3.0)


def spread_bits(c: Column, bits: int = 21) -> Column:
    """Two zero bits after each of the low ``bits`` bits of a non-negative long."""
    x = c.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(codes: list[Column], bits: int = 21) -> Column:
    """Interleaved bits of three codes."""
    a, b, c = (spread_bits(x, bits) for x in codes)
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def cell(c: Column, low: float, high: float, bits: int) -> Column:
    """Cell number of a value on a grid of 2**bits cells from low to high."""
    n = (1 << bits) - 1
    if high <= low:
        return F.lit(0).cast("long")
    at = F.floor((c.cast("double") - F.lit(low)) / F.lit(high - low) * F.lit(float(n)))
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n).cast("long"), at.cast("long")))


def bit_width(n: Column) -> Column:
    """Binary digits of a non-negative long; 0 for 0 and less."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.length(F.bin(n))).cast("int")


def order_bits(count: int) -> int:
    """Bits that an index below ``count`` takes."""
    return max(0, count - 1).bit_length()


def ratio(original: Column, compressed: Column) -> Column:
    """Original over compressed bytes, infinite for none."""
    return F.when(compressed == 0, F.lit(float("inf"))).otherwise(original.cast("double") / compressed.cast("double"))
