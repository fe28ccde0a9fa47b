"""Codecs as column expressions.

A code is the number of steps of twice the bound from the column's least value. A value that its code would
miss by more than the bound once it is narrowed (an ulp, or a bound of 0) is kept as a literal beside it; the
literal columns are null elsewhere and cost next to nothing in Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantara.fields import ParticleError
from quantara.functions.scalar import bit_width, dequantize, l2_axis_bound, quantize


@dataclass(frozen=True)
class Quantizer:
    """A column's least value and the bound on each value's error."""

    low: float
    bound: float

    def code(self, c: Column) -> Column:
        return quantize(c, self.low, self.bound)

    def value(self, q: Column) -> Column:
        return dequantize(q, self.low, self.bound)

    def literal(self, c: Column) -> Column:
        """The value where decoding and narrowing would leave the bound, else null."""
        restored = self.value(self.code(c)).cast("float").cast("double")
        missed = F.abs(restored - c.cast("double")) > F.lit(self.bound)
        return F.when(missed, c.cast("double"))

    def restore(self, q: Column, literal: Column) -> Column:
        return F.coalesce(literal, self.value(q).cast("float").cast("double"))


def triplet_quantizers(codec: str, lows: dict[str, float], axis_bound: float, l2_bound: float) -> dict[str, Quantizer]:
    """``sorted``: the bound on each axis; ``lattice``: cells within a Euclidean bound."""
    bound = l2_axis_bound(l2_bound) if codec == "lattice" else axis_bound
    return {f: Quantizer(low, bound) for f, low in lows.items()}


def encode(rows: DataFrame, quantizers: dict[str, Quantizer]) -> DataFrame:
    """Fields f become q_f (code) and e_f (literal or null)."""
    keep = [c for c in rows.columns if c not in quantizers]
    return rows.select(*keep, *(x for f, q in quantizers.items() for x in (q.code(F.col(f)).alias(f"q_{f}"), q.literal(F.col(f)).alias(f"e_{f}"))))


def decode(rows: DataFrame, quantizers: dict[str, Quantizer]) -> DataFrame:
    """The inverse of encode, within the bound."""
    gone = {f"{p}_{f}" for f in quantizers for p in "qe"}
    return rows.select(*(c for c in rows.columns if c not in gone), *(q.restore(F.col(f"q_{f}"), F.col(f"e_{f}")).alias(f) for f, q in quantizers.items()))


def delta_encode(rows: DataFrame, fields, by: str = "rank", chunk: str = "chunk_id") -> DataFrame:
    """Codes to differences from the row before in the chunk; the chunk's first stays."""
    w = Window.partitionBy(chunk).orderBy(by)
    return rows.withColumns({f"q_{f}": F.col(f"q_{f}") - F.coalesce(F.lag(f"q_{f}").over(w), F.lit(0).cast("long")) for f in fields})


def delta_decode(rows: DataFrame, fields, by: str = "rank", chunk: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(chunk).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"q_{f}": F.sum(f"q_{f}").over(w) for f in fields})


def packed_width(rows: DataFrame, column: str, chunk: str = "chunk_id") -> DataFrame:
    """(chunk_id, n, low, width, bits): what frame-of-reference packing of a column takes by chunk."""
    out = rows.groupBy(chunk).agg(F.count("*").alias("n"), F.min(column).cast("long").alias("low"), F.max(column).cast("long").alias("high"))
    width = bit_width(F.col("high") - F.col("low"))
    return out.select(chunk, "n", "low", width.cast("long").alias("width"), (F.col("n") * width).alias("bits"))


def check_decoded(rows: DataFrame, count: int, name: str = "rows", types: dict[str, str] | None = None) -> None:
    """Refuse a decoded table of another size or other types. Of Parquet, the footers are read only."""
    if types:
        got = dict(rows.dtypes)
        wrong = [f for f, t in types.items() if got.get(f) != t]
        if wrong:
            raise ParticleError(f"decoded {', '.join(f'{f} is {got.get(f)}, not {types[f]}' for f in wrong)}")
    if (n := rows.count()) != count:
        raise ParticleError(f"{name}: decoded {n} rows instead of {count}")
