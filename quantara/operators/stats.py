"""Column profiles: one wide aggregate gives all that the planner needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantara.fields import POSITIONS, VELOCITIES, ParticleError
from quantara.functions.scalar import cast_error, scaled


@dataclass(frozen=True)
class FieldStats:
    minimum: float
    maximum: float
    cast: float = 0.0

    @property
    def range(self) -> float:
        return self.maximum - self.minimum


@dataclass(frozen=True)
class Profile:
    count: int
    id_min: int
    id_max: int
    positions: dict[str, FieldStats]  # logical units
    velocities: dict[str, FieldStats]  # source units

    @property
    def fields(self) -> dict[str, FieldStats]:
        return {**self.positions, **self.velocities}


def range_columns(name: str, c: Column) -> list[Column]:
    """min, max and cast error of a double column; + 0.0 makes -0.0 an ordinary zero."""
    return [(F.min(c) + 0.0).alias(f"{name}_min"), (F.max(c) + 0.0).alias(f"{name}_max"), F.max(cast_error(c)).alias(f"{name}_cast")]


def profile(view: DataFrame, scale: float = 1.0) -> Profile:
    """Partial and final hash aggregates over one scan; nothing is shuffled but a row a task."""
    columns = [F.count("*").alias("n"), F.min("id").alias("id_min"), F.max("id").alias("id_max")]
    for f in POSITIONS:
        columns += range_columns(f, scaled(F.col(f), scale))
    for f in VELOCITIES:
        columns += range_columns(f, F.col(f).cast("double"))
    r = view.agg(*columns).first()
    if not r["n"]:
        raise ParticleError("the table has no rows")
    of = lambda fs: {f: FieldStats(r[f"{f}_min"], r[f"{f}_max"], r[f"{f}_cast"]) for f in fs}
    return Profile(r["n"], int(r["id_min"]), int(r["id_max"]), of(POSITIONS), of(VELOCITIES))


def int_range(view: DataFrame, fields) -> DataFrame:
    """min, max and range of columns cut to whole numbers."""
    whole = {f: F.col(f).cast("long") for f in fields}
    out = view.agg(*(a for f, c in whole.items() for a in (F.min(c).alias(f"{f}_min"), F.max(c).alias(f"{f}_max"))))
    return out.select("*", *((F.col(f"{f}_max") - F.col(f"{f}_min")).alias(f"{f}_range") for f in fields))
