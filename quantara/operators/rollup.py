"""Size and quality roll-ups: by component, by field group, by batch of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantara.fields import GROUPS, LOGICAL, POSITIONS, VELOCITIES
from quantara.functions.scalar import ratio

#: Component: prefixes of its files below the package.
COMPONENTS = {
    **{f: (f"{f}.",) for f in ("x", "y", "z")},
    "xyz": ("positions.", "order.", "x.", "y.", "z."),
    "order": ("order.",),
    "velocity_order": ("velocity_order.",),
    "id": ("id.",),
    **{f: (f"{f}.",) for f in ("vx", "vy", "vz")},
    "vxyz": ("velocities.", "velocity_order."),
}
GROUP_PREFIXES = {"positions": COMPONENTS["xyz"], "id": ("id.",), "velocities": ("velocities.", "velocity_order.", "vx.", "vy.", "vz.")}


def bytes_with_prefixes(prefixes: tuple[str, ...], path: Column | None = None, size: Column | None = None) -> Column:
    """Sum of the sizes of files whose path starts with one of the prefixes."""
    path, size = F.col("path") if path is None else path, F.col("bytes") if size is None else size
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | path.startswith(p)
    return F.coalesce(F.sum(F.when(hit, size)), F.lit(0)).cast("long")


def original_bytes(item_bytes: dict[str, int], count: int, fields) -> int:
    return sum(item_bytes[f] for f in fields) * count


def _sized(sizes: DataFrame, named: dict[str, tuple[tuple[str, ...], int]], by: list[str]) -> DataFrame:
    """(by, name, original_bytes, compressed_bytes, compression_ratio): overlapping groups in one aggregate."""
    sums = sizes.groupBy(*by).agg(*(bytes_with_prefixes(p).alias(n) for n, (p, _) in named.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(o).cast("long").alias("original_bytes"), F.col(n).alias("compressed_bytes")) for n, (_, o) in named.items()))
    out = sums.select(*by, F.explode(rows).alias("s")).select(*by, "s.*")
    return out.withColumn("compression_ratio", ratio(F.col("original_bytes"), F.col("compressed_bytes")))


def component_ratios(sizes: DataFrame, item_bytes: dict[str, int], count: int, order_bytes: int = 4, by: list[str] | None = None) -> DataFrame:
    of = {"xyz": POSITIONS, "vxyz": VELOCITIES, **{f: (f,) for f in LOGICAL}}
    original = {n: original_bytes(item_bytes, count, of[n]) if n in of else order_bytes * count for n in COMPONENTS}
    return _sized(sizes, {n: (p, original[n]) for n, p in COMPONENTS.items()}, by or [])


def group_ratios(sizes: DataFrame, item_bytes: dict[str, int], count: int, by: list[str] | None = None) -> DataFrame:
    return _sized(sizes, {g: (p, original_bytes(item_bytes, count, GROUPS[g])) for g, p in GROUP_PREFIXES.items()}, by or [])


def group_totals(sizes: DataFrame, complete: bool = True) -> DataFrame:
    """Totals of (name, original_bytes, compressed_bytes) over files, by bytes; nulls unless all files have them."""
    out = sizes.groupBy("name").agg(F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("c"))
    c = F.col("c") if complete else F.lit(None).cast("long")
    return out.select("name", "original_bytes", c.alias("compressed_bytes"), ratio(F.col("original_bytes"), c).alias("compression_ratio"))


def batch_totals(files: DataFrame, wall_seconds: float) -> DataFrame:
    """One row over (succeeded, particles, original_bytes, compressed_bytes, wall_seconds) of files.

    Compressed bytes and their ratio are null as soon as a file failed or lacks them.
    """
    ok = F.col("succeeded")
    sums = files.agg(
        F.count("*").alias("files"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("particles"))), F.lit(0)).cast("long").alias("particles"),
        F.coalesce(F.sum(F.when(ok, F.col("original_bytes"))), F.lit(0)).cast("long").alias("original_bytes"),
        F.sum(F.when(ok, F.col("compressed_bytes"))).cast("long").alias("c"),
        F.count_if(ok & F.col("compressed_bytes").isNotNull()).alias("sized"),
        F.coalesce(F.sum(F.when(ok, F.col("wall_seconds"))), F.lit(0.0)).alias("file_seconds"),
    )
    complete = (F.col("failed") == 0) & (F.col("succeeded") > 0) & (F.col("sized") == F.col("succeeded"))
    c = F.when(complete, F.col("c"))
    wall = float(wall_seconds)
    per = lambda x: x / F.lit(wall) if wall else F.lit(float("inf"))
    return sums.select(
        "files", "succeeded", "failed", "particles", "original_bytes", c.alias("compressed_bytes"),
        F.when(complete, ratio(F.col("original_bytes"), c)).alias("compression_ratio"), "file_seconds",
        per(F.col("file_seconds")).alias("parallel_speedup"), per(F.col("original_bytes") / F.lit(1024.0 * 1024.0)).alias("mib_per_second"),
    )


def summary(files: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """min, mean, median and max of a column; no row without values."""
    rows = files.where(F.col(column).isNotNull())
    aggs = [F.min(column).alias("min"), F.avg(column).alias("mean"), F.median(column).alias("median"), F.max(column).alias("max")]
    out = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs).where("min is not null")
    return out


def stage_seconds(files: DataFrame, column: str = "timings") -> DataFrame:
    """(stage, seconds): sums of a map of timings by name."""
    return files.select(F.explode(column).alias("stage", "seconds")).where("seconds is not null").groupBy("stage").agg(F.sum("seconds").alias("seconds")).orderBy("stage")


def quality_rows(metrics: DataFrame, fixed_point: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, field, max_abs, mse, psnr, units): a field's fixed-point figures go before its others."""
    by = by or []
    units = F.when(F.col("field").isin(*POSITIONS), F.lit("logical_units")).otherwise(F.lit("source_units"))
    out = metrics.select(*by, "field", "max_abs", "mse", "psnr", units.alias("units"))
    if fixed_point is None:
        return out
    twin = fixed_point.select(*by, "field", *(F.col(c).alias(f"f_{c}") for c in ("max_abs", "mse", "psnr")))
    joined = out.join(twin, [*by, "field"], "left")
    has = F.col("f_max_abs").isNotNull()
    return joined.select(*by, "field", *(F.when(has, F.col(f"f_{c}")).otherwise(F.col(c)).alias(c) for c in ("max_abs", "mse", "psnr")), F.when(has, F.lit("fixed_point_units")).otherwise(F.col("units")).alias("units"))
