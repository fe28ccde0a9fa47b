"""Quality of a restored table: errors by field and by triplet, and verdicts on the bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def error_sums(o: Column, r: Column, name: str) -> list[Column]:
    """The mergeable sums of a field: squares, absolutes, largest, and the original's range."""
    e = r.cast("double") - o.cast("double")
    return [
        F.count("*").alias(f"{name}_n"),
        F.sum(e * e).alias(f"{name}_sq"),
        F.sum(F.abs(e)).alias(f"{name}_ab"),
        F.max(F.abs(e)).alias(f"{name}_max"),
        F.min(o.cast("double")).alias(f"{name}_low"),
        F.max(o.cast("double")).alias(f"{name}_high"),
    ]


def finished(name: str) -> dict[str, Column]:
    """n, max_abs, mse, rmse, mae, range, nrmse, psnr from the sums, with the rules for exact and constant columns."""
    c = lambda x: F.col(f"{name}_{x}")
    n = F.when(c("n") > 0, c("n"))
    mse, span = c("sq") / n, (c("high") - c("low")) + 0.0
    rmse = F.sqrt(mse)
    safe_mse, safe_span = F.when(mse > 0, mse), F.when(span > 0, span)
    psnr = F.when(mse == 0, F.lit(INF)).when(span == 0, F.lit(-INF)).otherwise(20 * F.log10(safe_span) - 10 * F.log10(safe_mse))
    nrmse = F.when((span == 0) & (rmse == 0), F.lit(0.0)).when(span == 0, F.lit(INF)).otherwise(rmse / safe_span)
    return {"n": c("n"), "max_abs": c("max"), "mse": mse, "rmse": rmse, "mae": c("ab") / n, "range": span, "nrmse": nrmse, "psnr": psnr}


def field_metrics(aligned: DataFrame, fields, scales: dict[str, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """A row a field (and group): field and the figures of ``finished``. One wide aggregate, then a small unpivot."""
    scales = scales or {}
    of = lambda p, f: F.col(f"{p}_{f}").cast("double") / F.lit(scales[f]) if scales.get(f, 1.0) != 1.0 else F.col(f"{p}_{f}")
    sums = aligned.groupBy(*(by or [])).agg(*(a for f in fields for a in error_sums(of("o", f), of("r", f), f)))
    rows = [F.struct(F.lit(f).alias("field"), *(v.alias(k) for k, v in finished(f).items())) for f in fields]
    return sums.select(*(by or []), F.explode(F.array(*rows)).alias("m")).select(*(by or []), "m.*")


def exact_match(aligned: DataFrame, field: str = "id") -> DataFrame:
    return aligned.agg(F.coalesce(F.bool_and(F.col(f"o_{field}") == F.col(f"r_{field}")), F.lit(True)).cast("int").alias("exact_match"))


def triplet_metrics(aligned: DataFrame, fields, scale: float = 1.0) -> DataFrame:
    """One row: n, max_l2, mean_l2, rms_l2."""
    square = sum(((F.col(f"r_{f}").cast("double") - F.col(f"o_{f}").cast("double")) / F.lit(scale)) ** 2 for f in fields)
    return aligned.select(square.alias("sq")).agg(F.count("*").alias("n"), F.sqrt(F.max("sq")).alias("max_l2"), F.avg(F.sqrt("sq")).alias("mean_l2"), F.sqrt(F.avg("sq")).alias("rms_l2"))


def verdict(observed: Column, bound: Column) -> Column:
    """Whether an error is within its bound and the tolerance for arithmetic."""
    return observed <= bound + F.lit(1e-12) + F.lit(1e-6) * F.greatest(F.lit(1.0), bound)


def observed_relative(observed: Column, span: Column) -> Column:
    return F.when(F.coalesce(span, F.lit(0.0)) == 0, F.when(observed == 0, F.lit(0.0)).otherwise(F.lit(INF))).otherwise(observed / F.when(span != 0, span))


def with_verdicts(metrics: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """``metrics`` (a row a field) with bound, relative error and bound_ok."""
    pairs = [x for f, b in bounds.items() for x in (F.lit(f), F.lit(float(b)))]
    bound = F.element_at(F.create_map(*pairs), F.col("field"))
    return metrics.withColumn("bound", bound).withColumn("observed_relative", observed_relative(F.col("max_abs"), F.col("range"))).withColumn("bound_ok", verdict(F.col("max_abs"), F.col("bound")))
