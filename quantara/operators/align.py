"""Bringing original and restored rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.fields import ParticleError


def duplicate_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: n, distinct_n, duplicated."""
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("distinct_n"))
    return facts.withColumn("duplicated", (F.col("n") - F.col("distinct_n")))


def mismatch(original: DataFrame, restored: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: ids that occur more often on one side than on the other; counts combine before the shuffle."""
    sided = original.select(id_col, F.lit(1).alias("o"), F.lit(0).alias("r")).union(restored.select(id_col, F.lit(0), F.lit(1)))
    counts = sided.groupBy(id_col).agg(F.sum("o").alias("o"), F.sum("r").alias("r"))
    return counts.agg(*(F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long").alias(n) for n, c in (("only_original", F.col("o") > F.col("r")), ("only_restored", F.col("r") > F.col("o")))))


def _paired(original: DataFrame, restored: DataFrame, key: str, fields) -> DataFrame:
    left = original.select(F.col(key), *(F.col(f).alias(f"o_{f}") for f in fields))
    right = restored.select(F.col(key), *(F.col(f).alias(f"r_{f}") for f in fields))
    return left.join(right, key)


def by_id(original: DataFrame, restored: DataFrame, fields, id_col: str = "id") -> DataFrame:
    """(id, o_f, r_f for each field): a one-to-one join by id, refused if ids repeat or differ."""
    m = mismatch(original, restored, id_col).first()
    if m["only_original"] or m["only_restored"]:
        raise ParticleError(f"ids differ: {m['only_original']} only in the original, {m['only_restored']} only in the restored table")
    if duplicate_ids(original, id_col).first()["duplicated"]:
        raise ParticleError("ids repeat, so rows cannot be aligned by id")
    return _paired(original, restored, id_col, fields)


def by_place(original: DataFrame, restored: DataFrame, fields, order: DataFrame | None = None) -> DataFrame:
    """The same by place, or through a stored order (rank of the restored row, row_id of the original)."""
    if order is not None:
        restored = order.join(restored.withColumnRenamed("row_id", "rank"), "rank").drop("rank")
    return _paired(original, restored, "row_id", fields)
