"""Row orders as tables (rank, row_id): sorting, gathering, scattering, validating, chunk-local places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantara.fields import ParticleError
from quantara.functions.scalar import cell, morton
from quantara.lineage import cut

_LOCAL = 1 << 33  # monotonically_increasing_id: partition number above, place in the partition below


def global_rank(df: DataFrame, *by: Column | str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with gapless ranks from 0 in the order of ``by``, without a single-task sort.

    Rows are range-partitioned and sorted in their partitions once, materialised, and each partition's
    offset (a count a partition) is added to the place inside. ``by`` must be a total order for a fixed result.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    part, local = F.expr(f"__m div {_LOCAL}"), F.col("__m") % _LOCAL
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    start = F.get(F.array(*(F.lit(o).cast("long") for o in offsets or [0])), part.cast("int"))
    return placed.withColumn(name, start + local).drop("__m")


def id_order(view: DataFrame) -> DataFrame:
    """(rank, row_id): a stable sort by id."""
    return global_rank(view.select("id", "row_id"), "id", "row_id").select("rank", "row_id")


def morton_codes(view: DataFrame, fields, ranges: dict[str, tuple[float, float]], bits: int = 21) -> DataFrame:
    """``view`` with the code of each row along the space-filling curve."""
    return view.withColumn("code", morton([cell(F.col(f), *ranges[f], bits) for f in fields], bits))


def morton_order(view: DataFrame, fields, ranges, bits: int = 21) -> DataFrame:
    """(rank, row_id): rows along the curve, ties by place."""
    return global_rank(morton_codes(view, fields, ranges, bits).select("code", "row_id"), "code", "row_id").select("rank", "row_id")


def gather(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Row k of the result is row order[k] of ``rows``; row_id is the new place."""
    columns = [c for c in rows.columns if c != "row_id"]
    return order.join(rows, "row_id").select(F.col("rank").alias("row_id"), *columns)


def scatter(rows: DataFrame, order: DataFrame) -> DataFrame:
    """The inverse of gather."""
    columns = [c for c in rows.columns if c != "row_id"]
    return order.join(rows.withColumnRenamed("row_id", "rank"), "rank").select("row_id", *columns)


def permutation_facts(order: DataFrame, column: str = "row_id") -> DataFrame:
    """One row: n, low, high, distinct, and whether it is a permutation of 0..n-1."""
    c = F.col(column)
    facts = order.agg(F.count("*").alias("n"), F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high"), F.count_distinct(c).alias("distinct_n"))
    ok = (F.col("n") == 0) | ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct_n") == F.col("n")))
    return facts.withColumn("valid", ok.cast("int"))


def check_permutation(order: DataFrame, count: int, label: str, column: str = "row_id") -> None:
    r = permutation_facts(order, column).first()
    if r["n"] != count or (count and (r["low"] < 0 or r["high"] >= count)):
        raise ParticleError(f"{label}: places out of range for {count} rows")
    if r["distinct_n"] != r["n"]:
        raise ParticleError(f"{label}: not a permutation")


def local_facts(rows: DataFrame, chunk: str = "chunk_id", column: str = "local_idx") -> DataFrame:
    """The same for each chunk."""
    c = F.col(column)
    facts = rows.groupBy(chunk).agg(F.count("*").alias("n"), F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high"), F.count_distinct(c).alias("distinct_n"))
    return facts.withColumn("valid", ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct_n") == F.col("n"))).cast("int"))


def local_order(rows: DataFrame, *by, chunk: str = "chunk_id") -> DataFrame:
    """``rows`` with k, the rank inside the chunk; chunks are of bounded size."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(chunk).orderBy(*by)).cast("long") - 1)


def to_global(rows: DataFrame, chunk_size: int) -> DataFrame:
    """Chunk-local places to places in the table."""
    return rows.withColumn("row_id", F.col("chunk_id").cast("long") * chunk_size + F.col("local_idx"))


def to_local(rows: DataFrame, chunk_size: int) -> DataFrame:
    """Places in the table to chunk-local ones; a place outside its chunk is an error."""
    local = F.col("row_id") - F.col("chunk_id").cast("long") * chunk_size
    inside = F.assert_true((local >= 0) & (local < chunk_size), F.lit("a place lies outside its chunk"))
    return rows.withColumn("local_idx", F.when(inside.isNull(), local))
