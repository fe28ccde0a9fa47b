"""Fixed-size chunks of the canonical order, and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.fields import BATCH_VALUES, MAX_CHUNK, ParticleError


@dataclass(frozen=True)
class Segment:
    """Chunks that are handled together: equal ones up to BATCH_VALUES, a short last one alone."""

    index: int
    start: int
    values: int
    chunks: int


def check_options(chunk_size: int, workers: int = 1) -> None:
    if chunk_size <= 0 or chunk_size >= MAX_CHUNK:
        raise ParticleError(f"a chunk must have 1 to {MAX_CHUNK - 1} rows")
    if workers < 0:
        raise ParticleError("workers must not be negative")


def chunk_count(count: int, chunk_size: int) -> int:
    return 1 if chunk_size <= 0 else -(-count // chunk_size)


def segments(count: int, chunk_size: int) -> list[Segment]:
    """The batches of chunks, in closed form."""
    check_options(chunk_size)
    each = max(1, BATCH_VALUES // chunk_size)
    full, tail = divmod(count, chunk_size)
    out = [Segment(i, c * chunk_size, min(each, full - c) * chunk_size, min(each, full - c)) for i, c in enumerate(range(0, full, each))]
    return out + [Segment(len(out), full * chunk_size, tail, 1)] * bool(tail)


def with_chunks(rows: DataFrame, chunk_size: int, place: str = "row_id") -> DataFrame:
    """``rows`` with chunk_id and local_idx; one chunk for size 0. No shuffle: both follow from the place."""
    if chunk_size <= 0:
        return rows.withColumns({"chunk_id": F.lit(0).cast("long"), "local_idx": F.col(place)})
    return rows.withColumns({"chunk_id": F.expr(f"{place} div {chunk_size}"), "local_idx": F.col(place) % chunk_size})


def with_segments(rows: DataFrame, count: int, chunk_size: int) -> DataFrame:
    """``rows`` (with chunk_id) and the batch of chunks they belong to."""
    each = max(1, BATCH_VALUES // chunk_size)
    full, tail = divmod(count, chunk_size)
    last = -(-full // each)
    return rows.withColumn("segment_id", F.when((F.col("chunk_id") == full) & F.lit(bool(tail)), F.lit(last).cast("long")).otherwise(F.expr(f"chunk_id div {each}")))


def chunk_facts(rows: DataFrame, count: int, chunk_size: int) -> DataFrame:
    """(chunk_id, n, expected, valid): whether each chunk has the rows that it must have."""
    size = chunk_size if chunk_size > 0 else max(count, 1)
    facts = rows.groupBy("chunk_id").agg(F.count("*").alias("n"))
    facts = facts.withColumn("expected", F.least(F.lit(size).cast("long"), F.lit(count).cast("long") - F.col("chunk_id") * size))
    return facts.withColumn("valid", (F.col("n") == F.col("expected")).cast("int"))


def check_chunks(rows: DataFrame, count: int, chunk_size: int) -> None:
    """Refuse tables whose chunks are short, doubled, or missing."""
    facts = chunk_facts(rows, count, chunk_size).agg(F.count("*").alias("chunks"), F.sum("n").alias("rows"), F.min("valid").alias("valid")).first()
    if facts["chunks"] != (chunk_count(count, chunk_size) if count else 0) or (facts["rows"] or 0) != count:
        raise ParticleError("the package does not cover all rows")
    if count and not facts["valid"]:
        raise ParticleError("a chunk is misaligned")
