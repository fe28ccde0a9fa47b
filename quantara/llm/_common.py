"""Helpers that all training-data operators share: reading, lineage cuts, guarded broadcasts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it is measured to take no more bytes than this.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and
    all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quantara-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so later steps neither recompute it nor depend on an executor.

    A checkpoint hands on its plan's constraints and estimated size; in a loop of joins the estimates are products of
    products, numbers of more and more digits, and planning takes minutes and the driver's heap. So the rows are
    wrapped anew, without either.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    done = df.checkpoint(eager=True)._jdf
    plain = spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False)
    return DataFrame(plain, spark)


def small_batches(spark: SparkSession) -> SparkSession:
    """Have whole texts sent to Python in batches of a few MB, whatever their length, so that a worker's memory is bounded
    by that and the longest text. Smaller settings stay."""
    for key, most, unit in (("maxBytesPerBatch", 4 << 20, "b"), ("maxRecordsPerBatch", 2000, "")):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, f"{most}{unit}")
    return spark


def release(spark: SparkSession) -> None:
    """Let go of shuffles and checkpoints that nothing refers to any more: Spark deletes their files once the driver's
    garbage is collected, which may else be long after. What a first collection frees may hold others."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)  # files are deleted by another thread


def _row_bytes(df: DataFrame):
    """About the bytes that a row takes in a hashed table, as a column; None for columns of no known size."""
    total = F.lit(16).cast("long")
    for field in df.schema:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total += 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            total += 24 + 8 * F.coalesce(F.size(c), F.lit(0))
        elif isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType)):
            total += 16
        else:
            return None
    return total


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (a materialised table) is measured to fit a broadcast."""
    row = _row_bytes(df)
    return row is not None and (df.agg(F.sum(row)).first()[0] or 0) <= limit


def guarded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if ``df`` (a materialised table) is measured to be small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, limit) else df


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def words_count(text):
    """Number of maximal runs of anything but ASCII white space, as a column; null counts none.

    White space at an end leaves an empty part there, which is no word.
    """
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    first = F.when(F.get(parts, 0) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - first - last).cast("long")


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of ``df``'s (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
