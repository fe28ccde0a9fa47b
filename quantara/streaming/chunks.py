"""Streams of particles: quantising is stateless, so each micro-batch is encoded as it comes.

Bounds must be planned before (from a sample or from known ranges), since a stream has no whole to profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.operators.codec import Quantizer, encode
from quantara.operators.metrics import error_sums, finished


def encode_stream(rows: DataFrame, quantizers: dict[str, Quantizer]) -> DataFrame:
    """The encoded stream, a projection inside codegen."""
    return encode(rows, quantizers)


def windowed_error(rows: DataFrame, field: str, quantizer: Quantizer, ts: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Quality of the restored values by window of event time; state is one row of sums a window."""
    restored = rows.withColumn("r", quantizer.restore(quantizer.code(F.col(field)), quantizer.literal(F.col(field))))
    # Watermarks need a timestamp with time zone.
    timed = restored.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    sums = timed.groupBy(F.window("__t", window).alias("w")).agg(*error_sums(F.col(field), F.col("r"), field))
    done = finished(field)
    return sums.select(F.col("w.start").alias("window_start"), *(done[k].alias(k) for k in ("n", "max_abs", "mse", "mae")))
