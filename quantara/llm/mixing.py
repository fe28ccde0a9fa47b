"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 48-bit hash of its id. Words are summed by (source, top 12 hash bits); in each
source the bucket in which the budget runs out is found, and only that bucket is looked into by the next
12 bits, four times over. What lies below the threshold found is taken once more than the rest. No row is
sorted, thresholds of growing budgets are nested, and reruns agree.

Defined results: a null text has no words; a null source is a source of its own and comes last; rows that
repeat an id share its hash, so they are taken alike (the threshold then moves by all of them); documents
without words take nothing; an empty table gives an empty result; other columns are carried along or ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantara.llm._common import cut, guarded_broadcast, private, words_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BITS, LEVELS = 12, 4


def _hash(doc_id):
    """48 bits of the id's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: water-filling of share x all sizes by weight under cap x size.

    Taking sources as capped in order of cap per weight raises the level of the rest for as long as they
    really are above their caps, and lowers it after, so the level wanted is the largest. The windows run
    over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", weight.cast("double")).withColumn("most", F.lit(cap) * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    x = x.withColumn("level", level)
    x = x.withColumn("target", F.least(F.col("most"), F.max("level").over(whole) * F.col("w")))
    return x.select("source", "source_size", "target")


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, times, below): all rows are taken ``times`` times, those with hash < below once more."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("times", times).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("times") * F.col("source_size")))
    state = guarded_broadcast(cut(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("done", F.lit(0).cast("long"))))
    keys = ["source", "source_size", "target", "times", "rest", "prefix", "done"]
    bucket = Window.partitionBy("source").orderBy("bucket")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        rows = slim.alias("d").join(state.alias("s"), F.expr(f"d.source <=> s.source and shiftright(d.h, {shift + BITS}) = s.prefix"))
        rows = rows.select(*(F.col(f"s.{k}") for k in keys), F.expr(f"shiftright(d.h, {shift})").alias("bucket"), F.col("d.size").alias("size"))
        sums = rows.groupBy(*keys, "bucket").agg(F.sum("size").alias("size"))
        sums = sums.withColumn("upto", F.col("done") + F.sum("size").over(bucket))
        edge = F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).over(Window.partitionBy("source"))
        sums = sums.withColumn("edge", edge).where(F.col("bucket") == F.col("edge"))
        if level < LEVELS - 1:
            state = sums.withColumn("prefix", F.col("edge")).withColumn("done", F.col("upto") - F.col("size")).select(*keys)
            state = guarded_broadcast(cut(state))
    # The last bucket holds one hash: it is taken if that brings the sum nearer.
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size"))
    return sums.select("source", "source_size", "target", "times", (F.col("edge") + F.when(nearer, 1).otherwise(0)).alias("below"))


def mix_sources(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, cap=CAP, out=("size", "source_size", "target", "copies")) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the row).

    ``out`` names the new columns; they replace columns of the same names.
    """
    source = F.col(source_col).cast("string").alias("source")
    slim = cut(docs.select(source, words_count(F.col(text_col)).alias("size"), _hash(F.col(id_col)).alias("h")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, cap))
    edges = guarded_broadcast(cut(thresholds(slim, targets)).select("source", "times", "below"))
    plan = guarded_broadcast(cut(targets.alias("t").join(edges.alias("e"), F.expr("t.source <=> e.source"), "left").select("t.*", "e.times", "e.below")))
    names = dict(zip(("size", "source_size", "target", "copies"), out, strict=True))
    kept = [c for c in docs.columns if c.lower() not in {v.lower() for v in out}]
    s, h, key = private(docs, "mix_size", "mix_hash", "mix_source")
    x = docs.withColumns({s: words_count(F.col(text_col)), h: _hash(F.col(id_col)), key: F.col(source_col).cast("string")})
    x = x.alias("d").join(plan.alias("p"), F.col(f"d.{key}").eqNullSafe(F.col("p.source")), "left")
    copies = F.when(F.col(f"d.{s}") == 0, F.lit(0)).otherwise(F.coalesce(F.col("p.times"), F.lit(0)) + F.when(F.col(f"d.{h}") < F.col("p.below"), 1).otherwise(0))
    return x.select(
        *(F.col(f"d.`{c}`") for c in kept),
        F.col(f"d.{s}").alias(names["size"]),
        F.col("p.source_size").alias(names["source_size"]),
        F.col("p.target").alias(names["target"]),
        copies.cast("long").alias(names["copies"]),
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix takes it, with the columns of ``docs``."""
    names = private(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    mixed = mix_sources(docs, out=tuple(names), **options)
    (k,) = private(mixed, "mix_k")
    # Two copies at most, so the repeat is a bounded in-row explode.
    return mixed.where(F.col(names[3]) > 0).withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*docs.columns)
