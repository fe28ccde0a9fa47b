"""Connected components of a table of links, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.llm._common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every end of a link; label is the smallest id of its component. Ids may be of any ordered type.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their roots by
    doubling, and contracts the links to what joins different roots. Stars are done in a round, and links
    shrink from round to round, so the work is about that of the first. Sums over hot nodes combine before
    the shuffle, and joins on them have plain exchanges on both sides, which can be split.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = cut(links.where(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b")).distinct())
    labels = None
    while True:
        nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
        best = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("best"))
        hooks = cut(nodes.join(best, "id", "left").select("id", F.coalesce("best", "id").alias("label")))
        while True:
            to = hooks.select(F.col("id").alias("label"), F.col("label").alias("next"))
            far = to.select(F.col("label").alias("next"), F.col("next").alias("far"))
            further = hooks.join(to, "label").join(far, "next")
            hooks = cut(further.select("id", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")))
            still = hooks.where("moved").isEmpty()
            hooks = hooks.select("id", "label")
            if still:
                break
        if labels is None:
            labels = hooks
        else:
            to = hooks.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = cut(labels.join(to, "label", "left").select("id", F.coalesce("next", "label").alias("label")))
        for end in "ab":
            edges = edges.join(hooks.withColumnsRenamed({"id": end, "label": f"root_{end}"}), end)
        edges = edges.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        edges = cut(edges.distinct())
        if edges.isEmpty():
            return labels
