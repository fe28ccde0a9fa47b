"""Sharding by histogram sort.

Rows are ordered by the MD5 of their text, so equal texts lie together. Exact bytes and rows are counted by
key prefix, all partitions at once; only prefixes in which a shard border falls, or which hold too many rows
for one task, are looked into further, until each border is exact (or within ``tolerance`` bytes). Then rows
go to their places in one exchange. A group of equal texts larger than ``whole`` of a shard is ordered by
the MD5 of the id inside, so that it can be split; all smaller groups stay whole.

Defined results: a null text counts as empty; rows that repeat an id and a text are put in some order next to
each other; an empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantara.llm._common import cut, private

SHARDS = 8
#: Of a shard's bytes: a group of equal texts above it may be split.
WHOLE = 0.01
#: A cell with more than 1/CELLS of all rows is split, as long as its rows differ.
CELLS = 1024
#: Hex digits by which a cell is split.
DIGITS = 3
KEY = 64  # 32 hex digits of the text's MD5, 32 of the id's


@dataclass
class Cell:
    prefix: str
    size: int
    rows: int
    low: str
    high: str


def _size(text):
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def _key(text, doc_id):
    return F.concat(F.md5(F.coalesce(text, F.lit(""))), F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))))


def _count(slim: DataFrame, inside: dict[str, int] | None) -> list[Cell]:
    """One histogram: bytes, rows and extreme keys by prefix; ``inside`` gives the prefixes looked into and their new length."""
    if inside is None:
        cell, rows = F.substring("k", 1, DIGITS), slim
    else:
        cell = F.lit(None).cast("string")
        for n, to in sorted({(len(p), to) for p, to in inside.items()}):
            mine = [p for p, t in inside.items() if (len(p), t) == (n, to)]
            cell = F.when(F.substring("k", 1, n).isin(mine), F.substring("k", 1, to)).otherwise(cell)
        rows = slim.where(cell.isNotNull())
    found = rows.groupBy(cell.alias("c")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
    return [Cell(r["c"], r["size"], r["rows"], r["low"], r["high"]) for r in found.collect()]


def _shared(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), KEY)


def find_cells(slim: DataFrame, shards: int = SHARDS, tolerance: int = 0, whole: float = WHOLE, cells: int = CELLS) -> tuple[list[tuple[Cell, int, int]], dict[str, int]]:
    """Leaf cells in key order with (shard, first slot), and how far each split prefix is read on.

    What comes to the driver is bounded by the cells: 16**DIGITS, and as many for each border and each
    cell over 1/``cells`` of the rows.
    """
    leaves = {c.prefix: c for c in _count(slim, None)}
    total, count = sum(c.size for c in leaves.values()), sum(c.rows for c in leaves.values())
    step: dict[str, int] = {}

    while True:
        before, inside = 0, {}
        for c in sorted(leaves.values(), key=lambda c: c.prefix):
            border = before * shards // total != max(before, before + c.size - 1 - tolerance) * shards // total
            one_text = c.low[:32] == c.high[:32]
            keep = c.low == c.high or one_text and c.size <= whole * total / shards
            if not keep and (border or c.rows > max(1, count // cells)):
                n = max(_shared(c.low, c.high), len(c.prefix))
                to = min(n + DIGITS, KEY)
                inside[c.prefix] = min(to, 32) if n < 32 else to
            before += c.size
        if not inside:
            break
        step |= inside
        for p in inside:
            del leaves[p]
        leaves |= {c.prefix: c for c in _count(slim, inside)}

    out, before, slots = [], 0, [0] * shards
    for c in sorted(leaves.values(), key=lambda c: c.prefix):
        shard = before * shards // total
        out.append((c, shard, slots[shard]))
        slots[shard] += c.rows
        before += c.size
    return out, step


def shard_documents(docs: DataFrame, shards: int = SHARDS, *, id_col="doc_id", text_col="text", tolerance: int = 0, out=("size", "shard", "slot")) -> DataFrame:
    """``docs`` with size, shard and slot (gapless in each shard); ``out`` names them, they replace columns of the same names."""
    spark = docs.sparkSession
    size, key, cell, sort = private(docs, "shard_size", "shard_key", "shard_cell", "shard_order")
    slim = cut(docs.select(_size(F.col(text_col)).alias("size"), _key(F.col(text_col), F.col(id_col)).alias("k")))
    found, step = find_cells(slim, shards, tolerance)
    length = F.lit(DIGITS)
    if step:
        # Prefixes that were split: fewer than borders + cells, so the map stays small.
        table = F.create_map(*(F.lit(x) for p in step.items() for x in p))
        for _ in range(_depth(step)):
            length = F.coalesce(F.element_at(table, F.col(key).substr(F.lit(1), length)), length)
    places = spark.createDataFrame([(c.prefix, s, t) for c, s, t in found], "c string, s int, t long")
    x = docs.withColumns({size: _size(F.col(text_col)), key: _key(F.col(text_col), F.col(id_col))})
    x = x.withColumn(cell, F.col(key).substr(F.lit(1), length)).alias("d").join(F.broadcast(places).alias("p"), F.col(f"d.{cell}") == F.col("p.c"))
    rank = F.row_number().over(Window.partitionBy("p.s", f"d.{cell}").orderBy(f"d.{key}")) - 1
    kept = [c for c in docs.columns if c.lower() not in {v.lower() for v in out}]
    return x.select(*(F.col(f"d.`{c}`") for c in kept), F.col(f"d.{size}").alias(out[0]), F.col("p.s").alias(out[1]), (F.col("p.t") + rank).cast("long").alias(out[2]))


def _depth(step: dict[str, int]) -> int:
    """How many splits lie above the deepest cell."""
    most = 0
    for p in step:
        n, depth = DIGITS, 1
        while n < len(p):
            n, depth = step[p[:n]], depth + 1
        most = max(most, depth)
    return most
