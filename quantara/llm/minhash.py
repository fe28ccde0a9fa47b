"""Near-duplicate detection with BagMinHash signatures.

A text is the multiset of its five-word shingles. A shingle of multiplicity w owns the integer weight levels
1..w. Levels are grouped in dyadic intervals (0,1], (1,2], (2,4], (4,8], ...; each interval has a Poisson
process whose rate is the interval's width, seeded by shingle and interval. A point has a time, one of
``ROWS * BANDS`` components, and a level that bits of its own choose by halving the interval again and again;
it counts if the level is at most w. A component's value is the time of its first point, so two texts agree
in it with the probability of their weighted Jaccard similarity, exactly. Points are drawn in time order and
only until every component has a value earlier than the next point, so most shingles of a long text draw few.

Equal texts (by MD5) are collapsed to a node first; nodes are banded. Each bucket is checked against its
smallest member (a star), so most buckets are one component after a check a member. A bucket that is not is
*open*: its members outside the head's component are held, block by block, against its members of other
components, so no link is lost and no pair becomes a row. Buckets of the same members are looked at once.
Links are verified on the exact multisets, whose shingles are compared by their words. Classes are the
connected components. Texts are fetched once, for nodes that share a bucket with another.

Defined results: a null text is a class of its own; equal texts (empty ones too) are one class; a text of
fewer than five words is one shingle, one without words is alike to equal texts only; an id that has
several texts has a row, and maybe a class, for each, and of a class the row of the smallest (id, MD5) stays;
rows without an id have no class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.llm._common import cut, guarded_broadcast, private, small_batches
from quantara.llm._text import U64, Block, blocks, exact_shingles, mix, shingles
from quantara.llm.components import components

SIMILARITY = 0.8
WIDTH = 5
#: P(a pair at 0.8 shares a band) = 1 - (1 - 0.8**6)**32 > 0.9999.
ROWS, BANDS = 6, 32
_GOLDEN = U64(0x9E3779B97F4A7C15)
#: Texts are signed and compared in parts of about so many bytes (one text at least).
SIGN_BYTES, PAIR_BYTES = 1 << 19, 1 << 21
#: A block of a bucket has about so many texts, and so many shingles, at most (one text at least).
GROUP_BLOCK, GROUP_SHINGLES = 256, 100_000
#: Columns of an incidence matrix that are multiplied at a time.
COLUMNS = 1 << 12


def multisets(block: Block, width: int = WIDTH, by_words=shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle."""
    owner, hashes = by_words(block, width)
    by = np.lexsort((hashes, owner))
    owner, hashes = owner[by], hashes[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash of n multisets at once: an n x m array of times; inf without elements."""
    out = np.full(n * m, np.inf)
    # One process an element and dyadic interval that begins below its weight.
    top = int(counts.max(initial=0))
    low, parts, k = 0, [], 0
    while low < top:
        at = np.flatnonzero(counts > low)
        width = max(low, 1)
        parts.append((at, np.full(len(at), k), np.full(len(at), low), np.full(len(at), width)))
        low, k = low + width, k + 1
    if not parts:
        return out.reshape(n, m)
    at, interval, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = mix(hashes[at] + mix(interval.astype(U64) + U64(1)))
    text, weight, width = owner[at], counts[at], width
    time, drawn = np.zeros(len(at)), 0
    for r in range(64):
        step = 1 if r < 4 else min(256, 2 << (r - 4))  # few shingles need many points: draw them in one go
        number = (np.arange(drawn, drawn + step, dtype=U64) + U64(1)) * _GOLDEN
        first = mix(seed[:, None] + number)
        second = mix(first ^ _GOLDEN)
        gap = -np.log(((first >> U64(11)).astype(float) + 1.0) * 2.0**-53) / width[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        component = ((second >> U64(32)) % U64(m)).astype(np.int64)
        level = low[:, None] + 1 + ((second & U64(0xFFFFFFFF)) & (width.astype(U64)[:, None] - U64(1))).astype(np.int64)
        counted = level <= weight[:, None]
        np.minimum.at(out, (text[:, None] * m + component)[counted], times[counted])
        limit = out.reshape(n, m).max(axis=1)
        drawn, time = drawn + step, times[:, -1]
        go = time < limit[text]
        if not go.any():
            return out.reshape(n, m)
        seed, text, weight, width, low, time = seed[go], text[go], weight[go], width[go], low[go], time[go]
    raise RuntimeError("a signature did not fill up")


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """n x BANDS hashes of consecutive components."""
    n, m = signature.shape
    parts = signature.view(U64).reshape(n, m // rows, rows)
    key = np.tile(np.arange(1, m // rows + 1, dtype=U64), (n, 1))
    for j in range(rows):
        key = mix(key * _GOLDEN ^ parts[:, :, j])
    return key


def _sign(slim: DataFrame, rows: int, bands: int, width: int) -> DataFrame:
    """(id, digest, n, keys) of (id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), SIGN_BYTES):
                owner, hashes, counts = multisets(block, width)
                keys = band_keys(signatures(owner, hashes, counts, block.n, rows * bands), rows)
                total = np.bincount(owner, counts, block.n).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(block.first, block.n), batch.column(1).slice(block.first, block.n), pa.array(total), lists], ["id", "digest", "n", "keys"])

    return slim.mapInArrow(run, "id long, digest binary, n long, keys array<long>")


def _features(texts: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature number) of each (shingle, 1..count) of all texts together, by shingle."""
    whole = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    (block,) = blocks(whole, 1 << 62)  # numbers of shingles hold within a block
    owner, shingle, counts = multisets(block, width, exact_shingles)
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    row, feature = np.repeat(owner, counts), np.repeat(shingle, counts) * (int(counts.max(initial=0)) + 1) + level
    by = np.argsort(feature, kind="stable")
    row, feature = row[by], feature[by]
    return row, np.cumsum(np.append(0, feature[1:] != feature[:-1])) if len(feature) else feature


def similarities(a: pa.Array, b: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of texts in the same places."""
    n = len(a)
    row, feature = _features(pa.concat_arrays([a, b]), width)
    total = np.bincount(row, minlength=2 * n)
    first = row < n
    left, right = ((row[side] % n) * (int(feature[-1]) + 1) + feature[side] if len(feature) else feature for side in (first, ~first))
    common = np.intersect1d(left, right, assume_unique=True)
    both = np.bincount(common // (int(feature[-1]) + 1), minlength=n) if len(common) else np.zeros(n)
    union = total[:n] + total[n:] - both
    return np.divide(both, union, out=np.zeros(n), where=union > 0)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                keep = pa.array(similarities(part.column(2), part.column(3), width) >= similarity)
                yield part.select([0, 1]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def _slices(batch: pa.RecordBatch, most: int = PAIR_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (one row at least), for bounded memory."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[2:]:
        size += np.diff(np.frombuffer(column.cast(pa.large_string()).buffers()[1], np.int64)[column.offset :][: batch.num_rows + 1])
    total, i = np.cumsum(size), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def _links(nodes: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame | None:
    """(id, label) of the nodes that verified links tie to others; None without links. ``texts``: (id, digest, text)."""
    rows = nodes.where("n > 0").select("node", F.explode("keys").alias("key"))
    heads = cut(rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count("*").alias("members")).where("members > 1"))
    crowded = guarded_broadcast(heads.where("members > 2").select("key", "head"))
    more = cut(rows.join(crowded, "key").select("key", "head", "node"))
    star = heads.where("members = 2").select(F.col("head").alias("a"), F.col("last").alias("b")).union(more.where("node <> head").select("head", "node"))
    star = cut(star.distinct())
    if star.isEmpty():
        return None
    ids = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    wanted = guarded_broadcast(cut(nodes.join(ids, "node", "left_semi").select("node", "n", "digest", F.col("least").alias("id"))))
    # Of the copies of a text, the row with the least id; so no text is a hot key.
    found = cut(texts.join(wanted, ["id", "digest"]).dropDuplicates(["node"]).select("node", "n", "text"))
    links = cut(verify(star, found, similarity, width))
    labels = None if links.isEmpty() else components(links)
    more = _between(_open(more, labels), found, similarity, width)
    more = None if more is None else cut(more)
    return labels if more is None or more.isEmpty() else components(links.union(more))


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, label, out) of the members (key, head, node) of buckets that are more than one component."""

    def labelled(df, id_col, name):
        if labels is None:
            return df.withColumn(name, F.col(id_col))
        return df.join(labels.select(F.col("id").alias(id_col), F.col("label").alias(name)), id_col, "left").withColumn(name, F.coalesce(name, id_col))

    rows = labelled(labelled(members, "node", "label"), "head", "head_label")
    rows = cut(rows.select("key", "node", "label", (F.col("label") != F.col("head_label")).alias("out")))
    # Buckets with the same members, which near copies share in most bands, are looked at once.
    number = F.xxhash64("node", F.lit(7)).cast("decimal(20,0)")
    facts = rows.groupBy("key").agg(F.count_if("out").alias("outs"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(number).alias("s"))
    chosen = facts.where("outs > 0").groupBy("m", "x", "s").agg(F.min("key").alias("key")).select("key")
    return rows.join(guarded_broadcast(cut(chosen)), "key", "left_semi")


def _between(members: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame | None:
    """Pairs (a, b) of labels that a verified link ties, of ``members`` (key, node, label, out): in a bucket, each text
    that is ``out`` is held against all texts of other labels. None if there are none.

    A bucket of any size is cut to blocks of bounded texts; a task multiplies the incidence matrices of two blocks,
    so pairs are never rows. A multiset is the set of its (shingle, 1..count), so products are exact overlaps.
    """
    members = cut(members.join(texts.select("node", "n"), "node"))
    if members.isEmpty():
        return None
    size = lambda which: F.greatest(F.ceil(F.count_if(which) / GROUP_BLOCK), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / GROUP_SHINGLES)).cast("int")
    sizes = members.groupBy("key").agg(size(F.col("out")).alias("bo"), size(~F.col("out")).alias("bi"))
    rows = members.join(guarded_broadcast(cut(sizes)), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("bo")).otherwise(F.col("bi"))).cast("int"))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    block = F.col("block")
    own = F.concat(upto(F.col("bo"), lambda k: task(0, F.least(block, k), F.greatest(block, k))), upto(F.col("bi"), lambda k: task(1, block, k)))
    tasks = F.when(F.col("out"), own).otherwise(upto(F.col("bo"), lambda k: task(1, k, block)))
    dealt = rows.select("key", "node", "label", "out", "block", F.explode(tasks).alias("t"))
    dealt = dealt.join(texts.select("node", "text"), "node").select("key", "t.*", "label", "out", "block", "text")

    def run(key, table):
        _, kind, i, j = (k.as_py() for k in key)
        table = table.combine_chunks()
        label, block, out = (table.column(c).to_numpy() for c in ("label", "block", "out"))
        row, x = _features(table.column("text"), width)
        total = np.bincount(row, minlength=len(label))
        left = (block == i) & (out if kind else True)
        right = ~out if kind else block == j
        a, b = _linked(row, x, total, np.flatnonzero(left), np.flatnonzero(right), label, similarity)
        pair = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])], 1), axis=0)
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    return dealt.groupBy("key", "kind", "i", "j").applyInArrow(run, "a long, b long")


def _linked(row, feature, total, left, right, label, similarity) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right texts of different labels that are similar enough. ``feature`` ascends from 0."""
    if not len(feature):
        return left[:0], right[:0]
    place = [np.full(len(total), -1) for _ in range(2)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    # Only what both sides have counts; near copies have little else than that in common.
    shared = np.ones(int(feature[-1]) + 1, bool)
    for side in place:
        has = np.zeros(len(shared), bool)
        has[feature[side[row] >= 0]] = True
        shared &= has
    keep = shared[feature]
    row, feature = row[keep], (np.cumsum(shared) - 1)[feature[keep]]
    both, n = np.zeros((len(left), len(right)), np.float32), int(shared.sum())
    for start in range(0, n, COLUMNS):
        at = slice(*np.searchsorted(feature, [start, start + COLUMNS]))
        sides = []
        for side, size in zip(place, (len(left), len(right)), strict=True):
            where = side[row[at]]
            matrix = np.zeros((size, min(COLUMNS, n - start)), np.float32)
            matrix[where[where >= 0], feature[at][where >= 0] - start] = 1
            sides.append(matrix)
        both += sides[0] @ sides[1].T
    union = total[left][:, None] + total[right][None, :] - both.astype(np.float64)
    a, b = np.nonzero((both >= similarity * union) & (union > 0) & (label[left][:, None] != label[right][None, :]))
    return left[a], right[b]


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity=SIMILARITY, width=WIDTH, rows=ROWS, bands=BANDS) -> tuple[DataFrame, DataFrame]:
    """((id, digest) of each row that has an id, (digest, class_id, first) of each text): class_id is the smallest id of
    the class and ``first`` its digest."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    slim = texts.select("id", _digest(F.col("id"), F.col("text")).alias("digest"), "text")
    signed = _sign(slim, rows, bands, width)
    nodes = signed.groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbered as they are written, once
    labels = _links(nodes, slim, similarity, width)
    alone = nodes.select("digest", F.col("least").alias("class_id"), F.col("digest").alias("first"))
    if labels is None:
        return slim.select("id", "digest"), alone
    grouped = cut(labels.join(nodes.select(F.col("node").alias("id"), "digest", "least"), "id"))
    first = grouped.groupBy("label").agg(F.min(F.struct("least", "digest")).alias("best"))
    tied = grouped.join(first, "label").select("digest", F.col("best.least").alias("tied_id"), F.col("best.digest").alias("tied_first"))
    named = alone.join(guarded_broadcast(cut(tied)), "digest", "left")
    return slim.select("id", "digest"), named.select("digest", F.coalesce("tied_id", "class_id").alias("class_id"), F.coalesce("tied_first", "first").alias("first"))


def _digest(id_col, text):
    """16 bytes for the text's; a null text has those of its row's id."""
    return F.coalesce(F.unhex(F.md5(text)), F.encode(F.concat(F.lit("null "), id_col), "UTF-8"))


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row a row of ``docs``: id, class_id, kept (whether it is the one of its class that stays)."""
    ids, named = _classes(docs, id_col, text_col, **options)
    kept = (F.col("id") == F.col("class_id")) & (F.col("digest") == F.col("first"))
    found = ids.join(named, "digest").select(F.col("id").alias(id_col), "class_id", kept.alias("kept"))
    none = docs.select(F.col(id_col).cast("long").alias("id")).where("id is null")
    return found.union(none.select("id", F.lit(None).cast("long"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` of which each class keeps the one with the smallest (id, MD5 of the text); rows that repeat
    both stay once. Rows without an id stay."""
    ids, named = _classes(docs, id_col, text_col, **options)
    id_key, text_key = private(docs, "dropped_id", "dropped_digest")
    found = ids.groupBy("id", "digest").agg(F.count("*").alias("rows")).join(named, "digest")
    stays = (F.col("id") == F.col("class_id")) & (F.col("digest") == F.col("first"))
    marked = cut(found.where(~stays | (F.col("rows") > 1)).select(F.col("id").alias(id_key), F.col("digest").alias(text_key), stays.alias("stays")))
    gone = guarded_broadcast(marked.where("not stays").drop("stays"))
    this = F.col(id_col).cast("long"), _digest(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    same = (this[0] == F.col(id_key)) & (this[1] == F.col(text_key))
    out = docs.join(gone, same, "left_anti")
    twice = marked.where("stays").drop("stays")
    if twice.isEmpty():
        return out
    twice = guarded_broadcast(twice)
    once = out.join(twice, same, "left_semi").withColumns({id_key: this[0], text_key: this[1]}).dropDuplicates([id_key, text_key])
    return out.join(twice, same, "left_anti").unionByName(once.drop(id_key, text_key))
