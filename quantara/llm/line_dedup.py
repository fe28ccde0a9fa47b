"""Fuzzy line deduplication by SimHash blocks, with DataFrame operations only.

Lines are normalised to lower-case words of letters with a blank between them. Equal lines collapse first. A line's
name is its place (id, hash of the text, line number), and the first place stands for it.

A line's fingerprint is a SimHash that is voted on block by block: its words of four letters and more (short lines:
its runs of three characters) are ordered by hash, the range of hashes has a border for each block, and the four that
come next after a border cast the block's votes; a bit is set if more than half of them have it. So a changed word
disturbs the blocks next to it and leaves the others whole, lines of any length have votes of the same weight, and the
pigeonhole principle holds for blocks: lines that differ in fewer blocks than there are agree in a block. (With all
words voting on all bits, a tenth of the words changed moves ten bits of 64 anywhere, and hardly a block is whole.)

Lines that agree in a block are candidates. In each bucket the members are held against the one that shares most
buckets; those that remain apart are held against the members of other groups, in large buckets those that share one of
their rarest words, which loses no pair. Candidates within DISTANCE of
64 bits (a short fingerprint that the blocks give up, parities of character pairs in the shortest) are verified by edit similarity of the normalised lines:
by edits of words, and where a line is short (below 72 characters), by edits of characters. One line per connected
group stays, the first. The recall is below 1 and stated in the README by length.

Defined results: null texts stay null and have no lines; lines without letters always stay; rows that share an id and
a text are one document, so that equal line numbers stay or go together, and rows that share an id alone are not; rows
without an id stay as they are; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.llm._common import cut, delete_path, guarded_broadcast, is_small, private, release, scratch_path
from quantara.llm.components import components

SIMILARITY = 0.9
#: Bits of the short fingerprint by which lines of that similarity differ at most (all but a few).
DISTANCE = 13
#: Lines below so many characters are made of runs of RUN characters, others of words.
SHORT, RUN = 80, 3
#: Lines below LEAST characters are compared by the parities of their pairs of characters instead of a short fingerprint:
#: an edit turns four of these at most, and two such lines differ by three edits at most, so none of their pairs is lost
#: (one with a line of LEAST or more may have four). Those below TINY have keys of pairs, too, for their runs of three are
#: too few to stay whole.
LEAST, TINY = 40, 22
#: Kinds of characters that are counted in lines below SHORT (60 bits, so that no sum reaches the sign).
KINDS = 15
#: Letters of a word that votes, if the line has any.
LETTERS = 4
#: Blocks of short and of other lines (powers of two, 64 at most).
BLOCKS = (16, 8)
#: In buckets of so many members that the star leaves apart, each is held against each; in larger ones, lines of words are
#: if they share one of their rarest words.
CROWD = 32
#: Such lines have so many times 64 parities of words (a power of two).
ODD = 4


def _words(line):
    """The words of a line: runs of letters, in lower case."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}]+", -1), "")


def normal(line):
    """The words of a line with a blank between them."""
    return F.array_join(_words(line), " ")


def _document(text):
    """Number that tells apart the texts of an id."""
    return F.xxhash64(text)


def _lines(docs: DataFrame) -> DataFrame:
    """(id, doc, line, norm, words) of every line; one without a word has an empty ``norm``. (A filter here would have the
    words made twice, for itself and for the result.)"""
    parts = docs.select("id", _document(F.col("text")).alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    parts = parts.select("id", "doc", "line", _words(F.col("raw")).alias("words"))
    return parts.select("id", "doc", "line", F.array_join("words", " ").alias("norm"), "words")


def _digest(norm):
    """128 bits by which equal lines are found."""
    return F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(1), norm).alias("h2")


def _block(x, blocks: int):
    """The block whose border is next below x."""
    return F.shiftrightunsigned(x, 64 - (blocks.bit_length() - 1))


def _votes(hashes, blocks: int):
    """(block, bits): of each block with a word, the votes of the four words from its border on, in hash order.

    ``hashes`` ascend; longs are signed, so the first block is the one in the middle, which does no harm.
    """

    def first(x, i):  # the first has none before it
        return F.coalesce(_block(x.bitwiseXOR(F.get(hashes, i - 1)), blocks) != 0, F.lit(True))

    def majority(x, i):
        y, z, w = (F.get(hashes, F.pmod(i + k, F.size(hashes))) for k in (1, 2, 3))
        two, other = x.bitwiseAND(y), z.bitwiseAND(w)
        return two.bitwiseAND(z.bitwiseOR(w)).bitwiseOR(other.bitwiseAND(x.bitwiseOR(y)))

    def vote(x, i):
        return F.when(first(x, i), F.struct(_block(x, blocks).cast("int").alias("block"), majority(x, i).alias("bits")))

    return F.array_compact(F.transform(hashes, vote))


def _keys(votes, kind: int):
    return F.transform(votes, lambda v: F.xxhash64(F.lit(kind), v["block"], v["bits"]))


def _sketch(votes, blocks: int):
    """64 bits: as many of each block's."""
    width = 64 // blocks

    def add(all_bits, v):
        own = v["bits"].bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        return all_bits.bitwiseOR(F.call_function("shiftleft", own, v["block"] * width))

    return F.aggregate(votes, F.lit(0).cast("long"), add)


def _is_long(size, similarity: float):
    """Lines that have votes of words; those below SHORT have votes of runs too, so that alike lines share a kind."""
    return size >= similarity * SHORT


def _parities(hashes):
    """64 bits: whether an odd number of the hashes falls to each."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))))


def _bag(norm):
    """How often characters of each of KINDS kinds occur, 15 times at most, in four bits each."""

    def add(counts, c):
        at = (F.ascii(c) % KINDS) * 4
        now = F.call_function("shiftrightunsigned", counts, at).bitwiseAND(F.lit(15).cast("long"))
        return F.when(now < 15, counts + F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(counts)

    return F.aggregate(F.split(norm, ""), F.lit(0).cast("long"), add)


def _bags_apart(a, b):
    """The sum of the differences of two bags; an edit of a character adds two at most."""
    kind = lambda x, i: F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15).cast("long"))
    return functools.reduce(operator.add, (F.abs(kind(a, i) - kind(b, i)) for i in range(KINDS)))


def _runs(norm, size, length: int):
    return F.transform(F.sequence(F.lit(1), F.greatest(size - (length - 1), F.lit(1))), lambda i: F.xxhash64(F.substr(norm, i, F.lit(length))))


def _fingerprints(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``lines`` with h1, h2, size, sim, also, keys instead of (norm, words); lines too short for any edit have no keys.
    ``also`` is the ``sim`` by which a line is compared with a shorter one whose ``sim`` is of another kind."""
    about = [c for c in lines.columns if c not in ("norm", "words")]
    voting = F.filter("words", lambda w: F.octet_length(w) >= LETTERS)
    sized = lines.select(*about, *_digest(F.col("norm")), F.length("norm").alias("size"), "norm", "words", voting.alias("long_words"))
    size, none = F.col("size"), F.array().cast("array<bigint>")
    able, long = (1 - similarity) / similarity * size + 1e-9 >= 1, _is_long(size, similarity)
    words = F.transform(F.when(F.size("long_words") > 0, F.col("long_words")).otherwise(F.col("words")), lambda w: F.xxhash64(w))
    ordered = lambda use, x: F.when(use, F.sort_array(F.array_distinct(x))).otherwise(none)
    pairs = F.when(able & (size * similarity < LEAST), _runs("norm", size, 2)).otherwise(none)
    hashed = sized.select(*about, "h1", "h2", "size", ordered(able & (size < SHORT), _runs("norm", size, RUN)).alias("runs"), ordered(able & long, words).alias("word_hashes"), pairs.alias("pairs"), F.when(able & (size < SHORT), _bag(F.col("norm"))).otherwise(0).alias("bag"))
    hashed = hashed.withColumn("few", ordered(size < TINY, F.col("pairs")))
    sides = {"runs": BLOCKS[0], "word_hashes": BLOCKS[1], "few": BLOCKS[0]}
    voted = hashed.select(*about, "h1", "h2", "size", "bag", _parities(F.col("pairs")).alias("parities"), *(_votes(F.col(c), n).alias(c) for c, n in sides.items()))
    parities, by_runs, by_words = F.col("parities"), _sketch(F.col("runs"), BLOCKS[0]), _sketch(F.col("word_hashes"), BLOCKS[1])
    sim = F.when(size < LEAST, parities).when(long, by_words).otherwise(by_runs)
    also = F.when(size < LEAST, F.lit(0).cast("long")).when(size * similarity < LEAST, parities).when(long & (size < SHORT), by_runs).otherwise(0)
    return voted.select(*about, "h1", "h2", "size", sim.alias("sim"), also.alias("also"), "bag", F.concat(*(_keys(F.col(c), kind) for kind, c in enumerate(sides))).alias("keys"))


#: By what it is decided whether lines may be alike.
SIDE = ("size", "sim", "also", "bag")


def _near(a: str, b: str, similarity: float):
    """Whether lines may be alike, by their lengths and short fingerprints (of the shorter line's kind), and where edits
    of characters count, by their bags, which lose no pair. ``a``, ``b``: forms of the names of the columns SIDE."""
    (size_a, sim_a, also_a, bag_a), (size_b, sim_b, also_b, bag_b) = ([F.col(f.format(c)) for c in SIDE] for f in (a, b))
    kind = lambda size: F.when(size < LEAST, 0).when(_is_long(size, similarity), 2).otherwise(1)
    shorter = kind(F.least(size_a, size_b))
    print_a, print_b = (F.when(kind(size) == shorter, sim).otherwise(also) for size, sim, also in ((size_a, sim_a, also_a), (size_b, sim_b, also_b)))
    near = (F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b)) & (F.bit_count(print_a.bitwiseXOR(print_b)) <= DISTANCE)
    most = F.floor((1 - similarity) * F.greatest(size_a, size_b) + 1e-9)
    return near & ((shorter == 2) | (_bags_apart(bag_a, bag_b) + F.abs(size_a - size_b) <= 2 * most))


def _texts(lids: DataFrame, docs: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """(lid, size, norm, symbols) of the lines: the text of short ones, a character a word of the others.

    ``names``: (lid, name). Documents are dealt once; a document's text is split once, however many of its lines are wanted.
    """
    wanted = names.join(guarded_broadcast(cut(lids.distinct())), "lid")
    wanted = wanted.groupBy("name.id", "name.doc").agg(F.collect_list(F.struct("lid", "name.line")).alias("wanted"))
    wanted = cut(wanted)
    ids = cut(wanted.select("id").distinct())
    if is_small(ids):  # else the join below alone drops the other documents
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    texts = docs.withColumn("doc", _document(F.col("text"))).join(wanted, ["id", "doc"])
    texts = texts.select(F.split("text", "\n", -1).alias("lines"), "wanted").select("lines", F.explode("wanted").alias("w"))
    texts = texts.select("w.lid", _words(F.get("lines", F.col("w.line"))).alias("words")).withColumn("norm", F.array_join("words", " "))
    size = F.length("norm")
    texts = texts.select("lid", size.alias("size"), F.when(size < SHORT, F.col("norm")).alias("norm"), F.when(_is_long(size, similarity), _symbols(F.col("words"))).alias("symbols"))
    return cut(texts.dropDuplicates(["lid"]))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of line numbers whose normalised lines have the edit similarity.

    Edits of words cost a fraction of what those of characters do: a line of n characters has a table of n * n / 5
    cells within the bound, one of n / 6 words a 36th of it.
    """
    both = pairs
    for end in "ab":
        both = both.join(texts.select(F.col("lid").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("size", "norm", "symbols"))), end)
    by_words = _is_long(F.least("size_a", "size_b"), similarity)
    both = both.select("a", "b", *(F.when(by_words, F.col(f"symbols_{end}")).otherwise(F.col(f"norm_{end}")).alias(to) for end, to in zip("ab", "xy")))
    most = F.floor((1 - similarity) * F.greatest(F.length("x"), F.length("y")) + 1e-9).cast("int")
    both = both.select("a", "b", "x", "y", most.alias("most")).repartition(_parts(pairs))  # small rows, much work
    return both.where("levenshtein(x, y, most) >= 0").select("a", "b")


def _symbols(words):
    """A text with one character for each word: one of 2**20, by the word's hash."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    low, high = 0x3FF, 0xFFC00
    pairs = F.transform(hashes, lambda h: F.hex(F.lit(0xD800DC00) + F.shiftleft(h.bitwiseAND(F.lit(high).cast("long")), 6) + h.bitwiseAND(F.lit(low).cast("long"))))
    return F.decode(F.unhex(F.array_join(pairs, "")), "UTF-16BE")


def _parts(pairs: DataFrame, each: int = 2000) -> int:
    """A number of partitions with so many pairs each, and work for all cores."""
    return max(-(-pairs.count() // each), pairs.sparkSession.sparkContext.defaultParallelism)


def _labelled(df: DataFrame, labels: DataFrame | None, lid: str, to: str) -> DataFrame:
    if labels is None:
        return df.withColumn(to, F.col(lid))
    found = labels.select(F.col("id").alias("found_id"), F.col("label").alias("found_label"))
    return df.join(found, F.col(lid) == F.col("found_id"), "left").withColumn(to, F.coalesce("found_label", lid)).drop("found_id", "found_label")


def _links(prints: DataFrame, docs: DataFrame, similarity: float) -> DataFrame | None:
    """(id, label) of the lines (lid) that verified links tie to others; None without links."""
    brief = prints.select("lid", *SIDE)
    keys = prints.select("lid", F.explode("keys").alias("key"))
    heads = cut(keys.groupBy("key").agg(F.min("lid").alias("head"), F.max("lid").alias("last"), F.count("*").alias("members")).where("members > 1"))
    crowded = guarded_broadcast(heads.where("members > 2").select("key", "members"))
    # A line's score: the members of its buckets. Of a group of near copies, the one that the others are copies of is in
    # all large buckets, and most of the others are near it, if not near each other.
    members = keys.join(crowded, "key").groupBy("lid").agg(F.collect_list("key").alias("keys"), F.sum("members").alias("score"))
    members = cut(members.join(brief, "lid").select("lid", *SIDE, "score", F.explode("keys").alias("key")))
    two = heads.where("members = 2").select(F.col("head").alias("a"), F.col("last").alias("b")).distinct()
    for end in "ab":
        two = two.join(brief.select(F.col("lid").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in SIDE)), end)
    two = cut(two.where(_near("{}_a", "{}_b", similarity)).select("a", "b"))
    release(docs.sparkSession)
    texts = _texts(members.select("lid").union(two.select("a")).union(two.select("b")), docs, prints.select("lid", "name"), similarity)
    release(docs.sparkSession)
    head = F.max_by("lid", F.struct("score", F.xxhash64("lid")))
    heads = guarded_broadcast(cut(members.groupBy("key").agg(head.alias("head"))))
    members = cut(members.drop("score").join(heads, "key"))
    head = members.where("lid = head").select("key", *(F.col(c).alias(f"h_{c}") for c in SIDE))
    star = members.where("lid <> head").join(guarded_broadcast(cut(head)), "key").where(_near("{}", "h_{}", similarity))
    found = star.select(F.least("lid", "head").alias("a"), F.greatest("lid", "head").alias("b"))
    links = _verified(cut(found.union(two).distinct()), texts, similarity)
    links = cut(links)
    labels = None if links.isEmpty() else components(links)
    release(docs.sparkSession)
    # Members of buckets that are more than one group yet.
    rows = cut(_labelled(members.drop("head"), labels, "lid", "label"))
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    several = guarded_broadcast(cut(several.where("low <> high").select("key", "n")))
    new = cut(_verified(_remaining(cut(rows.join(several, "key")), texts, similarity), texts, similarity))
    if new.isEmpty():
        return labels
    return components(new if labels is None else labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(new))


def _remaining(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Near pairs (a, b) of members (key, lid, size, sim, also, bag, label, n) of a bucket, n being its members, that have
    different labels.

    A passage that is in many lines makes a bucket of n lines which are not alike, and n * n pairs. So lines of words in
    large buckets are met by their rarest words, none of which is of the passage; no pair within the limit is lost.
    """
    long = lambda size: _is_long(size, similarity)
    small = members.where((F.col("n") <= CROWD) | (F.col("size") < SHORT))
    pairs = _apart(small, (F.col("n") <= CROWD) | ~long(F.least("size", "o_size")), (), similarity)
    crowd = members.where((F.col("n") > CROWD) & long(F.col("size")))
    crowd = cut(crowd.groupBy("lid").agg(F.collect_list("key").alias("keys"), *(F.first(c).alias(c) for c in (*SIDE, "label"))))
    rare = crowd.join(_rare_words(crowd.select("lid").join(texts.select("lid", "symbols"), "lid"), similarity), "lid")
    # An edit of a word turns two parities at most, and one if the number of words changes.
    turned = functools.reduce(operator.add, (F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("o_odd")[i])) for i in range(ODD)))
    few = turned + F.abs(F.col("words") - F.col("o_words")) <= 2 * F.floor((1 - similarity) * F.greatest("words", "o_words") + 1e-9)
    pairs = pairs.union(_apart(rare, long(F.least("size", "o_size")) & few & F.arrays_overlap("keys", "o_keys"), ("keys", "words", "odd"), similarity))
    return cut(pairs.distinct())


def _rare_words(texts: DataFrame, similarity: float) -> DataFrame:
    """(lid, words, odd, key): the number of words, their parities, and the words of each line (lid, symbols) that the fewest of these lines have, one more than the edits that
    the similarity allows. Of two lines within so many edits, one at least has one of its rarest words (all in one order)
    in the other, and then among the other's rarest. A word's second occurrence counts as another word."""
    words = texts.select("lid", F.explode(F.regexp_extract_all("symbols", F.lit("(?s)(.)"), F.lit(1))).alias("word"))
    words = words.groupBy("lid", "word").agg(F.count("*").alias("times"))
    words = cut(words.select("lid", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"), "word").select("lid", F.xxhash64("word", "time").alias("key")))
    uses = words.groupBy("key").agg(F.count("*").alias("lines"))
    ordered = words.join(uses, "key").groupBy("lid").agg(F.sort_array(F.collect_list(F.struct("lines", "key"))).alias("keys"))
    most = F.floor((1 - similarity) / similarity * F.size("keys") + 1e-6).cast("int")  # of the longest line that may be alike
    hashes = F.col("keys")["key"]
    part = lambda i: F.filter(hashes, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(ODD - 1).cast("long")) == i)
    odd = F.array(*(_parities(part(i)) for i in range(ODD)))
    return ordered.select("lid", F.size("keys").alias("words"), odd.alias("odd"), F.explode(F.slice("keys", F.lit(1), most + 1)["key"]).alias("key"))


def _apart(members: DataFrame, also, more: tuple[str, ...], similarity: float) -> DataFrame:
    """Near pairs (a, b) of members (key, lid, size, sim, also, bag, label, more) that share a key and have different
    labels, if ``also`` holds; the largest group of a key is met by the others and not by itself."""
    groups = members.groupBy("key", "label").agg(F.count("*").alias("uses"))
    hub = groups.groupBy("key").agg(F.max(F.struct("uses", "label"))["label"].alias("hub"))
    hub = guarded_broadcast(cut(hub))
    rows = cut(members.join(hub, "key"))
    out = rows.where("label <> hub").select("key", *(F.col(c).alias(f"o_{c}") for c in ("lid", *SIDE, "label", *more)))
    once = (F.col("label") == F.col("hub")) | (F.col("o_lid") < F.col("lid"))
    near = _near("{}", "o_{}", similarity)
    # The join itself drops what is not near.
    pairs = out.alias("o").join(rows.alias("r"), (F.col("o.key") == F.col("r.key")) & (F.col("label") != F.col("o_label")) & once & near & also)
    return pairs.select(F.least("o_lid", "lid").alias("a"), F.greatest("o_lid", "lid").alias("b"))


def line_groups(docs: DataFrame, path: str, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(lines, groups) of (id, text): (id, doc, line, h1, h2) of each line, and (h1, h2, name, uses, keep) of the
    distinct ones, ``keep`` being the name of the occurrence that stays. ``path``: a folder that both read."""
    spark = docs.sparkSession
    _fingerprints(_lines(docs), similarity).write.parquet(f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines").where("size > 0")
    name = F.struct("id", "doc", "line").alias("name")
    one = lines.groupBy("h1", "h2").agg(F.min(name).alias("name"), F.count("*").alias("uses"), *(F.first(c).alias(c) for c in (*SIDE, "keys")))
    one.withColumn("lid", F.monotonically_increasing_id()).write.parquet(f"{path}/prints")  # numbered as they are written, once
    prints = spark.read.parquet(f"{path}/prints")
    del one  # with it goes its shuffle
    release(spark)
    labels = _links(prints, docs, similarity)
    about = ["h1", "h2", "name", "uses"]
    lines = lines.select("id", "doc", "line", "h1", "h2")
    if labels is None:
        return lines, prints.select(*about, F.col("name").alias("keep"))
    # Components are named by numbers; the occurrence that stays is the first by name.
    grouped = cut(labels.withColumnRenamed("id", "lid").join(prints.select("lid", "name"), "lid"))
    first = grouped.groupBy("label").agg(F.min("name").alias("keep"))
    kept = grouped.join(first, "label").select("lid", "keep")
    return lines, prints.join(kept, "lid", "left").select(*about, F.coalesce("keep", "name").alias("keep"))


def dedup_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", similarity: float = SIMILARITY, out=("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``text_col`` cut to the lines that stay, and the numbers of lines before and dropped."""
    spark = docs.sparkSession
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    path = scratch_path(spark, "lines")
    lines, groups = line_groups(slim, path, similarity)
    # Only lines with several occurrences, or in a group with others, can go.
    risky = groups.where("uses > 1 or keep <> name").select("h1", "h2", "keep.*").withColumnsRenamed({"id": "keep_id", "doc": "keep_doc", "line": "keep_line"})
    stays = (F.col("id") == F.col("keep_id")) & (F.col("doc") == F.col("keep_doc")) & (F.col("line") == F.col("keep_line"))
    gone = lines.join(guarded_broadcast(cut(risky)), ["h1", "h2"]).where(~stays)
    key, doc, drop = private(docs, "line_id", "line_doc", "line_drop")
    gone = cut(gone.groupBy(F.col("id").alias(key), F.col("doc").alias(doc)).agg(F.collect_set("line").alias(drop)))  # bounded by a document's lines
    delete_path(spark, path)
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in out}]
    same = (F.col(id_col).cast("long") == F.col(key)) & (_document(F.col(text_col).cast("string")) == F.col(doc))
    x = docs.select(*kept).join(guarded_broadcast(gone), same, "left")
    parts = F.split(F.col(text_col).cast("string"), "\n", -1)
    left = F.filter(parts, lambda _, i: ~F.array_contains(F.col(drop), i))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    counts = [F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(v)).cast("long") for c, v in ((text_col, parts), (drop, F.col(drop)))]
    return x.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept), *(c.alias(n) for c, n in zip(counts, out, strict=True)))
