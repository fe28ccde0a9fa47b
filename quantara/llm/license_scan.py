"""License scans by a positional index of rare tokens, with DataFrame operations only.

Templates are short passages that a licence's notice must have. An inverted index holds each template's
words by position. The document frequency of every licence word is counted over all documents; a template is
looked up by its ``ANCHORS`` words of highest inverse document frequency only, so a file without rare licence
words costs nothing after its words were split. Hits vote for (file, template, where the template would
begin); votes that agree on that place are an intersection of postings by relative position. A template with
enough of them is reported if its mandatory key phrases stand in the file too.

Votes are gathered by the MD5 of the file's words, so copies of a text vote once and share the answer, and a
text that makes up a third of all rows is no hot key.

Defined results: null and empty texts have no words, labels "" and score 0; repeated rows and ids are each
answered; ties in frequency go to the word first by code point; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantara.llm._common import cut, private

ANCHORS = 8
#: Share of a template's anchors that must agree on the place.
VOTES = 0.5
#: Score of a file that has a base phrase but no template.
BASE_SCORE = 0.5

# Phrases whose every place is counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, passage of the public licence text or its usual notice, key phrases that must be there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", ("mozilla public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software", "released into the public domain")),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text):
    """The words in lower case, one blank between them."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _words(norm):
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _places(words, norm, phrase: str):
    """Where the phrase's words stand in a row; only files that hold the phrase are looked through."""
    parts = phrase.split()

    def here(i):
        return reduce(lambda a, b: a & b, (F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(parts)))

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when(_has(norm, phrase), found).otherwise(F.array().cast("array<int>"))


def _has(norm, phrase: str):
    return F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.lit(f" {phrase} "))


def _postings(spark, templates) -> DataFrame:
    return spark.createDataFrame([(label, w, k) for label, text, _ in templates for k, w in enumerate(text.split())], "label string, word string, place int")


def anchors(files: DataFrame, templates, n: int) -> DataFrame:
    """(label, word, place, anchors): the postings of each template's ``n`` words that fewest files have.

    ``files`` has ``words``. Counts combine before the shuffle; what remains is one row a licence word.
    """
    postings = _postings(files.sparkSession, templates)
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    seen = files.select(F.explode(F.array_distinct("words")).alias("word")).where(F.col("word").isin(vocabulary))
    frequency = seen.groupBy("word").agg(F.count("*").alias("files"))
    words = postings.groupBy("label", "word").agg(F.count("*").alias("uses")).join(F.broadcast(frequency), "word", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("files", "uses", "word"))
    rare = words.withColumn("rank", rank).where(F.col("rank") <= n).select("label", "word", F.count("*").over(Window.partitionBy("label")).alias("anchors"))
    return cut(rare.join(postings, ["label", "word"]))


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", templates=TEMPLATES, phrases=PHRASES, n_anchors: int = ANCHORS, votes: float = VOTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    files = docs.select(id_col, *keep, normal(F.col(text_col)).alias("norm"))
    files = files.withColumns({"words": _words(F.col("norm")), "digest": F.md5("norm")})
    index = anchors(files, templates, n_anchors)  # labels x n_anchors words, each with its places
    hits = files.select("digest", F.posexplode("words").alias("pos", "word")).where(F.col("word").isin([r["word"] for r in index.select("word").distinct().collect()]))
    hits = hits.join(F.broadcast(index), "word").select("digest", "label", "anchors", "word", (F.col("pos") - F.col("place")).alias("begin"))
    # Distinct words a place, copies of the text counted once; both counts combine before the shuffle.
    agreed = hits.distinct().groupBy("digest", "label", "anchors", "begin").agg(F.count_distinct("word").alias("n"))
    best = agreed.where(F.col("n") >= votes * F.col("anchors")).groupBy("digest", "label").agg(F.max(F.col("n") / F.col("anchors")).alias("share"))
    found = cut(best.groupBy("digest").agg(F.collect_list(F.struct("label", "share")).alias("found")))  # one entry a template at most

    keys = {label: reduce(lambda a, b: a & b, (_has(F.col("norm"), p) for p in must)) for label, _, must in templates}
    verified = F.array_compact(F.array(*(F.when(ok, F.lit(label)) for label, ok in keys.items())))
    places = [_places(F.col("words"), F.col("norm"), p) for p in phrases]
    named = F.array_compact(F.array(*(F.when(_has(F.col("norm"), p), F.lit(label)) for p, label in phrases.items())))
    rows = files.select(
        id_col, *keep, "digest",
        F.size("words").cast("long").alias("n_words"),
        F.concat(*places).alias("at"),
        F.array_sort(F.array_distinct(named)).alias("base"),
        verified.alias("verified"),
    ).alias("f").join(found.alias("v"), "digest", "left")
    hit = F.filter(F.coalesce("found", F.array().cast("array<struct<label:string,share:double>>")), lambda x: F.array_contains(F.col("verified"), x["label"]))
    rows = rows.withColumn("hit", hit)
    share = F.array_max(F.transform("hit", lambda x: x["share"]))
    return rows.select(
        id_col, *keep, "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("hit", lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(share, F.lit(0.0)), F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )
