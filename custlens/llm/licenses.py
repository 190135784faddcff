"""Operator 9 [native]: license scan by an exact set-similarity join.

Texts are cut into blocks of ``2 * STRIDE`` words that begin every ``STRIDE`` words, so that any
passage as long as a template lies within one block.  A block matches a template when it contains
at least ``CONTAINMENT`` of the template's distinct words.  All such (block, template) pairs are
found: the templates' words are put in one global order (ascending document frequency in the
corpus, then alphabetical), and a template of n words that must share m of them is indexed by
its n - m + 1 first words (prefix filter: a matching block has one of these).  Blocks join that
index on the word; a block with fewer than m distinct words is dropped (length filter), as is a
pair whose first shared word leaves too few words behind it in either set (positional filter).
The pairs that are left are verified by intersection.

Beside that, places where a phrase's words stand consecutively are found exactly (``PHRASES``).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  Templates and
phrases are constants, so the index and the word order are of bounded size; everything that
grows with the corpus is aggregated before it is shuffled.

Defined cases: a null or empty text has no words, no labels (empty strings) and score 0;
repeated rows give repeated results; rows that repeat a ``doc_id`` with another text are kept
apart; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.tables import stored, table

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"   # on text whose A-Z are not lower-cased yet
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTAINMENT = 0.8
STRIDE = 24

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Openings of license notices and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved"),
]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def _lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by ascending number of documents that have the word, ties alphabetical."""
    cased = [w for v in vocabulary for w in {v, v.upper(), v.capitalize()}]   # usual spellings; any order is right
    own = docs.select(F.explode(F.array_intersect(F.split(F.coalesce(F.col("text"), F.lit("")), SEPARATORS), _texts(cased))).alias("w"))
    found = {r["w"]: r["n"] for r in own.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT, stride: int = STRIDE) -> DataFrame:
    """One row per document: word count, phrase places, labels and score."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    if max(len(t.split()) for _, t in templates) > stride:
        raise ValueError("a template is longer than the stride")
    order = word_order(docs, sorted({w for _, s in sets for w in s}))
    place = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted(s, key=place.__getitem__)) for label, s in sets]
    index = [(w, t, i) for t, (_, s) in enumerate(sets) for i, w in enumerate(s[:len(s) - ceil(containment * len(s)) + 1])]
    prefix_words = sorted({w for w, _, _ in index})

    # every document's words are split once; those without a phrase's or a prefix's word go no further
    anchors = sorted({*prefix_words, *(p.split()[-1] for p in phrases)})
    df = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    df = df.withColumn("raw", _words(F.col("text")))
    likely = F.col("text").rlike("(?i)(?<![0-9A-Za-z])(?:" + "|".join(anchors) + ")(?![0-9A-Za-z])")
    df = df.withColumn("w", F.when(F.coalesce(likely, F.lit(False)), F.transform("raw", _lower)))
    df = df.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size("raw").cast("bigint").alias("n_words"), "w")

    def places(phrase: str) -> Column:
        p = phrase.split()
        def at(i: Column) -> Column:
            here = F.lit(True)
            for j, w in enumerate(p):
                here = here & F.coalesce(F.get(F.col("w"), i + j) == w, F.lit(False))
            return here
        return F.when(F.size("w") >= len(p), F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - len(p), F.lit(0))), at))

    names = {f"p{i}": (phrase, label) for i, (phrase, label) in enumerate(phrases.items())}
    df = stored(df.withColumns({c: F.coalesce(places(phrase), F.array().cast("array<int>")) for c, (phrase, _) in names.items()}), "license-words")

    # blocks against the index
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(stride))
    block = F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_distinct(F.slice(F.col("w"), i + 1, 2 * stride)).alias("b")))
    blocks = df.where("w is not null and size(w) > 0").select("doc_id", "text_hash", F.explode(block).alias("block"))
    blocks = blocks.select("doc_id", "text_hash", "block.start", "block.b")
    blocks = blocks.withColumn("ordered", F.array_intersect(_texts(order), F.col("b")))
    prefix = spark.createDataFrame(index, "word string, template int, place int")
    hits = blocks.select("doc_id", "text_hash", "start", F.size("b").alias("b_size"), "ordered", F.posexplode("ordered").alias("b_place", "word"))
    hits = hits.join(F.broadcast(prefix), "word")   # as many rows as the constants have words
    needed = F.get(F.array(*[F.lit(ceil(containment * len(s))) for _, s in sets]), F.col("template"))
    length = F.get(F.array(*[F.lit(len(s)) for _, s in sets]), F.col("template"))
    left = F.least(length - F.col("place"), F.size("ordered") - F.col("b_place"))
    words_of = F.get(F.array(*[_texts(s) for _, s in sets]), F.col("template"))
    hits = hits.where(F.col("b_size") >= needed).where(left + F.least(F.col("place"), F.col("b_place")) >= needed)
    hits = hits.withColumn("shared", F.size(F.array_intersect("ordered", words_of))).where(F.col("shared") >= needed)
    label = F.get(_texts([label for label, _ in sets]), F.col("template"))
    found = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(label).alias("block_labels"), F.max(F.col("shared") / length).alias("share"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "block_labels", "share")

    out = df.select("doc_id", "text_hash", "n_words", *names)
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_h")), "left")
    every = F.concat(*[F.col(c) for c in names])
    base = F.array_sort(F.array_distinct(F.concat(*[F.when(F.size(c) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for c, (_, label) in names.items()])))
    labels = F.array_sort(F.array_union(base, F.coalesce("block_labels", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
