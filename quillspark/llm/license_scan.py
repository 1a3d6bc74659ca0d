"""License scans by diagonal voting, with DataFrame operations.

All rolling word k-grams of all documents are joined by hash to the positions of the same
k-grams in the templates (the words themselves are compared in the join, so a hash never decides). A hit at word
p for template word t votes for diagonal p - t. Votes are summed per diagonal, neighbouring
diagonals that continue each other (words were added or left out) are merged, and a merged span is
verified by the share of the template's k-grams it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import texts

# fixed values: phrases that count as places, and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Passages of common licences and notices, with labels of this scan's own.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution", "creative-commons"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

K = 3  # words of a k-gram; shorter templates use all their words
BAND = 4  # diagonals that may continue each other differ by at most so many words
GAP = 6  # and lie at most so many words apart
LEAST_SHARE = 0.6  # of a template's k-grams in a verified span
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text as they are written: runs of letters a-z and A-Z, digits and characters beyond ASCII."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def _lower(word: Column) -> Column:
    return F.translate(word, UPPER, UPPER.lower())


def template_grams(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per k-gram of each template; as many rows as the templates have words, whatever the corpus."""
    rows = []
    for number, (phrase, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in notices]):
        w = phrase.split()
        k = min(K, len(w))
        if k < 2:
            raise ValueError(f"template {phrase!r} has fewer than two words")
        for t in range(len(w) - k + 1):
            rows.append((number, label, is_base, len(w) - k + 1, t, k, *w[t:t + k], *[None] * (K - k)))
    found = spark.createDataFrame(rows, "template int, label string, is_base boolean, n_grams int, t int, k int, a string, b string, c string")
    return found.withColumn("hash", F.xxhash64("k", "a", "b", "c"))


def hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, template, label, is_base, n_grams, k, p, t: every k-gram of a document in a template.

    Each document also has one row with p = -1 and no template.
    """
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    n = F.size("w")
    # one row per word with the two after it, and one with the number -1 that each document has
    zipped = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("w")).alias("a"), F.col("w").alias("b"), F.slice("w", 2, F.greatest(n, F.lit(1))).alias("c"))
    each = rows.select("doc_id", "text_hash", n.cast("long").alias("n_words"), F.posexplode(zipped).alias("q", "g")).select(
        "doc_id", "text_hash", "n_words", (F.col("q") - 1).alias("p"), "g.a", "g.b", "g.c")
    low = [F.lower(c) for c in "abc"]
    document = F.when(F.col("p") < 0, F.lit(0).cast("long"))
    two = F.coalesce(document, F.xxhash64(F.lit(2), *low[:2]))
    three = F.when(F.col("p") >= 0, F.xxhash64(F.lit(3), *low))
    grams = each.select("*", F.explode(F.array(two, three)).alias("hash"))
    start = docs.sparkSession.createDataFrame([(None, None, None, None, None, 2, None, None, None, 0)], templates.schema)
    t = F.broadcast(templates.unionByName(start).withColumnsRenamed({c: f"t_{c}" for c in "abc"}))
    # the words themselves are compared on the rows that the hash finds
    same = [_lower(grams[c]).eqNullSafe(t[f"t_{c}"]) | (t["k"] < i) | t["template"].isNull() for i, c in enumerate("abc", 1)]
    found = grams.join(t, (grams["hash"] == t["hash"]) & same[0] & same[1] & same[2])
    return settle(found.select("doc_id", "text_hash", "n_words", "template", "label", "is_base", "n_grams", "k", "p", "t").distinct(), "license-hits")


def spans(hit: DataFrame, band: int = BAND, gap: int = GAP) -> DataFrame:
    """Merged spans: doc_id, text_hash, template, label, is_base, start, end (words), share of the template's k-grams.

    Base templates stand for one phrase word by word, so their diagonals are not merged.
    """
    key = ["doc_id", "text_hash", "template", "label", "is_base", "n_grams"]
    diagonals = hit.where("p >= 0").groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("p").alias("lo"), F.max(F.col("p") + F.col("k")).alias("hi"))
    order = Window.partitionBy(*key).orderBy("lo", "hi", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("is_base") | F.lag("diagonal").over(order).isNull() | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > band)
             | (F.col("lo") - F.max("hi").over(before) > gap))
    groups = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order))
    return groups.groupBy(*key, "span").agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.least(
        F.lit(1.0), F.sum("votes") / F.col("n_grams")).alias("share")).drop("span", "n_grams")


def scan(docs: DataFrame, base=BASE, notices=NOTICES, least: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are the smallest and
    largest start (null without one). ``labels`` adds the labels of verified notices; ``score`` is
    the largest share of a template found. Rows that repeat both id and text are one document and give one row;
    a null text counts as empty, and a null id as an id of its own.
    """
    found = hits(docs, template_grams(docs.sparkSession, base, notices))
    key = ["doc_id", "text_hash"]
    places = spans(found).withColumn("verified", F.col("share") >= F.when(F.col("is_base"), 1.0).otherwise(least))
    every = found.where("p < 0").select(*key, "n_words").unionByName(places.drop("template"), allowMissingColumns=True)
    in_base = F.col("is_base") & F.col("verified")
    per = every.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(in_base, 1)).alias("n_base"),
        F.min(F.when(in_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(in_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(in_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(~F.col("is_base") | F.col("verified"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("verified"), 1)).alias("n_spans"),
    )
    return per.drop("text_hash")
