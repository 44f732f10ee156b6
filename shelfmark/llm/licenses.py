"""License scan by diagonal voting; DataFrame functions only.

Every rolling k-gram of words is hashed and joined to the (hash, template,
position) table of the templates, a table of fixed size that is broadcast. Hits
vote for the diagonal doc position - template position; votes are counted where
the document lies, before any shuffle. Neighbouring diagonals of a long
template are merged (words put in or left out), and a merged span counts once enough
of the template's grams lie on it within a span of about the template's length.
Short base phrases count only where all their grams lie on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, texts

# Base phrases with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Opening or notice lines of public licences, with the label each gives.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license", "apache-2.0"),
    ("gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a gram of a base phrase, and of a notice.
SHORT_GRAM, LONG_GRAM = 2, 4
#: Diagonals this near are one span; the share of a notice's grams that a span needs; its length against the notice's.
NEAR, SHARE, STRETCH = 2, 0.8, 1.3


def template_grams(spark, base=BASE, notices=NOTICES) -> DataFrame:
    """(gram, template, at, label, is_base, grams, words): at most the words of the templates, whatever the corpus."""
    rows = []
    for number, (phrase, label, is_base) in enumerate([(*b, True) for b in base] + [(*n, False) for n in notices]):
        words = phrase.split()
        k = SHORT_GRAM if is_base else LONG_GRAM
        for at in range(len(words) - k + 1):
            rows.append((words[at:at + k], number, at, label, is_base, len(words) - k + 1, len(words)))
    table = spark.createDataFrame(rows, "gram_words array<string>, template int, at int, label string, "
                                        "is_base boolean, grams int, words int")
    hashed = F.transform("gram_words", lambda word: F.xxhash64(word))
    two = F.xxhash64(*[F.get("h", F.lit(n)) for n in range(SHORT_GRAM)])
    four = F.xxhash64(*[F.get("h", F.lit(n)) for n in range(LONG_GRAM)])
    return table.withColumn("h", hashed).select(F.when(F.col("is_base"), two).otherwise(four).alias("gram"),
                                                "template", "at", "label", "is_base", "grams", "words")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of any non-ASCII characters, in
    lower case. A null or empty text has no words, no labels and a score of 0. Rows
    that repeat a doc_id and a text give the same row each; further columns are ignored.
    """
    spark = docs.sparkSession
    plain = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("key"))
    words = F.filter(F.split(ascii_lower(F.col("text")), BETWEEN_WORDS), lambda word: word != "")
    hashed = plain.select("doc_id", "key", F.transform(words, lambda word: F.xxhash64(word)).alias("h"))
    rolling = F.expr("""transform(h, (x, i) -> array(
        xxhash64(x, get(h, i + 1)), xxhash64(x, get(h, i + 1), get(h, i + 2), get(h, i + 3))))""")
    grams = (hashed.select("doc_id", "key", F.posexplode(rolling).alias("pos", "both"))
             .select("doc_id", "key", "pos", F.explode("both").alias("gram")))
    votes = (grams.join(F.broadcast(template_grams(spark)), "gram")
             .withColumn("diagonal", F.col("pos") - F.col("at"))
             .groupBy("doc_id", "key", "template", "label", "is_base", "grams", "words", "diagonal")
             .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high")))
    base = votes.filter(F.col("is_base") & (F.size("ats") == F.col("grams"))).select(
        "doc_id", "key", "label", "is_base", F.col("diagonal").alias("place"), F.lit(1.0).alias("score"))
    along = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) <= NEAR)
    merged = (votes.filter(~F.col("is_base"))
              .withColumn("opens", F.when(apart, 0).otherwise(1))
              .withColumn("span", F.sum("opens").over(along))
              .groupBy("doc_id", "key", "template", "label", "grams", "words", "span")
              .agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
                   F.min("low").alias("low"), F.max("high").alias("high"))
              .withColumn("score", F.size("ats") / F.col("grams"))
              .filter((F.col("score") >= SHARE) & (F.col("high") + LONG_GRAM - F.col("low") <= F.col("words") * STRETCH))
              .select("doc_id", "key", "label", F.lit(False).alias("is_base"), F.lit(None).cast("int").alias("place"),
                      "score"))
    names = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    found = base.unionByName(merged).groupBy("doc_id", "key").agg(
        F.count("place").alias("n_base"), F.min("place").alias("first"), F.max("place").alias("last"),
        names(F.col("is_base")).alias("base_labels"), names(F.lit(True)).alias("labels"), F.max("score").alias("score"))
    every = plain.select("doc_id", "key", F.size(words).cast("long").alias("n_words"))
    joined = every.join(found.withColumnRenamed("doc_id", "found_id").withColumnRenamed("key", "found_key"),
                        F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op8_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)
