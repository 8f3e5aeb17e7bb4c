"""License scans (operator 10): diagonal voting on word k-grams, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in lower case.

* Every word of every text starts a window of 4 words.  A window whose first words are a phrase of
  ``PHRASES`` is a base place.
* The hash of a window's first 3 words is joined with all positions of the templates
  (``TEMPLATES``; a table of fixed size, so it is broadcast), and their words are compared.
* Hits vote for (document, template, diagonal): text position less template position.
  Neighbouring diagonals, at most ``MAX_SHIFT`` apart (words put in or left out), are merged.
* A merged span is verified by its coverage, the share of the template's 3-grams in it, of at
  least ``MIN_COVERAGE``, and by its length, at most ``MAX_STRETCH`` times the template's.

Score: 1 with a base place, else the best coverage of a verified span (0 without one).
One row for each row of the table.  Defined cases: null and empty texts have no words;
repeated rows each get the same row; a null id is kept; an empty table gives no rows;
columns other than doc_id and text are not read.  A letter that is not ASCII but has an
ASCII lower-case form (the Kelvin sign) counts as that form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlytics.llm.common import documents, numbered, written

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening words of public licences and of usual notices, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation either version 3 of the license "
            "or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced"),
)

GRAM = 3
WINDOW = max(len(p.split()) for p in PHRASES)
MAX_SHIFT = 3
MIN_COVERAGE = 0.6
MAX_STRETCH = 1.5
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words, with an empty one in front or behind if the text has other characters there."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _NO_WORD, -1)


def _windows(df: DataFrame, *keep: str) -> DataFrame:
    """(keep.., pos, w0..w3): a row for each word; one with pos null if there is none."""
    n = F.size("words")
    zipped = F.arrays_zip("words", *[F.slice("words", k + 1, n) for k in range(1, WINDOW)])
    rows = df.select(*keep, F.posexplode_outer(zipped).alias("pos", "w"))
    return rows.select(*keep, "pos", *[F.col("w")[str(k) if k else "words"].alias(f"w{k}") for k in range(WINDOW)])


def _gram() -> Column:
    return F.when(F.col(f"w{GRAM - 1}").isNotNull(), F.xxhash64(*[f"w{k}" for k in range(GRAM)]))


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    """(gram, t0.., at array<struct<template, label, at, grams, length>>), a row for each 3-gram of the templates."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)],
                                 "template int, label string, text string").withColumn("words", _words(F.col("text")))
    grams = _windows(rows.withColumn("length", F.size("words")), "template", "label", "length").withColumn("gram", _gram())
    spot = F.struct("template", "label", F.col("pos").alias("at"), (F.col("length") - (GRAM - 1)).alias("grams"), "length")
    return (grams.where("gram is not null")
            .groupBy("gram", *[F.col(f"w{k}").alias(f"t{k}") for k in range(GRAM)]).agg(F.collect_list(spot).alias("spots")))


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    spans array<struct<label, start, end, coverage>> (words, end exclusive)."""
    text = (numbered(docs.select("doc_id", "text")).withColumn("words", _words(F.col("text")))
            .withColumn("before", (F.element_at("words", 1) == "").cast("int"))
            .withColumn("n_words", (F.size("words") - F.col("before")
                                    - ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")).cast("long")))
    phrase = F.lit(None).cast("string")
    for words, label in PHRASES.items():
        same = F.lit(True)
        for k, w in enumerate(words.split()):
            same &= F.col(f"w{k}") == w
        phrase = F.when(same, label).otherwise(phrase)
    rows = (_windows(text, "row", "doc_id", "before", "n_words").withColumn("gram", _gram()).withColumn("phrase", phrase)
            .join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram", "left"))  # of fixed size
    same = F.lit(True)
    for k in range(GRAM):
        same &= F.col(f"w{k}") == F.col(f"t{k}")
    spots = F.when(same, F.col("spots"))
    rows = written(rows.select("row", "doc_id", "n_words", "pos", (F.col("pos") - F.col("before")).cast("long").alias("word"),
                               "phrase", spots.alias("spots"))
                   .where("coalesce(pos, 0) = 0 or phrase is not null or spots is not null"), "license-hits")

    hits = rows.where("spots is not null").select("row", "word", F.explode("spots").alias("s"))
    votes = (hits.select("row", "word", "s.*").withColumn("diagonal", F.col("word") - F.col("at"))
             .groupBy("row", "template", "label", "grams", "length", "diagonal")
             .agg(F.count("*").alias("votes"), F.min("word").alias("start"), F.max("word").alias("end"),
                  F.collect_set("at").alias("ats")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    runs = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > MAX_SHIFT).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("new").over(order))
    spans = (runs.groupBy("row", "template", "label", "grams", "length", "run")
             .agg(F.min("start").alias("start"), (F.max("end") + GRAM).alias("end"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"))
             .withColumn("coverage", F.round(F.col("covered") / F.col("grams"), 6))
             .where((F.col("coverage") >= MIN_COVERAGE) & (F.col("end") - F.col("start") <= MAX_STRETCH * F.col("length"))))
    found = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", "start", "end", "coverage"))).alias("spans"))

    base = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase").isNotNull(), F.col("word"))).alias("first_word"),
        F.max(F.when(F.col("phrase").isNotNull(), F.col("word"))).alias("last_word"),
        F.sort_array(F.collect_set("phrase")).alias("own"))
    none = F.array().cast("array<string>")
    more = F.coalesce(F.transform("spans", lambda s: s["label"]), none)
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return base.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", more))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(best, F.lit(1.0))).alias("score"), "spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan(documents(spark, sf_dir)).drop("spans")
