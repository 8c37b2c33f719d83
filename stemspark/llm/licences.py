"""License scans by diagonal voting: rolling word k-gram hashes of every text are joined to the templates' positions, hits vote
for their offset (text position - template position), neighbouring offsets merge, and the span is verified against the
template's words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .native import LOWER, NON_WORD, UPPER, rolling_hashes, split_words

#: Words of a gram.
GRAM = 3
#: Offsets this near are one diagonal (words put in or left out between them).
NEIGHBOURS = 3
#: Edit similarity to the template from which a span counts.
VERIFIED = 0.8

# Phrases whose places count as such, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their licences word them, with their labels.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
}


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def template_words(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """label, template (its words): as many rows as there are templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "label string, words string")
    return rows.select("label", split_words(folded(F.col("words")), NON_WORD).alias("template"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs(doc_id, text), and spans:
    the verified (label, start, stop, similarity) in words from 0.

    base_labels are those of PHRASES, labels theirs and the spans' (distinct, sorted, comma-joined, empty for none); first_word
    and last_word are the smallest and largest start of a phrase (null for none); score is 1 with a phrase, else the best
    span's similarity, else 0. Null text is empty; rows with the same doc_id and text have the same result; null doc_ids are
    passed through; other columns are ignored; an empty table gives no rows.

    The templates' grams are broadcast: their number is that of the given templates' words, whatever the corpus. Hits
    are grouped by text, template and offset, never by gram.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text").alias("row2"), split_words(folded(F.col("text")), NON_WORD).alias("words"))
    known = template_words(spark, TEMPLATES if templates is None else templates)
    grams = F.broadcast(rolling_hashes(known, "template", GRAM, "grams").select("label", F.posexplode_outer("grams").alias("tpos", "gram")).where("gram is not null"))

    hits = rolling_hashes(rows.select("row", "row2", "words"), "words", GRAM, "grams").select("row", "row2", F.posexplode_outer("grams").alias("pos", "gram")).join(grams, "gram")
    votes = hits.distinct().groupBy("row", "row2", "label", (F.col("pos") - F.col("tpos")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    votes = common.stored(votes, "licence-votes")
    w = Window.partitionBy("row", "row2", "label").orderBy("offset", "lo")  # the hits of one text on one template
    near = (F.col("offset") - F.lag("offset").over(w) <= NEIGHBOURS) & (F.col("lo") <= F.lag("hi").over(w) + GRAM + NEIGHBOURS)
    merged = votes.withColumn("diagonal", F.sum(F.when(near, 0).otherwise(1)).over(w))
    merged = merged.groupBy("row", "row2", "label", "diagonal").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("offset").alias("offset"))
    size = known.select("label", F.size("template").alias("size"))
    enough = merged.join(F.broadcast(size), "label").where(F.col("votes") >= F.greatest(F.lit(1), F.floor((F.col("size") - GRAM + 1) / 4)))
    # From where the template would start to where it would end, or the hits' own ends if these lie further out.
    start = F.greatest(F.least("lo", "offset"), F.lit(0))
    candidates = enough.select("row", "row2", "label", start.alias("start"), F.greatest(F.col("hi") + GRAM, F.col("offset") + F.col("size")).alias("stop"))
    asked = common.stored(candidates.groupBy("row", "row2").agg(F.collect_list(F.struct("label", "start", "stop")).alias("asked")), "licence-asked")

    texts = rows.select("row", "row2", "words").join(common.small(asked, 200_000), ["row", "row2"])
    spans = texts.select("row", "row2", "words", F.explode_outer("asked").alias("a")).select("row", "row2", "a.label", "a.start", F.least("a.stop", F.size("words")).alias("stop"), "words")
    spans = spans.select("row", "row2", "label", "start", "stop", F.slice("words", F.col("start") + 1, F.col("stop") - F.col("start")).alias("span"))
    spans = spans.join(F.broadcast(known), "label").withColumns({"s": F.array_join("span", " "), "t": F.array_join("template", " ")})
    similar = 1 - F.levenshtein("s", "t") / F.greatest(F.length("s"), F.length("t"))
    found = spans.select("row", "row2", "label", "start", "stop", similar.alias("similarity")).where(F.col("similarity") >= VERIFIED).distinct()
    # Templates that differ in a word meet at the same place: the most similar one has it.
    best = F.max("similarity").over(Window.partitionBy("row", "row2", "start"))
    found = found.withColumn("best", best).where("similarity = best").drop("best")
    found = found.groupBy("row", "row2").agg(F.array_sort(F.collect_list(F.struct("label", "start", "stop", "similarity"))).alias("spans"))
    found = common.small(common.stored(found, "licence-spans"), 200_000)

    base = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    some = F.lit(False)
    for phrase in PHRASES:
        some = some | F.contains(F.col("joined"), F.lit(f" {phrase} "))
    base = base.select("doc_id", "row", "row2", "words", F.size("words").cast("long").alias("n_words"), some.alias("some"))

    def starts(phrase: str) -> Column:
        parts = phrase.split(" ")
        first = F.transform("words", lambda x, i: F.when(x == parts[0], i))
        return F.filter(first, lambda i: i.isNotNull())

    def stands(parts: list[str]):
        return lambda i: F.array_join(F.slice("words", i + 1, len(parts)), " ") == " ".join(parts)

    none = F.expr("cast(array() as array<int>)")
    for n, phrase in enumerate(PHRASES):
        base = base.withColumn(f"s{n}", F.when(F.col("some"), starts(phrase)).otherwise(none))
    for n, phrase in enumerate(PHRASES):
        base = base.withColumn(f"p{n}", F.filter(f"s{n}", stands(phrase.split(" "))))
    base = base.select("doc_id", "row", "row2", "n_words", *[f"p{n}" for n in range(len(PHRASES))])
    places = F.concat(*[f"p{n}" for n in range(len(PHRASES))])
    marks = F.array_compact(F.array(*[F.when(F.size(f"p{n}") > 0, label) for n, label in enumerate(PHRASES.values())]))
    out = base.select("doc_id", "row", "row2", "n_words", places.alias("places"), F.array_sort(F.array_distinct(marks)).alias("marks")).join(found, ["row", "row2"], "left")
    spans_ = F.coalesce("spans", F.expr("cast(array() as array<struct<label:string,start:int,stop:int,similarity:double>>)"))
    out = out.withColumn("spans", spans_)
    return out.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("marks", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("marks", F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0))).alias("score"),
        "spans",
    )
