"""Licence scan: n-gram logistic regression over paragraphs, a calibrated unknown class, templates to confirm (operator 2).

DataFrame functions and Spark ML only; no Python runs on executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rareclass.llm.shared import stored

UNKNOWN = "unknown"
#: Notices of each family as they stand in documents. The wording of public licences.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Released under the CC0 1.0 Universal public domain dedication license."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright 2020 Example Corporation. All rights reserved."),
    ("proprietary", "No part of this publication may be reproduced without the prior written permission of the copyright holder."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)
# End of the fixed values.
#: Sentences that use the same words and license nothing.
NEGATIVES = (
    "She showed her driving license to the officer.", "The license plate of the car was stolen.", "Copyright law changed in that year.",
    "He asked for permission to leave the room.", "Human rights are reserved for nobody.", "A gun license is required in this state.",
    "The warranty of the washing machine expired.", "They fought for equal rights under the law.", "The apache helicopter landed in the field.",
    "The fishing license costs ten euros a year.", "Permission was denied by the owner of the house.", "Public domain books are old.",
    "The software was sold with a licensed operator.", "Redistribution of wealth was the topic of the meeting.", "All seats are reserved.",
    "Is this film rated and licensed for the cinema?", "The gnu is an antelope of the public park.", "Without permission nobody may enter the building.",
)
#: Words in half a piece of a paragraph. Pieces overlap by half, so a span of this length is whole in one of them: the longest
#: template has 29 words, and a span may be half as long again.
REACH = 48
#: Words on either side of a span that the classifier sees with it.
AROUND = 3
#: Every template n-gram used as a feature holds one of these; a paragraph without any has no feature and is unknown.
ANCHORS = ("licen", "copyright", "rights", "permission", "redistribut", "gnu", "public domain", "apache", "mozilla", "creative commons",
           "bsd", "cc by", "cc0")


class Licences(NamedTuple):
    """The fitted classifier, its temperature and the family names by label."""

    vocabulary: list[str]
    model: object
    temperature: float
    families: list[str]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, numbers and versions as ``#``."""
    flat = F.regexp_replace(F.lower(text), r"[0-9]+(\.[0-9]+)*", " # ")
    return F.filter(F.split(F.trim(F.regexp_replace(flat, r"[^\p{L}#]+", " ")), " "), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct runs of two and three words, and the words next to the ends, so that very short notices have some too."""
    marked = F.concat(F.array(F.lit("^")), words, F.array(F.lit("$")))
    pairs = F.zip_with(marked, F.slice(marked, 2, F.size(marked)), lambda a, b: F.concat_ws(" ", a, b))
    triples = F.zip_with(F.slice(marked, 1, F.size(marked) - 2), F.slice(pairs, 2, F.size(marked)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.filter(F.concat(pairs, triples), lambda g: g.isNotNull() & ~g.rlike("^[^ ]*$")))


def has_anchor(text: Column) -> Column:
    lowered, found = F.lower(text), F.lit(False)
    for a in ANCHORS:
        found = found | lowered.contains(a)
    return found


def may_have_anchor(text: Column) -> Column:
    """True wherever the words of ``text`` hold an anchor, whatever stands between the two words of one (a line end, a hyphen)."""
    lowered, found = F.lower(text), F.lit(False)
    for a in ANCHORS:
        both = F.lit(True)
        for word in a.split(" "):
            both = both & lowered.contains(word)
        found = found | (both & lowered.rlike(r"cc[^\p{L}0-9]+by") if a == "cc by" else both)
    return found


def _variants(spark: SparkSession) -> DataFrame:
    """(family, words, fold): templates whole, cut at either end, and with single words left out or replaced."""
    rows = [(f, t) for f, t in TEMPLATES] + [(UNKNOWN, t) for t in NEGATIVES]
    base = spark.createDataFrame(rows, "family string, text string").coalesce(1).withColumn("words", words_of(F.col("text")))
    n = F.size("words")
    cuts = base.select("family", F.explode(F.array(
        F.col("words"), F.slice("words", 1, F.greatest(F.ceil(n * 0.75), F.lit(2)).cast("int")),
        F.slice("words", F.greatest(F.floor(n * 0.25), F.lit(1)).cast("int"), n),
        F.concat(F.array(F.lit("note"), F.lit("that")), F.col("words")), F.concat(F.col("words"), F.array(F.lit("see"), F.lit("below"))),
        F.concat(F.array(F.lit("copyright"), F.lit("#")), F.col("words")))).alias("words"))
    drops = base.withColumn("k", F.explode(F.sequence(F.lit(1), n))).select("family", F.explode(F.array(
        F.concat(F.slice("words", 1, F.col("k") - 1), F.slice("words", F.col("k") + 1, n)),
        F.concat(F.slice("words", 1, F.col("k") - 1), F.array(F.lit("thing")), F.slice("words", F.col("k") + 1, n)))).alias("words"))
    empty = base.limit(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("words"))
    return cuts.unionByName(drops.filter(F.size("words") > 1)).unionByName(empty).dropDuplicates(["words"]) \
        .withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(4)))


def train(spark: SparkSession, penalty: float = 2e-3) -> Licences:
    """Fit on three quarters of the template variants, choose the temperature on the rest. The training rows come from the fixed
    templates and negatives alone, so their number does not grow with the corpus."""
    families = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
    anchored = F.filter(grams_of(F.col("words")), lambda g: has_anchor(g))
    rows = stored(_variants(spark).select("fold", "family", anchored.alias("grams")).withColumn(
        "label", F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1), "licence-rows")
    vectors = CountVectorizer(inputCol="grams", outputCol="x", binary=True, minDF=1.0, vocabSize=1 << 16).fit(rows)
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=penalty, elasticNetParam=0.2,
                               maxIter=200, tol=1e-6).fit(vectors.transform(rows.filter("fold <> 0")))
    tried = [0.25 * k for k in range(1, 17)]
    held = model.transform(vectors.transform(rows.filter("fold = 0"))).select(
        "label", vector_to_array("rawPrediction").alias("raw"))
    losses = held.agg(*[F.avg(-F.log(F.greatest(F.element_at(softmax(F.col("raw"), t), F.col("label").cast("int") + 1), F.lit(1e-12))))
                        .alias(f"t{i}") for i, t in enumerate(tried)]).first()
    return Licences(vectors.vocabulary, model, min(zip(losses, tried, strict=True))[1], families)


def softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    parts = F.transform(raw, lambda v: F.exp((v - top) / temperature))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return F.transform(parts, lambda v: v / total)


def pieces_of(paragraphs: DataFrame) -> DataFrame:
    """Overlapping pieces of every paragraph that hold an anchor (first: number of the first word, words), line ends and comment signs
    dropped. Each step is a column of its own: what a lambda refers to is evaluated again for every element."""
    words = F.array_join(words_of(F.regexp_replace("text", r"(?m)^\s*#+", " ")), " ")
    halves = F.regexp_extract_all(words, F.lit(r"(?:\S++ ?+){1,%d}" % REACH), F.lit(0))
    each = paragraphs.select("row", "doc_id", "paragraph", F.explode(F.array(halves)).alias("halves"))
    each = each.select("row", "doc_id", "paragraph", F.size("halves").alias("n"), F.explode(F.arrays_zip(
        F.col("halves").alias("here"), F.concat(F.slice("halves", 2, F.size("halves")), F.array(F.lit(""))).alias("next"),
        F.sequence(F.lit(0), F.greatest(F.size("halves") - 1, F.lit(0))).alias("k"))).alias("p"))
    piece = F.trim(F.concat_ws(" ", F.trim("p.here"), F.trim("p.next")))
    return each.filter((F.col("p.k") == 0) | (F.col("p.k") + 1 < F.col("n"))).select(
        "row", "doc_id", "paragraph", (F.col("p.k") * REACH).alias("first"), piece.alias("piece")).filter(
        has_anchor(F.col("piece"))).withColumn("words", F.split("piece", " ")).drop("piece")


def _windows(pairs: Column, template: Column, alike: float) -> Column:
    """(start, end, matched) of the shortest runs of ``pairs`` that hold the share ``alike`` of the template's pairs."""
    places = F.filter(F.transform(pairs, lambda p, i: F.when(F.array_contains(template, p), i)), lambda i: i.isNotNull())
    reach = F.size(template) + F.floor(F.size(template) / 2).cast("int") + 4

    def run(s: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("seen"), s.alias("end"))
        found = F.aggregate(
            F.filter(places, lambda q: (q >= s) & (q < s + reach)), start,
            lambda a, q: F.when(F.array_contains(a["seen"], F.get(pairs, q)), a).otherwise(
                F.struct(F.array_append(a["seen"], F.get(pairs, q)).alias("seen"), q.alias("end"))))
        return F.struct(s.alias("start"), found["end"].alias("end"), F.size(found["seen"]).alias("matched"))

    runs = F.filter(F.transform(places, run), lambda r: r["matched"] >= alike * F.size(template))
    return F.filter(runs, lambda r: ~F.exists(runs, lambda o: (o["start"] > r["start"]) & (o["end"] <= r["end"]) & (o["matched"] >= r["matched"])))


def scan(docs: DataFrame, known: Licences, least: float = 0.5, alike: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(rows, paragraphs).

    ``rows``: row, doc_id, n_paragraphs (runs of lines that are not blank). ``paragraphs``: row, doc_id, paragraph (its number from 0),
    text, family, probability, similarity, confirmed: one row per notice in a paragraph, and one ``unknown`` row for a paragraph that has an
    anchor word and no notice. A notice is a span of words, over line ends as well, that holds the share ``alike`` of the word pairs
    of a template and, with the words around it, has a calibrated probability of ``least`` for the template's family. Of overlapping
    spans the one with most pairs stays, each missing pair of its template counted against three. ``text`` has the words of the span.
    """
    spark = docs.sparkSession
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    numbered = F.transform(F.col("parts"), lambda p, i: F.struct(i.alias("paragraph"), p.alias("text")))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", parts.alias("parts")).select(
        "row", "doc_id", F.size("parts").alias("n_paragraphs"), F.when(may_have_anchor(F.col("text")), numbered).alias("found")), "licence-paragraphs")
    # candidate pieces are few bytes but costly rows, so they are dealt over all tasks instead of by file size
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces_of(rows.select("row", "doc_id", F.inline("found"))).repartition(tasks, "row", "paragraph", "first")
    # one row, from the fixed templates
    templates = spark.createDataFrame([*TEMPLATES], "family string, template string").coalesce(1).select(
        "family", F.filter(grams_of(words_of(F.col("template"))), lambda g: ~g.rlike(r"[\^$]|^[^ ]+ [^ ]+ ")).alias("pairs")) \
        .agg(F.sort_array(F.collect_list(F.struct("family", "pairs"))).alias("templates"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    share = lambda t: F.size(F.array_intersect(t["pairs"], F.col("pairs"))) / F.size(t["pairs"])
    each = pieces.withColumn("pairs", pairs).crossJoin(F.broadcast(templates)).withColumn(
        "shares", F.transform("templates", share)).select(
        "row", "doc_id", "paragraph", "first", "words", "pairs", F.array_max("shares").alias("nearest"),
        F.explode_outer(F.filter("templates", lambda t, i: F.get("shares", i) >= alike)).alias("t"))
    # without a template the piece as a whole is judged, so that its paragraph has a row
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.size("words") - 2).alias("end"), F.lit(0).alias("matched")))
    each = each.withColumn("w", F.explode(F.when(F.col("t").isNull(), whole).otherwise(_windows(F.col("pairs"), F.col("t.pairs"), alike))))
    before = F.least(F.col("w.start"), F.lit(AROUND))
    each = each.select(
        "row", "doc_id", "paragraph", F.col("t.family").alias("named"), (F.col("first") + F.col("w.start")).alias("start"),
        (F.col("first") + F.col("w.end") + 1).alias("end"),
        (F.col("w.matched") - 3 * (F.size("t.pairs") - F.col("w.matched"))).alias("score"),
        F.coalesce(F.col("w.matched") / F.size("t.pairs"), "nearest").alias("similarity"),
        F.array_join(F.slice("words", F.col("w.start") + 1, F.col("w.end") - F.col("w.start") + 2), " ").alias("text"),
        F.slice("words", F.col("w.start") + 1 - before, F.col("w.end") - F.col("w.start") + 2 + before + AROUND).alias("seen"))
    each = each.withColumn("grams", F.filter(grams_of(F.col("seen")), lambda g: has_anchor(g)))
    vectors = CountVectorizerModel.from_vocabulary(known.vocabulary, inputCol="grams", outputCol="x", minTF=1.0).setBinary(True)
    scored = known.model.transform(vectors.transform(each)).withColumn("p", softmax(vector_to_array("rawPrediction"), known.temperature))
    own = F.get("p", (F.array_position(F.array(*[F.lit(f) for f in known.families]), F.col("named")) - 1).cast("int"))
    scored = scored.withColumn("probability", F.coalesce(own, F.array_max("p"))).withColumn(
        "confirmed", F.col("named").isNotNull() & (F.col("probability") >= least))
    # spans that overlap, directly or through others, are one cluster; clusters are short
    place = W.partitionBy("row", "paragraph").orderBy(F.desc("confirmed"), "start", "end", "named")
    scored = scored.select("row", "doc_id", "paragraph", "named", "start", "end", "score", "similarity", "probability", "text", "confirmed") \
        .withColumn("number", F.row_number().over(place)) \
        .withColumn("reached", F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1))) \
        .filter(F.col("confirmed") | (F.col("number") == 1)) \
        .withColumn("cluster", F.sum((F.col("start") > F.coalesce("reached", F.lit(-1))).cast("int")).over(place))
    ranked = F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("m"), (-F.col("similarity")).alias("s"), (F.col("end") - F.col("start")).alias("n"), (-F.col("probability")).alias("q"),
        "start", "end", "named", "text", "confirmed")))
    clusters = scored.groupBy("row", "paragraph", "cluster").agg(F.first("doc_id").alias("doc_id"), ranked.alias("spans"))
    kept = F.aggregate("spans", F.slice("spans", 1, 1), lambda a, x: F.when(
        F.exists(a, lambda k: (k["start"] <= x["end"]) & (x["start"] <= k["end"])), a).otherwise(F.array_append(a, x)))
    out = clusters.withColumn("k", F.explode(kept))
    return rows.drop("found"), out.select(
        "row", "doc_id", "paragraph", "k.text", F.when(F.col("k.confirmed"), F.col("k.named")).otherwise(UNKNOWN).alias("family"),
        (-F.col("k.q")).alias("probability"), (-F.col("k.s")).alias("similarity"), "k.confirmed")


def scan_corpus(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licences, families (sorted, distinct), probability of the surest one (null without any).

    Whole texts are read; null and empty ones have no paragraph. Equal rows give equal results; other columns are ignored.
    """
    rows, paragraphs = scan(docs, train(docs.sparkSession))
    per_row = paragraphs.filter("confirmed").groupBy("row").agg(
        F.count("*").alias("n_licences"), F.array_sort(F.collect_set("family")).alias("families"), F.max("probability").alias("probability"))
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability")
