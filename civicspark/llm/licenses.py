"""License scans by a trained paragraph classifier, in built-in functions and Spark ML only.

Every paragraph (line) of every text becomes a sparse vector of word 1- and 2-grams; multinomial logistic regression,
trained here on license notices and on paragraphs of the corpus, gives the chance of each license family, of an unknown
license and of no license. A family counts only from a calibrated chance on and if the paragraph also holds enough of
the word 3-grams of one of the family's notices; a license-like paragraph that fails either is reported as unknown.

Notices wrapped over lines are judged in the same way as one paragraph, the words from where a notice begins to where it
would end, within lines that no blank line parts (one without letters and figures, such as a bare comment mark, is blank).
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Customary notices of license families; those under "unknown" stand for licenses outside the list.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Distributed under the terms of the GNU General Public License, version 2.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work has been dedicated to the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    ),
    "unknown": (
        "Licensed under the Artistic License 2.0.",
        "This file is licensed under the Eclipse Public License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Released under the terms of the zlib license.",
        "Use of this data is governed by a license agreement with the provider.",
        "See the LICENSE file for license terms and copyright information.",
    ),
}

FEATURES = 1 << 14
NEGATIVE_DOCS = 400
NEGATIVES = 4000
LONGEST = 20_000
ITERATIONS = 40
CONTAINED = 0.6
STEPS = 20
NONE, UNKNOWN = "none", "unknown"


def tokens(text: Column) -> Column:
    """Lower-case words and numbers; a full stop counts only before a figure."""
    lower = F.lower(text)
    plain = F.when(F.contains(lower, F.lit(".")), F.regexp_replace(lower, r"\.(?![0-9])", " ")).otherwise(lower)
    return F.regexp_extract_all(plain, F.lit(r"[a-z0-9.]+"), F.lit(0))


def once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row. It leaves a generator, so the planner cannot copy its expression into
    each of the expressions that read it (nor, within one of them, into the function run on each word)."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def grams(words: Column, n: int) -> Column:
    """Word n-grams, in order."""
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), size)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(i + 1), size), lambda a, b: F.concat_ws(" ", a, b))
    return out


def featured(frame: DataFrame) -> DataFrame:
    """Adds ``_grams``, the words and pairs of neighbouring words of a frame with ``words``.

    Blanks fill each word up to a multiple of four bytes (one at least, so that no two grams become one): for such
    strings ``hash`` is the hash of HashingTF, and :func:`likely` knows a gram's feature without making a vector.
    """
    filled = once(frame, "_filled", F.transform("words", lambda w: F.rpad(w, (F.floor(F.length(w) / 4).cast("int") + 1) * 4, " ")))
    size = F.size("_filled")
    pairs = F.zip_with(F.slice("_filled", F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice("_filled", F.lit(2), F.greatest(size - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return once(filled, "_grams", F.concat("_filled", pairs)).drop("_filled")


def vectors(frame: DataFrame) -> DataFrame:
    """Adds ``features`` to a frame with ``_grams``."""
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(frame).drop("_grams")


def likely(model: LogisticRegressionModel) -> Column:
    """False only where the model gives the grams a chance of license below one half.

    One half needs a license whose margin comes up to that of "none" less the logarithm of the number of licenses, and
    no license's margin over "none" is above the sum, over the features, of the largest one of any license.
    """
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    most = F.split(F.lit(",".join(map(repr, (weights[1:] - weights[0]).max(0).tolist()))), ",").cast("array<double>")
    least = -math.log(len(bias) - 1) - float((bias[1:] - bias[0]).max()) - 1e-6  # less what sums of doubles may be off
    held = F.array_distinct(F.transform("_grams", lambda g: F.pmod(F.hash(g), F.lit(FEATURES))))
    return F.aggregate(held, F.lit(0.0), lambda s, f: s + F.get(most, f)) >= least


def paragraphs(docs: DataFrame) -> DataFrame:
    """The columns but text, paragraph (line, from 0) and words of every line of the whole texts that holds a word."""
    keep = [c for c in docs.columns if c != "text"]
    lines = docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("paragraph", "line"))
    return once(lines, "words", tokens(F.col("line"))).where(F.size("words") > 0).drop("line")


def notices(spark: SparkSession) -> DataFrame:
    """family, words of the customary notices."""
    rows = [(family, text) for family, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").select("family", tokens(F.col("text")).alias("words"))


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, row, paragraph (first line), last line and words of runs of words that lie like a notice over several lines.

    Each word 3-gram that a text shares with a notice tells where the notice would begin and end; the first such gram of
    each beginning counts. Words beyond a blank line are left out. (A notice of three words is one 3-gram.)
    """
    spark = docs.sparkSession
    marks = notices(spark).select(F.size("words").alias("size"), grams(F.col("words"), 3).alias("marks")).where(F.size("marks") > 0)
    known = [r["marks"] for r in marks.collect()]  # of the notices above
    longest = max(map(len, known)) + 2
    telling = F.array(*map(F.lit, sorted({g for m in known for g in m})))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = once(docs, "_plain", tokens(text))
    # A gram is put together only where each of its words has that place in some gram of the notices.
    places = [sorted({g.split(" ")[i] for m in known for g in m}) for i in range(3)]
    after = lambda i: F.get("_plain", i)
    gram = lambda w, i: F.when(w.isin(places[0]) & after(i + 1).isin(places[1]) & after(i + 2).isin(places[2]), F.concat_ws(" ", w, after(i + 1), after(i + 2)))
    some = once(some, "_told", F.array_intersect(F.array_compact(F.transform("_plain", gram)), telling)).where(F.size("_told") > 0).drop("_plain")
    outside = F.struct(F.lit("").alias("w"), F.lit(-1).alias("line"))

    def words_of(line: Column, i: Column) -> Column:
        own = F.transform(tokens(line), lambda w: F.struct(w.alias("w"), i.alias("line")))
        return F.when(F.size(own) > 0, own).otherwise(F.array(outside))

    margin = F.array_repeat(outside, longest)
    some = once(some, "_words", F.concat(margin, F.flatten(F.transform(F.split(text, "\n"), words_of)), margin)).drop("text")
    some = once(some, "_all", F.transform("_words", lambda x: x["w"]))
    some = once(some, "_at", F.filter(F.transform(grams(F.col("_all"), 3), lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda x: F.array_contains("_told", x["gram"])))
    near = F.transform("_at", lambda x: F.struct(x["gram"].alias("gram"), F.slice("_words", x["at"] + 1 - longest, F.lit(2 * longest)).alias("near")))
    hits = some.select("doc_id", "row", F.explode(near).alias("_hit")).select("doc_id", "row", "_hit.gram", "_hit.near")
    starts = marks.select("size", "marks", F.posexplode("marks").alias("j", "gram"))  # one row for each gram of the notices above
    runs = hits.join(F.broadcast(starts), "gram").withColumn("run", F.slice("near", longest + 1 - F.col("j"), F.col("size")))
    same = F.zip_with(grams(F.transform("run", lambda x: x["w"]), 3), F.col("marks"), lambda a, b: a == b)
    runs = runs.where(F.array_position(same, True) == F.col("j") + 1)
    before, after = F.slice("run", F.lit(1), F.col("j")), F.slice("run", F.col("j") + 1, F.col("size") - F.col("j"))
    ends = lambda part: F.array_position(F.transform(part, lambda x: x["w"]), "").cast("int")
    until = lambda part: F.when(ends(part) > 0, F.slice(part, F.lit(1), ends(part) - 1)).otherwise(part)
    runs = runs.withColumn("run", F.concat(F.reverse(until(F.reverse(before))), until(after)))
    runs = runs.select("doc_id", "row", F.get(F.col("run"), F.lit(0))["line"].alias("paragraph"), F.element_at("run", -1)["line"].alias("last"), F.transform("run", lambda x: x["w"]).alias("words"))
    return runs.where("last > paragraph")


def variants(known: DataFrame) -> DataFrame:
    """The notices, and each of them less one of its words: what calibration is measured on."""
    without = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.concat(F.slice("words", F.lit(1), i - 1), F.slice("words", i + 1, F.size("words"))))
    return known.select("family", F.explode(without).alias("words")).where(F.size("words") > 1)


def fit(docs: DataFrame) -> tuple[LogisticRegressionModel, list[str], float]:
    """Classifier, its class names and the least chance from which a family counts.

    Classes without license: at most NEGATIVES lines of the NEGATIVE_DOCS documents of at most LONGEST characters that
    come first by a hash of their id, without those that share a word 3-gram with a notice.
    """
    spark = docs.sparkSession
    known = notices(spark)
    names = [NONE, *NOTICES]
    label = F.coalesce(*(F.when(F.col("family") == n, F.lit(float(i))) for i, n in enumerate(names)))
    telling = [r[0] for r in known.select(F.explode(grams(F.col("words"), 3)).alias("g")).distinct().collect()]  # of the notices above
    some = docs.where(F.length("text") <= LONGEST).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(NEGATIVE_DOCS)
    plain = paragraphs(some).where(~F.arrays_overlap(grams(F.col("words"), 3), F.array(*map(F.lit, telling))))
    plain = plain.orderBy(F.xxhash64("doc_id", "paragraph")).limit(NEGATIVES).select(F.lit(NONE).alias("family"), "words")
    rows = known.withColumn("weight", F.lit(20.0)).union(variants(known).withColumn("weight", F.lit(2.0))).union(plain.withColumn("weight", F.lit(1.0)))
    train = vectors(featured(rows.withColumn("label", label))).select("label", "weight", "features").coalesce(1)
    model = LogisticRegression(maxIter=ITERATIONS, regParam=2e-4, weightCol="weight", family="multinomial").fit(train)
    best = guesses(model.transform(vectors(featured(variants(known)))), names)
    sure = [F.sum((F.when(F.col("chance") >= t / STEPS, F.col("guess")).otherwise(UNKNOWN) == F.col("family")).cast("int")).alias(str(t)) for t in range(1, STEPS)]
    right = best.select(*sure).first().asDict()
    top = max(right.values())
    good = [int(t) for t, n in right.items() if n == top]
    return model, names, max(0.5, (min(good) + max(good)) / 2 / STEPS)


def guesses(scored: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``license`` (chance that there is one), and the likeliest class among licenses with its chance."""
    chances = scored.withColumn("_p", vector_to_array("probability"))
    pairs = F.array(*(F.struct(F.get("_p", F.lit(i)).alias("p"), F.lit(n).alias("n")) for i, n in enumerate(names) if i))
    best = F.array_max(pairs)
    return chances.withColumn("license", 1 - F.get("_p", F.lit(0))).withColumn("_best", best).withColumn("guess", F.col("_best.n")).withColumn("chance", F.col("_best.p"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, chance, similarity, confirmed of every license-like paragraph of the whole texts.

    ``similarity`` is the largest share of a notice's word 3-grams (2-grams for short ones) that the paragraph holds,
    over the notices of the guessed family. Unconfirmed paragraphs have the family "unknown". Null and empty texts have
    no paragraph; repeated rows are scanned each; null ids stay; an empty table gives no rows; other columns are not read.
    A confirmed notice that is wrapped over lines is reported at its first line; its other lines are reported only if
    they are confirmed by themselves or begin a wrapped notice that is at least as similar.
    """
    model, names, least = fit(docs.select("doc_id", "text"))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    both = paragraphs(rows).withColumn("last", F.col("paragraph")).unionByName(wrapped(rows))
    found = guesses(model.transform(vectors(featured(both).where(likely(model)))), names).where(F.col("license") >= 0.5)
    marks = notices(docs.sparkSession).select("family", F.when(F.size("words") > 3, grams(F.col("words"), 3)).otherwise(grams(F.col("words"), 2)).alias("marks"))
    of_family = marks.groupBy("family").agg(F.collect_list("marks").alias("notices"))  # as many rows as NOTICES has families
    own = F.concat(grams(F.col("words"), 3), grams(F.col("words"), 2))
    joined = found.select("doc_id", "row", "paragraph", "last", "guess", "chance", own.alias("own")).join(F.broadcast(of_family), F.col("guess") == F.col("family"), "left")
    share = F.array_max(F.transform("notices", lambda m: F.size(F.array_intersect(F.col("own"), m)) / F.size(F.array_distinct(m))))
    judged = joined.withColumn("similarity", F.coalesce(share, F.lit(0.0)))
    confirmed = (F.col("guess") != UNKNOWN) & (F.col("chance") >= least) & (F.col("similarity") >= CONTAINED)
    judged = judged.withColumn("confirmed", confirmed).where(F.col("confirmed") | (F.col("last") == F.col("paragraph")))
    # Best of each line: a line confirmed by itself, the wrapped notice most alike, an unconfirmed line.
    lines = judged.withColumn("line", F.explode(F.sequence("paragraph", "last")))
    alone, begins = F.col("last") == F.col("paragraph"), F.col("line") == F.col("paragraph")
    family = F.when(F.col("confirmed"), F.col("guess")).otherwise(UNKNOWN)
    best = lines.groupBy("row", "line").agg(F.max(F.struct("confirmed", alone.alias("alone"), "similarity", begins.alias("begins"), "chance", family.alias("family"), "doc_id")).alias("_best"))
    return best.where("_best.begins").select("_best.doc_id", F.col("line").alias("paragraph"), "_best.family", "_best.chance", "_best.similarity", "_best.confirmed")
