"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a text; longer ones are looked at in overlapping windows. Its
features are the word n-grams (one to three words) hashed to a sparse vector. A
multinomial logistic regression names the licence family, with "unknown" as one class,
trained on pieces of the templates below and on ordinary paragraphs of the corpus, with
and without licence words put in. What the model calls a family with less than the
calibrated probability is unknown too: the limit is what all but one in a hundred of
the ordinary paragraphs kept back stay under. A prediction counts once enough of its
word triples are also found in a template of that family.

A paragraph that shares no word triple with any template cannot be confirmed and is not
scored; all others are. DataFrame functions and pyspark.ml only.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 13
WINDOW, STEP = 40, 20
#: Distinct paragraphs of least hash, of which the ordinary ones serve for training and calibration.
SAMPLE = 1000
LEAST_SIMILARITY = 0.5
QUANTILE = 0.99

#: Licence words that ordinary paragraphs are trained with.
ANCHORS = ["licence", "license", "licensed", "licensing", "copyright", "spdx", "warranty", "redistribution",
           "gpl", "lgpl", "agpl", "creative commons", "cc by", "cc0", "public domain", "unlicense"]

#: Public licence names and notices by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction. Copyright holders are not liable.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "This code is licensed under the two-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
#: Sentences with licence words that grant nothing.
ORDINARY = [
    "She renewed her driving license last week.", "The pilot's licence was suspended for a month.",
    "The shop sells licensed toys and comics.", "Copyright law is taught in the second year.",
    "The licensing board meets on Monday.", "The car comes with a three year warranty.",
    "The redistribution of land was debated for years.", "Its road tax and license plate had expired.",
    "They applied for a fishing license.", "A license to print money, he called it.", "The apache warriors rode north.",
    "The public domain of a king was his land.", "Poetic licence explains the rest.", "The photo is copyright of the museum."]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]

_ANCHOR_RE = r"(?i)\b(?:" + "|".join(a.replace(" ", r"[\s-]") for a in ANCHORS) + r")\b"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+]+|\.(?=\s|$)"), lambda w: w != "")


def _template_triples() -> list[str]:
    """All word triples of the templates, cut as ``words_of`` does."""
    found = set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        # [^\W_] is a letter or digit
        w = [x for x in re.split(r"(?:(?![.+])[\W_])+|\.(?=\s|$)", text.lower()) if x]
        found |= {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}
    return sorted(found)


#: Frequent words of templates; the quick filter looks for triples of these as a whole.
_FREQUENT = {"a", "an", "and", "any", "are", "as", "by", "for", "from", "has", "in", "into", "is", "it", "not", "of", "or", "that",
             "the", "this", "to", "under", "use", "with", "you", "all", "may", "can"}


def _hitting_words(triples: list[str]) -> list[str]:
    """Words of which every triple holds one, so that no text with a triple is without them."""
    words: set[str] = set()
    longest = lambda t: max((len(w), w) for w in set(t.split()) - _FREQUENT)
    for best, triple in sorted(((longest(t), t) for t in triples), reverse=True):
        if not words & set(triple.split()):
            words.add(best[1])
    return sorted(words)


TRIPLES = _template_triples()
_PLAIN = [t for t in TRIPLES if set(t.split()) <= _FREQUENT]
_HIT_RE = (r"(?<![\p{L}\p{N}.+])(?:" + "|".join(
    [re.escape(w) for w in _hitting_words([t for t in TRIPLES if t not in _PLAIN])]
    + [t.replace(" ", r"[^\p{L}\p{N}+]+") for t in _PLAIN]) + r")(?![\p{L}\p{N}+])")


def _ngrams(words: Column, size: int) -> Column:
    """Runs of ``size`` words; empty if there are fewer."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                     lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(
        F.expr("cast(array() as array<string>)"))


def _may_hold_statement(line: Column) -> Column:
    """Whether a word triple of some template is in the line; confirmation needs one."""
    # the array of one makes the words a variable, or they would be cut anew for each triple
    return F.lower(line).rlike(_HIT_RE) & F.exists(F.array(words_of(line)), lambda words: F.arrays_overlap(
        _ngrams(words, 3), F.array(*map(F.lit, TRIPLES))))


def _features(rows: DataFrame) -> DataFrame:
    """Adds ``x``, the hashed n-grams of the array column ``words``."""
    rows = rows.withColumn("_grams", F.concat(*[_ngrams(F.col("words"), n) for n in (1, 2, 3)]))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="x").transform(rows).drop("_grams")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, paragraph number and text of every line of the documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.posexplode(F.split(text, "\n", -1)).alias("paragraph", "line"))


def windows(words: Column) -> Column:
    """The words themselves, or overlapping windows of them that cover all."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW + STEP, F.lit(1)), F.lit(STEP))
    return F.transform(starts, lambda i: F.slice(words, i, WINDOW))


def _training_rows(docs: DataFrame) -> DataFrame:
    """Rows (line, family, kept_back): pieces of templates, and ordinary paragraphs."""
    spark = docs.sparkSession
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            w = text.split()
            pieces = {text, *(" ".join(w[i:i + 8]) for i in range(0, max(1, len(w) - 7), 2)), " ".join(w[:6]), "# " + text}
            rows += [(p, family, 0) for p in sorted(pieces)]
    rows += [(text, UNKNOWN, i % 2) for i, text in enumerate(ORDINARY)]
    fixed = spark.createDataFrame(rows, "line string, family string, kept_back int")
    # of least hash, so that reruns agree; the hashes alone tell which, so no text is shuffled for it, and
    # the patterns are tried on these few only
    lines = paragraphs(docs).where(F.length("line") > 20).select(F.xxhash64("line").alias("h"), "line")
    largest = lines.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    drawn = lines.where(F.col("h") <= F.lit(largest).cast("long")).distinct()
    plain = drawn.where(~F.col("line").rlike(_ANCHOR_RE) & ~_may_hold_statement(F.col("line")))
    mixed = plain.select(F.explode(F.array("line", F.concat(
        F.get(F.array(*map(F.lit, ANCHORS)), F.pmod("h", F.lit(len(ANCHORS))).cast("int")), F.lit(" "), "line"))).alias(
        "line"), F.lit(UNKNOWN).alias("family"), F.pmod(F.shiftright("h", 8), F.lit(2)).cast("int").alias("kept_back"))
    return fixed.union(mixed)


def train(docs: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The model, and the probability that a family needs to be believed."""
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    rows = _features(_training_rows(docs).coalesce(1).withColumn("words", words_of(F.col("line")))
                     .withColumn("label", label)).persist()
    try:
        model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1e-3,
                                   maxIter=60).fit(rows.where("kept_back = 0"))
        top = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
        limit = model.transform(rows.where("kept_back = 1")).agg(F.percentile(top, F.lit(QUANTILE))).first()[0]
    finally:
        rows.unpersist()
    return model, max(0.5, min(limit or 0.0, 0.95))


def _similarity(words: Column, family: Column) -> Column:
    """Largest share of word triples, of the shorter side, that a template of the family has in common."""
    result = F.lit(0.0)
    own = _ngrams(words, 3)
    for name, texts in TEMPLATES.items():
        shares = []
        for text in texts:
            theirs = _ngrams(words_of(F.lit(text)), 3)
            shares.append(F.coalesce(F.try_divide(F.size(F.array_intersect(own, theirs)), F.least(
                F.size(F.array_distinct(own)), F.size(F.array_distinct(theirs)))), F.lit(0.0)))
        result = F.when(family == name, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(result)
    return result


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """Confirmed statements: doc_id, text_hash, paragraph, family, probability and similarity."""
    model, limit = train(docs)
    found = (paragraphs(docs).where(_may_hold_statement(F.col("line")))
             .select("doc_id", "text_hash", "paragraph", F.explode(windows(words_of(F.col("line")))).alias("words")))
    scored = model.transform(_features(found))
    chances = F.slice(vector_to_array("probability"), 2, len(FAMILIES))
    best = (scored.withColumn("_p", chances).withColumn("probability", F.array_max("_p"))
            .withColumn("family", F.get(F.array(*map(F.lit, FAMILIES[1:])),
                                        (F.array_position("_p", F.col("probability")) - 1).cast("int")))
            .where(F.col("probability") > limit)
            .withColumn("similarity", _similarity(F.col("words"), F.col("family")))
            .where(F.col("similarity") >= LEAST_SIMILARITY))
    return best.groupBy("doc_id", "text_hash", "paragraph", "family").agg(
        F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_paragraphs, families and statements.

    ``families`` lists the families found, in order of their names, and ``statements``
    the paragraphs as number:family, in order. A null or empty text is one empty
    paragraph without statement. Rows are told apart by doc_id and text, so repeated
    rows agree and null ids do no harm; other columns are ignored; an empty table gives
    an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = licence_paragraphs(docs).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("family")).alias("families"),
        F.array_sort(F.collect_set(F.struct("paragraph", "family"))).alias("statements")).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "families", "statements")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.size(F.split(text, "\n", -1)).cast("long").alias("n_paragraphs"))
    shown = F.transform("statements", lambda s: F.concat_ws(":", s["paragraph"].cast("string"), s["family"]))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select(
        "doc_id", "n_paragraphs", F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("statements"))
