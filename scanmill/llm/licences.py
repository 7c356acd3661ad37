"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by comparison with templates."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanmill.llm.common import like, written

NONE, UNKNOWN = "none", "unknown"
SHINGLE = 5
SIMILARITY = 0.8
NEGATIVES = 4_000
"""Paragraphs of the corpus that teach the class `none`: those with the least hashes of all, whatever their number."""
VOCABULARY = 8_192
"""Most n-grams of the model; with the families it bounds what is broadcast."""
LEAST_WEIGHT = 0.3
"""N-grams that weigh less for every family are left out of the model before its temperature is set."""
CONTEXTS = 6
"""How often each template is shown, each time inside other words."""

# Wording by which licence families are granted.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "This project is released under the Apache 2.0 license."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Licensed under the 3-Clause BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Released under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
    ("reserved", "All rights reserved. No part of this work may be reproduced without permission."),
    ("reserved", "Copyright, all rights reserved, unauthorized copying of this file is strictly prohibited."),
)


@dataclass(frozen=True)
class Model:
    """Sparse weights: one row (hash of the n-gram, weights by family) per n-gram that counts, intercepts and the temperature."""

    families: tuple[str, ...]
    intercepts: tuple[float, ...]
    temperature: float
    weights: DataFrame


def _templates(spark: SparkSession) -> DataFrame:
    rows = json.dumps([{"family": f, "text": t} for f, t in TEMPLATES])
    parsed = F.from_json(F.lit(rows), "array<struct<family: string, text: string>>")
    return spark.range(1).select(F.posexplode(parsed).alias("at", "t")).select("at", "t.family", "t.text")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner dots and hyphens."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.-]+|(?<![\p{L}\p{N}])[.-]+|[.-]+(?![\p{L}\p{N}])", " ")
    return F.filter(F.split(kept, " ", -1), lambda w: w != "")


def grams(found: Column) -> Column:
    """Hashes of the single words and of the pairs of words."""
    singles = F.transform(found, lambda w: F.xxhash64(w))
    pairs = F.zip_with(singles, F.slice(singles, 2, F.greatest(F.size(singles), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    # The last pair has one word only.
    return F.concat(singles, F.slice(pairs, 1, F.greatest(F.size(singles) - 1, F.lit(0))))


def shingles(found: Column) -> Column:
    """Runs of five words as text; fewer words are one shingle, none are none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - SHINGLE + 1, F.lit(1)))
    return F.when(F.size(found) > 0, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(found, i, SHINGLE), " ")))).otherwise(
        F.array().cast("array<string>")
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): the lines of each text that are not blank, numbered from zero."""
    lines = like(docs, ["doc_id", "text"]).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "text"))
    return lines.filter(F.trim("text") != "")


def _likeness(found: Column, template: Column) -> Column:
    """The part of a template's shingles that a paragraph has."""
    return F.size(F.array_intersect(found, template)) / F.size(template)


def _examples(docs: DataFrame) -> DataFrame:
    """(family, words, fold, weight): templates inside corpus words, and corpus paragraphs as `none` unless they hold
    half of a template. At most NEGATIVES + CONTEXTS * templates rows."""
    spark = docs.sparkSession
    template = written(_templates(spark).select("at", "family", words(F.col("text")).alias("template")))
    known = [r.s for r in template.select(shingles(F.col("template")).alias("s")).collect()]
    lines = paragraphs(docs).select("text", F.xxhash64("text").alias("order"))
    # Of all hashes only so many are looked at that twice the rows wanted remain, or all where there are few.
    part = 2.0 * NEGATIVES / max(1, lines.count())
    texts = lines.filter(F.col("order") < -(2.0**63) + part * 2.0**64).orderBy("order", "text").limit(NEGATIVES)
    sample = written(texts.withColumn("nth", F.row_number().over(Window.orderBy("order", "text"))).select("nth", words(F.col("text")).alias("words")))
    near = reduce(or_, (_likeness(F.col("s"), F.array(*map(F.lit, s))) >= 0.5 for s in known))
    plain = written(sample.withColumn("s", shingles(F.col("words"))).filter(~near).drop("s"))
    shown = template.select("at", "family", "template", F.explode(F.sequence(F.lit(0), F.lit(CONTEXTS))).alias("time"))
    context = plain.select(F.col("nth").alias("c_nth"), F.slice("words", 1, 12).alias("context"))
    inside = shown.join(context, F.col("at") * (CONTEXTS + 1) + F.col("time") + 1 == F.col("c_nth"), "left")
    around = F.when(F.col("context").isNull() | (F.col("time") == 0), F.col("template")).when(
        F.col("time") % 2 == 0, F.concat("context", "template")
    ).otherwise(F.concat("template", "context"))
    positive = inside.select("family", around.alias("words"), (F.col("time") == CONTEXTS).alias("held"))
    negative = plain.select(F.lit(NONE).alias("family"), "words", (F.col("nth") % 4 == 0).alias("held"))
    return positive.unionByName(negative)


def train(docs: DataFrame) -> Model:
    """Multinomial logistic regression with sparse weights on words and word pairs. Classes weigh alike; a held-out part
    sets the temperature that makes its probabilities fit best."""
    spark = docs.sparkSession
    examples = written(_examples(docs).withColumn("grams", F.array_distinct(grams(F.col("words"))).cast("array<string>")).drop("words"))
    families = (NONE, *sorted({family for family, _ in TEMPLATES}))
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    sizes = examples.groupBy("family").agg((1 / F.count("*")).alias("weight"))
    rows = examples.join(sizes, "family").withColumn("label", label)
    counted = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2, binary=True).fit(rows)
    ready = written(counted.transform(rows).select("features", "label", "weight", "held", "grams").repartition(2))
    fitted = LogisticRegression(
        family="multinomial", maxIter=30, regParam=0.0005, elasticNetParam=0.9, weightCol="weight", standardization=False
    ).fit(ready.filter("not held"))
    present = len(fitted.interceptVector)
    matrix = fitted.coefficientMatrix.toArray()
    used = (abs(matrix).max(axis=0) >= LEAST_WEIGHT).nonzero()[0]
    vocabulary = counted.vocabulary
    rows = json.dumps([{"gram": int(vocabulary[g]), "w": matrix[:, g].tolist()} for g in used])
    parsed = F.from_json(F.lit(rows), "array<struct<gram: long, w: array<double>>>")
    weights = written(spark.range(1).select(F.explode(parsed).alias("r")).select("r.gram", "r.w"))
    model = Model(families[:present], tuple(fitted.interceptVector.toArray().tolist()), 1.0, weights)
    held = written(_scores(ready.filter("held").select(F.monotonically_increasing_id().alias("row"), "label", F.col("grams").cast("array<long>").alias("grams")), model, ["row", "label"]))
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
    losses = held.agg(*(
        F.sum(-F.log(F.greatest(F.get(_softmax(F.col("scores"), t), F.col("label").cast("int")), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)
    )).first()
    best = min(range(len(grid)), key=lambda i: (losses[i] if losses[i] is not None else 0.0, abs(grid[i] - 1)))
    return Model(model.families, model.intercepts, grid[best], weights)


def _scores(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys and scores by family of the rows (keys, grams) that have an n-gram of the model; each n-gram counts once.
    The model's n-grams are at most VOCABULARY, so they go to every executor; n-grams it lacks drop out there, before
    anything is shuffled. (The outer form keeps Spark from working out all n-grams a second time to see if there are any.)"""
    zero = F.array(*(F.lit(b) for b in model.intercepts))
    found = rows.select(*keys, F.explode_outer(F.array_distinct("grams")).alias("gram")).join(F.broadcast(model.weights), "gram")
    sums = found.groupBy(*keys).agg(*(F.sum(F.get("w", F.lit(k))).alias(f"s{k}") for k in range(len(model.families))))
    return sums.select(*keys, F.zip_with(zero, F.array(*(F.col(f"s{k}") for k in range(len(model.families)))), lambda a, b: a + b).alias("scores"))


def _softmax(scores: Column, temperature: float) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    return F.transform(raised, lambda r: r / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def scan(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, paragraph, text, family, probability, predicted, similarity) of every paragraph of `docs` (doc_id, text)
    that grants a licence.

    The classifier scores a paragraph's words and word pairs; paragraphs that look like none are left out. A family is
    named if its calibrated probability reaches `least` and one of its templates confirms it: the paragraph holds
    SIMILARITY of the template's five-word shingles. Licence-like paragraphs without both are `unknown`. Null and blank
    texts have no paragraphs. Repeated rows of one doc_id are told apart by their texts; equal ones give one row."""
    spark = docs.sparkSession
    lines = paragraphs(docs).withColumn("words", words(F.col("text")))
    scored = _scores(lines.withColumn("grams", grams(F.col("words"))), model, ["doc_id", "paragraph", "text"])
    families, top = F.array(*map(F.lit, model.families)), F.array_max("scores")
    likely = scored.withColumn("predicted", F.element_at(families, F.array_position("scores", top).cast("int"))).filter(F.col("predicted") != NONE)
    others = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.exp((s - top) / model.temperature))
    judged = likely.select("doc_id", "paragraph", "text", "predicted", (1 / others).alias("probability"))
    known = _templates(spark).groupBy("family").agg(F.collect_list(shingles(words(F.col("text")))).alias("known"))
    compared = judged.join(F.broadcast(known), judged.predicted == known.family, "left").drop("family").withColumn("s", shingles(words(F.col("text"))))
    likeness = F.coalesce(F.array_max(F.transform("known", lambda t: _likeness(F.col("s"), t))), F.lit(0.0))
    named = (F.col("probability") >= least) & (F.col("similarity") >= SIMILARITY)
    return compared.withColumn("similarity", likeness).select(
        "doc_id", "paragraph", "text", F.when(named, F.col("predicted")).otherwise(UNKNOWN).alias("family"),
        "probability", "predicted", "similarity",
    )
