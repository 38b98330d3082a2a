"""Licence scan by a trained paragraph classifier. The main path is DataFrame functions only.

1. Features are word n-grams (one to three words) over the vocabulary of the
   templates below, hashed into BUCKETS. Other words stand as one mark, so a
   paragraph without a word of the vocabulary has no feature and is unknown: such
   paragraphs are dropped exactly, before any n-gram is made.
2. Training: templates with words dropped and corpus words around them, against a
   bounded sample of corpus paragraphs (NEGATIVES, chosen by hash) and of shuffled
   template words, as class ``unknown``. Sparse multinomial logistic regression
   (proximal steps, so most weights are zero), then a temperature that makes the
   probabilities of held-out paragraphs honest.
3. Scan: the weights (at most BUCKETS rows, a fixed bound) are joined to the
   n-grams and summed for each paragraph; softmax; best family.
4. A prediction holds if its probability is CONFIDENCE or more and the paragraph
   holds a template of the family to SIMILARITY, the other way about for long
   templates of which it is a part.

A paragraph is a line. Defined results: null and empty texts have no finding; a
null id is reported as null; rows that repeat are each reported; an empty table
gives an empty table.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, id_of, key_of, materialise, table

BUCKETS = 1 << 13
NEGATIVES = 2_000
CONFIDENCE = 0.5
SIMILARITY = 0.75
COPIES, FEW_COPIES = 40, 6
STEPS = 300
SPARSITY = 2e-5

UNKNOWN = "unknown"
# The notices by which public licences are commonly stated.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
    ],
    "proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
# The names by which notices call the licences.
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)", "X11 MIT license"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0 license"],
    "GPL": ["GNU General Public License v3.0", "GNU GPL version 2", "GPLv3", "GPL-2.0 license"],
    "LGPL": ["GNU Lesser General Public License v3.0", "GNU LGPL version 2.1", "LGPL-3.0 license"],
    "AGPL": ["GNU Affero General Public License v3.0", "GNU AGPL version 3", "AGPL-3.0 license"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "modified BSD license"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0 license"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0 license"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0 license"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0 license"],
    "CC0": ["Creative Commons CC0 1.0 Universal public domain dedication", "CC0 1.0", "CC0-1.0 license"],
}
#: With each name, a wording that training and template comparison know.
WORDINGS = ["Licensed under the {}.", "Distributed under the terms of the {}.", "Released under {}, see LICENSE.", "License: {}"]
for _family, _names in NAMES.items():
    TEMPLATES[_family] = TEMPLATES[_family] + [w.format(n) for n in _names for w in WORDINGS]
#: Words too common to tell of a licence by themselves; they stay in n-grams, but a paragraph needs another word of the vocabulary.
COMMON = "a an and are as at be by can for found free from in is it not of on or see that the this to use via with work you".split()


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, with dots inside numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def _plain_words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())


VOCABULARY = sorted({w for x in TEMPLATES.values() for t in x for w in _plain_words(t)})
CUES = [w for w in VOCABULARY if w not in COMMON]
FAMILIES = [*TEMPLATES, UNKNOWN]


def marked(words: Column) -> Column:
    """Words outside the vocabulary become one mark."""
    known = F.array(*map(F.lit, VOCABULARY))
    return F.transform(words, lambda w: F.when(F.array_contains(known, w), w).otherwise(F.lit("~")))


def features(marks: str) -> Column:
    """Distinct buckets of the one- to three-word n-grams of a column of marked words; a row of marks alone is none."""
    m, n = F.col(marks), F.size(marks)
    following = lambda k: F.slice(m, k, F.greatest(n - (k - 1), F.lit(0)))
    joined = lambda a, b: F.concat_ws(" ", a, b)
    pairs = F.zip_with(F.slice(m, 1, F.greatest(n - 1, F.lit(0))), following(2), joined)
    triples = F.zip_with(F.slice(pairs, 1, F.greatest(n - 2, F.lit(0))), following(3), joined)
    every = F.filter(F.array_distinct(F.concat(m, pairs, triples)), lambda g: ~g.isin("~", "~ ~", "~ ~ ~"))
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """key, paragraph (its number), body: the lines that hold a cue word."""
    lines = docs.select(key_of(id_column).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1)).alias("paragraph", "body"))
    words = F.split(F.lower("body"), r"[^\p{L}\p{N}.]+")
    return lines.where(F.arrays_overlap(F.transform(words, lambda w: F.rtrim(w, F.lit("."))), F.array(*map(F.lit, CUES))) | F.col("body").rlike(r"(?i)\b(?:gpl|mpl|lgpl|agpl|apache|spdx)\b"))


def _training_texts(corpus: list[str], seed: int = 5) -> tuple[list[str], list[int], list[int]]:
    """Texts, their families, and the template that each was made from: -1 for those of no family."""
    rng = random.Random(seed)
    filler = [w for x in corpus for w in x.split()] or ["text"]
    texts, labels, made_from = [], [], []
    worded = {w.format(n) for x in NAMES.values() for n in x for w in WORDINGS}
    numbers = {t: n for n, t in enumerate(t for f in FAMILIES[:-1] for t in TEMPLATES[f])}
    for k, family in enumerate(FAMILIES[:-1]):
        for template in TEMPLATES[family]:
            for i in range(COPIES if template not in worded else FEW_COPIES):
                words = template.split()
                drop = 0 if i < 4 else rng.choice([0, 0.05, 0.1])
                words = [w for w in words if rng.random() >= drop]
                if i % 2:
                    words = rng.sample(filler, min(len(filler), rng.randrange(6))) + words + rng.sample(filler, min(len(filler), rng.randrange(12)))
                texts.append(" ".join(words))
                labels.append(k)
                made_from.append(numbers[template])
    every = [w for x in TEMPLATES.values() for t in x for w in t.split()]
    others = corpus + [" ".join(rng.sample(every, rng.randrange(1, 6)) + rng.sample(filler, min(len(filler), rng.randrange(10)))) for _ in range(COPIES * 25)]  # template words without their order, among others
    return texts + others, labels + [len(FAMILIES) - 1] * len(others), made_from + [-1] * len(others)


def held_out(labels: list[int], made_from: list[int]) -> np.ndarray:
    """Rows for the temperature: all of the last template of each family that has several, and a fifth of those of no family."""
    of = {}
    for k, t in zip(labels, made_from, strict=True):
        of.setdefault(k, set()).add(t)
    last = {max(x) for k, x in of.items() if len(x) > 1}
    return np.array([t in last if t >= 0 else i % 5 == 0 for i, t in enumerate(made_from)], bool)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _weights(x: np.ndarray, y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse logistic regression by proximal steps; each family has the same say."""
    price = (y @ (1 / np.maximum(y.mean(axis=0), np.float32(1e-6))))[:, None]
    price /= price.sum()
    w, c = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    rate = 20.0
    for _ in range(steps):
        e = ((_softmax(x @ w + c) - y) * price).astype(np.float32)
        w -= rate * (x.T @ e)
        w = np.sign(w) * np.maximum(np.abs(w) - np.float32(rate * SPARSITY), 0)
        c -= np.float32(rate * 0.1) * e.sum(axis=0)
    return w, c


def fit(rows: list[list[int]], labels: list[int], made_from: list[int], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (buckets by families), constants and the temperature. The temperature is that of a fit without some wordings, on these."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(max(1, len(r)))
    y = np.eye(len(FAMILIES), dtype=np.float32)[labels]
    used = np.flatnonzero(x.any(axis=0))
    x, held = x[:, used], held_out(labels, made_from)
    w, c = _weights(x[~held], y[~held], steps)
    z = x[held] @ w + c
    loss = lambda t: -np.log(np.maximum((_softmax(z * t) * y[held]).sum(axis=1), 1e-12)).mean()
    warmth = min(np.linspace(0.2, 3, 57), key=loss)
    w, c = _weights(x, y, steps)
    out = np.zeros((BUCKETS, len(FAMILIES)))
    out[used] = w
    return out, c.astype(float), float(warmth)


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
    """Fit on templates and on a bounded sample of the corpus's paragraphs that hold no cue phrase."""
    spark = docs.sparkSession
    chance = min(1.0, 4 * NEGATIVES / max(1, docs.count()))
    some = docs.where(chosen(chance, id_column, text_column, salt=3))
    line = F.explode(F.slice(F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1), 1, 3))
    corpus = some.select(line.alias("body")).select(F.substring("body", 1, 400).alias("body")).where(~F.col("body").rlike(r"(?i)licen[cs]|copyright|rights reserved|spdx") & (F.length("body") > 0))
    corpus = [r.body for r in corpus.orderBy(F.xxhash64("body"), "body").limit(NEGATIVES).collect()]
    return fit_texts(spark, *_training_texts(corpus))


def fit_texts(spark: SparkSession, texts: list[str], labels: list[int], made_from: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    made = spark.createDataFrame(list(zip(texts, labels, made_from, strict=True)), "body string, label int, template int").select(marked(words_of(F.col("body"))).alias("m"), "label", "template")
    made = made.select(features("m").alias("f"), "label", "template").collect()  # the training texts
    made.sort(key=lambda r: (r.label, r.template, sorted(r.f)))
    random.Random(1).shuffle(made)
    return fit([r.f for r in made], [r.label for r in made], [r.template for r in made])


def scan(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed: the paragraphs that a family other than unknown claims."""
    spark = docs.sparkSession
    weights, constants, warmth = model
    names = [f"w{k}" for k in range(len(FAMILIES))]
    rows = [(int(b), *map(float, weights[b] * warmth)) for b in np.flatnonzero(np.abs(weights).sum(axis=1))]
    sent = spark.createDataFrame(rows, "bucket int, " + ", ".join(f"{n} double" for n in names))
    templates = spark.createDataFrame([(f, _plain_words(t)) for f, x in TEMPLATES.items() for t in x], "family string, template array<string>")
    # Written, so that a paragraph's number stays and its n-grams are made once: these are the few lines with a cue.
    lines = paragraphs(docs, id_column, text_column).withColumn("words", words_of(F.col("body"))).withColumn("line", F.monotonically_increasing_id())
    grams = lines.withColumn("m", marked(F.col("words"))).select("line", "key", "paragraph", "words", features("m").alias("f"))
    grams = materialise(grams, "licence-grams").where(F.size("f") > 0)
    one = grams.select("line", F.sqrt(F.size("f").cast("double")).alias("norm"), F.explode("f").alias("bucket"))
    sums = one.join(F.broadcast(sent), "bucket").groupBy("line").agg(F.first("norm").alias("norm"), *(F.sum(n).alias(n) for n in names))
    logits = F.array(*(F.col(n) / F.col("norm") + F.lit(float(c) * warmth) for n, c in zip(names, constants, strict=True)))
    scored = sums.select("line", logits.alias("z")).select("line", "z", F.array_max("z").alias("top"))
    total = F.aggregate(F.transform("z", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("z", F.col("top")).cast("int"))
    said = scored.select("line", best.alias("family"), (1 / total).alias("probability")).where(F.col("family") != UNKNOWN)
    said = said.join(grams.select("line", "key", "paragraph", "words"), "line")
    shared = F.size(F.array_intersect("words", "template"))
    distinct = F.size(F.array_distinct("template"))
    near = F.greatest(shared / distinct, F.when(distinct >= 12, shared / F.size(F.array_distinct("words"))).otherwise(F.lit(0.0)))
    compared = said.join(F.broadcast(templates), "family").groupBy("line", "key", "paragraph", "family", "probability").agg(F.max(near).alias("similarity"))
    confirmed = (F.col("probability") >= CONFIDENCE) & (F.col("similarity") >= SIMILARITY)
    return compared.select(id_of("key").alias("doc_id"), "paragraph", "family", F.round("probability", 6).alias("probability"), "similarity", confirmed.alias("confirmed"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).where("confirmed").drop("confirmed")
