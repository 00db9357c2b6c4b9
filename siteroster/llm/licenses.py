"""Licence scan: a sparse n-gram classifier names the licence of each paragraph, and templates confirm it.

Every line with a word is a paragraph. Its features are the distinct words and
word pairs that occur in the templates below. A multinomial logistic regression
tells the licence families, licences of no known family (``unknown``) and
ordinary text apart; it is trained here on varied templates, on made-up licences,
and on a bounded sample of paragraphs of the documents. A temperature fitted on a
held-out part calibrates its probabilities. A family stands only if it reaches
``least`` and a template of the family shares enough pairs; otherwise the
paragraph is ``unknown``.

Scanning is done with built-in functions. The weights give a bound: a paragraph
without one of the heavy words cannot be told from ordinary text, so such
paragraphs, and texts without any, are left out before features are made.

Defined results: null and empty texts have no paragraphs; long texts are scanned
whole; repeated rows give their rows again; ids may be null; other columns are
not read; documents without a licence give no row.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.llm.sampling import chosen_by_hash
from siteroster.llm.words import text_or_empty

#: Wording of common licences and notices.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.", "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "lgpl": ["Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1"],
    "bsd": [
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}
#: Licences of no family; ``@`` stands for a made-up name.
UNKNOWN = ["Licensed under the @ License.", "Released under the @ Public License, version 4.", "Licensed under @ 1.0.",
           "This work is licensed under the terms of the @ agreement.", "Use of this work is subject to the @ licence.",
           "Distributed under the terms of the @ license.", "SPDX-License-Identifier: @"]
CLASSES = [*TEMPLATES, "unknown", "none"]
TOKEN = "[^a-z0-9]+"


def grams(text: str) -> set[str]:
    words = [w for w in re.split(TOKEN, text.lower()) if w]
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


class Classifier:
    """Weights by gram and class, biases, temperature."""

    def __init__(self, ordinary: list[str], variants: int = 40, steps: int = 400, seed: int = 23):
        rng = random.Random(seed)
        self.ordinary = Counter(w for text in ordinary for w in grams(text) if " " not in w)
        spare = [w for text in ordinary[:500] for w in text.split()] or ["word"]
        samples = [(text, "none") for text in ordinary]
        for family, texts in [*TEMPLATES.items(), ("unknown", UNKNOWN)]:
            for text in texts:
                for number in range(variants):
                    words = text.replace("@", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))).split()
                    if number:
                        words = [w for w in words if len(words) < 6 or rng.random() > 0.06]
                        words = rng.choices(spare, k=rng.choice((0, 0, 2, 6))) + words + rng.choices(spare, k=rng.choice((0, 0, 3, 8)))
                    samples.append((" ".join(words), family))
        rng.shuffle(samples)
        self.vocabulary = sorted(set().union(*(grams(t) for ts in TEMPLATES.values() for t in ts),
                                             *(grams(t.replace("@", "|")) for t in UNKNOWN)))
        place = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(samples), len(place)), np.float32)
        for row, (text, _) in enumerate(samples):
            x[row, [place[g] for g in grams(text) if g in place]] = 1
        y = np.array([CLASSES.index(c) for _, c in samples])
        held = np.arange(len(y)) % 5 == 0
        self.weights, self.bias = self._fit(x[~held], y[~held], steps)
        scores = x[held] @ self.weights + self.bias
        self.temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: self._loss(scores / t, y[held]))
        self.accuracy = float((scores.argmax(axis=1) == y[held]).mean())

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, steps: int, sparse: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
        target = np.eye(len(CLASSES), dtype=np.float32)[y]
        # classes weigh alike, as ordinary text would drown small ones
        share = (1 / np.maximum(1, target.sum(axis=0)))[y][:, None].astype(np.float32) / len(CLASSES)
        weights, bias = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
        speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(steps):
            scores = x @ weights + bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            d = (scores / scores.sum(axis=1, keepdims=True) - target) * share
            speed_w = 0.9 * speed_w - 4.0 * (x.T @ d + 1e-4 * weights)
            speed_b = 0.9 * speed_b - 1.0 * d.sum(axis=0)
            weights, bias = weights + speed_w, bias + speed_b
            # a small constant step towards zero keeps the weights sparse
            weights = np.sign(weights) * np.maximum(0, np.abs(weights) - 4.0 * sparse)
        return weights, bias

    @staticmethod
    def _loss(scores: np.ndarray, y: np.ndarray) -> float:
        scores = scores - scores.max(axis=1, keepdims=True)
        return float(-(scores[np.arange(len(y)), y] - np.log(np.exp(scores).sum(axis=1))).mean())

    def heavy_words(self) -> list[str]:
        """Words of which a paragraph needs one to be told from ordinary text.

        The other words are light: for every class, the gains over ordinary text of
        all grams made of light words alone stay below what the biases favour
        ordinary text by. Words that are frequent in ordinary text come first.
        """
        gain = np.maximum(0, self.weights[:, :-1] - self.weights[:, -1:])
        margin = self.bias[-1] - self.bias[:-1]
        words = [g for g in self.vocabulary if " " not in g]
        light: set[str] = set()
        for word in sorted(words, key=lambda w: (-self.ordinary[w], w)):
            tried = light | {word}
            rows = [i for i, g in enumerate(self.vocabulary) if tried.issuperset(g.split(" "))]
            if (gain[rows].sum(axis=0) < margin).all():
                light = tried
        return [w for w in words if w not in light]


def _strings(values: list[str]) -> Column:
    return F.split(F.lit("\t".join(values)), "\t")


def _grams(paragraph: Column) -> Column:
    words = F.filter(F.split(F.lower(paragraph), TOKEN), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def ordinary_paragraphs(docs: DataFrame, documents: int, most: int) -> list[str]:
    """A bounded sample of paragraphs that share few pairs with any template."""
    lines = docs.where(chosen_by_hash(docs, "doc_id", documents)).select(
        F.explode(F.split(text_or_empty(), "\n")).alias("line")).where("trim(line) <> ''").limit(most).collect()
    known = [grams(t) for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts]
    return [line for (line,) in lines if not any(len(grams(line) & k) >= 0.5 * len(k) for k in known)]


def scan_licenses(
    docs: DataFrame, least: float = 0.5, overlap: float = 0.6, documents: int = 400, most: int = 5000,
) -> DataFrame:
    """``doc_id, paragraph, family, probability, template_overlap`` for every licence paragraph (line number from 0)."""
    model = Classifier(ordinary_paragraphs(docs, documents, most))
    heavy = model.heavy_words()
    # the class of the words' letters keeps the boundary test in step with the tokens
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, heavy)) + ")(?![a-z0-9])"
    lines = docs.select("doc_id", text_or_empty().alias("text")).where(F.col("text").rlike(pattern)).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where(F.col("line").rlike(pattern))
    vocabulary = _strings(model.vocabulary)
    weights = F.split(F.lit(",".join(f"{w:.5f}" for w in model.weights.ravel())), ",").cast("array<double>")
    found = lines.select("doc_id", "paragraph", _grams(F.col("line")).alias("grams")).withColumn(
        "places", F.transform(F.array_intersect("grams", vocabulary), lambda g: F.array_position(vocabulary, g) - 1))
    n = len(CLASSES)
    def score(c: int) -> Column:
        return (F.lit(float(model.bias[c])) + F.aggregate("places", F.lit(0.0), lambda total, p: total + F.get(
            weights, (p * n + c).cast("int")))) / model.temperature

    scores = F.array(*[score(c) for c in range(n)])
    # made by a generator, the scores are worked out once and not again within the filter below
    found = found.withColumn("scores", F.explode(F.array(scores))).withColumn("top", F.array_max("scores"))
    found = found.withColumn("class", (F.array_position("scores", F.col("top")) - 1).cast("int")).where(
        F.col("class") < n - 1)
    total = F.aggregate("scores", F.lit(0.0), lambda sum_, s: sum_ + F.exp(s - F.col("top")))
    pairs = F.filter("grams", lambda g: g.contains(" "))
    shares = []
    for texts in TEMPLATES.values():
        each = []
        for text in texts:
            own = sorted(g for g in grams(text) if " " in g)
            each.append(F.size(F.array_intersect("pairs", _strings(own))) / F.greatest(
                F.least(F.size("pairs"), F.lit(len(own))), F.lit(1)))
        shares.append(F.greatest(*each) if len(each) > 1 else each[0])
    found = found.withColumn("pairs", pairs).withColumn("probability", 1 / total).withColumn(
        "template_overlap", F.coalesce(F.get(F.array(*shares, F.lit(0.0)), F.col("class")), F.lit(0.0)))
    confirmed = (F.col("probability") >= least) & (F.col("template_overlap") >= overlap)
    return found.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"),
        F.when(confirmed, F.get(_strings(CLASSES), F.col("class"))).otherwise(F.lit("unknown")).alias("family"),
        "probability", "template_overlap")
