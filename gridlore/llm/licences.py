"""Licence scans: a trained paragraph classifier over sparse word n-grams, its predictions confirmed against templates.

Training (on the driver, from the templates below and variations of them): softmax regression over presence of word 1- to 3-grams with an L1 penalty,
against ordinary sentences; on held-out variations a temperature. The unknown class is calibrated on licences that the model hasn't seen: families are left out by turns, kin together, and
the least probability at which a family is named is set so that at most ``wrong_share`` of the texts of left-out families and of ordinary text are both named and confirmed. Scanning (DataFrame functions only): texts are cut into paragraphs, those that hold a key word of the
model are scored, a family is named if it is likeliest and likely enough, and confirmed if the paragraph holds enough of a template's n-grams. What
is likelier a licence than not but isn't named or not confirmed is ``unknown``.

Every n-gram of the model holds a key word (a word of a template that is no filler), so paragraphs without one score as ordinary text exactly and
needn't be scored. The penalty alone decides which n-grams stay.

Defined results: null and empty texts have no paragraphs; repeated rows are each reported; null ids keep their findings; an
empty table gives no rows. Paragraphs end at blank lines and at line ends after a full stop, an exclamation or a question mark, so a notice that is wrapped or lists its conditions stays whole. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual notices of licence families, as their publishers word them.
TEMPLATES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "Public domain": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
#: Families whose texts share most of their words; they are left out together when the unknown class is calibrated.
KIN = (("GPL", "LGPL", "AGPL"), ("CC-BY", "CC-BY-SA", "CC-BY-NC"), ("Apache", "MPL"), ("MIT", "BSD"), ("Public domain", "Proprietary"))
#: Ordinary sentences that use words of the templates.
ORDINARY = (
    "The software was slow and the files were lost when the program closed.",
    "She has a license to drive and a permit to park near the public library.",
    "A copy of the book is free of charge for any person who visits the library.",
    "The work of the commission is subject to the following conditions and rights.",
    "The source of the river lies above the old mill, and the law of the land applies.",
    "Version two of the file was published by the foundation in the spring.",
    "We noticed no modification in the binary form of the code after the use of the new library.",
    "The general public was not permitted to use the terms in the notice.",
    "Commercial international attribution is a common creative problem of the author.",
    "Restrictions on travel were lifted without prior written notice.",
    "The project file has a list of names and the date of each distribution.",
    "Copyright is a hard subject and the license fee was too high for the students.",
    "Under the terms of the lease the owner may modify the house in any form.",
    "Please find the following documentation in the public domain section of the site.",
    "He released the bird and later version of events differed from the first.",
    "That and this of the in with for on are as was by to it is be or an at from.",
)
#: Words that say nothing by themselves.
FILLERS = frozenset("a all an and any are as at be been being but by can charge for form forms from has have here hereby http in into is it its may met must no not of on only or other out part person should such that the there this to was were which will with without work you your above after along along following found later later list near obtain obtaining person prior program project received see terms use used via www com org".split())

PARAGRAPH = r"\n[ \t]*\n\s*|(?<=[.!?])[ \t]*\n"
NOT_WORD = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Settings:
    variations: int = 24
    steps: int = 250
    rate: float = 2.0
    l1: float = 4e-4
    wrong_share: float = 0.01
    similarity: float = 0.6
    most_least: float = 0.97  # beyond it known families would go unnamed; the templates have the last word
    left_out_steps: int = 80
    seed: int = 5


def ngrams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, list[float]]  # n-gram -> a weight for each family, ordinary text being zero
    bias: list[float]
    temperature: float
    least: float
    keys: tuple[str, ...]
    templates: tuple[tuple[str, tuple[str, ...]], ...]  # family and n-grams, for each template
    similarity: float


@cache
def train(s: Settings = Settings()) -> Model:
    rng = np.random.default_rng(s.seed)
    families = tuple(TEMPLATES)
    keys = tuple(sorted({w for t in TEMPLATES.values() for x in t for w in words(x) if w not in FILLERS and not w.isdigit()}))
    keyed = set(keys)
    made = [f"{a}{b}" for a in ("tor", "ven", "mal", "esh", "ond", "qui") for b in ("ath", "ine", "ous", "elle", "ando", "ung")]

    def vary(text: str) -> list[str]:
        """Words lost, put in, versions changed, other text around."""
        w = [str(rng.integers(1, 6)) if x.isdigit() else x for x in words(text)]
        w = [x for x in w if len(w) <= 5 or rng.random() > 0.06]
        if rng.random() < 0.3 and len(w) > 14:
            a = rng.integers(0, len(w) // 2)
            w = w[a : a + max(10, len(w) // 2)]
        near = lambda: [str(rng.choice(made)) for _ in range(rng.integers(0, 8))]
        return near() + w + near() if rng.random() < 0.5 else w

    rows, y = [], []
    for k, f in enumerate(families):
        for t in TEMPLATES[f]:
            rows += [words(t)] + [vary(t) for _ in range(s.variations)]
            y += [k] * (1 + s.variations)
    ordinary = len(families)
    mixed = [w for x in ORDINARY for w in words(x)]
    for x in ORDINARY:
        rows += [words(x)] + [vary(x) for _ in range(s.variations // 2)] + [[str(w) for w in rng.choice(mixed, rng.integers(3, 30))] for _ in range(s.variations)]
        y += [ordinary] * (1 + s.variations // 2 + s.variations)
    held = rng.random(len(rows)) < 0.25
    y = np.array(y)
    own = [{g for g in ngrams(w) if not keyed.isdisjoint(g.split())} for w in rows]
    grams = sorted({g for w, out in zip(own, held) if not out for g in w})
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)), np.float32)
    for i, w in enumerate(own):
        x[i, [at[g] for g in w if g in at]] = 1
    soft = lambda z: (e := np.exp(z - z.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)

    def descend(own: np.ndarray, target: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        weight, bias = np.zeros((own.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
        scale = (len(own) / np.maximum(1, own.sum(axis=1).mean())) ** 0.5
        for step in range(steps):
            rate = s.rate / (1 + 3 * step / steps)
            back = (soft(own @ weight + bias) - target) / len(own)
            weight -= rate * (own.T @ back) * scale
            weight = np.sign(weight) * np.maximum(0, np.abs(weight) - rate * s.l1)
            bias -= rate * back.sum(axis=0)
        return weight - weight[:, -1:], bias - bias[-1]

    known = np.eye(ordinary + 1, dtype=np.float32)[y]
    weight, bias = descend(x[~held], known[~held], s.steps)
    z, truth = x[held] @ weight + bias, y[held]
    temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(soft(z / t)[np.arange(len(truth)), truth] + 1e-12).sum())
    templates = tuple((f, tuple(sorted({g for g in ngrams(words(t)) if not keyed.isdisjoint(g.split())}))) for f in families for t in TEMPLATES[f])

    def confirmed(p: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The likeliest family's probability, zero where none of its templates confirms it."""
        top = p[:, :-1].argmax(axis=1)
        sure = [max(len(own[i].intersection(t)) / len(t) for f, t in templates if f == families[k]) >= s.similarity for i, k in zip(texts, top)]
        return np.where(sure, p[np.arange(len(top)), top], 0.0)

    plain = np.flatnonzero(held & (y == ordinary))
    wrong = [confirmed(soft((x[plain] @ weight + bias) / temperature), plain)]
    for kin in KIN:
        out = np.isin(y, [families.index(f) for f in kin])
        w, b = descend(x[~held & ~out], known[~held & ~out], s.left_out_steps)
        wrong.append(confirmed(soft((x[out] @ w + b) / temperature), np.flatnonzero(out)))
    wrong = np.sort(np.concatenate(wrong))
    least = float(np.clip(wrong[int(np.ceil(len(wrong) * (1 - s.wrong_share))) - 1], 0.5, s.most_least))
    kept = np.flatnonzero(np.abs(weight).max(axis=1) > 0)
    return Model(families, {grams[i]: [round(float(v), 6) for v in weight[i, :-1]] for i in kept}, [round(float(v), 6) for v in bias[:-1]], float(round(temperature, 6)), round(least, 6), keys, templates, s.similarity)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, words) of every paragraph."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.lower(F.regexp_replace(F.col(text_col).cast("string"), "\r\n?", "\n")), PARAGRAPH, -1)).alias("paragraph", "text"))
    return src.select("doc_id", "paragraph", F.filter(F.split("text", NOT_WORD, -1), lambda w: w != "").alias("words"))


def _array(values) -> Column:
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), "array<string>")


def classify(rows: DataFrame, m: Model) -> DataFrame:
    """rows (.., words) -> those with a licence: family, probability, similarity, confirmed."""
    rows = rows.where(F.arrays_overlap("words", _array(m.keys)))
    n = F.size("words")
    grams = F.concat(
        F.col("words"),
        F.zip_with(F.slice("words", 1, F.greatest(n - 1, F.lit(0))), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b)),
        F.zip_with(F.zip_with(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), F.slice("words", 2, F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)), F.slice("words", 3, n), lambda a, b: F.concat_ws(" ", a, b)),
    )
    wanted = sorted(set(m.weights) | {g for _, t in m.templates for g in t})
    rows = rows.withColumn("_grams", F.array_intersect(grams, _array(wanted))).where(F.size("_grams") > 0)
    table = F.from_json(F.lit(json.dumps(m.weights, ensure_ascii=False)), "map<string, array<double>>")
    zero = F.array(*[F.lit(b) for b in m.bias])
    found = F.filter(F.transform("_grams", lambda g: F.try_element_at(table, g)), lambda w: w.isNotNull())
    rows = rows.withColumn("_logit", F.aggregate(found, zero, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b)))
    rows = rows.withColumn("_exp", F.transform("_logit", lambda v: F.exp(F.least(v / F.lit(m.temperature), F.lit(500.0)))))
    total = F.aggregate("_exp", F.lit(1.0), lambda a, v: a + v)
    rows = rows.withColumn("_p", F.array_max("_exp") / total).withColumn("licence", F.lit(1.0) - F.lit(1.0) / total)
    rows = rows.withColumn("_top", F.array_position("_exp", F.array_max("_exp")).cast("int")).where("licence > 0.5")
    shares = F.array(*[F.struct(F.lit(m.families.index(f) + 1).alias("f"), (F.size(F.array_intersect("_grams", _array(t))) / F.lit(float(len(t)))).alias("share")) for f, t in m.templates])
    own = F.array_max(F.transform(F.filter(shares, lambda x: x["f"] == F.col("_top")), lambda x: x["share"]))
    rows = rows.withColumn("similarity", own)
    likely = F.col("_p") >= m.least
    confirmed = likely & (F.col("similarity") >= m.similarity)
    name = F.element_at(F.array(*[F.lit(f) for f in m.families]), F.col("_top"))
    return rows.withColumn("confirmed", confirmed).withColumn("family", F.when(confirmed, name).otherwise(F.lit("unknown"))).withColumn("likeliest", name).withColumnRenamed("_p", "probability").drop("_grams", "_logit", "_exp", "_top", "words")


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, probability, licence, similarity, confirmed, family, likeliest) of every licence paragraph."""
    return classify(paragraphs(docs, id_col, text_col), model or train())
