"""Licence scan of paragraphs, with DataFrame functions only.

A paragraph (a line) is a bag of hashed one- and two-word grams. A sparse logistic regression says whether it
states a licence at all, with a calibrated probability; the rest is the unknown class. A second one names
the family. A comparison with the family's templates on word shingles confirms the name.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read, save

# Notices and characteristic sentences of the licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["Released under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0."],
    "Zlib": ["Released under the zlib License.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation."],
    "ODbL-1.0": ["This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Identifiers of the licences in SPDX lines.
SPDX = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT", "MIT-0"], "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"], "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL-2.0": ["MPL-2.0"], "ISC": ["ISC"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0"], "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0"], "public-domain": ["CC0-1.0", "Unlicense", "0BSD"], "BSL-1.0": ["BSL-1.0"], "EPL": ["EPL-2.0"], "Zlib": ["Zlib"], "OFL-1.1": ["OFL-1.1"], "GFDL": ["GFDL-1.3-or-later"], "ODbL-1.0": ["ODbL-1.0"],
}
for _family, _names in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {x}" for x in _names]
#: Sentences with the same words that state no licence.
PLAIN = [
    "She renewed her driving licence last week.", "A licence is required to fish in this river.", "The apache helicopter landed near the river.", "Researchers at MIT released a new study.", "The general public was invited to the library.",
    "The restaurant lost its licence to sell alcohol.", "Version 3 of the report was released in May.", "The software was distributed to schools without a fee.", "He reserved a table and the rights to the song were sold.", "The foundation published a copy of the work.",
    "The public domain of the park is open to all persons.", "Creative writing and common attribution errors in the work.", "The mozilla team met in version two of the plan.", "You may not use this door except in an emergency.", "Permission to enter was granted free of charge.",
    "The author waived the fee for related neighbors.", "A new dog licence costs ten pounds under the old law.", "The licensed practitioner works under the general rules.", "This program starts at nine and is free for the public.", "Copying of keys is strictly prohibited in this shop.",
    "Die Lizenz wurde gestern im Rathaus verlängert.", "Le permis de conduire est obligatoire pour tous.", "La licencia de pesca se renueva cada año.", "Sold under the brand name since 2004.", "The conditions of the road are met with care.",
]
FAMILIES = sorted(TEMPLATES)

BUCKETS = 1 << 14
#: Bound of the fit: documents whose paragraphs are examples of the unknown class, and paragraphs of them.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 400, 4000
#: Probability from which a paragraph is taken to state a licence, and the share of such paragraphs that a corpus
#: is expected to have; the weight of the penalty that keeps the regressions sparse.
KNOWN, PRIOR, PENALTY = 0.5, 0.02, 1e-5
#: Steps of the fit.
STEPS = 300
SHINGLE, SIMILARITY = 5, 0.8


def tokens(paragraph: Column) -> Column:
    """Hashes of the words (letters and digits, lower case) of a paragraph."""
    return F.transform(F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(t: Column) -> Column:
    """Buckets of the one- and two-word grams of a paragraph given as hashes."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    one = F.transform(t, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def literal(value: list, kind: str) -> Column:
    """A constant of the plan from JSON text: one node, folded before the query runs."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def linear(t: Column, weights: np.ndarray) -> Column:
    """Weights summed over the grams of a paragraph, over the root of their number; zero for none."""
    w = literal([round(float(x), 6) for x in weights], "array<double>")
    n = F.greatest(F.size(t) * 2 - 1, F.lit(1)).cast("double")

    def total(buckets: Column) -> Column:
        return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(w, b))

    return total(grams(t)) / F.sqrt(n)


def shingles(t: Column, k: Column) -> Column:
    """Hashes of the runs of k words."""
    return F.when(F.size(t) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(t, i, k))))


class _Bags:
    """Sparse rows of bucket lists, each divided by the root of its length."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        size = np.array([len(r) for r in rows])
        self.row = np.repeat(np.arange(self.n), size)
        self.col = np.array([b for r in rows for b in r], dtype=np.int64)
        self.val = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * g[self.row], minlength=BUCKETS)


def _fit(bags: _Bags, y: np.ndarray, k: int, weight: np.ndarray, sparse: float, steps: int) -> np.ndarray:
    """Weights (k rows) of a softmax regression with an absolute-value penalty, by accelerated proximal gradient steps.

    Rows have weights that sum to one and norm at most one, so a fixed step of 2 is safe.
    """
    used, col = np.unique(bags.col, return_inverse=True)
    hot, rate = np.eye(k)[y] * weight[:, None], 2.0
    w = ahead = np.zeros((k, len(used)))
    t = 1.0
    for _ in range(steps):
        z = np.stack([np.bincount(bags.row, weights=bags.val * ahead[c][col], minlength=bags.n) for c in range(k)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p *= weight[:, None] / p.sum(axis=1, keepdims=True)
        g = np.stack([np.bincount(col, weights=bags.val * (p - hot)[bags.row, c], minlength=len(used)) for c in range(k)])
        new = ahead - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparse, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    out = np.zeros((k, BUCKETS))
    out[:, used] = w
    return out


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def _examples(seed: int = 5) -> list[tuple[str, str, int]]:
    """(family or "", text, source): templates and plain sentences, whole, cut, with lost words and with neighbours. What comes from
    one sentence has one source, so no fit is judged on another form of what it has seen."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    around = ["", "", "Copyright (c) 2019 Example Authors.", "Copyright 2021, all contributors.", "See the file for details.", "Please read the notes."]
    out, source = [], 0
    for family, texts, times in [*((f, TEMPLATES[f], 24) for f in FAMILIES), ("", PLAIN, 12)]:
        for text in texts:
            source += 1
            out.append((family, text, source))
            words = text.split()
            for _ in range(times):
                kept = words
                if len(words) > 14 and rng.random() < 0.6:
                    a = int(rng.integers(0, len(words) - 10))
                    kept = words[a : a + int(rng.integers(10, len(words) - a + 1))]
                kept = [w for w in kept if rng.random() > (0.06 if family else 0.15)] or words
                body = " ".join(kept)
                out.append((family, f"{pick(around)} {body}" if rng.random() < 0.5 and family else f"{body} {pick(around)}" if family else body, source))
    # a copyright line alone states no licence
    return out + [("", f"Copyright (c) {y} Example Authors.", 0) for y in range(1990, 2025)] + [("", "See the file for details.", 0), ("", "Please read the notes.", 0)] * 5


class Model:
    def __init__(self, any_weights: np.ndarray, slope: float, offset: float, family_weights: np.ndarray, templates: list):
        self.any, self.slope, self.offset, self.family, self.templates = any_weights, slope, offset, family_weights, templates

    def known(self, t: Column) -> Column:
        """Probability that a paragraph states a licence."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * linear(t, self.any) + F.lit(self.offset))))

    def best(self, t: Column) -> Column:
        """(margin, name) of the best family; the last by name of equals."""
        return F.array_max(F.array(*[F.struct(linear(t, self.family[k]).alias("margin"), F.lit(f).alias("name")) for k, f in enumerate(FAMILIES)]))

    def similarity(self, t: Column, family: Column) -> Column:
        """The larger share of shingles in common, of the paragraph's or of a template's, over the family's templates."""
        known = literal(self.templates, "array<struct<family:string,k:int,sh:array<bigint>>>")

        def one(x: Column) -> Column:
            def shared(own: Column) -> Column:
                both = F.size(F.array_intersect(own, x["sh"]))
                part = F.when(F.size(own) >= 2, both / F.greatest(F.size(F.array_distinct(own)), F.lit(1))).otherwise(0.0)
                return F.greatest(both / F.size(x["sh"]), part)

            return F.get(F.transform(F.array(shingles(t, x["k"])), shared), F.lit(0))

        return F.coalesce(F.array_max(F.transform(F.filter(known, lambda x: x["family"] == family), one)), F.lit(0.0))


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on made-up examples of every family and, for the unknown class, paragraphs of SAMPLE_DOCS documents.

    The documents are those of the smallest id hashes; paragraphs of theirs that share a run of SHINGLE words
    with a template are left out. Spark computes all features; the fit works on a few thousand short lists.
    """
    spark = documents.sparkSession
    made = _examples()
    rows = spark.createDataFrame(made, "family string, text string, source int").select("family", "source", tokens(F.col("text")).alias("t"))
    fixed = spark.createDataFrame([(f, x) for f in FAMILIES for x in TEMPLATES[f]], "family string, text string").select("family", tokens(F.col("text")).alias("t"))
    k = F.least(F.size("t"), F.lit(SHINGLE))
    templates = [{"family": r["family"], "k": r["k"], "sh": r["sh"]} for r in fixed.select("family", k.alias("k"), F.array_distinct(shingles(F.col("t"), k)).alias("sh")).collect()]
    ids = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i", F.lit(5)), "i").limit(SAMPLE_DOCS).distinct()
    lines = documents.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "i")
    lines = save(lines.select(F.explode(F.split("text", "\n")).alias("p")).where("trim(p) <> ''").distinct().select("p", tokens(F.col("p")).alias("t")), "lines")
    stated = literal(sorted({h for x in templates for h in x["sh"]}), "array<bigint>")
    apart = ~F.arrays_overlap(shingles(F.col("t"), F.lit(SHINGLE)), stated) & ~F.arrays_overlap(shingles(F.col("t"), F.lit(3)), stated)
    corpus = lines.where(apart).orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS).select(F.lit("").alias("family"), F.monotonically_increasing_id().cast("int").alias("source"), "t")
    got = [(r["family"], r["g"], r["source"]) for part in (rows, corpus) for r in part.select("family", "source", grams(F.col("t")).alias("g")).collect()]
    families = np.array([FAMILIES.index(f) if f else -1 for f, *_ in got])
    known = (families >= 0).astype(int)
    share = known.mean()

    def stated_or_not(at: np.ndarray) -> np.ndarray:
        own = known[at].mean()
        w = _fit(_Bags([got[i][1] for i in at]), known[at], 2, np.where(known[at] == 1, 0.5 / own, 0.5 / (1 - own)) / len(at), PENALTY, STEPS)
        return w[1] - w[0]

    # margins of every example by a fit that has seen no other form of its sentence: what new wording will get
    fold, margins = np.array([s % 3 for *_, s in got]), np.zeros(len(got))
    for k in range(3):
        at = np.flatnonzero(fold == k)
        if not len(at):
            continue
        margins[at] = _Bags([got[i][1] for i in at]).dot(stated_or_not(np.flatnonzero(fold != k)))
    slope, offset = _calibrate(margins, known)
    any_weights = stated_or_not(np.arange(len(got)))
    # from the examples' share of licence paragraphs to the one expected in a corpus
    offset += float(np.log(PRIOR / (1 - PRIOR)) - np.log(share / (1 - share)))
    named = np.flatnonzero(known == 1)
    family_weights = _fit(_Bags([got[i][1] for i in named]), families[named], len(FAMILIES), np.full(len(named), 1 / len(named)), PENALTY, 120)
    return Model(any_weights, slope, offset, family_weights, templates)


_FOUND = "array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, licence, probability, similarity, n_paragraphs, found. No shuffle.

    found lists the paragraphs that are not of the unknown class. licence is the family of the most probable
    confirmed one (the first of equals), "unconfirmed" if none is confirmed, "unknown" if none is found.
    Paragraphs are lines with a word; null and empty texts have none. Every row of df gives one row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.select(F.col(id_col).alias("id"), F.transform(F.split(text, "\n"), tokens).alias("t"))
    scored = F.filter(F.transform("t", lambda t, i: F.struct(i.alias("no"), t.alias("t"), model.known(t).alias("p"))), lambda x: (F.size(x["t"]) > 0) & (x["p"] >= F.lit(KNOWN)))
    out = out.select("id", F.size(F.filter("t", lambda t: F.size(t) > 0)).cast("long").alias("n_paragraphs"), scored.alias("c"))
    out = out.withColumn("c", F.transform("c", lambda c: F.struct(c["no"].alias("no"), c["t"].alias("t"), c["p"].alias("p"), model.best(c["t"])["name"].alias("family"))))
    out = out.withColumn("c", F.transform("c", lambda c: F.struct(c["no"].alias("paragraph"), c["family"].alias("family"), c["p"].alias("probability"), model.similarity(c["t"], c["family"]).alias("similarity"))))
    found = F.transform("c", lambda c: F.struct(c["paragraph"].alias("paragraph"), c["family"].alias("family"), c["probability"].alias("probability"), c["similarity"].alias("similarity"), (c["similarity"] >= F.lit(SIMILARITY)).alias("confirmed")))
    out = out.withColumn("found", found.cast(_FOUND))
    rank = lambda x: F.struct(x["confirmed"].alias("ok"), x["probability"].alias("p"), (-x["paragraph"]).alias("no"), x["family"].alias("family"), x["similarity"].alias("s"))
    out = out.withColumn("best", F.array_max(F.transform("found", rank)))
    name = F.when(F.col("best").isNull(), "unknown").when(F.col("best.ok"), F.col("best.family")).otherwise("unconfirmed")
    return out.select(F.col("id").alias(id_col), name.alias("licence"), F.coalesce("best.p", F.lit(0.0)).alias("probability"), F.coalesce("best.s", F.lit(0.0)).alias("similarity"), "n_paragraphs", "found")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state; see scan for null and empty texts, ties and repeated rows."""
    documents = read(spark, sf_dir, "documents")
    return scan(documents, train(documents))
