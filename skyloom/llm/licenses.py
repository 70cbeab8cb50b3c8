"""License scans by a trained paragraph classifier, in DataFrame operations only.

Paragraphs (lines) are classified by a sparse logistic regression over word uni- and bigrams. It is trained on
seeded variations of license notices, on license-like texts of no known family, and on a bounded sample of the
corpus' own paragraphs (``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters). Words that the sample
uses commonly are no features, so a text without any feature word is ordinary text, and only the others are
scored. Probabilities are calibrated by a temperature on held-out variations; a paragraph
whose best family is less likely than ``SURE``, or has too few words of each of that family's templates
(``CONFIRM``), is of *unknown* license unless ordinary text is likelier.

Notices are wrapped in files. So lines that give no family are classified again together with up to ``AROUND`` lines
before and after them, as far as no line without words (comment marks are none) or of a known license of its own
lies between. A notice of several lines is given at the first of them that gives it with its neighbours.

Defined results: a null or empty text has no paragraphs with a license. A family is counted once a line, and once
for all lines that only together give it, as far as no line without words lies between;
repeated rows each get a row; a null id is a row like any other; equal probabilities go to the family first in
the list.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample

#: Bounds of the corpus sample; variations of each template; most features.
SAMPLE_DOCS, SAMPLE_CHARS, VARIATIONS, FEATURES = 300, 5_000, 24, 3_000
#: Share of the sample's paragraphs from which on a word is common; least probability and share of template words.
COMMON, SURE, CONFIRM = 0.01, 0.5, 0.6
#: Lines to either side of one that gives no family that it is classified with; 17 lines hold any template of 3 words a line.
AROUND = (1, 2, 4, 8)
SLOTS = 8192
NONE, UNKNOWN = "none", "unknown"

# Notices of the families, as their texts ask for or as they are commonly given.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
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
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
    ),
}
#: License-like texts of no known family.
OTHERS = (
    "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    "This software is proprietary and confidential and may not be copied or distributed.",
    "Licensed under the Acme Internal Source License, version 7.",
    "Use of this product is subject to the terms of the end user license agreement.",
    "Licensed to the customer named above for a single site only.",
    "Released under a custom license; contact the author for terms.",
    "This work is licensed under the Foo Public Terms, version 1.",
    "You may not use this material without a commercial license.",
    "Copyright by the authors. Redistribution of this document requires a license.",
    "SPDX-License-Identifier: LicenseRef-Custom",
)
#: Names that such licenses are made up with.
NAMES = ("Acme", "Foo", "Northern", "Blue", "Vendor", "Sample", "Harbor", "Delta", "Orchid", "Granite", "Willow", "Summit")
#: Ordinary texts that have some of the words.
ORDINARY = (
    "She is a licensed physician in two states.", "He renewed his driving licence on Monday.", "The version of events told by the public was general.",
    "Permission to land was granted by the tower.", "The software update improved the general performance.", "A copy of the file was obtained from the archive.",
    "The team released a new version of the library.", "The foundation published a free guide for the public.", "The apache helicopter landed at the base.",
)


def words_of(text: Column) -> Column:
    """Words of a paragraph: letters and digits, lower case; a number keeps its dot."""
    return F.array_remove(F.split(F.lower(text), r"(?:[^\p{L}\p{N}.]|\.(?!\p{N})|(?<!\p{N})\.)+"), "")


def ngrams_of(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.concat(words, pairs))


def _plain_words(text: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", text.lower()))


@dataclass
class Model:
    """families: names of the classes. cues: the feature words, without one of which a line is ordinary; none if that isn't so. slots: JSON of the features and their weights by slot.
    start: intercepts. temperature: what scores are divided by. templates: JSON of each class' templates as words."""

    families: list[str]
    cues: list[str]
    slots: str
    start: list[float]
    temperature: float
    templates: str


def _variations(text: str, rng: random.Random) -> str:
    words = text.split(" ")
    kept = [w for w in words if len(words) < 6 or rng.random() > 0.12]
    if len(kept) > 12 and rng.random() < 0.3:
        kept = kept[:max(8, int(len(kept) * rng.uniform(0.6, 1)))]
    out = " ".join(kept)
    return out.upper() if rng.random() < 0.1 else out.lower() if rng.random() < 0.2 else out


def training_rows() -> list[tuple[str, str, bool]]:
    """Seeded (text, class, held out) without the corpus' own paragraphs."""
    rng = random.Random(11)
    made = [f"{how} the {a} {b} {kind}{', version ' + str(rng.randint(1, 9)) if rng.random() < 0.5 else ''}." for how in ("Licensed under", "Released under", "Distributed under")
            for a, b, kind in zip(rng.sample(NAMES, 8), rng.sample(NAMES, 8), rng.choices(("License", "Terms", "Public Terms", "Agreement", "Software License"), k=8), strict=True)]
    named = [(t, family) for family, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in (*OTHERS, *made)] + [(t, NONE) for t in ORDINARY]
    return [(t if k == 0 else _variations(t, rng), family, k % 4 == 3) for t, family in named for k in range(VARIATIONS)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark: SparkSession = docs.sparkSession
    text = F.col(text_col).cast("string")
    fitting = docs.where((text != "") & (F.length(text) <= SAMPLE_CHARS)).select(text.alias("text"), F.col(id_col).alias("k"))
    sample = hashed_sample(fitting, SAMPLE_DOCS, F.col("k"), F.col("text"))
    own = [r.text for r in sample.select(F.explode(F.split("text", "\n")).alias("text")).where("trim(text) <> ''").distinct().orderBy("text").collect()]
    # Paragraphs of the sample that have many of a notice's words are no examples of ordinary text.
    notices = [_plain_words(t) for t in (*(t for ts in TEMPLATES.values() for t in ts), *OTHERS)]
    plain = [t for t in own if not any(2 * len(n & w) >= len(n) for w in [_plain_words(t)] for n in notices)]
    rows = training_rows() + [(t, NONE, i % 4 == 3) for i, t in enumerate(plain)]
    families = [*TEMPLATES, UNKNOWN, NONE]
    data = spark.createDataFrame([(t, float(families.index(c)), h, c == NONE and i >= len(rows) - len(plain)) for i, (t, c, h) in enumerate(rows)], "text string, label double, held boolean, own boolean").withColumn("words", words_of(F.col("text")))
    often = data.where("own").select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().where(F.col("count") > COMMON * max(1, len(plain)))
    common = sorted(r.w for r in often.collect()) or [""]
    # A bigram is a feature only if one of its words is, so that a feature never comes without a feature word.
    rare = F.filter("words", lambda w: ~w.isin(common))
    grams = F.filter(ngrams_of(F.col("words")), lambda g: F.exists(F.split(g, " "), lambda w: ~w.isin(common)))
    data = data.withColumn("grams", F.when(F.size(rare) > 0, grams).otherwise(F.array().cast("array<string>"))).cache()
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, minDF=3, binary=True).fit(data.where("label <> {0}".format(families.index(NONE))))
    fitted = LogisticRegression(family="multinomial", maxIter=60, regParam=0.002, elasticNetParam=0.5).fit(vectorizer.transform(data.where("not held")))
    start = fitted.interceptVector.toArray().tolist()
    start += [-50.0] * (len(families) - len(start))
    weights = fitted.coefficientMatrix.toArray()
    used = [(g, [round(float(x), 5) for x in weights[:, i]]) for i, g in enumerate(vectorizer.vocabulary) if abs(weights[:, i]).sum() > 1e-6]
    held = fitted.transform(vectorizer.transform(data.where("held"))).select("label", vector_to_array("rawPrediction").alias("raw")).cache()
    losses = [F.avg(-F.log(F.greatest(F.lit(1e-9), F.get(F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / t)), F.col("label").cast("int")) / F.aggregate(F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / t)), F.lit(0.0), lambda a, b: a + b)))).alias(f"t{t}") for t in (0.5, 0.7, 1.0, 1.4, 2.0)]  # noqa: B023
    nll = held.agg(*losses).first()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: nll[f"t{t}"] if nll[f"t{t}"] is not None else 0)
    hashed = spark.createDataFrame(used or [("", [0.0] * len(families))], "g string, w array<double>").select("g", "w", F.pmod(F.xxhash64("g"), F.lit(SLOTS)).alias("s")).orderBy("s", "g").collect()
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for r in hashed:
        slots[r.s].append({"g": r.g, "w": (list(r.w) + [0.0] * len(families))[:len(families)]})
    cues = sorted({w for g, _ in used for w in g.split(" ") if w not in set(common)})
    flat = [(i, t) for i, f in enumerate(families) for t in TEMPLATES.get(f, ())]
    split = spark.createDataFrame(flat, "i int, t string").select("i", F.array_distinct(words_of(F.col("t"))).alias("w")).collect()
    by_class = [[list(r.w) for r in split if r.i == i] for i in range(len(families))]
    data.unpersist()
    held.unpersist()
    # A line without features has the intercepts for scores: only if ordinary text leads there can it be passed over.
    return Model(families, (cues or [""]) if start[-1] == max(start) else [], json.dumps(slots), start, float(temperature), json.dumps(by_class))


def classified(words: Column, model: Model) -> Column:
    """struct<family, confidence, agreement> of a paragraph's words."""
    k = len(model.families)
    slots = F.from_json(F.lit(model.slots), "array<array<struct<g string, w array<double>>>>")
    templates = F.from_json(F.lit(model.templates), "array<array<array<string>>>")
    start = F.from_json(F.lit(json.dumps(model.start)), "array<double>")
    hits = F.flatten(F.transform(ngrams_of(words), lambda g: F.filter(F.get(slots, F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int")), lambda e: e["g"] == g)))
    scores = F.aggregate(hits, start, lambda a, e: F.zip_with(a, e["w"], lambda x, y: x + y))
    # Nested steps, each as the one element of an array, so that none is worked out more than once.
    def softmax(s):
        powers = F.transform(F.array(F.transform(s, lambda x: F.exp((x - F.array_max(s)) / model.temperature))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
        return F.get(powers, 0)

    def verdict(p):
        known = F.array_max(F.transform(F.slice(p, 1, k - 2), lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
        agree = F.coalesce(F.array_max(F.transform(F.get(templates, -known["i"]), lambda t: F.size(F.array_intersect(t, words)) / F.size(t))), F.lit(0.0))
        none = F.get(p, k - 1)
        sure = (known["p"] >= SURE) & (agree >= CONFIRM)
        ordinary = (none >= known["p"]) & (none >= F.get(p, k - 2))
        names = F.array(*map(F.lit, model.families))
        family = F.when(sure, F.get(names, -known["i"])).when(ordinary, F.lit(NONE)).otherwise(F.lit(UNKNOWN))
        sureness = F.when(sure, known["p"]).when(ordinary, none).otherwise(1 - none)
        return F.struct(family.alias("family"), sureness.alias("confidence"), agree.cast("double").alias("agreement"))

    return F.get(F.transform(F.transform(F.array(scores), softmax), verdict), 0)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: for each document its paragraphs (place from 0) that are not ordinary text."""
    cues = F.from_json(F.lit(json.dumps(model.cues)), "array<string>")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    empty = F.array().cast("array<struct<paragraph int, words array<string>>>")
    lines = F.transform(F.split("_t", "\n"), lambda p, i: F.struct(i.alias("paragraph"), words_of(p).alias("words")))
    out = out.withColumn("_p", F.when(F.arrays_overlap(words_of(F.col("_t")), cues), F.filter(lines, lambda x: F.arrays_overlap(x["words"], cues))).otherwise(empty) if model.cues else F.filter(lines, lambda x: F.size(x["words"]) > 0))
    out = out.withColumn("_f", F.transform("_p", lambda x: F.struct(x["paragraph"].alias("paragraph"), classified(x["words"], model).alias("c"))))
    out = out.withColumn("_l", F.when(F.exists("_f", lambda x: x["c"]["family"].isin(UNKNOWN, NONE)), lines).otherwise(empty))
    known = F.filter("_f", lambda x: ~x["c"]["family"].isin(UNKNOWN, NONE))
    out = out.withColumn("_b", F.filter("_l", lambda x: F.size(x["words"]) == 0)["paragraph"]).withColumn("_e", F.concat("_b", known["paragraph"]))
    out = out.withColumn("_g", F.transform("_f", lambda x: F.when(x["c"]["family"].isin(UNKNOWN, NONE), _wrapped(x, model)).otherwise(F.struct(x["paragraph"].alias("paragraph"), F.lit(False).alias("wide"), x["c"].alias("c")))))
    # The place of each among the lines without words.
    out = out.withColumn("_g", F.transform("_g", lambda x: F.struct(x["paragraph"].alias("paragraph"), x["wide"].alias("wide"), x["c"].alias("c"), F.size(F.filter("_b", lambda b: b < x["paragraph"])).alias("part"))))
    # Of the lines of one notice the first, or the one that gives the family alone.
    first = F.filter("_g", lambda x: (x["c"]["family"] != NONE) & ~(x["wide"] & F.exists("_g", lambda y: (y["part"] == x["part"]) & (y["c"]["family"] == x["c"]["family"]) & (~y["wide"] | (y["paragraph"] < x["paragraph"])))))
    return out.select("doc_id", F.transform(first, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["c"]["family"].alias("family"), x["c"]["confidence"].alias("confidence"), x["c"]["agreement"].alias("agreement"))).alias("found"))


def _wrapped(x: Column, model: Model) -> Column:
    """A line that gives no family, classified with its neighbours; ``wide`` says that they give one."""
    at = x["paragraph"]
    lo = F.coalesce(F.array_max(F.filter("_e", lambda e: e < at)), F.lit(-1)) + 1
    hi = F.coalesce(F.array_min(F.filter("_e", lambda e: e > at)), F.size("_l")) - 1

    def windows(s):
        ends = F.array_distinct(F.transform(F.array(*map(F.lit, AROUND)), lambda r: F.struct(F.greatest(s["lo"], at - r).alias("a"), F.least(s["hi"], at + r).alias("b"))))
        words = F.transform(F.filter(ends, lambda w: w["a"] < w["b"]), lambda w: F.flatten(F.slice("_l", w["a"] + 1, w["b"] - w["a"] + 1)["words"]))
        found = F.filter(F.transform(words, lambda w: classified(w, model)), lambda c: ~c["family"].isin(UNKNOWN, NONE))
        best = F.array_max(F.transform(found, lambda c: F.struct(c["agreement"].alias("agreement"), c["confidence"].alias("confidence"), c["family"].alias("family"))))
        return F.struct(best.alias("best"))

    def chosen(s):
        b = s["best"]
        return F.struct(at.alias("paragraph"), b.isNotNull().alias("wide"),
                        F.when(b.isNull(), x["c"]).otherwise(F.struct(b["family"].alias("family"), b["confidence"].alias("confidence"), b["agreement"].alias("agreement"))).alias("c"))

    return F.get(F.transform(F.transform(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), windows), chosen), 0)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licenses`` (families in order, by comma), ``n_licensed``, ``n_unknown`` paragraphs and the greatest ``confidence``."""
    found = scan(docs, train(docs, id_col, text_col), id_col, text_col)
    known = F.filter("found", lambda x: x["family"] != UNKNOWN)
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("licenses"), F.size(known).cast("long").alias("n_licensed"),
        (F.size("found") - F.size(known)).cast("long").alias("n_unknown"), F.coalesce(F.round(F.array_max(F.transform(known, lambda x: x["confidence"])), 6), F.lit(0.0)).alias("confidence"))
