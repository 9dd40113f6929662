"""License scans: a trained paragraph classifier, all in DataFrame operations.

A paragraph is a line. Its words (ASCII letters and digits, lower-cased) and word pairs are hashed to BUCKETS features, and
multinomial logistic regression over them tells the families, notices of other licenses (UNKNOWN) and what is no notice
(NONE). It is trained on notices that PATTERNS make of the names of each family, on EXCERPTS of their texts whole and in
windows as wrapped lines have them, on notices of invented licenses and on ORDINARY sentences, and, as what is no notice, on
up to NEGATIVES lines of the corpus itself (of the texts of the least hashes) that are unlike every notice.

Scoring is a cascade of two regressions trained on the same rows. The first has the word pairs of all lines and tells any
notice from none: the run of words whose pairs add most to the log-odds (the first, if several do) is the line's passage, so
a notice inside a long line is found as well as alone. Passages of log-odds over GATE go to the second one.

Two more fits on half of the families each are shown the other half, whole families that they never saw: the probability
that all but 1 - CALIBRATE of these stay under is the least that names a family. Template comparison confirms: some notice
of the family must have CONFIRM of its features in the passage. Where either is missing the family is unknown.

Null and empty texts have no paragraphs, no rows give no rows, equal rows give equal rows; of equally probable families the
first by name is taken, and of templates the one with the higher share. A text of any length is split by the JVM; a line is
held whole. Columns of docs besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

# Families, their SPDX identifiers and the names that notices give them.
FAMILIES = {
    "agpl-3.0": ("AGPL-3.0-or-later", "GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPL-3.0"),
    "apache-2.0": ("Apache-2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0"),
    "artistic-2.0": ("Artistic-2.0", "Artistic License 2.0", "Perl Artistic License 2.0"),
    "bsd-2-clause": ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "bsd-3-clause": ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "bsl-1.0": ("BSL-1.0", "Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "cc-by-4.0": ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "cc-by-nc-4.0": ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "cc-by-nc-nd-4.0": ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
    "cc-by-nc-sa-4.0": ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "cc-by-nd-4.0": ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "cc0-1.0": ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal", "CC0"),
    "cddl-1.0": ("CDDL-1.0", "Common Development and Distribution License, Version 1.0", "CDDL 1.0"),
    "epl-2.0": ("EPL-2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"),
    "eupl-1.2": ("EUPL-1.2", "European Union Public Licence, Version 1.2", "EUPL v1.2"),
    "gpl-2.0": ("GPL-2.0-or-later", "GNU General Public License, version 2", "GNU GPLv2", "GPL-2.0"),
    "gpl-3.0": ("GPL-3.0-or-later", "GNU General Public License, version 3", "GNU GPLv3", "GPL-3.0"),
    "isc": ("ISC", "ISC License", "Internet Systems Consortium License"),
    "lgpl-2.1": ("LGPL-2.1-or-later", "GNU Lesser General Public License, version 2.1", "GNU LGPLv2.1", "LGPL-2.1"),
    "lgpl-3.0": ("LGPL-3.0-or-later", "GNU Lesser General Public License, version 3", "GNU LGPLv3", "LGPL-3.0"),
    "mit": ("MIT", "MIT License", "MIT license (Expat)"),
    "mpl-2.0": ("MPL-2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "ms-pl": ("MS-PL", "Microsoft Public License", "Ms-PL"),
    "odbl-1.0": ("ODbL-1.0", "Open Database License v1.0", "Open Data Commons Open Database License"),
    "ofl-1.1": ("OFL-1.1", "SIL Open Font License, Version 1.1", "SIL Open Font License"),
    "postgresql": ("PostgreSQL", "PostgreSQL License", "PostgreSQL Licence"),
    "proprietary": ("LicenseRef-Proprietary", "proprietary license", "commercial end user license agreement"),
    "psf-2.0": ("PSF-2.0", "Python Software Foundation License Version 2", "PSF License"),
    "unlicense": ("Unlicense", "Unlicense", "The Unlicense"),
    "wtfpl": ("WTFPL", "Do What The F*ck You Want To Public License", "WTFPL"),
    "zlib": ("Zlib", "zlib License", "zlib/libpng License"),
}
# How notices name a license; {} is its name.
PATTERNS = (
    "{}", "Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}; see the LICENSE file for details.", "This work is licensed under a {}.",
    "This software is distributed under the terms of the {}.", "The code is available under {}", "License: {}", "You may use this file under the terms of the {} only.", "Published under {} by the authors",
)
# What the texts of licenses say.
EXCERPTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met under the BSD 2-Clause license"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain worldwide."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. You just do what you want to."),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. The fonts and derivatives cannot be released under any other type of license."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright (c) 2011 Example Corporation. All rights reserved."),
    ("proprietary", "All rights reserved by the publisher. No part of this work may be reproduced without permission."),
    ("proprietary", "Copyright the company. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    ("proprietary", "This software is the confidential and proprietary information of the company and may not be disclosed or reproduced without prior written consent."),
    ("unknown", "The software is provided AS IS, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("unknown", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software."),
    ("unknown", "This work has been dedicated to the public domain by its author."),
    ("unknown", "Copyright (c) 2020 the contributors"),
    ("unknown", "Copyright (C) 1999-2014 Example Incorporated and others"),
    ("unknown", "Permission to reprint this article is granted for noncommercial use with attribution to the author."),
    ("unknown", "Redistribution and use in source and binary forms are permitted with or without modification under the terms of this license."),
)
# Sentences that use the words of notices and are none.
ORDINARY = (
    "He lost his driving license after the accident last year.", "The rights of men and the gnu on the plain were discussed.", "She asked for permission to leave the room early.", "Apache helicopters flew over the town.",
    "The public library has a copy of the book.", "This work was hard, and the terms were not fair.", "The source of the river is in the mountains.", "He is free to go wherever he wants to.", "They distribute food under the bridge.",
    "The mit students built a robot.", "A version of the story was published in 1984.", "You may use this room for the meeting.", "The software was slow and the files were large.", "We reserved a table for four at the restaurant.",
    "The commons is a piece of land that all may use.", "All rights and wrongs aside, the plan worked.", "The general public was not amused.", "Creative people often work at night.", "No copyright law existed at that time.", "The eclipse was visible from the coast.",
    "Python is a snake that lives in warm countries.", "The boost to the economy was small.", "The artist sold three paintings under a false name.", "Available under the table at the back of the shop.", "Mozilla and Apache are names that many know.",
)
#: Parts of the names of invented licenses.
_INVENTED = (("Acme", "Nova", "Orion", "Harbor", "Zephyr", "Quartz", "Lumen", "Delta"), ("Public License", "Community License", "Source License", "Open License", "Shared Terms"), ("", " 1.0", " version 4", " v7"))
NONE, UNKNOWN = "none", "unknown"
BUCKETS, NEGATIVES, NEGATIVE_TEXTS = 16384, 1500, 300
CALIBRATE, LEAST, CONFIRM = 0.9, 0.4, 0.85
ITERATIONS, RIDGE, WEIGHT_NONE = 60, 5e-5, 30.0
#: Ridge of the first stage, and the log-odds from which a passage goes to the second.
GATE_RIDGE, GATE = 1e-3, -1.0
SEED = 11


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _next(w: Column) -> Column:
    return F.concat(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), F.array(F.lit("")))


def features(w: Column) -> Column:
    """Buckets of the words and of the word pairs, as words of the vocabulary 0 to BUCKETS - 1."""
    one = F.transform(w, lambda x: F.pmod(F.hash(x), F.lit(BUCKETS)))
    two = F.zip_with(w, _next(w), lambda x, y: F.pmod(F.hash(x, y), F.lit(BUCKETS)))
    return F.array_distinct(F.concat(one, two)).cast("array<string>")


def notices() -> list[tuple[str, str]]:
    """(family or UNKNOWN or NONE, text): all that training starts from, by rule from the values above."""
    r, out = random.Random(SEED), []
    for family, (spdx, *names) in FAMILIES.items():
        out += [(family, f"SPDX-License-Identifier: {x}") for x in {spdx, spdx.removesuffix("-or-later"), spdx.replace("-or-later", "-only")}]
        out += [(family, p.format(n)) for n in names for p in PATTERNS]
    for family, text in EXCERPTS:
        w = text.split()
        out.append((family, text))
        out += [(family, " ".join(w[i : i + 14])) for i in range(0, max(0, len(w) - 10), 7) if len(w) > 20]
    invented = [f"{a} {b}{c}" for a in _INVENTED[0] for b in _INVENTED[1] for c in _INVENTED[2]]
    out += [(UNKNOWN, r.choice(PATTERNS).format(n)) for n in invented]
    out += [(UNKNOWN, f"Copyright {c} {y} {n}") for c in ("(c)", "(C)", "") for y in (1998, 2012, "2015-2021", 2023) for n in ("Foo", "Jane Doe", "The Project Authors", "Example Ltd.")]
    return out + [(NONE, x) for x in ORDINARY]


def _varied(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """rows, and each with a word left out, with a line of copyright before it and between other words."""
    r, out = random.Random(SEED + 1), []
    for family, text in rows:
        out.append((family, text))
        w = text.split()
        if len(w) > 5:
            k = r.randrange(len(w))
            out.append((family, " ".join(w[:k] + w[k + 1 :])))
        if family != NONE:
            out.append((family, f"and the {text} it was"))
            if r.random() < 0.3:
                out.append((family, f"Copyright (c) {r.randint(1990, 2024)} Some Name. {text}"))
    return out


def _grams(text: str) -> set[tuple[str, ...]]:
    w = [x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]
    return set(zip(w, w[1:])) or {(x,) for x in w}


def _sampled(docs: DataFrame, text_col: str, negatives: int) -> list[str]:
    """Up to `negatives` lines of the NEGATIVE_TEXTS texts of the least hashes; lines that are like a notice are left out."""
    t = docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    last = t.select("h").orderBy("h").limit(NEGATIVE_TEXTS).agg(F.max("h")).first()[0]  # of hashes alone, so no texts meet in a task
    lines = t.where(F.col("h") <= F.lit(last)).select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 20 and 2000")
    lines = [r["line"] for r in lines.distinct().orderBy(F.xxhash64("line"), "line").limit(negatives).collect()]
    own = [g for f, x in notices() if f != NONE and len(g := _grams(x)) > 1]
    seen = {g for x in own for g in x}
    return [x for x in lines if not (g := _grams(x) & seen) or max(len(g & y) / len(y) for y in own) < 0.5]


def _fit(train: DataFrame, **how):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    def vectors(tokens: DataFrame) -> DataFrame:
        return CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], inputCol="tokens", outputCol="features").setBinary(True).transform(tokens)

    # a bounded sample of a few thousand rows: one partition
    ready = vectors(train).select("label", "weight", "features").coalesce(1).cache()
    fitted = LogisticRegression(maxIter=ITERATIONS, standardization=False, weightCol="weight", **how).fit(ready)
    ready.unpersist()
    return fitted, vectors


def _weighted(spark: SparkSession, rows: list[tuple[str, str]], number: dict[str, float], tokens) -> DataFrame:
    """Every class counts alike, and what is no notice more."""
    n = Counter(f for f, _ in rows)
    weight = {f: 100 * (WEIGHT_NONE if f == NONE else 1.0) / n[f] for f in n}
    return spark.createDataFrame([(number[f], weight[f], x) for f, x in rows], "label double, weight double, text string").select("label", "weight", tokens(words(F.col("text"))).alias("tokens"))


def _pairs(w: Column) -> Column:
    """Buckets of word pairs, the last word's with nothing."""
    return F.array_distinct(F.zip_with(w, _next(w), lambda x, y: F.pmod(F.hash(x, y), F.lit(BUCKETS)))).cast("array<string>")


class Gate:
    """The first stage: whether a passage is any notice, by its word pairs alone."""

    def __init__(self, spark: SparkSession, rows: list[tuple[str, str]]):
        number = {f: float(f != NONE) for f, _ in rows}
        fitted, _ = _fit(_weighted(spark, rows, number, _pairs), family="binomial", regParam=GATE_RIDGE)
        self.gains, self.start = [round(float(x), 3) for x in fitted.coefficients.toArray()], float(fitted.intercept)

    def passages(self, lines: DataFrame) -> DataFrame:
        """lines (w: words) whose run of greatest log-odds can be a notice; w becomes that run with a word on either side."""
        gains = _gains(F.col("w"), self.gains)
        found = lines.where(_reaches(gains, max(1e-9, GATE - self.start))).withColumn("run", _run(gains)).where("run.hi > run.lo")
        return found.withColumn("w", F.expr("slice(w, greatest(run.lo, 1), run.hi - run.lo + 3)")).drop("run")


class Model:
    """The second stage: a multinomial regression; classes: NONE, UNKNOWN, then families."""

    def __init__(self, spark: SparkSession, rows: list[tuple[str, str]]):
        self.classes = [NONE, UNKNOWN, *sorted({f for f, _ in rows} - {NONE, UNKNOWN})]
        number = {f: float(i) for i, f in enumerate(self.classes)}
        self.fitted, self.vectors = _fit(_weighted(spark, rows, number, features), family="multinomial", regParam=RIDGE)

    def scored(self, tokens: DataFrame) -> DataFrame:
        """tokens with p_none, family (the most probable of the classes that are notices) and probability."""
        from pyspark.ml.functions import vector_to_array

        out = self.fitted.transform(self.vectors(tokens)).withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")
        out = out.withColumns({"p_none": F.col("p")[0], "probability": F.array_max(F.slice("p", 2, len(self.classes)))})
        at = F.array_position(F.slice("p", 2, len(self.classes)), F.col("probability")).cast("int")
        return out.withColumn("family", F.element_at(F.array(*map(F.lit, self.classes[1:])), at)).drop("p")


def _gains(w: Column, gains: list[float]) -> Column:
    """By word, what its pair with the next adds to the log-odds."""
    # one literal: the optimizer folds it
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<double>")
    return F.zip_with(w, _next(w), lambda x, y: F.element_at(table, F.pmod(F.hash(x, y), F.lit(BUCKETS)) + 1))


def _reaches(gains: Column, least: float) -> Column:
    """Whether some run of gains has a sum of `least` (over 0) or more; a sum that has stays."""
    top = F.lit(least)
    return F.aggregate(gains, F.lit(0.0), lambda s, x: F.when(s >= top, s).otherwise(F.greatest(s + x, F.lit(0.0)))) >= top


def _run(gains: Column) -> Column:
    """The run of gains of the greatest sum, the first of several, as words [lo, hi)."""
    zero = F.lit(0)
    start = F.struct(zero.alias("i"), F.lit(0.0).alias("now"), zero.alias("since"), F.lit(0.0).alias("best"), zero.alias("lo"), zero.alias("hi"))

    def step(s: Column, x: Column) -> Column:
        now = F.greatest(s["now"] + x, F.lit(0.0))
        since, i = F.when(s["now"] > 0, s["since"]).otherwise(s["i"]), s["i"] + 1
        better = now > s["best"]
        return F.struct(i.alias("i"), now.alias("now"), since.alias("since"), F.when(better, now).otherwise(s["best"]).alias("best"), F.when(better, since).otherwise(s["lo"]).alias("lo"), F.when(better, i).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(gains, start, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))


def training(docs: DataFrame, text_col: str = "text", negatives: int = NEGATIVES) -> list[tuple[str, str]]:
    return _varied(notices()) + [(NONE, x) for x in _sampled(docs, text_col, negatives)]


def judged(passages: DataFrame, model: Model, least: float) -> DataFrame:
    """passages (w) that are a notice, with family, probability, share and confirmed."""
    return named(model.scored(passages.withColumn("tokens", features(F.col("w")))).where("p_none < 0.5"), least)


def calibrated(spark: SparkSession, rows: list[tuple[str, str]]) -> float:
    """The probability that CALIBRATE of the notices of families a model was never shown stay under; LEAST at least."""
    names, wrong = sorted({f for f, _ in rows} - {NONE, UNKNOWN}), []
    for k in range(2):
        held = set(names[k::2])
        model = Model(spark, [x for x in rows if x[0] not in held])
        asked = [(x,) for f, x in notices() if f in held]
        got = judged(spark.createDataFrame(asked, "text string").select(words(F.col("text")).alias("w")), model, 0.0).where(F.col("family") != UNKNOWN)
        got = [r["probability"] for r in got.select("probability").collect()]
        wrong += got + [0.0] * (len(asked) - len(got))
    return max(LEAST, float(np.quantile(wrong, CALIBRATE))) if wrong else LEAST


def named(scored: DataFrame, least: float) -> DataFrame:
    """scored (with words w) with family, share and confirmed: what is not sure or not confirmed by a template is UNKNOWN."""
    spark = scored.sparkSession
    by: dict[str, list[str]] = {}
    for f, x in notices():
        if f not in (NONE, UNKNOWN):
            by.setdefault(f, []).append(x)
    templates = spark.createDataFrame(list(by.items()), "family string, texts array<string>")
    templates = templates.select("family", F.transform("texts", lambda x: features(words(x))).alias("templates"))  # a row a family
    own = features(F.col("w"))
    both = scored.join(F.broadcast(templates), "family", "left")
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(own, t)) / F.size(t)))
    both = both.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("confirmed", F.col("share") >= CONFIRM).drop("templates")
    sure = (F.col("probability") >= least) & F.col("confirmed")
    return both.withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES) -> DataFrame:
    """(doc_id, paragraph from 0, family, probability, share, confirmed) of each paragraph that is a notice of a known or unknown license."""
    spark = docs.sparkSession
    rows = training(docs, text_col, negatives)
    gate, model, least = Gate(spark, rows), Model(spark, rows), calibrated(spark, rows)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "line"))
    lines = lines.where("line <> ''").select("doc_id", "paragraph", words(F.col("line")).alias("w"))
    out = judged(stored(gate.passages(lines), "passages"), model, least)
    return out.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("share", 6).alias("share"), "confirmed")


def evaluate(spark: SparkSession, every: int = 5) -> dict[str, float]:
    """Held-out figures: each `every`-th notice of a family is kept from training; and the half of the families that is, as unknown."""
    base = notices()
    held = [x for i, x in enumerate(base) if i % every == 2 and x[0] not in (NONE, UNKNOWN)]
    kept = [x for x in base if x not in held]
    rows = _varied(kept)
    gate, model, least = Gate(spark, rows), Model(spark, rows), calibrated(spark, rows)

    def ask(texts, gate, model):
        t = spark.createDataFrame(texts, "want string, text string").select("want", words(F.col("text")).alias("w"))
        return judged(gate.passages(t), model, least).select("want", "family").collect()

    got = ask(held, gate, model)
    sure = [r for r in got if r["family"] != UNKNOWN]
    right = sum(r["want"] == r["family"] for r in sure)
    other = {f for i, f in enumerate(sorted(FAMILIES)) if i % 2}
    strange, rows = [x for x in base if x[0] in other], [x for x in rows if x[0] not in other]
    wrong = [r for r in ask(strange, Gate(spark, rows), Model(spark, rows)) if r["family"] != UNKNOWN]
    return {"precision": right / max(1, len(sure)), "recall": right / len(held), "found": len(got) / len(held), "least": least, "unknown": 1 - len(wrong) / len(strange)}
