"""Licence scans with a trained paragraph classifier, in DataFrame and MLlib operations only.

Paragraphs are the lines of a text, seen with their neighbours up to a blank line. Training rows: every run of
TRAIN_WORDS or more words of each template sentence (a family's notices, below), and as the unknown class the
lines of a bounded sample of the documents themselves that no template matches, near-misses (the templates' words
in another order) and foils that use the same words without being licences. Features: hashed word 1-, 2- and
3-grams; classifier: multinomial logistic regression. Calibration: unknown rows are dealt to a fit and a calibration
fold by hash (all others are fitted: a short template is one row), and a line counts as licence only if its family's probability is over the least one at which no more than
FALSE_RATE of the unknown calibration rows pass; those are rows of the kind that are scored, with a template's
word in them. Template comparison then confirms, with 3-word shingles (of all words, if fewer), if CONFIRM or more
of the line's are in the union of that family's templates (several sentences on a line), or of one template's in
the line (a notice among other words), or of one template's in the line and its neighbours up to a blank line (a
wrapped notice), if half of those that touch the line are in the union. A line that passes one test but not the
other is reported with family `unknown`; one whose words are those of two families goes to the likelier.

A text that has CONFIRM of a template's shingles has one of the template's telling words, which are worked out from
the templates; lines without any are unknown without being scored, and aren't listed.

The sample is SAMPLE_DOCS distinct whole texts, those with the least hashes.

Nulls and odd input: a null or empty text has no paragraphs; null ids are kept; equal rows give equal
rows; very long lines are one paragraph; an empty table gives none (and the classifier then has only the
foils and near-misses as unknown class); further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, running

# Usual wording of licence notices, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0).",
        "SPDX-License-Identifier: CC-BY-4.0",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# Lines with the same words that are no licences.
FOILS = [
    "She was licensed under state law to teach in two counties.", "The driver's license was released on Monday.", "Version 3 of the report is out.",
    "The general public may attend; no permission is needed.", "Copyright law was the topic of the evening.", "He asked permission to use the copy.",
    "The work is free of charge for members.", "A fishing license costs four pounds a year.", "The warranty covers parts and work for two years.",
    "All rights reserved.", "The foundation published its yearly report.", "This software has a new version every month.",
    "The author waived the fee for the reading.", "Terms and conditions apply to this offer.", "The council granted the restaurant a new license.",
    "Please read the notice on the door.", "Copies of the map were included in the box.", "The apache helicopter landed at noon.", "MIT released its admission figures.",
]
UNKNOWN = "unknown"
TRAIN_WORDS = 4
SAMPLE_DOCS = 400
FEATURES = 1 << 14
CONFIRM = 0.8
#: Sampled lines with more of their shingles in a family's templates may be licences, and are no examples of others.
ALIKE = 0.3
FALSE_RATE = 0.1
#: A template that touches a line reaches no further: a line holds a word at least; twice the characters leave room for markers.
REACH_LINES = max(len(t.split()) for ts in TEMPLATES.values() for t in ts)
REACH_CHARS = 2 * max(len(t) for ts in TEMPLATES.values() for t in ts)
#: What is no part of a word. Java matches a repeated group by recursion, so words are cut out and not matched.
_BETWEEN = r"(?<![\p{L}\p{N}])[.-]|[.-](?![\p{L}\p{N}])|[^\p{L}\p{N}.-]"


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def _telling() -> str:
    """Pattern of words of which every text holds one that has CONFIRM of some template's 3-word shingles.

    Of each template the longest words are taken until more than 1 - CONFIRM of its shingles hold one of them.
    """
    found = set()
    for own in (_words_of(t) for ts in TEMPLATES.values() for t in ts):
        n, held = max(1, len(own) - 2), set()
        for i in sorted(range(len(own)), key=lambda i: (-len(own[i]), i)):
            if len(held) > (1 - CONFIRM) * n + 1e-9:
                break
            new = {s for s in range(max(0, i - 2), min(i, n - 1) + 1)} - held
            if new:
                held |= new
                found.add(own[i])
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in sorted(found)) + r")(?![\p{L}\p{N}])"


TELLING = _telling()


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and inner dots and hyphens."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _BETWEEN, " "), " "), lambda x: x != "")


def shingles(words: Column, n: int) -> Column:
    """Runs of n words, joined."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _featured(df: DataFrame) -> DataFrame:
    """Adds the hashed 1-, 2- and 3-grams of column `words` as `features`."""
    terms = F.concat(F.col("words"), shingles(F.col("words"), 2), shingles(F.col("words"), 3))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features").transform(df.withColumn("terms", terms)).drop("terms")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, i, t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", tokens(F.col("text")))


def _sampled(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """(text): n distinct whole texts, those with the least hashes. A threshold on the hash leaves about twice as many to be ordered."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    total = texts.select("h").agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, (2.0 * n + 200) / max(1, total))
    low = texts.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return low.dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(n).select("text")


def training_rows(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(words, family, telling, fold): runs of template words, and as unknown foils, near-misses and lines of a bounded sample of documents."""
    spark = docs.sparkSession
    whole = _templates(spark)
    n = F.size("words")
    cuts = whole.withColumn("a", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n - TRAIN_WORDS + 1)))).withColumn("b", F.explode(F.sequence(F.least(n, F.col("a") + TRAIN_WORDS - 1), n)))
    positive = cuts.where(((F.col("a") == 1) | (F.col("b") == n)) | (F.pmod(F.xxhash64("text", "a", "b"), F.lit(8)) == 0))
    positive = positive.select(F.slice("words", F.col("a"), F.col("b") - F.col("a") + 1).alias("words"), "family")
    foils = spark.createDataFrame([(t,) for t in FOILS], "text string").select(tokens(F.col("text")).alias("words"))
    turn = F.explode(F.sequence(F.lit(1), F.lit(12)))
    order = F.transform(F.array_sort(F.transform("words", lambda w, i: F.struct(F.xxhash64(w, i, F.col("turn")).alias("h"), w.alias("w")))), lambda x: x["w"])
    # Words of a short template in another order may be the template.
    missed = whole.where(n >= TRAIN_WORDS).withColumn("turn", turn).select(order.alias("words"))
    lines = _sampled(docs, text_col, sample_docs).select(F.explode(F.split("text", "\n")).alias("line")).select(tokens(F.col("line")).alias("words")).where(F.size("words") > 0)
    known = F.array(*[F.lit(x) for x in sorted({x for ts in TEMPLATES.values() for t in ts for x in _shingles_of(t)})])
    own = F.array_distinct(F.when(F.size("words") >= 3, shingles(F.col("words"), 3)).otherwise(F.array(F.array_join("words", " "))))
    lines = lines.where(_share(own, known) < ALIKE).distinct()
    negative = foils.unionByName(missed).unionByName(lines).withColumn("family", F.lit(UNKNOWN))
    both = positive.unionByName(negative).withColumn("telling", F.array_join("words", " ").rlike(TELLING))
    return both.withColumn("fold", F.pmod(F.xxhash64("words", "family"), F.lit(4)))


def _shingles_of(text: str) -> list[str]:
    own = _words_of(text)
    return [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]


def train(docs: DataFrame, text_col: str = "text"):
    """(model, families in index order, least probability)."""
    families = [UNKNOWN, *sorted(TEMPLATES)]
    index = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    rows = materialise(training_rows(docs, text_col).select("words", "fold", "telling", index[F.col("family")].alias("label")))
    rows = _featured(rows).coalesce(2).cache()
    fit = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial").fit(rows.where("fold <> 0 OR label <> 0"))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(families) - 1))
    held = fit.transform(rows.where("fold = 0 AND label = 0 AND telling")).agg(F.percentile(best, F.lit(1 - FALSE_RATE)).alias("p")).first()["p"]
    rows.unpersist()
    return fit, families, max(0.5, held or 0.0)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, start, end, line, before, after): lines with a template's word, numbered from 0, with code-point positions.

    before and after are the text around the line up to a blank line, as far as a template can reach.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.lower("text").rlike(TELLING)).select("id", F.split("text", "\n").alias("lines"))
    source = source.withColumn("starts", running(F.transform("lines", lambda x: F.length(x) + 1), lambda a, b: a + b))
    near = lambda lines: F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(x)), "\n")
    before = lambda n: F.substring_index(F.right(near(F.slice("lines", F.greatest(F.lit(1), n + 1 - REACH_LINES), F.least(n, F.lit(REACH_LINES)))), F.lit(REACH_CHARS)), "\n\n", -1)
    after = lambda n: F.substring_index(F.left(near(F.slice("lines", n + 2, REACH_LINES)), F.lit(REACH_CHARS)), "\n\n", 1)
    telling = F.filter(F.transform("lines", lambda x, i: F.when(F.lower(x).rlike(TELLING), i)), lambda i: i.isNotNull())
    found = source.select("id", "lines", "starts", F.explode(telling).alias("paragraph"))
    line, start = F.element_at("lines", F.col("paragraph") + 1), F.element_at("starts", F.col("paragraph") + 1)
    n = F.col("paragraph")
    return found.select("id", "paragraph", start.alias("start"), (start + F.length(line)).alias("end"), line.alias("line"), before(n).alias("before"), after(n).alias("after"))


def _share(part: Column, whole: Column) -> Column:
    """Share of `part` that is in `whole`."""
    return F.size(F.array_intersect(part, whole)) / F.greatest(F.lit(1), F.size(part))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained: tuple | None = None) -> DataFrame:
    """(id, paragraph, start, end, family, probability, similarity) of every line with a telling word of a template.

    trained: what `train` gave, for other documents; without it the classifier is trained on these.
    family is `unknown` unless the classifier and a template agree; similarity is the greatest of the
    three containments above in the predicted family.
    """
    model, families, least = trained or train(docs, text_col)
    placed = paragraphs(docs, id_col, text_col).withColumns({"words": tokens(F.col("line")), "before": tokens(F.col("before")), "after": tokens(F.col("after"))})
    scored = model.transform(_featured(placed)).withColumn("p", vector_to_array("probability"))
    best = F.array_max(F.slice("p", 2, len(families) - 1))
    scored = scored.withColumn("probability", best).withColumn("guess", F.element_at(F.array(*[F.lit(f) for f in families[1:]]), F.array_position(F.slice("p", 2, len(families) - 1), best).cast("int")))
    mine = F.when(F.size("words") >= 3, shingles(F.col("words"), 3)).otherwise(F.array(F.array_join("words", " ")))
    known = _templates(docs.sparkSession).withColumn("s", F.array_distinct(shingles(F.col("words"), 3))).withColumn("all", F.array_join("words", " "))
    known = known.groupBy("family").agg(F.collect_list("s").alias("known"), F.collect_list("all").alias("alls")).select(F.col("family").alias("guess"), "known", F.array_distinct(F.concat(F.flatten("known"), "alls")).alias("union"))
    # One row a family, from the fixed templates.
    both = scored.withColumn("mine", F.array_distinct(mine)).join(F.broadcast(known), "guess")
    last = F.slice("before", F.greatest(F.lit(1), F.size("before") - 1), F.lit(2))
    both = both.withColumn("touching", F.array_distinct(shingles(F.concat(last, "words", F.slice("after", 1, 2)), 3)))
    both = both.withColumn("around", F.array_distinct(shingles(F.concat("before", "words", "after"), 3)))
    inside = F.array_max(F.transform("known", lambda t: _share(t, F.col("mine"))))
    wrapped = F.when(_share(F.col("touching"), F.col("union")) >= 0.5, F.array_max(F.transform("known", lambda t: F.when(F.arrays_overlap(t, "touching"), _share(t, F.col("around")))))).otherwise(0.0)
    both = both.withColumn("similarity", F.greatest(_share(F.col("mine"), F.col("union")), inside, F.coalesce(wrapped, F.lit(0.0))))
    sure = (F.col("probability") >= least) & (F.col("similarity") >= CONFIRM) & (F.size("words") > 0)
    return both.select("id", "paragraph", "start", "end", F.when(sure, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"), F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
