"""Licence statements in documents, by a trained paragraph classifier.

Lines, and blocks of lines between blank ones joined, are reduced to words and classified
by a sparse logistic regression on word n-grams, trained on the labelled table below; one
of its classes is "unknown".  Its probabilities are calibrated by a temperature chosen on
held-out rows.  A family is confirmed when the paragraph shares enough n-grams with one of
the family's statements.  Only what shares no word with any statement, function words
aside, is left out.  Equal paragraphs are judged once.
Everything is DataFrame expressions and Spark's own regression.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens.llm.common import sized, written

UNKNOWN = "unknown"
FEATURES = 1 << 13
SHARE = 0.6  # of the n-grams of a statement, or of the paragraph, that both have
LEAST = 3  # n-grams that both have
CONTAINED = 0.8  # of the n-grams of a statement, in a block of lines that is judged otherwise as a whole

#: Parts of words; what holds one is judged whether or not it shares a word with a statement.  Fixed values.
ANCHORS = ["licen", "copyright", "permission", "redistribut", "public domain", "creative commons", "spdx", "rights reserved", "reproduced",
           "warranty", "vorbehalten", "droits", "derechos"]

#: The labelled table; wordings of licence notices are fixed values.
STATEMENTS: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "MIT License",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License. See LICENSE for more information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The software is provided as is, without warranty of any kind, express or implied",
        "Provided as is, without warranty of any kind.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License.",
        "Released under the GPL, version 2 or later. See the license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0. Attribution license.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Published under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Published under the Creative Commons Attribution-NonCommercial License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work has been released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
    UNKNOWN: [
        "You need a license to drive a car in this country.",
        "Her fishing licence was taken away by the court last year.",
        "The company licensed its brand to a partner for ten years.",
        "He asked for permission to leave the room early.",
        "Copyright law has changed a lot over the last hundred years.",
        "The software license was too expensive for the school.",
        "They argued about the license fee for public radio.",
        "The redistribution of land followed the war.",
        "The results could not be reproduced by another team.",
        "Permission to build was given by the town.",
        "The pub lost its licence after the fight.",
        "A licensed doctor must sign this form before you travel.",
        "The minister spoke about copyright and the public.",
        "An old castle was in the public domain and free to visit.",
        "Please read the license agreement before you install anything.",
        "The creative commons room is open on Mondays.",
        "Students asked the library for permission to copy pages.",
        "The plate on the license was hard to read in the rain.",
        "He said that the terms of the license were not clear.",
        "Software can be bought with or without a license.",
    ],
}

#: Words that are no sign of a statement by themselves.
FUNCTION_WORDS = set(
    "a all alle an and any are as at be by can been do for from have has here if in including is it its later los may more must no not of on only "
    "or other out should shall so some that the their they this to under was were which who with you your".split()
)


def telling_words() -> list[str]:
    """The words of the families' statements but function words, single letters and numbers."""
    words = {w for f, ts in STATEMENTS.items() if f != UNKNOWN for t in ts for w in re.split(r"[\W_]+", t.lower())}
    return sorted(w for w in words - FUNCTION_WORDS if len(w) > 1 and not w.isdigit())


def words_of(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def ngrams_of(words: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct n-grams of these sizes, words joined by spaces."""
    count = F.size(words)

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), count - (n - 1))
        return F.when(count >= n, F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + (j - 1)) for j in range(n))))).otherwise(
            F.array().cast("array<string>")
        )

    grams = [grams_of(n) for n in sizes]
    return F.array_distinct(F.concat(*grams))


def labelled_rows(spark: SparkSession) -> DataFrame:
    """(id, family, label, grams) of the labelled table."""
    families = list(STATEMENTS)
    rows = [(i, f, float(families.index(f)), t) for i, (f, t) in enumerate((f, t) for f, ts in STATEMENTS.items() for t in ts)]
    table = spark.createDataFrame(rows, "id int, family string, label double, text string")
    return table.select("id", "family", "label", ngrams_of(words_of(F.col("text"))).alias("grams"))


def _probabilities(model: LogisticRegressionModel, rows: DataFrame, temperature: float) -> DataFrame:
    """``rows`` (with grams) and ``p``, one calibrated probability per family."""
    scored = model.transform(HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows))
    odds = scored.select(*rows.columns, vector_to_array("rawPrediction").alias("_z"))
    top = odds.withColumn("_e", F.transform("_z", lambda z: F.exp((z - F.array_max("_z")) / temperature)))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return top.withColumn("p", F.transform("_e", lambda e: e / total)).drop("_z", "_e")


def train(spark: SparkSession) -> tuple[LogisticRegressionModel, float]:
    """The regression and its temperature, which minimises the loss on held-out rows of the labelled table."""
    rows = written(labelled_rows(spark), "statements").coalesce(1)
    features = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows)
    regression = LogisticRegression(family="multinomial", regParam=0.0003, standardization=False, maxIter=60, featuresCol="features", labelCol="label")
    held = F.col("id") % 3 == 2
    partly = regression.fit(features.where(~held))
    # families of which the training part holds nothing cannot be judged on the held-out part
    known = features.where(~held).select("family").distinct()
    tested = rows.where(held).join(F.broadcast(known), "family", "left_semi")
    losses = [
        (F.avg(-F.log(F.greatest(F.lit(1e-12), F.col(f"p{i}")))).alias(f"l{i}"), t) for i, t in enumerate((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0))
    ]
    wide = reduce(
        lambda df, it: _probabilities(partly, df, it[1][1]).withColumn(f"p{it[0]}", F.col("p")[F.col("label").cast("int")]).drop("p"),
        enumerate(losses),
        tested,
    )
    found = wide.agg(*[loss for loss, _ in losses]).first()
    best = min(range(len(losses)), key=lambda i: math.inf if found[i] is None else found[i])
    return regression.fit(features), losses[best][1]


def _lines_and_blocks(docs: DataFrame) -> DataFrame:
    """(_row, _key, start, line, whole, _line) of docs (_key, _text): each line, and each block of several lines as a whole.

    ``start`` is the first line of the block, which blank lines or the text's ends bound.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "_key", F.split("_text", "\n").alias("_lines"))
    rows = rows.withColumn("_filled", F.transform("_lines", lambda x: x.rlike("[\\p{L}\\p{N}\\p{P}\\p{S}]")))
    places = F.sequence(F.lit(1), F.size("_filled"))
    filled = lambda i: F.coalesce(F.get("_filled", i - 1), F.lit(False))
    rows = rows.select(
        "_row",
        "_key",
        "_lines",
        F.filter(places, lambda i: filled(i) & ~filled(i - 1)).alias("_first"),
        F.filter(places, lambda i: filled(i) & ~filled(i + 1)).alias("_last"),
    )
    line_of = lambda b: F.transform(F.sequence(b["_first"], b["_last"]), lambda i: F.get("_lines", i - 1))
    bounds = F.transform(F.arrays_zip("_first", "_last"), lambda b: F.struct((b["_first"] - 1).alias("start"), line_of(b).alias("_block")))
    blocks = rows.select("_row", "_key", F.inline(bounds))

    def unit(line: Column, whole: bool, text: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), F.lit(whole).alias("whole"), text.alias("_line"))

    single = F.transform("_block", lambda x, i: unit(F.col("start") + i, False, x))
    joined = F.array(unit(F.col("start"), True, F.array_join("_block", " ")))
    return blocks.select("_row", "_key", "start", F.inline(F.when(F.size("_block") > 1, F.concat(single, joined)).otherwise(single)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, family, chance, overlap, confirmed) for every line of every text that shares a telling word with a statement.

    ``family`` is the most probable class, ``unknown`` among them; ``chance`` its calibrated
    probability; ``overlap`` is the largest share of common n-grams with a statement of
    the family; ``confirmed`` says whether that is enough to count.  Lines are numbered from
    0.  A statement over several lines has a row at the first line of its block (lines
    between blank ones) if no line of the block is confirmed for its family alone; in a
    longer block its family is that of the statement which the block holds.  Null and
    empty texts have no lines and give no row; a null key stays null; repeated rows are
    all scanned; an empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    model, temperature = train(spark)
    families = list(STATEMENTS)
    telling = F.lit(telling_words())

    def judged_at_all(column: str, words: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(column).contains(a) for a in ANCHORS]) | F.arrays_overlap(words, telling)

    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    source = source.where(judged_at_all("_text", F.split(F.lower("_text"), "[^\\p{L}\\p{N}]+")))
    lines = _lines_and_blocks(source).withColumn("_words", words_of(F.col("_line"))).where(judged_at_all("_line", F.col("_words")))
    lines = lines.withColumn("words", F.concat_ws(" ", "_words")).drop("_words", "_line")
    # half a digest: what is grouped and joined by it stays narrow
    lines = lines.withColumn("_hash", F.substring(F.unhex(F.sha2("words", 256)), 1, 16))
    lines = written(lines, "lines")
    paragraphs = lines.select("_hash", "words").distinct().select("_hash", F.split("words", " ").alias("_words"))
    paragraphs = paragraphs.select("_hash", ngrams_of(F.col("_words")).alias("grams"))
    judged = _probabilities(model, paragraphs, temperature)
    names = F.lit(families)
    place = F.array_position("p", F.array_max("p")).cast("int")
    # the statements are the labelled table's, a few hundred n-grams each; of the paragraphs' n-grams only theirs are kept
    statements = written(labelled_rows(spark).where(F.col("family") != UNKNOWN), "families")
    known = F.lit(sorted(r[0] for r in statements.select(F.explode("grams")).distinct().collect()))
    judged = judged.select("_hash", F.array_intersect("grams", known).alias("grams"), F.size("grams").alias("n"), (place - 1).alias("is"), "p")
    judged = written(judged, "judged")
    statements = statements.select("id", F.col("label").cast("int").alias("of"), F.size("grams").alias("own"), F.explode("grams").alias("gram"))
    shared = judged.select("_hash", "is", "n", F.explode("grams").alias("gram")).join(F.broadcast(statements), "gram")
    # families by number: rows of fixed width are counted in place
    overlaps = shared.groupBy("_hash", "id").agg(F.count(F.lit(1)).alias("common"), *(F.first(c).alias(c) for c in ("n", "own", "is", "of")))
    enough = F.col("common") >= LEAST
    full = F.when(enough & (F.col("of") == F.col("is")), F.col("common") / F.col("own"))
    ratio = F.when(enough & (F.col("of") == F.col("is")), F.col("common") / F.least("n", "own"))
    by_name = F.lit([sorted(families).index(f) for f in families])  # ties go to the last name
    held = F.when(enough, F.struct((F.col("common") / F.col("own")).alias("share"), "own", by_name[F.col("of")].alias("by_name"), "of"))
    overlaps = overlaps.groupBy("_hash").agg(F.max(ratio).alias("overlap"), F.max(full).alias("full"), F.max(held).alias("held"))
    verdicts = judged.join(overlaps, "_hash", "left").select(
        "_hash", names[F.col("is")].alias("family"), F.array_max("p").alias("chance"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
        F.coalesce("full", F.lit(0.0)).alias("full"), "held.share", F.get(names, F.col("held.of")).alias("of"), F.get("p", F.col("held.of")).alias("of_chance"),
    )
    verdicts = written(verdicts, "verdicts")
    out = lines.drop("words").join(sized(verdicts, 50_000), "_hash")
    confirmed = (F.col("family") != UNKNOWN) & (F.col("overlap") >= SHARE)
    instead = F.col("whole") & ~confirmed & (F.coalesce("share", F.lit(0.0)) >= CONTAINED)
    out = out.withColumns({
        "confirmed": confirmed | instead,
        "family": F.when(instead, F.col("of")).otherwise(F.col("family")),
        "chance": F.when(instead, F.col("of_chance")).otherwise(F.col("chance")),
        "overlap": F.when(instead, F.col("share")).otherwise(F.col("overlap")),
    })
    out = out.drop("_hash", "share", "of", "of_chance")
    alone = F.max(~F.col("whole") & F.col("confirmed")).over(W.partitionBy("_row", "start", "family"))
    out = out.withColumn("_alone", alone).where(~F.col("whole") | (F.col("confirmed") & ~F.col("_alone")))
    # pieces of a statement that stays as a block are no statements of other families
    piece = ~F.col("whole") & F.max("whole").over(W.partitionBy("_row", "start")) & (F.col("full") < SHARE)
    out = out.withColumn("_piece", piece).where(~F.col("_piece") | (F.col("line") > F.col("start")))
    out = out.withColumn("confirmed", F.col("confirmed") & ~F.col("_piece"))
    return out.select(F.col("_key").alias(key), "line", "family", "chance", "overlap", "confirmed")
