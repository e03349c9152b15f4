"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

A header is a stretch around a word that speaks of licences or rights: ``BEFORE`` words before it and ``AFTER`` behind it,
over line ends and without comment marks. Its terms are pairs of neighbouring words, weighted by their frequency in it (one, and the
logarithm of repeats) and their inverse document frequency. The documents of the latter are the notices of all licences, together with a background in
which pairs of function words are in every document and other pairs in none, so a weight is a fixed value and the same header is
judged alike in a small table and in a large one. A header is a sparse vector, as are the notices; it takes the licence of the
notice with the highest cosine, if that is ``LEAST`` or more; pairs that no notice has make a header longer, by the weight
``UNKNOWN`` each. A notice that only reserves rights yields to one of a licence in the same header.

A file's licence is that of its best header. A licence file is one named so, of which the whole text is compared, too, if it has such a word, or one
of which the words of one header that notices have, too, are half; it speaks for its directory. A file without a licence inherits from
the nearest directory above it that has one: the directories' ancestors are joined with the directories that licence files
speak for. Of several best notices or files the first by name counts.

Null and empty texts have no header and inherit. A null path has no directory and inherits nothing. Rows with one path are one
file with the texts of all of them and give a row each. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.storage import documents_only, written

#: Notices of licences as they are usually worded, long and short.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
        "Apache License Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Released under the MIT License",
        "MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved", "Copyright. All rights reserved. Unauthorized copying is prohibited"],
}
#: The licence of notices that only reserve rights.
RESERVED = "Proprietary"
#: Words that say nothing about a licence.
FUNCTION_WORDS = "a an and any as by for from in is it of on or that the this to under with you may use".split()
MARK = r"(?i)licen[sc]|copyright|rights reserved|creative commons|permission is hereby|redistribution and use"
MARKED = r"(?i)licen[sc]|copyright|^rights$|^creative$|^permission$|^redistribution$"
BEFORE, AFTER, LEAST, UNKNOWN = 12, 28, 0.4, 0.35
NAMED = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)[^/]*$"
_BREAK = r"[^a-z0-9.-]+|[.]+(?![0-9])|(?<![a-z0-9])-+|-+(?![a-z0-9])"


def words_of(text: Column) -> Column:
    """Lower-case words; comment marks and other signs go, hyphens and points inside of words stay."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?m)^\s*(?:#+|//+|\*+|;+|--+|/\*+)", " "), _BREAK), lambda t: t != "")


def pairs_of(words: Column) -> Column:
    """Neighbouring words, each pair as one term."""
    n = F.size(words)
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def template_weights(docs: DataFrame) -> DataFrame:
    """(licence, notice, term, tf, idf) of all notices: a few hundred rows, whatever is scanned."""
    listed = [(licence, i, text) for licence, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    rows = docs.sparkSession.createDataFrame(listed, "licence string, notice int, text string")
    terms = rows.select("licence", "notice", F.explode(pairs_of(words_of(F.col("text")))).alias("term")).groupBy("licence", "notice", "term").agg(F.count(F.lit(1)).alias("tf"))
    spread = terms.groupBy("term").agg(F.countDistinct("licence").alias("df"))
    both = F.split("term", " ")
    plain = both[0].isin(FUNCTION_WORDS) & both[1].isin(FUNCTION_WORDS)
    n = len(TEMPLATES)
    idf = F.when(plain, F.lit(math.log(1 + 1 / (2 * n)))).otherwise(F.log(1 + n / F.col("df")))
    return terms.join(spread, "term").select("licence", "notice", "term", "tf", idf.alias("idf"))


def _weight() -> Column:
    return (1 + F.log("tf")) * F.coalesce("idf", F.lit(UNKNOWN))


def headers_of(files: DataFrame) -> DataFrame:
    """path, header (its words), n_words of the file, whole (whether it is all of a licence file), for every header of every whole text."""
    text = F.coalesce("text", F.lit(""))
    marked = files.select("path", text.alias("text")).where(F.col("path").isNotNull() & F.col("text").rlike(MARK))
    worded = marked.select("path", words_of(F.col("text")).alias("words"))
    size = F.size("words")
    at = F.filter(F.sequence(F.lit(1), size), lambda i: F.get(F.col("words"), i - 1).rlike(MARKED))
    around = F.transform(at, lambda i: F.slice(F.col("words"), F.greatest(i - BEFORE, F.lit(1)), F.least(i, F.lit(BEFORE + 1)) + AFTER))
    whole = F.when(F.col("path").rlike(NAMED), F.array(F.col("words"))).otherwise(F.array().cast("array<array<string>>"))
    split = worded.where(size > 0).select("path", size.alias("n_words"), F.transform(around, lambda h: F.struct(h.alias("header"), F.lit(False).alias("whole"))).alias("a"), F.transform(whole, lambda h: F.struct(h.alias("header"), F.lit(True).alias("whole"))).alias("b"))
    return split.select("path", "n_words", F.explode(F.concat("a", "b")).alias("h")).select("path", "n_words", "h.header", "h.whole")


def own_licences(files: DataFrame) -> DataFrame:
    """path, licence, score of the best header, and whether the file is a licence file."""
    headers = written(headers_of(files).withColumn("key", F.unhex(F.md5(F.array_join("header", " ").cast("binary")))), "licence-headers")
    notices = written(template_weights(files), "licence-templates")
    lengths = notices.groupBy("licence", "notice").agg(F.sqrt(F.sum(_weight() ** 2)).alias("length"))
    sides = notices.join(lengths, ["licence", "notice"]).select("licence", "notice", "term", (_weight() / F.col("length")).alias("side"))
    known = notices.select("term", "idf").distinct()
    # headers with the same words are judged once
    each = headers.select("key", "header").dropDuplicates(["key"])
    tf = each.select("key", F.explode(pairs_of(F.col("header"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(F.broadcast(known), "term", "left").withColumn("weight", _weight())
    weighed = written(weighed, "licence-terms")
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"), (F.sum(F.when(F.col("idf").isNotNull(), F.col("tf"))) + 1).alias("words"))
    dots = weighed.where("idf IS NOT NULL").join(F.broadcast(sides), "term").groupBy("key", "licence", "notice").agg(F.sum(F.col("weight") * F.col("side")).alias("dot"))
    cosines = dots.join(norms, "key").select("key", "licence", "words", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= LEAST)
    best = cosines.groupBy("key").agg(F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("cosine")).alias("below"), "licence")).alias("b"), F.max("words").alias("words"))
    found = headers.join(best, "key").select("path", "n_words", "words", "b")
    per_file = found.groupBy("path").agg(F.min("b").alias("b"), F.max("words").alias("words"), F.max("n_words").alias("n_words"))
    speaks = F.col("path").rlike(NAMED) | (2 * F.col("words") >= F.col("n_words"))
    return per_file.select("path", F.col("b.licence").alias("licence"), (-F.col("b.below")).alias("score"), speaks.alias("speaks"))


def directory_of(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, but for the top."""
    parts = F.split(directory, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(directory == "", F.array().cast("array<string>")).otherwise(own)


def scan(files: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, path, licence, how (own or inherited), score, from_path of every row of ``files`` (doc_id, path, text).

    ``docs`` is not read: the weights do not depend on the documents around a file.
    """
    own = written(own_licences(files), "licences-own")
    speaking = own.where("speaks").withColumn("above", directory_of(F.col("path")))
    spoken = written(speaking.groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("below"), "path", "licence")).alias("s")), "licences-spoken")
    directories = files.select(directory_of(F.col("path")).alias("directory")).where("directory IS NOT NULL").distinct()
    upward = directories.select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
    said = F.struct(F.col("s.licence").alias("licence"), F.col("s.path").alias("from_path"), (-F.col("s.below")).alias("score"))
    nearest = upward.join(spoken, "above").groupBy("directory").agg(F.max_by(said, F.length("above")).alias("n"))
    nearest = written(nearest, "licences-nearest")
    # every directory lies below the top: what speaks there is one row
    top = spoken.where("above = ''").agg(F.first(said).alias("top"))
    rows = files.select("doc_id", "path", directory_of(F.col("path")).alias("directory"))
    both = rows.join(own.select("path", F.col("licence").alias("own"), F.col("score").alias("own_score")), "path", "left").join(nearest, "directory", "left").crossJoin(F.broadcast(top))
    both = both.withColumn("n", F.coalesce("n", F.when(F.col("path").isNotNull(), F.col("top"))))
    return both.select(
        "doc_id", "path", F.coalesce("own", "n.licence").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("n.licence").isNotNull(), "inherited").alias("how"),
        F.coalesce("own_score", "n.score").alias("score"), F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("n.from_path")).alias("from_path"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source, a directory for each thousand ids, in it one for each hundred.

    Every tenth document is a notice of its thousand, so that its licence, if it has one, holds for the files below it.
    """
    given = documents_only(docs, "doc_id", "text", "source")
    number = F.col("doc_id")
    level = lambda n: F.floor(number / n).cast("long").cast("string")
    name = number.cast("string")
    thousand = F.concat_ws("/", F.coalesce("source", F.lit("none")), level(1000))
    path = F.when(number % 10 == 0, F.concat(thousand, F.lit("/NOTICE-"), name)).otherwise(F.concat_ws("/", thousand, level(100), F.concat(name, F.lit(".txt"))))
    return given.select("doc_id", path.alias("path"), "text")
