"""Licences of files by sparse TF-IDF cosine to templates, handed down from the nearest ancestor directory.

1. A file's headers are its lines that speak of a licence, each with the line after it; a licence file (by
   its name) also counts as a whole. Long texts cost no more: only header lines leave the text.
2. Document frequencies of every word are counted over all headers and weigh as shares of them, so that the size of the table plays no part.
   The TF-IDF vectors of a header and of the templates meet in a join by word, and their cosines are sums of that join.
3. The best template over the threshold, whose version and name the header holds (MARKS), is the file's own licence; a licence of another
   version or of a name that only resembles it is none. The conditions of BSD-2-Clause are its own unless those of BSD-3-Clause follow. A licence file gives its licence to its directory; a file without an own
   licence takes that of the nearest ancestor: its path's ancestors are joined with the licensed directories, deepest first.

Defined cases: null and empty texts have no own licence, but inherit. A null path inherits nothing. Rows with a null or
repeated doc_id give a row each (their key is path, doc_id and text). Of licence files in one directory the most similar decides, then
the smallest licence name. Templates that tie on a file are taken by name. An empty table gives an empty result. Columns other than those
named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import held, texts

THRESHOLD = 0.5
#: Share of headers that is added to each word's, so that the weight of a word in hardly any header stays bounded.
RARE = 0.1
_CUE = r"(?i)licen[sc]e|copyright|spdx|permission (?:is|to use)|redistribut|warrant|neither the name"
_LICENCE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"

#: Words of licence texts, for telling how much of a text is one.
_LEGAL = r"(?i)licen[sc]|copyright|permission|permitted|redistribut|convey|warrant|liab|covered work|source code|spdx"

#: Templates: the short notices of public licences, with the forms in which files name them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
        "GNU General Public License Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "GNU General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-3.0",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0-1.0": ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related rights.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential."],
}

#: What a header must hold, and must not hold, to name a licence that shares most of its words with others.
_V = r"(?i)(?:\bversion |\bv\.? ?|gpl-?v?|license,? )"
_OTHER_GPL = r"(?i)\b(?:lesser|affero|library general|lgpl|agpl)"
MARKS = {
    "MIT": (r"(?i)\bmit\b|permission is hereby granted", None),
    "ISC": (r"(?i)\bisc\b|permission to use", None),
    "Apache-2.0": (r"(?i)\b2(?:\.0)?\b", r"(?i)\b1\.1\b"),
    "GPL-2.0": (_V + r"2(?:\.0)?(?!\.?[0-9])", _OTHER_GPL),
    "GPL-3.0": (_V + r"3(?:\.0)?(?!\.?[0-9])", _OTHER_GPL),
    "AGPL-3.0": (r"(?i)\b(?:affero|agpl)", _V + r"[12](?:\.0)?(?!\.?[0-9])"),
    "LGPL-2.1": (r"(?i)2\.1\b", r"(?i)\b(?:affero|agpl)"),
    "LGPL-3.0": (_V + r"3(?:\.0)?(?!\.?[0-9])", r"(?i)\b(?:affero|agpl)"),
    "MPL-2.0": (r"(?i)\b2\.0\b", None),
    "BSD-2-Clause": (r"(?i)\b2[- ]clause|redistribution and use", r"(?i)\b[34][- ]clause"),
    "BSD-3-Clause": (r"(?i)\b3[- ]clause|neither the name", r"(?i)\b[024][- ]clause"),
    "CC-BY-4.0": (r"4\.0", r"(?i)non-?commercial|share-?alike|no-?deriv|\b(?:nc|sa|nd)\b"),
    "CC-BY-NC-4.0": (r"4\.0", r"(?i)share-?alike|no-?deriv|\b(?:sa|nd)\b"),
}
#: Licences whose text begins another's: where both are found in a file, it has the other.
BEGINS = {"BSD-2-Clause": "BSD-3-Clause"}


def _says(header: Column, licence: Column) -> Column:
    """Whether the header holds the marks of the licence."""
    out = F.lit(True)
    for name, (needs, bars) in MARKS.items():
        holds = (header.rlike(needs) if needs else F.lit(True)) & (~header.rlike(bars) if bars else F.lit(True))
        out = F.when(licence == name, holds).otherwise(out)
    return out


def licence_share(text: Column) -> Column:
    """The share of a text's characters that lie in sentences or lines with a word of licences; 0 for a null or empty text."""
    parts = F.split(text, r"[.;\n]+")
    sizes = F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.rlike(_LEGAL).alias("legal")))
    total = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("long").alias("legal"), F.lit(0).cast("long").alias("all")),
        lambda s, p: F.struct((s["legal"] + F.when(p["legal"], p["n"]).otherwise(0)).alias("legal"), (s["all"] + p["n"]).alias("all")),
        lambda s: F.coalesce(F.try_divide(s["legal"], s["all"]), F.lit(0.0)),
    )
    return F.coalesce(total, F.lit(0.0))


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def headers(files: DataFrame) -> DataFrame:
    """key, path, header (a line that speaks of a licence, and the next), whole (a licence file) of (doc_id, path, text)."""
    key = F.xxhash64("path", "doc_id", "text")
    lines = F.split("text", "\n")
    cue = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_CUE), F.concat_ws(" ", x, F.get(lines, i + 1)))), lambda x: x.isNotNull())
    # the sentence of a line that holds the cue, since prose keeps many sentences in a line
    part = F.flatten(F.transform(cue, lambda x: F.filter(F.split(x, r"(?<=[.;])\s+(?=[A-Z])"), lambda s: s.rlike(_CUE))))
    whole = F.col("path").rlike(_LICENCE_NAME)
    found = F.when(F.col("text").rlike(_CUE), F.when(whole, F.array_append(part, F.col("text"))).otherwise(part))
    return files.select(key.alias("key"), "doc_id", "path", F.coalesce(whole, F.lit(False)).alias("whole"), F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))).alias("found"))


def own_licences(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, licence and similarity of the best template, for rows of headers() that have one over the threshold."""
    spark = rows.sparkSession
    listed = [(name, i, text) for name, forms in TEMPLATES.items() for i, text in enumerate(forms)]
    template = spark.createDataFrame(listed, "licence string, form int, text string").coalesce(1)
    template = template.select("licence", "form", F.explode(_words(F.col("text"))).alias("word")).groupBy("licence", "form", "word").agg(F.count("*").alias("tf"))
    template = held(template.coalesce(1))  # a few hundred rows, fixed by TEMPLATES
    # equal headers are scored once, however many files hold them
    header = rows.select(F.explode("found").alias("header")).groupBy("header").agg(F.count("*").alias("n"))
    # all words count towards a header's length, only template words can meet
    term = header.select("header", "n", F.explode(_words(F.col("header"))).alias("word")).groupBy("header", "n", "word").agg(F.count("*").alias("tf"))
    term = held(term)
    total = header.agg(F.sum("n").alias("t"), F.count("*")).first().t or 0
    frequency = held(term.groupBy("word").agg(F.sum("n").alias("df")))
    # by the share of headers, so that the same shares weigh the same in a table of any size
    weight = 1 + F.log((1 + RARE) / (F.coalesce("df", F.lit(0)) / max(total, 1) + RARE))
    usual = frequency.filter(F.col("df") * 1000 >= total).select("word").union(template.select("word")).distinct()
    # the templates' vocabulary and words of a thousandth of all headers: so many at most as a thousand headers have words
    usual = F.broadcast(held(usual.join(frequency, "word", "left").select("word", weight.alias("idf")).coalesce(1)))
    side = lambda t, idf: t.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    seldom = term.join(usual, "word", "left_anti")
    left = side(term, usual).unionByName(side(seldom, frequency.select("word", weight.alias("idf"))))
    right = side(template, usual)
    left_norm = left.groupBy("header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("h_norm"))
    right_norm = F.broadcast(right.groupBy("licence", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm")))
    right = F.broadcast(right.select("licence", "form", "word", F.col("w").alias("t_w")))
    dots = left.join(right, "word").groupBy("header", "licence", "form").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    scored = dots.join(right_norm, ["licence", "form"]).join(left_norm, "header").withColumn("similarity", F.round(F.col("dot") / F.col("h_norm") / F.col("t_norm"), 9))
    fit = (F.col("similarity") >= threshold) & _says(F.col("header"), F.col("licence"))
    best = scored.filter(fit).groupBy("header").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("b"))
    met = rows.select("key", F.explode("found").alias("header")).join(best, "header")
    whole = {name: F.min(F.when(F.col("b.licence") == name, F.col("b"))).alias(f"whole_{i}") for i, name in enumerate(BEGINS.values())}
    met = met.groupBy("key").agg(F.min("b").alias("b"), *whole.values())
    for i, begun in enumerate(BEGINS):
        met = met.withColumn("b", F.when((F.col("b.licence") == begun) & F.col(f"whole_{i}").isNotNull(), F.col(f"whole_{i}")).otherwise(F.col("b")))
    return met.select("key", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity"))


def ancestors(path: str) -> Column:
    """All directories above a path, as struct<depth, directory>; the root is depth 0 and the empty string."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory")))


def licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file (doc_id, path, text): doc_id, path, own (or null), similarity, licence (own or inherited), directory it comes from."""
    files = texts(files, F.col("path").cast("string").alias("path"))
    rows = held(headers(files))
    own = held(own_licences(rows, threshold))
    named = rows.select("key", "doc_id", "path", "whole").join(own.withColumnRenamed("licence", "own"), "key", "left")
    # one licence for each directory with a licence file
    giver = named.filter("whole AND own IS NOT NULL").select(F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), F.struct((-F.col("similarity")).alias("s"), "own").alias("g"))
    giver = held(giver.groupBy("directory").agg(F.min("g.own").alias("low"), F.min("g").alias("g")).select("directory", F.col("g.own").alias("given")))
    # directories, not files, look for their ancestors: one row per level of each distinct directory
    place = named.filter("path IS NOT NULL").select(F.regexp_replace("path", "/?[^/]*$", "").alias("place")).distinct()
    above = place.withColumn("file", F.concat("place", F.lit("/x"))).withColumn("file", F.when(F.col("place") == "", "x").otherwise(F.col("file")))
    above = above.select("place", F.explode(ancestors("file")).alias("a")).select("place", F.col("a.depth").alias("depth"), F.col("a.directory").alias("directory"))
    nearest = above.join(giver, "directory").groupBy("place").agg(F.max(F.struct("depth", "directory", "given")).alias("n"))
    nearest = nearest.select("place", F.col("n.directory").alias("from"), F.col("n.given").alias("given"))
    out = named.withColumn("at", F.regexp_replace("path", "/?[^/]*$", "")).join(nearest, F.col("at") == F.col("place"), "left")
    return out.select("doc_id", "path", "own", "similarity", F.coalesce("own", "given").alias("licence"), F.when(F.col("own").isNull(), F.col("from")).alias("inherited_from"))
