"""License scans with built-in functions only: sparse TF-IDF cosine to templates, then inheritance by directory.

Notices are compared as runs of terms (stop words aside), weighted by TF-IDF over the templates: windows as long
as the template that start at one of its terms, across line breaks; each line; and the whole of a licence file.
A run counts if its cosine to the template is LEAST or more and it holds LEAST_TERMS of the template's terms, or all of
them if it has fewer ('mit' or 'released under' is no licence, 'MIT License' is). No other gate stands before the
scores: a run that comes near a template holds terms with LEAST squared of its squared weight, so texts and runs without
them are left out first, and no hit is lost. Of the templates that come near, the one with the most of its terms met
(squared score times length) is the file's own licence. A directory's licence is that of its licence file. A file
without its own takes that of the nearest directory above that has one, found by joining each distinct directory's
ancestors with the licensed directories by path.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Short headers and the telling sentences of licence texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights: public domain, CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)
#: The notice that four licences share but for a word and a number, and the tag that any file may bear.
TEMPLATES += tuple(
    (name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {n} of the License")
    for name, kind, n in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))
)
TEMPLATES += tuple(
    (name, f"SPDX-License-Identifier: {name}{end}")
    for name in sorted({name for name, _ in TEMPLATES} - {"Proprietary"})
    for end in (("", "-only", "-or-later") if "GPL" in name else ("",))
)
STOP = frozenset("a an and any are as at be by for from in into is it its of on or that the this to was with you your work".split())
LEAST = 0.6
LEAST_TERMS = 3
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
_SPLIT = r"[^a-z0-9.-]+"
_EDGE = r"^[.-]+|[.-]+$"


def terms_of(text: str) -> list[str]:
    found = (re.sub(_EDGE, "", t) for t in re.split(_SPLIT, text.lower()))
    return [t for t in found if t and t not in STOP]


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, share of the unit vector); idf of each term; idf of a term no template has."""
    counts = [Counter(terms_of(text)) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, ((name, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(counts)) + 1


def _telling(rows, least: float) -> dict[str, list[int]]:
    """Terms, with their templates, of which every run that scores `least` holds one: the rest of each template has too little weight."""
    found: dict[str, list[int]] = {}
    for i in sorted({r[0] for r in rows}):
        left = 1.0
        for _, _, term, weight in sorted((r for r in rows if r[0] == i), key=lambda r: -r[3]):
            if left < least * least - 1e-6:
                break
            found.setdefault(term, []).append(i)
            left -= weight * weight
    return found


def own_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files: path, text. Returns path, licence, score for files with a run of terms that comes near a template."""
    spark = files.sparkSession
    rows, idf, unknown = template_weights()
    weights = F.broadcast(spark.createDataFrame([(i, t, w) for i, _, t, w in rows], "template int, term string, weight double"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    table = [(i, name, len(terms_of(text)), {t: w * w for k, _, t, w in rows if k == i}) for i, (name, text) in enumerate(TEMPLATES)]
    templates = F.broadcast(spark.createDataFrame(table, "template int, licence string, n int, squares map<string,double>").withColumn("own", F.map_keys("squares")))  # fixed size

    def near(terms) -> F.Column:
        """By Cauchy and Schwarz no run of terms scores more than the root of this share."""
        return F.aggregate(F.array_intersect(F.col("own"), terms), F.lit(0.0), lambda a, t: a + F.col("squares")[t]) >= least * least - 1e-6

    def words(line) -> F.Column:
        found = F.transform(F.split(line, _SPLIT), lambda t: F.regexp_replace(t, _EDGE, ""))
        return F.filter(found, lambda t: (t != "") & ~t.isin(*sorted(STOP)))

    telling = _telling(rows, least)
    index = F.create_map(*[x for term, ids in sorted(telling.items()) for x in (F.lit(term), F.array(*map(F.lit, ids)))])
    telling = "|".join(map(re.escape, sorted(telling)))
    texts = files.select("path", F.lower("text").alias("low")).where(F.rlike("low", F.lit(f"(?<![a-z0-9])(?:{telling})(?![a-z0-9])")))
    texts = texts.select("path", F.transform(F.split("low", "\n"), words).alias("lines")).withColumn("terms", F.flatten("lines"))
    texts = texts.withColumn("held", F.array_intersect(F.array(*[F.lit(t) for t in sorted(idf)]), F.col("terms")))
    maybe = F.flatten(F.filter(F.transform("held", lambda t: F.try_element_at(index, t)), lambda ids: ids.isNotNull()))
    both = texts.withColumn("template", F.explode(F.array_distinct(maybe))).join(templates, "template").where(near(F.col("held")))
    start = lambda i: F.greatest(F.lit(1), F.least(i + 1, F.size("terms") - F.col("n") + 1))
    windows = F.filter(F.transform("terms", lambda t, i: F.when(F.array_contains("own", t), F.slice("terms", start(i), F.col("n")))), lambda w: w.isNotNull())
    whole = F.when(F.rlike(_name(F.col("path")), F.lit(LICENSE_FILE)), F.array("terms")).otherwise(F.array().cast("array<array<string>>"))
    enough = lambda run: near(run) & (F.size(F.array_intersect(F.col("own"), run)) >= F.least(F.lit(LEAST_TERMS), F.size("own")))
    runs = both.select("path", "template", "licence", "n", F.explode(F.filter(F.concat("lines", windows, whole), enough)).alias("run"))
    runs = runs.withColumn("at", F.xxhash64("run")).dropDuplicates(["path", "template", "at"])
    tf = runs.select("path", "template", "licence", "n", "at", F.explode("run").alias("term")).groupBy("path", "template", "licence", "n", "at", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(idfs, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown))).join(weights, ["template", "term"], "left")
    scored = tf.groupBy("path", "template", "licence", "n", "at").agg((F.sum(F.col("w") * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("score"))
    scored = scored.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    met = F.round(F.col("score") * F.col("score") * F.col("n"), 6)
    best = scored.groupBy("path").agg(F.min(F.struct((-met).alias("m"), (-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def _name(path) -> F.Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def _directory(path) -> F.Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files: path, text. Returns path, licence, score, basis ('own', 'inherited' or null) and source (a directory).

    Null or empty texts have no licence of their own. Rows that share a path are one file: its best run of terms
    counts, and each row has its result. Of equally near templates the first licence by name is taken, of several
    licence files of a directory the nearest to a template. A null path gets no licence. Other columns are not read.
    Texts are read once: what is found is written before it is used for files and for directories.
    """
    own = saved(own_licences(files.where("path IS NOT NULL"), least))
    ranked = F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")
    licensed = own.where(F.rlike(_name(F.col("path")), F.lit(LICENSE_FILE))).groupBy(_directory(F.col("path")).alias("above")).agg(ranked).select("above", F.col("b.licence").alias("up_licence"), (-F.col("b.s")).alias("up_score"))
    # inheritance is resolved once a directory, however many files it holds
    folders = files.where("path IS NOT NULL").select(_directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    chain = folders.select("folder", F.explode(above).alias("a")).select("folder", "a.depth", "a.above")
    nearest = chain.join(licensed, "above").groupBy("folder").agg(F.max_by(F.struct("above", "up_licence", "up_score"), "depth").alias("up"))
    out = files.select("path", _directory(F.col("path")).alias("folder")).join(own, "path", "left").join(nearest, "folder", "left")
    basis = F.when(F.col("licence").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited")
    return out.select("path", F.coalesce("licence", "up.up_licence").alias("licence"), F.coalesce("score", "up.up_score").alias("score"), basis.alias("basis"), F.when(basis == "inherited", F.col("up.above")).alias("source"))


def oracle_values() -> dict[str, str]:
    """The fixed tables as SQL VALUES."""
    rows, idf, unknown = template_weights()
    return {
        "templates": ", ".join(f"({i}, '{n}', '{t}', {w!r}::DOUBLE)" for i, n, t, w in rows),
        "lengths": ", ".join(f"({i}, {len(terms_of(text))})" for i, (_, text) in enumerate(TEMPLATES)),
        "idf": ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in sorted(idf.items())),
        "unknown": f"{unknown!r}::DOUBLE",
        "stop": ", ".join(f"'{s}'" for s in sorted(STOP)),
    }
