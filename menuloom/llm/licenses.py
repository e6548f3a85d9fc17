"""Licence scans in DataFrame operations only: sparse TF-IDF cosine of licence headers and
licence files to templates, then inheritance from the nearest ancestor directory.

A document is a file of a source tree. Its header is made of the lines that speak of a
licence (all lines of a file whose name says so). Words of headers become sparse
TF-IDF vectors over the templates' words, with document frequencies counted over all
headers; the template with the highest score is the licence if it reaches the threshold. The
score is the cosine, but with the geometric mean of both norms for the template's norm where
the header's is smaller (headers quote templates in part), and at most 1. A
directory has the licence that its licence files (or else most of its headers) state. Files
that state none take that of the nearest directory above, found by joining all
ancestor paths, whose number is bounded by a path's depth.

Cases: null and empty texts have no header; null paths are files of the root without a
directory of their own; ties go to the more specific template, then by name; repeated rows
are judged each; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from menuloom.session import broadcast_if_small, reliable_checkpoint

THRESHOLD = 0.5

# Short forms and opening words of common licences (fixed values).
TEMPLATES = {
    "MIT": "released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software; redistribute it and/or modify it under the terms of the GNU General Public License",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "released under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted",
    "BSD-2-Clause": "released under the BSD 2-Clause License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "released under CC0 1.0 Universal. Creative Commons Zero public domain dedication",
    "Unlicense": "This is free and unencumbered software released into the public domain. The Unlicense",
    "Proprietary": "All rights reserved. Proprietary and confidential. Unauthorized copying of this file is strictly prohibited",
}
# What makes a line part of a header, and a file a licence file (fixed values).
HEADER_LINE = r"(?i)licen[sc]e|copyright|spdx|all rights reserved|public domain|creative commons|\bCC BY|\bCC0|redistribution and use|permission is hereby"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
_TERM = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"


def header(path: Column, text: Column) -> Column:
    """The lines that speak of a licence; all of a licence file."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(HEADER_LINE))
    return F.when(path.rlike(LICENCE_FILE), text).when(text.rlike(HEADER_LINE), F.array_join(lines, "\n"))


def terms(text: Column) -> Column:
    """Words, numbers and pairs of neighbouring words of a header."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({_TERM})"), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def stated(files: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """Rows (row, licence, score) of the files whose header is near enough to a template."""
    spark = files.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "licence string, body string")
    t = known.select("licence", F.explode(terms(F.col("body"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("n"))
    own = reliable_checkpoint(t)  # as large as the templates are
    words = F.broadcast(own.select("term").distinct())
    f = files.where("header IS NOT NULL").select("row", F.explode(terms(F.col("header"))).alias("term")).join(words, "term").groupBy("row", "term").agg(F.count("*").alias("n"))
    f = reliable_checkpoint(f)
    total = f.select("row").distinct().count()
    seen = f.groupBy("term").agg(F.count("*").alias("df"))
    weight = own.join(seen, "term", "left").groupBy("term").agg(F.max("df").alias("df"), F.count_distinct("licence").alias("tf"))
    # Frequencies over templates and headers: what many of either share says little.
    idf = weight.select("term", (F.log((F.lit(len(templates)) + 1.0) / F.col("tf")) + F.log((F.lit(total) + 2.0) / (F.coalesce("df", F.lit(0)) + 1.0)) / 8).alias("idf"))
    idf = F.broadcast(reliable_checkpoint(idf))
    value = (1 + F.log("n")) * F.col("idf")
    tv = own.join(idf, "term").select("licence", "term", value.alias("t"))
    norms = tv.groupBy("licence").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_norm"))
    tv = F.broadcast(reliable_checkpoint(tv.join(norms, "licence")))
    fv = f.join(idf, "term").select("row", "term", value.alias("f"))
    size = fv.groupBy("row").agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("f_norm"))
    dots = fv.join(tv, "term").groupBy("row", "licence").agg(F.sum(F.col("f") * F.col("t")).alias("dot"), F.max("t_norm").alias("t_norm"))
    # A header quotes a template in part: the cosine is taken over the header's own terms,
    # with the template's norm tempered.
    scored = dots.join(size, "row").withColumn("score", F.col("dot") / (F.col("f_norm") * F.sqrt(F.col("t_norm") * F.least("t_norm", "f_norm"))))
    best = scored.groupBy("row").agg(F.max_by(F.struct("licence", "score"), F.struct(F.round("score", 9), F.col("dot"), F.col("licence"))).alias("b"))
    return best.select("row", F.col("b.licence").alias("licence"), F.least(F.col("b.score"), F.lit(1.0)).alias("score")).where(F.col("score") >= threshold)


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, the root ('') last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(docs: DataFrame, path: Column, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, path, licence, score, origin): origin is stated, inherited or none."""
    files = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"),
        header(F.coalesce(path, F.lit("")), F.col(text)).alias("header"),
    )
    files = reliable_checkpoint(files)
    own = reliable_checkpoint(files.join(stated(files, templates or TEMPLATES, threshold), "row", "left"))
    directory = F.regexp_replace("path", "(^|/)[^/]*$", "")
    votes = own.where("licence IS NOT NULL").groupBy(directory.alias("dir"), "licence").agg(F.count("*").alias("n"), F.max(F.col("path").rlike(LICENCE_FILE)).alias("file"))
    dirs = votes.groupBy("dir").agg(F.max_by("licence", F.struct("file", "n", "licence")).alias("dir_licence"))
    dirs = broadcast_if_small(dirs)
    # Every directory that has a file without a licence of its own is resolved once.
    wanted = own.where("licence IS NULL").select(directory.alias("from"), F.col("path").alias("p")).groupBy("from").agg(F.min("p").alias("p"))
    steps = wanted.select("from", F.posexplode(ancestors(F.col("p"))).alias("up", "dir"))
    nearest = steps.join(dirs, "dir").groupBy("from").agg(F.min_by("dir_licence", "up").alias("inherited"))
    out = own.withColumn("from", directory).join(broadcast_if_small(nearest), "from", "left")
    return out.select(
        "doc_id", "path", F.coalesce("licence", "inherited").alias("licence"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(F.col("licence").isNotNull(), "stated").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )
