"""Licences of files: sparse TF-IDF cosine of licence sentences to templates, then inheritance by directory.

Sentences with a licence cue are taken from the whole text of every file. Terms are weighted by their inverse
frequency over all such sentences of the corpus; the cosine to each template is a sum over common terms.
A file has its own licence if a sentence reaches THRESHOLD; it is a licence file of its directory if it is named
like one or if such sentences hold at least LICENCE_SHARE of its words. Files without an own licence take that of
the nearest directory above them (their own directory first) that has a licence file: the ancestors of the
different directories, not of the files, are joined by path, and files join their directory.

Defined results: null and empty texts have no licence of their own but may inherit; a null path has no directory and
inherits nothing; of equal cosines the template that sorts first counts, of several licence files in a directory the
one with the highest cosine, then the least path; repeated rows each get a row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import BLANKS, join_groups, stored

THRESHOLD, LICENCE_SHARE = 0.55, 0.25
CUE = r"(?i)licen[sc]e|\bcopying permission\b|spdx-|creative commons|\bcc[ -]by\b|\bcc0\b|public domain|redistribution and use|permission is hereby granted"
FILE_NAME = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense)[^/]*$"
#: Notices as their licences word them, fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is free software; licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def sentences(docs: DataFrame, path_col: str, text_col: str, id_col: str) -> DataFrame:
    """Stored: place (of the row), doc_id, path, dir, n_words, and the licence sentences as term lists."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.filter(F.split(text, r"\n|(?<=[.!?;])[\x20\x09]+"), lambda s: s.rlike(CUE))
    return stored(docs.select(
        F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"),
        F.regexp_extract(path_col, r"^(.*)/[^/]*$", 1).alias("dir"), F.size(F.array_remove(F.split(text, BLANKS), "")).alias("n_words"),
        F.when(text.rlike(CUE), F.transform(cut, lambda s: F.regexp_extract_all(F.lower(s), F.lit(_TERM), F.lit(0)))).alias("sentences"),
    ), "sentences")


def _idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + F.coalesce(df, F.lit(0)))) + 1


def matches(found: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(place, licence, score, matched): best template of each row with a sentence that reaches THRESHOLD."""
    spark = found.sparkSession
    rows = found.where("size(sentences) > 0").select("place", F.posexplode("sentences").alias("sentence", "terms")).where("size(terms) > 0")
    counted = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf")))
    rows = stored(rows.select("place", "sentence", F.size("terms").alias("length"), F.explode(counted).alias("t")).select("place", "sentence", "length", "t.term", "t.tf"), "terms")
    frequency = stored(rows.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    total = rows.select("place", "sentence").distinct().count()
    # templates are a bounded list: their terms are looked up, and come to the driver
    names = sorted({t for _, text in templates for t in _terms(text)})
    df = dict(frequency.where(F.col("term").isin(names)).collect())
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in names}
    vectors = []
    for _, text in templates:
        weights = {t: n * idf[t] for t, n in Counter(_terms(text)).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append({t: w / norm for t, w in weights.items()})
    wanted = spark.createDataFrame([(t, [v.get(t, 0.0) for v in vectors]) for t in names], "term string, shares array<double>")
    weighted = join_groups(rows, frequency, "term", "df").withColumn("w", F.col("tf") * _idf(F.lit(total), F.col("df"))).join(F.broadcast(wanted), "term", "left")
    dots = [F.sum(F.col("w") * F.coalesce(F.col("shares")[k], F.lit(0.0))).alias(f"dot{k}") for k in range(len(templates))]
    scored = weighted.groupBy("place", "sentence", "length").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"dot{k}") / F.col("norm"), 9).alias("score"), F.lit(-k).alias("order")) for k in range(len(templates))]))
    scored = scored.withColumn("best", best).where(F.col("best.score") >= THRESHOLD)
    ids = F.array(*[F.lit(name) for name, _ in templates])
    return scored.groupBy("place").agg(F.max(F.struct("best.score", "best.order")).alias("top"), F.sum("length").alias("matched")).select(
        "place", ids[-F.col("top.order")].alias("licence"), F.col("top.score").alias("score"), "matched"
    )


def inherited(files: DataFrame) -> DataFrame:
    """(dir, licence, score, from_dir, files): of every directory with files, from the nearest one with a licence file."""
    dirs = files.where("path IS NOT NULL").groupBy("dir").agg(
        F.count("*").alias("files"), F.max(F.when(F.col("is_file"), F.struct("score", "licence"))).alias("own")
    )
    # of equal scores the least path decides
    first = files.where("is_file AND path IS NOT NULL").groupBy("dir", "score").agg(F.min(F.struct("path", "licence")).alias("first"))
    dirs = stored(dirs.join(first.select("dir", F.col("score").alias("top"), "first"), (dirs.dir == first.dir) & (F.col("own.score") == F.col("top")), "left").select(
        dirs.dir, "files", F.col("first.licence").alias("licence"), F.col("top").alias("score")
    ), "dirs")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    steps = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    owners = dirs.where("licence IS NOT NULL").select(F.col("dir").alias("above"), "licence", "score")
    nearest = steps.join(owners, "above").groupBy("dir").agg(F.max_by(F.struct("licence", "score", F.col("above").alias("from_dir")), "depth").alias("n"))
    return stored(dirs.select("dir", "files").join(nearest, "dir", "left").select("dir", "files", "n.*"), "inherited")


def scan(docs: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per file: doc_id, path, licence (null: none), origin (own, inherited, none), score, from_dir."""
    found = sentences(docs, path_col, text_col, id_col)
    own = stored(matches(found, templates), "matches")
    files = stored(found.drop("sentences").join(own, "place", "left").withColumn("is_file", F.col("licence").isNotNull() & (
        F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | (F.col("matched") >= LICENCE_SHARE * F.col("n_words"))
    )), "files")
    licensed = files.where("licence IS NOT NULL").select("doc_id", "path", "licence", F.lit("own").alias("origin"), "score", F.lit(None).cast("string").alias("from_dir"))
    bare = files.where("licence IS NULL AND path IS NOT NULL").select("doc_id", "path", "dir")
    homed = join_groups(bare, inherited(files), "dir", "files").select(
        "doc_id", "path", "licence", F.when(F.col("licence").isNull(), "none").otherwise("inherited").alias("origin"), "score", "from_dir"
    )
    lost = files.where("licence IS NULL AND path IS NULL").select(
        "doc_id", "path", "licence", F.lit("none").alias("origin"), "score", F.lit(None).cast("string").alias("from_dir")
    )
    return licensed.unionByName(homed).unionByName(lost)
