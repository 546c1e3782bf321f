"""License scans in DataFrame functions only: sparse TF-IDF cosine, then inheritance.

Every line of a text and every run of up to ``RUN_LINES`` lines is a candidate header, so
is the leading block of comment lines, and the text as a whole is a candidate licence
file.  Lines, runs, block and text meet the short templates; block and text also meet the
full-length licences.  A licence file is a text that as a whole reaches the threshold.
Term weights are tf * idf with document frequencies over all files; what can't reach the
threshold by the Cauchy-Schwarz inequality is not weighed, the rest goes on to the sparse
product with the templates, a join on terms.  A file without a licence of its own takes
that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

#: The template texts, by licence.  Short statements and opening words.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Proprietary", "All rights reserved."),
]
#: Notices that the licences ask for at the head of a file.
NOTICES: list[tuple[str, str]] = [
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
]
#: Folder of full-length licences, by name.
FULL_TEXTS = Path(__file__).with_name("licenses")
LINE_COSINE = 0.8
#: Lines of a leading block: blank, or with the mark of a comment.
COMMENT = r"^\s*(?:$|//|/?\*|#|--|;|%|<!--|\"\"\"|REM\b)"
#: Lines that a wrapped short template may take.
RUN_LINES = 4
#: Steps of a template's term weights in the bound on whole texts.
STEPS = 6
SALTS = 16


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _directory(path: Column) -> Column:
    """The directory that a path lies in, the root is empty."""
    return _bound(_parts(path), lambda parts: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def _parents(path: Column) -> Column:
    """All directories above a path, the nearest first, the root (empty) last."""
    every = lambda parts: F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return _bound(_parts(path), lambda parts: F.when(F.size(parts) < 1, F.array(F.lit(""))).otherwise(every(parts)))


def leading_terms(templates: list[tuple[str, str]], weight: dict[str, float], cosine: float) -> list[str]:
    """Terms of which every line within ``cosine`` of a template holds at least one.

    Of each template its heaviest terms, until a line without them has, by the
    Cauchy-Schwarz inequality, a lower cosine than asked.
    """
    out: set[str] = set()
    for _, text in templates:
        squares = {w: (n * weight[w]) ** 2 for w, n in Counter(_split(text)).items()}
        rest = total = sum(squares.values())
        for w in sorted(squares, key=lambda w: (-squares[w], w)):
            if rest < (cosine * cosine - 1e-6) * total:
                break
            out.add(w)
            rest -= squares[w]
    return sorted(out)


def template_vectors(spark: SparkSession, templates: list[tuple[str, str]], idf: DataFrame, unknown: float) -> DataFrame:
    """license, template, term, weight divided by the template's norm."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string")
    terms = rows.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").count()
    weighed = terms.join(idf, "term", "left").withColumn("w", F.col("count") * F.coalesce("idf", F.lit(unknown)))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("tw"))


def full_templates() -> list[tuple[str, str]]:
    """The notices and the full-length licences that stand beside this module."""
    return NOTICES + [(f.stem, f.read_text("utf-8")) for f in sorted(FULL_TEXTS.glob("*.txt"))]


def _within(templates: list[tuple[str, str]], weight: Callable[[str], float], cosine: float, distinct: Column) -> Column:
    """Whether a text with these distinct terms can be within ``cosine`` of a template.

    By the Cauchy-Schwarz inequality its terms must hold ``cosine ** 2`` of a template's
    squared norm.  A template's terms lie in steps by weight, and a term counts as the
    heaviest of its step, so that set sizes are enough.
    """
    sums = []
    for _, text in templates:
        squares = {w: (n * weight(w)) ** 2 for w, n in Counter(_split(text)).items()}
        ranked = sorted(squares, key=lambda w: (-squares[w], w))
        total, bound, rest, top = sum(squares.values()), F.lit(0.0), ranked, 0.0
        for step in range(STEPS):
            top = squares[rest[0]]
            here = [w for w in rest if squares[w] >= top / 3] if step < STEPS - 1 else rest
            bound = bound + F.size(F.array_intersect(distinct, F.array(*map(F.lit, here)))) * F.lit(top / total)
            rest = [w for w in rest if w not in set(here)]
            if not rest:
                break
        sums.append(bound >= F.lit(cosine * cosine - 1e-6))
    return reduce(Column.__or__, sums)


def scan_licenses(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None, cosine: float = LINE_COSINE, full: list[tuple[str, str]] | None = None, all_words: bool = False) -> DataFrame:
    """Per row: key, own_license, cosine, license_words, is_license_file, license, origin.

    ``origin`` is ``own``, ``inherited`` or null; ``inherited_from`` is the directory.
    Among a file's lines, runs, leading block and whole text the highest cosine wins, ties
    go to the licence of the first name; among the licence files of one directory likewise,
    by the cosine of the whole text, ties by name.  ``license_words`` are the words of the
    lines that any match covers.  ``full`` are the full-length templates, by default those
    of :func:`full_templates`, none beside own ``templates``.  With ``all_words`` every word
    has its document frequency over all files; without, a word of no short template weighs
    like one in no file, which grows with the number of files.  Null texts and paths have no
    licence of their own; a null path lies in the root.  Repeated rows are scanned each,
    their row number in a written table keeps them apart.
    """
    spark = files.sparkSession
    full = (full_templates() if templates is None else []) if full is None else full
    templates = TEMPLATES if templates is None else templates
    if not templates:
        raise ValueError("no templates")
    vocabulary = sorted({w for _, t in templates for w in _split(t)})
    words = F.array(*map(F.lit, vocabulary))
    rows = files.select(F.col(key).alias("key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # document frequencies over all files, the number of files under the empty term
    terms_of = F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))
    seen = terms_of if all_words else F.array_intersect(terms_of, words)
    hits = rows.select(F.explode(F.concat(F.filter(seen, lambda w: w != ""), F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    if all_words:
        hits = durable(hits, "document-frequencies")
    asked = spark.createDataFrame([(w,) for w in sorted({"", *vocabulary, *(w for _, t in full for w in _split(t))})], "term string")
    df = {r["term"]: r["n"] for r in hits.join(F.broadcast(asked), "term", "left_semi").collect()}
    total = df.pop("", 0)
    value = lambda n: math.log((total + 1) / (n + 1)) + 1
    weight = {w: value(df.get(w, 0)) for w in ([r for r in df] + vocabulary if all_words else vocabulary)}
    unknown = value(0)
    # no word weighs less than one that all files hold
    floor = 1.0 if all_words else unknown
    known = spark.createDataFrame(list(weight.items()), "term string, idf double")
    weights = F.create_map(*(F.lit(x) for w in vocabulary for x in (w, weight[w])))
    # Only units with a leading term of some template can reach the threshold, and of those
    # only units whose unknown terms, which add to the norm alone, weigh little.
    leading = leading_terms(templates, weight, cosine)
    has = lambda t: F.lower(t).rlike("(?:^|[^a-z0-9])(?:" + "|".join(leading) + ")(?:$|[^a-z0-9])")
    far = F.array(*map(F.lit, sorted({w for _, t in full for w in _split(t)}))) if full else None
    wide = _bound(F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), far), lambda t: _within(full, lambda w: weight.get(w, unknown), cosine, t)) if full else F.lit(False)
    texts = rows.select(F.monotonically_increasing_id().alias("row"), "key", "path", has("text").alias("some"), wide.alias("wide"), "text")
    bodies = F.when(F.col("some") | F.col("wide"), F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    texts = texts.withColumn("bodies", bodies).withColumn("marks", F.when(F.col("some"), F.transform("bodies", has)).otherwise(F.array().cast("array<boolean>")))
    # a unit: its first line, how many lines, whether it meets the full-length templates
    n = F.size("bodies")
    unit = lambda first, count, long: F.struct(first.cast("int").alias("first"), count.cast("int").alias("count"), long.alias("long"))
    run = lambda k: F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: unit(i, F.lit(k), F.lit(False))), lambda u: (u["first"] + k - 1 <= n) & F.exists(F.slice("marks", u["first"], F.lit(k)), lambda m: m))
    runs = F.when(F.col("some"), F.concat(*(run(k) for k in range(1, RUN_LINES + 1))))
    code = F.transform("bodies", lambda b: ~b.rlike(COMMENT))
    head = F.when(F.exists(code, lambda c: c), F.array_position(code, True) - 1).otherwise(n)
    blocks = F.when(n > 0, F.filter(F.array(unit(F.lit(1), head, F.col("wide")), unit(F.lit(1), n, F.col("wide"))), lambda u: u["count"] > 0))
    none = F.array().cast("array<struct<first:int,count:int,long:boolean>>")
    every = F.concat(F.array(unit(F.lit(0), F.lit(0), F.lit(False))), F.coalesce(runs, none), F.coalesce(blocks, none))
    units = texts.select("row", "key", "path", "some", "bodies", n.alias("n_lines"), F.posexplode(F.array_distinct(every)).alias("unit", "u"))
    units = units.select("row", "key", "path", "some", "unit", "n_lines", "u.*", F.when(F.col("u.first") > 0, F.slice("bodies", F.col("u.first"), F.col("u.count"))).alias("lines"))
    units = units.withColumn("body", F.array_join("lines", "\n"))
    terms = _terms(F.col("body"))
    squared = lambda w: F.element_at(weights, w) * F.element_at(weights, w)
    inner = lambda inside: F.aggregate(F.array_distinct(inside), F.lit(0.0), lambda acc, w: acc + squared(w) * F.pow(F.size(F.filter(inside, lambda x: x == w)), F.lit(2)))
    # the least that the unknown terms can weigh: all different
    outer = lambda every, inside: (F.size(every) - F.size(inside)) * F.lit(floor * floor)
    near = lambda known, other: (known > 0) & (known >= F.lit(cosine * cosine) * (known + other))
    able = _bound(terms, lambda every: _bound(F.filter(every, lambda w: F.array_contains(words, w)), lambda inside: _bound(inner(inside), lambda known: near(known, outer(every, inside)))))
    marked = units.withColumn("able", F.when(F.col("first") == 0, False).when(F.col("long"), True).when(F.col("some"), able).otherwise(False)).where("first = 0 or able")
    marked = marked.withColumn("terms", F.when(F.col("able"), terms)).withColumn("sizes", F.when(F.col("able"), F.transform("lines", lambda b: F.size(_terms(b)))))
    kept = durable(marked.select("row", "key", "path", "unit", "first", "long", (F.col("count") == F.col("n_lines")).alias("whole"), "able", "terms", "sizes"), "licence-units")
    norm = kept.where("able").select("row", "unit", "long", F.explode("terms").alias("term")).groupBy("row", "unit", "long", "term").agg(F.count("*").alias("tf"))
    if all_words:
        # of all words only those of the units that are weighed
        met = kept.where("able").select(F.explode("terms").alias("term")).distinct()
        idf = durable(hits.where("term != ''").join(met, "term", "left_semi").select("term", (F.log(F.lit(total + 1.0) / (F.col("n") + 1)) + 1).alias("idf")), "word-weights")
        norm = norm.join(idf, "term", "left")
    else:
        norm = norm.join(F.broadcast(known), "term", "left")
    norm = norm.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    vectors = template_vectors(spark, templates + full, known, unknown)
    lengths = norm.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = norm.join(F.broadcast(vectors), "term").where(F.col("long") | (F.col("template") < len(templates)))
    dots = dots.groupBy("row", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scores = dots.join(lengths, ["row", "unit"]).withColumn("cos", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cos") >= cosine)
    best = scores.groupBy("row", "unit").agg(F.max("cos").alias("cos"), F.min_by("license", F.struct(-F.col("cos"), F.col("license"))).alias("license"))
    best = durable(best.join(kept.where("able").select("row", "unit", "first", "whole", "sizes"), ["row", "unit"]), "licence-matches")
    covered = best.select("row", "first", F.posexplode("sizes").alias("at", "n")).select("row", (F.col("first") + F.col("at")).alias("line"), "n").distinct().groupBy("row").agg(F.sum("n").alias("license_words"))
    by = F.struct(-F.col("cos"), F.col("license"))
    own = best.groupBy("row").agg(F.max("cos").alias("cosine"), F.min_by("license", by).alias("own_license"), F.max(F.when(F.col("whole"), F.col("cos"))).alias("file_cosine"), F.min_by(F.when(F.col("whole"), F.col("license")), F.when(F.col("whole"), by)).alias("file_license"))
    scanned = kept.where("first = 0").select("row", "key", "path").join(own.join(covered, "row"), "row", "left")
    scanned = scanned.withColumn("license_words", F.coalesce(F.col("license_words"), F.lit(0)).cast("long"))
    scanned = scanned.withColumn("is_license_file", F.col("file_cosine").isNotNull())
    scanned = durable(scanned.withColumn("dir", _directory(F.col("path"))), "scanned-files")
    # one row a directory on both sides: a directory with a third of all files is one row
    offers = scanned.where("is_license_file").groupBy("dir").agg(F.min_by("file_license", F.struct(-F.col("file_cosine"), F.col("file_license"))).alias("offer"))
    dirs = scanned.select("dir", "path").groupBy("dir").agg(F.min("path").alias("path")).select("dir", F.posexplode(_parents(F.col("path"))).alias("up", "above"))
    nearest = dirs.join(offers.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.min_by(F.struct("offer", "above"), "up").alias("got"))
    # files of a hot directory are dealt over salts, the directory's row is repeated
    nearest = nearest.select("dir", "got", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = scanned.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    out = salted.join(nearest, ["dir", "salt"], "left")
    return out.select(
        F.col("key").alias(key), "path", "own_license", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "license_words", "is_license_file",
        F.coalesce("own_license", "got.offer").alias("license"), F.when(F.col("own_license").isNotNull(), "own").when(F.col("got").isNotNull(), "inherited").alias("origin"), F.when(F.col("own_license").isNull(), F.col("got.above")).alias("inherited_from"),
    )


def _split(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
