"""Licence scans with DataFrame functions alone: TF-IDF cosine to templates, then inheritance from the nearest directory above.

Segments are the lines of every file and the whole text of files that are licence files by name. Terms are lower-cased runs of letters and digits. A term weighs its count times
ln((files + 1) / (files that hold it + 1)), with counts of files over the whole table for the templates' terms; a term that no template has weighs as one that no file holds.

A segment can only reach the threshold with a template if it holds one of the template's heavy terms: without them the cosine is at most the length of the rest of the template's vector over its whole length, by
Cauchy-Schwarz. So texts and lines without any heavy term are passed over, which loses nothing. Equal segments are scored once.

A file's own licence is its best segment's. A file without one takes that of the nearest directory above it (its own first) that has a licence file: one by name, or one at least half of whose non-empty lines are licence
lines. Directories are looked up once each, by joins on their paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage

#: Short notices by which files commonly state a licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
THRESHOLD = 0.7
LICENCE_FILE = r"^(?i:licen[cs]e|copying|notice)([.\-_].*)?$"


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _heavy(vector: dict[str, float], threshold: float) -> set[str]:
    """Terms without which the rest of the vector is shorter than threshold times its length."""
    total = sum(w * w for w in vector.values())
    rest, out = total, set()
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < threshold * threshold * total * (1 - 1e-9):
            break
        out.add(t)
        rest -= w * w
    return out


def scan(files: DataFrame, stage: Stage, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files: (path, text), a row per file. (path, licence, score, origin, directory): origin is own, inherited or none; directory is where an inherited licence comes from."""
    spark = files.sparkSession
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({t for _, x in templates for t in _terms(x)})
    known = F.array(*[F.lit(t) for t in vocabulary])
    held = files.select(F.explode(F.array_intersect(terms(F.col("text")), known)).alias("t"))
    # the vocabulary is the templates', so what comes to the driver has its size
    df = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = files.count()
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) for t in vocabulary}
    vectors = [(name, {t: c * idf[t] for t, c in Counter(_terms(x)).items()}) for name, x in templates]
    vectors = [(name, v) for name, v in vectors if any(v.values())]
    heavy = sorted({t for _, v in vectors for t in _heavy(v, threshold)})
    nothing = "path string, licence string, score double, origin string, directory string"
    if not heavy:
        return files.select("path", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("score"), F.lit("none").alias("origin"), F.lit(None).cast("string").alias("directory")).to(spark.createDataFrame([], nothing).schema)
    gate = r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, heavy)) + r")(?![\p{L}\p{N}])"
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    # texts and lines with a heavy term
    some = files.where(F.lower("text").rlike(gate)).select("path", named.alias("named"), "text", lines.alias("lines"))
    near = some.select("path", "named", F.size("lines").alias("n_lines"), F.filter("lines", lambda x: F.lower(x).rlike(gate)).alias("lines"), F.when(F.col("named"), F.col("text")).alias("whole"))
    pieces = near.select("path", "named", "n_lines", F.explode(F.concat(F.transform("lines", lambda x: F.struct(F.lit(True).alias("line"), x.alias("s"))), F.when(F.col("whole").isNotNull(), F.array(F.struct(F.lit(False).alias("line"), F.col("whole").alias("s")))).otherwise(F.array()))).alias("p"))
    pieces = stage.write(pieces.select("path", "named", "n_lines", F.col("p.line").alias("line"), F.col("p.s").alias("s")), "segments")

    scored = stage.write(pieces.select("s").distinct().select("s", _best(F.col("s"), vectors, idf, math.log(n + 1)).alias("b")).where(F.col("b.score") >= threshold), "scored")
    found = pieces.join(scored, "s")
    own = found.groupBy("path").agg(F.max("b").alias("b"), F.sum(F.col("line").cast("int")).alias("n_licence"), F.max("n_lines").alias("n_lines"), F.max("named").alias("named"))
    own = stage.write(own.select("path", F.col("b.score").alias("score"), F.col("b.licence").alias("licence"), (F.col("named") | (2 * F.col("n_licence") >= F.col("n_lines"))).alias("is_file")), "own")

    directory = F.regexp_replace("path", "(^|/)[^/]*$", "")
    has = own.where("is_file").select(directory.alias("directory"), F.struct("score", "licence").alias("b")).groupBy("directory").agg(F.max("b").alias("b"))
    up = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", 1, k), "/").alias("directory")))
    places = files.select(directory.alias("at")).distinct().withColumn("parts", F.split("at", "/")).withColumn("depth", F.when(F.col("at") == "", 0).otherwise(F.size("parts")))
    above = places.select("at", F.inline(up)).join(has, "directory")
    nearest = above.groupBy("at").agg(F.max(F.struct("depth", "directory", "b")).alias("x"))
    nearest = stage.write(nearest.select("at", F.col("x.directory").alias("directory"), F.col("x.b.licence").alias("dir_licence"), F.col("x.b.score").alias("dir_score")), "directories")
    all_ = files.select("path", directory.alias("at")).join(own.select("path", "licence", "score"), "path", "left").join(nearest, "at", "left")
    mine = F.col("licence").isNotNull()
    return all_.select(
        "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(mine, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("directory")).alias("directory"),
    )


def _let(value: Column, use) -> Column:
    """use(value) with value computed once for a row."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def _best(s: Column, vectors: list, idf: dict[str, float], most: float) -> Column:
    """(score, licence) of the best template for a segment: rounded cosine; of equal scores the name that sorts last."""
    table = lambda d: F.create_map(*[F.lit(x) for t, v in d.items() for x in (t, v)])
    weights = table(idf)

    def weighted(w: Column) -> Column:
        count = lambda t: F.size(F.filter(w, lambda x: x == t))
        return F.transform(F.array_distinct(w), lambda t: F.struct(t.alias("t"), (count(t) * F.coalesce(F.try_element_at(weights, t), F.lit(most))).alias("w")))

    def score(vector: Column) -> Column:
        total = F.aggregate(vector, F.lit(0.0), lambda a, e: a + e["w"] * e["w"])
        return _let(F.sqrt(total), lambda norm: F.array_max(F.array(*[option(vector, norm, name, v) for name, v in vectors])))

    def option(vector: Column, norm: Column, name: str, v: dict[str, float]) -> Column:
        own, length = table(v), math.sqrt(sum(y * y for y in v.values()))
        dot = F.aggregate(vector, F.lit(0.0), lambda a, e: a + e["w"] * F.coalesce(F.try_element_at(own, e["t"]), F.lit(0.0)))
        return F.struct(F.when(norm > 0, F.round(dot / (norm * length), 6)).otherwise(0.0).alias("score"), F.lit(name).alias("licence"))

    return _let(terms(s), lambda w: _let(weighted(w), score))


def op2_licences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text, source, lang): doc_id, licence, score, origin, directory. A document's path is source/lang/doc_id.

    Nulls: a null text is an empty one; null parts of a path are empty; a null licence means that none was found. Repeated rows of one path are repeated in the result, with the licence that any of
    them has. Texts of any length are scanned whole. Empty table: no rows. Further columns are ignored.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    files = docs.select(F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    out = scan(files, Stage(spark, "licences"))
    return out.select(F.element_at(F.split("path", "/"), -1).try_cast("long").alias("doc_id"), "licence", "score", "origin", "directory")


def _sql_templates() -> str:
    return ", ".join("('%s', %d, '%s')" % (name, k, x.replace("'", "''")) for k, (name, x) in enumerate(TEMPLATES))


ORACLE_SQL = rf"""
WITH tpl AS (SELECT licence, k, list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS w FROM (VALUES {_sql_templates()}) AS v(licence, k, x)),
tt AS (SELECT licence, k, t, count(*) AS c FROM (SELECT licence, k, unnest(w) AS t FROM tpl) GROUP BY ALL),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS dir, coalesce(text, '') AS text,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM documents),
n AS (SELECT count(*) AS n FROM d),
df AS (
  SELECT t, count(*) AS df FROM (SELECT DISTINCT r, t FROM (
    SELECT r, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'))) AS t FROM d) WHERE t IN (SELECT t FROM tt)) GROUP BY t),
idf AS (SELECT t, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM (SELECT DISTINCT t FROM tt) LEFT JOIN df USING (t), n),
tv AS (SELECT licence, k, t, c * idf AS w FROM tt JOIN idf USING (t)),
tn AS (SELECT licence, k, sqrt(sum(w * w)) AS len FROM tv GROUP BY ALL),
seg AS (SELECT DISTINCT s FROM (SELECT unnest(lines) AS s FROM d)),
sw AS (SELECT s, t, count(*) AS c FROM (SELECT s, unnest(list_filter(regexp_split_to_array(lower(s), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS t FROM seg) GROUP BY ALL),
sv AS (SELECT s, t, c * coalesce(idf, ln(n + 1)) AS w FROM sw LEFT JOIN idf USING (t), n),
sn AS (SELECT s, sqrt(sum(w * w)) AS len FROM sv GROUP BY s HAVING sum(w * w) > 0),
cosine AS (SELECT s, licence, k, sum(sv.w * tv.w) AS dot FROM sv JOIN tv USING (t) GROUP BY ALL),
best AS (
  SELECT s, max({{'score': round(dot / (sn.len * tn.len), 6), 'licence': licence}}) AS b
  FROM cosine JOIN sn USING (s) JOIN tn USING (licence, k) GROUP BY s HAVING max(round(dot / (sn.len * tn.len), 6)) >= {THRESHOLD}),
own AS (
  SELECT doc_id, dir, any_value(nl) AS nl, max(b) AS b, count(*) AS hits
  FROM (SELECT r, doc_id, dir, len(lines) AS nl, unnest(lines) AS s FROM d) JOIN best USING (s) GROUP BY r, doc_id, dir),
has AS (SELECT dir, max({{'score': b.score, 'licence': b.licence}}) AS b FROM own WHERE 2 * hits >= nl GROUP BY dir),
up AS (
  SELECT q.dir, h.dir AS directory, h.b, row_number() OVER (PARTITION BY q.dir ORDER BY length(h.dir) DESC) AS k
  FROM (SELECT DISTINCT dir FROM d) q JOIN has h ON q.dir = h.dir OR starts_with(q.dir, h.dir || '/') OR h.dir = '')
SELECT d.doc_id, coalesce(own.b.licence, up.b.licence) AS licence, coalesce(own.b.score, up.b.score) AS score,
  CASE WHEN own.b IS NOT NULL THEN 'own' WHEN up.b IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.b IS NULL THEN up.directory END AS directory
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN up ON up.dir = d.dir AND up.k = 1
"""
