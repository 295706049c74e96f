"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest directory (native).

The *header* of a file is what its licence-like lines say: all lines of the whole text that
hold one of ``MARKS``.  The words of the header are weighed by TF-IDF, with document
frequencies of the templates, and compared with every template by sparse cosine: a join on
words with the templates' few hundred weights.  The best template from ``SIMILARITY`` on is
the file's own licence.  A *licence file* is one whose name says so, or whose header makes
up ``FILE_SHARE`` per cent of its words, or which is a whole licence text (``WHOLE``).

Texts with a licence-like line are also compared as a whole, on all their terms, with the
full licence texts in ``licenses/``.  In licence files the better of both cosines counts.

Files without a licence of their own inherit that of the nearest ancestor directory, their
own included, that holds a licence file.  Directories are joined with their ancestors by
path, so only distinct directories are expanded, never files; of several licence files in a
directory the one of the best cosine counts, then the least path.

Edge cases: a null or empty text has no header; a null path is a file in the root; equal
cosines go to the template name first in order; repeated rows are scanned alike; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrain.llm.common import WORD, staged, table

SIMILARITY = 0.45
FILE_SHARE = 40
#: Cosine of whole texts from which a file of any name is a licence file.
WHOLE = 0.8

#: Parts of words that make a line licence-like (lower case).
MARKS = "licen copyright permission warrant redistribut spdx"
#: Names of licence files (lower case, up to an extension).
FILES = "license licence copying notice unlicense"
#: Notices by licence, as their licensors ask files to carry them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the BSD 3-Clause License conditions are met.",
    "CC-BY-4.0": "This work is licensed under CC BY 4.0, a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under CC BY-NC 4.0, a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT (full)": "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense.",
}

#: Full licence texts by licence (Debian's common licences, MIT, BSD-2-Clause, Unlicense; without the holders' lines).
FULL = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}

#: A word of a header or template: lower-case letters, digits and inner dots or dashes.
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def template_weights(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """``license, term, weight, idf``: TF-IDF vectors of length 1 (a few hundred rows)."""
    rows = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")
    n = len(templates or TEMPLATES)
    tf = rows.select("license", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "term").agg(F.count("*").alias("tf"))
    df = Window.partitionBy("term")
    idf = F.log((1.0 + n) / (1.0 + F.count("*").over(df))) + 1.0
    w = tf.withColumn("idf", idf).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return w.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license")))).select("license", "term", "weight", "idf")


def headers(files: DataFrame) -> DataFrame:
    """``path, text, header, n_words`` of files with a licence-like line; others are dropped by one pattern before any line is split."""
    marks = "(?i)" + "|".join(MARKS.split())
    found = files.filter(F.col("text").rlike(marks))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(marks))
    return found.select("path", "text", F.array_join(lines, "\n").alias("header"), F.regexp_count("text", F.lit(WORD)).alias("n_words"))


def cosines(texts: DataFrame, key: str, text: str, templates: dict[str, str]) -> DataFrame:
    """``key, license, cosine`` of the best template of each distinct text; none without a common word."""
    weights = template_weights(texts.sparkSession, templates)
    words = texts.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    # the templates are a fixed table; a word that no template has weighs as much as the rarest
    unseen = F.log(F.lit(1.0 + len(templates))) + 1.0
    idf = weights.select("term", "idf").distinct()
    words = words.join(F.broadcast(idf), "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", unseen)).drop("idf")
    length = words.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = words.join(F.broadcast(weights), "term").groupBy(key, "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    both = dots.join(length, key).select(key, "license", F.round(F.col("dot") / F.col("length"), 6).alias("cosine"))
    return both.groupBy(key).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best")).select(key, F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"))


def own_licenses(files: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY, full: dict[str, str] | None = None) -> DataFrame:
    """``path, license, cosine, is_file`` of files whose header is like a template, or that as a whole are like a full licence text."""
    found = headers(files).withColumns({"_header": F.sha2("header", 256), "_text": F.sha2("text", 256)})
    found = staged(found, "headers")
    by_header = cosines(found.dropDuplicates(["_header"]), "_header", "header", templates or TEMPLATES)
    by_text = cosines(found.dropDuplicates(["_text"]), "_text", "text", full or FULL).select("_text", F.col("license").alias("_l"), F.col("cosine").alias("_c"))
    share = 100 * F.regexp_count("header", F.lit(WORD)) >= FILE_SHARE * F.col("n_words")
    named = F.lower(F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)).rlike(rf"^(?:{'|'.join(FILES.split())})(?:\.[^.]*)?$")
    both = found.select("path", "_header", "_text", (share | named).alias("_file")).join(by_header, "_header", "left").join(by_text, "_text", "left")
    is_file = F.col("_file") | F.coalesce(F.col("_c") >= WHOLE, F.lit(False))
    header = F.when(F.col("cosine") >= similarity, F.struct((-F.col("cosine")).alias("c"), "license"))
    whole = F.when(is_file & (F.col("_c") >= similarity), F.struct((-F.col("_c")).alias("c"), F.col("_l").alias("license")))
    best = both.select("path", is_file.alias("is_file"), F.least(header, whole).alias("b")).filter("b IS NOT NULL")
    # files that share a path: the best of them, a licence file first
    best = best.groupBy("path").agg(F.min(F.struct("b.c", "b.license", (~F.col("is_file")).alias("no_file"))).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), (~F.col("b.no_file")).alias("is_file"))


def directory(path: Column) -> Column:
    """All before the last slash; empty for the root."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """``path, license, cosine, origin, license_dir`` of the distinct paths of ``files`` (``path, text``).

    origin: ``own``, ``inherited`` or ``none``; license_dir: the directory inherited from.
    """
    own = staged(own_licenses(files, templates, similarity), "licenses")
    holders = own.filter("is_file").groupBy(directory(F.col("path")).alias("ancestor")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("b")).select("ancestor", F.col("b.license").alias("inherited"))
    paths = files.select("path").distinct().withColumn("dir", directory(F.col("path")))
    dirs = paths.select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    near = dirs.select("dir", up.alias("ancestor")).distinct().join(holders, "ancestor")
    near = near.groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "inherited")).alias("b")).select("dir", F.col("b.ancestor").alias("license_dir"), F.col("b.inherited").alias("inherited"))
    own = own.withColumnRenamed("path", "_p")
    rows = paths.join(own, paths["path"].eqNullSafe(own["_p"]), "left").join(near, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return rows.select("path", F.coalesce("license", "inherited").alias("license"), "cosine", origin.alias("origin"), F.when(F.col("license").isNull(), F.col("license_dir")).alias("license_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: ``source/lang/<thousand>/<doc_id>.txt`` with their texts."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    part = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none"))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), part, name).alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(table(spark, sf_dir, "documents"))
    found = scan(files.select("path", "text"))
    ids = files.select("doc_id", F.col("path").alias("_path"))
    return ids.join(found, ids["_path"].eqNullSafe(found["path"])).select("doc_id", "path", "license", "cosine", "origin", "license_dir")


def _sql_templates() -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))


_MARKED = "(?i)" + "|".join(MARKS.split())

QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL = {
    "op6_license_scan": rf"""
WITH f AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), 'none'),
    coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt') AS path FROM documents),
tpl(license, text) AS (VALUES {_sql_templates()}),
tt AS (SELECT license, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM tpl),
tf AS (SELECT license, term, count(*) AS tf FROM tt GROUP BY ALL),
ti AS (SELECT *, ln({len(TEMPLATES) + 1}.0::DOUBLE / (1.0 + count(*) OVER (PARTITION BY term))) + 1.0 AS idf FROM tf),
tw AS (SELECT *, (1 + ln(tf)) * idf AS w FROM ti),
tn AS (SELECT license, term, idf, w / sqrt(sum(w * w) OVER (PARTITION BY license)) AS weight FROM tw),
idf AS (SELECT DISTINCT term, idf FROM tn),
h AS (SELECT path, array_to_string([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_MARKED}')], chr(10)) AS header,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM f WHERE regexp_matches(text, '{_MARKED}')),
hw AS (SELECT path, header, n_words, term, count(*) AS tf FROM (SELECT path, header, n_words, unnest(regexp_extract_all(lower(header), '{TERM}')) AS term FROM (SELECT DISTINCT * FROM h)) GROUP BY ALL),
hv AS (SELECT hw.*, (1 + ln(tf)) * coalesce(idf, ln({len(TEMPLATES) + 1}.0::DOUBLE) + 1.0) AS w FROM hw LEFT JOIN idf USING (term)),
hl AS (SELECT path, header, n_words, sqrt(sum(w * w)) AS length FROM hv GROUP BY ALL),
hd AS (SELECT path, header, n_words, license, sum(w * weight) AS dot FROM hv JOIN tn USING (term) GROUP BY ALL),
hc AS (SELECT path, header, n_words, license, round(dot / length, 6) AS cosine FROM hd JOIN hl USING (path, header, n_words)),
hf AS (SELECT path, license, cosine, 100 * len(regexp_extract_all(header, '[^\x20\x09-\x0D]+')) >= {FILE_SHARE} * n_words AS is_file FROM hc WHERE cosine >= {SIMILARITY}),
own AS (SELECT * FROM hf QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license, is_file DESC) = 1),
holders AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS ancestor, license FROM own WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY cosine DESC, path) = 1),
near AS (SELECT f.path, ancestor, holders.license FROM f JOIN holders ON starts_with(f.path, ancestor || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path, f.doc_id ORDER BY length(ancestor) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.license, near.license) AS license, own.cosine,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.license IS NULL THEN near.ancestor END AS license_dir
FROM f LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""
}
