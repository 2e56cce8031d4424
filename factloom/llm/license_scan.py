"""Licence scan: templates found in texts by MinHash bands over overlapping windows.

Words are runs of letters and digits, lower-cased, so punctuation and line breaks do not matter. Bands
retrieve templates for windows sized like them, with the collision probabilities given in
``containment``, and a template matches where 80 % or more of its five-word shingles are present.

Defined results: null or empty texts match nothing; rows sharing a document id are read as one; rows
without an id are left out; ties, a document matching several templates, give one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.containment import contained, shingled

# The customary notices of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words(text: str = "text") -> Column:
    return F.split(F.lower(text), "[^\\p{L}\\p{N}]+")


def license_matches(docs: DataFrame, templates: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, license, n_common, n_template, first_word`` of every template found in a document."""
    left = docs.select(F.col("doc_id").alias("doc"), "text").filter("doc is not null")
    right = templates.select(F.col("license").alias("item"), "text").filter("item is not null")
    found = contained(shingled(left, words(), "doc"), shingled(right, words(), "item"), percent)
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("license"), "n_common",
        F.col("n_item").alias("n_template"), F.col("first_word").cast("long").alias("first_word"),
    )


def templates(spark) -> DataFrame:
    fields = [T.StructField("license", T.StringType()), T.StructField("text", T.StringType())]
    return spark.createDataFrame(list(TEMPLATES), T.StructType(fields))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), templates(spark))


_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
SQL = rf"""
WITH t(license, text) AS (VALUES {_VALUES}), d AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), q AS (SELECT license AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t
), ds AS (
  SELECT id, p - 1 AS p, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p+4], ' ') END AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)
), qs AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM q
), n AS (SELECT id, count(*) AS n_template FROM qs GROUP BY id)
SELECT ds.id AS doc_id, qs.id AS license, count(DISTINCT qs.s) AS n_common, any_value(n_template) AS n_template,
  min(p) AS first_word
FROM ds JOIN qs USING (s) JOIN n ON n.id = qs.id
GROUP BY ds.id, qs.id HAVING 100 * count(DISTINCT qs.s) >= 80 * any_value(n_template)
"""
