"""Benchmark decontamination: test items found inside long documents by size-partitioned MinHash.

Words are runs of non-space characters, lower-cased; shingles have five words, and an item counts as
leaked if a document has 80 % or more of its distinct shingles. See ``containment`` for the search.

Defined results: null or empty texts and items match nothing; an item of fewer than five words is
one shingle and matches documents that consist of just these words; rows sharing a document or
item id are read as one; rows whose id is null are left out of the pairs and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.containment import contained, shingled
from factloom.session import broadcast_if_small


def words(text: str = "text") -> Column:
    return F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_common, n_item`` for every item contained in a document."""
    left = docs.select(F.col("doc_id").alias("doc"), "text").filter("doc is not null")
    right = items.select(F.col("item_id").alias("item"), "text").filter("item is not null")
    found = contained(shingled(left, words(), "doc"), shingled(right, words(), "item"), percent)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_common", "n_item")


def clean(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that contain no item, with the columns they came with."""
    found = leaks(docs, items, percent).select("doc_id").distinct()
    return docs.join(broadcast_if_small(found, 64), "doc_id", "left_anti").select(*docs.columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), q AS (
  SELECT item_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), ds AS (
  SELECT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM d WHERE len(w) > 0
), qs AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM q WHERE len(w) > 0
), n AS (SELECT id, count(*) AS n_item FROM qs GROUP BY id)
SELECT ds.id AS doc_id, qs.id AS item_id, count(DISTINCT qs.s) AS n_common, any_value(n_item) AS n_item
FROM ds JOIN qs USING (s) JOIN n ON n.id = qs.id
GROUP BY ds.id, qs.id HAVING 100 * count(DISTINCT qs.s) >= 80 * any_value(n_item)
"""
