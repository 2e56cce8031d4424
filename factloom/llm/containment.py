"""MinHash containment search of short items inside long texts, in DataFrame operations only.

Items are partitioned by size: class ``c`` holds those with ``2**c`` to ``2**(c+1) - 1`` shingle positions. Long
texts are read in overlapping windows of each class, twice its largest item and half of that
apart, so every occurrence lies inside one window of a size like its own and containment becomes a fair
Jaccard similarity. Only shingles that some item of the class has are put into a window's set:
others cannot change which part of an item it contains. Each of ``HASHES`` bands is one minimum; an item
and a window that share one become a candidate, and exact containment decides.

An item of ``n`` shingles contained to 0.8 in a window has a Jaccard similarity of at least 0.19 to it, even
if the whole window consists of other items' shingles, and is missed with probability
``0.81 ** HASHES`` = 4e-5; where the window holds little else, at 0.7, with 1e-25.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import broadcast_if_small, pin

HASHES = 48
SHINGLE = 5


def shingled(texts: DataFrame, words: Column, key: str, size: int = SHINGLE) -> DataFrame:
    """``key, pos, shingle`` for every position; a shorter text is one shingle, its whole sequence."""
    found = texts.select(key, F.filter(words, lambda w: w != "").alias("words"))
    hashed = found.select(
        key, F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").alias("n_words")
    ).filter("n_words > 0")
    at = lambda i, k: F.get("h", i + k)
    full = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - size), lambda i: F.xxhash64(*[at(i, k) for k in range(size)])
    )
    whole = F.array(F.aggregate("h", F.xxhash64(F.col("n_words")), lambda a, x: F.xxhash64(a, x)))
    shingles = F.when(F.col("n_words") >= size, full).otherwise(whole)
    return hashed.select(key, F.posexplode(shingles).alias("pos", "shingle"))


def _minima(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each group and band: ``band, least``."""
    named = [F.min(F.xxhash64("shingle", F.lit(j))).alias(f"m{j}") for j in range(HASHES)]
    wide = rows.groupBy(*keys).agg(*named)
    return wide.select(*keys, F.posexplode(F.array(*[f"m{j}" for j in range(HASHES)])).alias("band", "least"))


def contained(doc_shingles: DataFrame, item_shingles: DataFrame, percent: int = 80) -> DataFrame:
    """``doc, item, n_common, n_item, first_word`` of the items contained to ``percent`` in a document.

    ``doc_shingles(doc, pos, shingle)`` is read once; the items' tables are broadcast only if small.
    """
    items = pin(item_shingles)
    sizes = items.groupBy("item").agg(
        F.count("*").alias("positions"), F.countDistinct("shingle").alias("n_item")
    )
    sizes = sizes.withColumn("class", F.floor(F.log2("positions")).cast("int")).select("item", "class", "n_item")
    owned = pin(items.select("item", "shingle").distinct().join(sizes, "item"))
    vocabulary = owned.select("shingle").distinct()
    hits = pin(doc_shingles.join(broadcast_if_small(vocabulary, 64), "shingle", "left_semi"))
    classes = broadcast_if_small(owned.select("shingle", "class").distinct(), 64)
    width = F.expr("shiftleft(2, class)")
    start = F.floor(F.col("pos") / width)
    windows = hits.join(classes, "shingle").select(
        "doc", "class", "shingle", F.explode(F.array(start, start - 1)).alias("window")
    )
    bands = _minima(windows, "doc", "class", "window")
    targets = _minima(owned, "item", "class").withColumnRenamed("item", "candidate")
    pairs = (
        bands.join(broadcast_if_small(targets, 64), ["class", "band", "least"])
        .select("doc", F.col("candidate").alias("item"))
        .distinct()
    )
    common = (
        hits.groupBy("doc", "shingle")
        .agg(F.min("pos").alias("pos"))
        .join(broadcast_if_small(owned, 64), "shingle")
        .join(pairs, ["doc", "item"])
    )
    return (
        common.groupBy("doc", "item")
        .agg(F.count("*").alias("n_common"), F.first("n_item").alias("n_item"), F.min("pos").alias("first_word"))
        .filter(100 * F.col("n_common") >= percent * F.col("n_item"))
    )
