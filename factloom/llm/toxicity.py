"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Learning takes at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id;
that bound is the operator's only limit. Feature counts and the rows' features are made by the
executors; the driver receives the counts of ``BUCKETS`` hashed n-grams' best ``MAX_FEATURES`` and
the sample's hits among them, all bounded by parameters. Scoring reads every text in full.

Defined results: a null or empty text scores by the bias alone; without both classes among the
labels every score is the smoothed share of toxic rows; rows with equal texts score alike; labels
that are null are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.text import MULTIPLIERS, mix, per_document, small_batches
from factloom.session import pin

SIZES = (5, 6)
BUCKETS = 1 << 20
MAX_LABELLED = 20_000
MAX_FEATURES = 20_000
MIN_DOCUMENTS = 3
MIN_Z = 2.5
THRESHOLD = 0.3


def ngrams(text: str) -> np.ndarray:
    """Buckets of the character n-grams of one text, lower-cased and framed by spaces; with repeats."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    parts = []
    for size in SIZES:
        n = len(points) - size + 1
        if n > 0:
            total = np.full(n, MULTIPLIERS[100 + size])
            for k in range(size):
                total += points[k : k + n] * MULTIPLIERS[k]
            parts.append((mix(total) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def class_counts(sample: DataFrame) -> DataFrame:
    """(bucket, toxic rows, other rows): documents holding each n-gram, summed inside tasks first."""
    small_batches(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[1 if y else 0][np.unique(ngrams(text or ""))] += 1
        found = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        for at in range(0, len(found), 65536):
            part = found[at : at + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[1][part]), pa.array(counts[0][part])], ["bucket", "pos", "neg"]
            )

    made = sample.select("text", "y").mapInArrow(run, "bucket int, pos int, neg int")
    return made.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit_weights(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 200, penalty: float = 1.0):
    """Logistic regression on ratio-scaled presence features by Adam on the full sample."""
    lengths = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), lengths)
    index = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    scaled = ratio[index]
    w, bias = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[index] * scaled, minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.append(
            np.bincount(index, error[at] * scaled, minlength=len(ratio)) / len(y) + penalty * w / len(y), error.mean()
        )
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w * ratio, bias


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and bias learnt from ``labels(doc_id, y)``."""
    chosen = (
        labels.filter("y is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    )
    sample = pin(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y"))
    sizes = {bool(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    prior = float(np.log((pos + 1) / (neg + 1)))
    nothing = np.zeros(0, dtype=np.int64), np.zeros(0), prior
    if not pos or not neg:
        return nothing
    share = [(F.col(c) + 1) / F.lit(float(n + 2)) for c, n in (("pos", pos), ("neg", neg))]
    ratio = F.log(share[0] / share[1])
    z = ratio / F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))
    best = (
        class_counts(sample)
        .filter(F.col("pos") + F.col("neg") >= MIN_DOCUMENTS)
        .select("bucket", ratio.alias("ratio"), F.abs(z).alias("z"))
        .filter(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "bucket")
        .limit(MAX_FEATURES)
        .collect()
    )
    if not best:
        return nothing
    best.sort(key=lambda r: r["bucket"])
    buckets, ratios = np.array([r["bucket"] for r in best]), np.array([r["ratio"] for r in best])
    place = sample.sparkSession.sparkContext.broadcast(buckets)

    def hits(texts: list[str]):
        known, out = place.value, []
        lookup = np.full(BUCKETS, -1, dtype=np.int32)
        lookup[known] = np.arange(len(known))
        for text in texts:
            found = lookup[ngrams(text)]
            out.append(np.unique(found[found >= 0]))
        return [pa.array(out, type=pa.list_(pa.int32()))]

    got = per_document(sample, hits, "hits array<int>", ["y"]).select("row.y", "hits").toArrow()
    rows = [np.array(x, dtype=np.int32) for x in got.column(1).to_pylist()]
    y = np.array(got.column(0).to_pylist()).astype(float)
    weights, bias = fit_weights(rows, y, ratios)
    return buckets, weights, bias


def toxicity(docs: DataFrame, model, carry, text: str = "text") -> DataFrame:
    """``row`` (the carried columns) with ``score``, the model's probability for each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]):
        buckets, weights, bias = held.value
        table = np.zeros(BUCKETS, dtype=np.float32)
        table[buckets] = weights
        out = []
        for t in texts:
            found = ngrams(t)
            found = np.unique(found[table[found] != 0])
            z = float(np.clip(bias + table[found].sum(dtype=np.float64), -30, 30))
            out.append(1 / (1 + np.exp(-z)))
        return [pa.array(out, type=pa.float64())]

    return per_document(docs, score, "score double", carry, text)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(~held_out()).select("doc_id", F.col("toxic").alias("y")))
    return toxicity(docs, model, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), held_out_of("row.doc_id"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def held_out_of(name: str):
    return (F.crc32(F.col(name).cast("string")) % 4 == 2).alias("held_out")
