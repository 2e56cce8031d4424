"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on text statistics, fitted on at most ``MAX_LABELLED`` labelled rows (those with the
smallest hash of their id), gives each document its own evidence. Its probabilities are summed for each
host and each path of a host, by grouped aggregation over all documents. Beta priors are fitted by
moments: hosts shrink toward the global mean with the strength that the spread of host means
supports, paths toward their host's posterior likewise. The document's log-odds are then moved by how
far its path's posterior stands from the global mean, so sparse sites change nothing.

Defined results: null and empty texts have all-zero statistics and are judged like any other; null
hosts and paths are sites of their own; repeated rows count once each; without labels of both
classes the classifier gives every document the smoothed share.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.text import WORD, per_document
from factloom.session import broadcast_if_small, pin

MAX_LABELLED = 20_000
KEEP_AT = 0.5
SITE_WEIGHT = 0.5
_STRENGTH = (1.0, 1e6)


def statistics(text: str) -> list[float]:
    """Length, shapes of words and characters, and repetition, each of moderate size."""
    words = WORD.findall(text)
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * 10
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    alpha = sum(1 for w in words if w.strip(".,;:!?").isalpha())
    marks = sum(text.count(c) for c in "#*$%&|<>!")
    return [
        np.log1p(n) / 5, min(sum(map(len, words)) / n / 10, 3.0), upper / n, alpha / n, min(marks / n, 2.0),
        len(counts) / n, counts.most_common(1)[0][1] / n, 1 - len(set(lines)) / len(lines),
        sum(c.isdigit() for c in text) / chars, float(n < 50),
    ]


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps for a ridge logistic regression: means, scales, coefficients with the bias last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p) / len(y))[:, None]).T @ z + penalty * np.eye(len(w))
        w = w - np.linalg.solve(hess, z.T @ (p - y) / len(y) + penalty * w)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED):
    """The classifier learnt from ``labels(doc_id, y)``; None, share if they hold one class only."""
    chosen = (
        labels.filter("y is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    made = per_document(
        sample, lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], "x array<double>", ["y"]
    )
    rows = made.select("row.y", "x").toArrow()
    y = np.array(rows.column(0).to_pylist(), dtype=float)
    if not len(y) or y.min() == y.max():
        return None, (y.sum() + 1) / (len(y) + 2)
    return _fit(np.array(rows.column(1).to_pylist()), y), None


def document_evidence(docs: DataFrame, model, carry) -> DataFrame:
    """``row`` (the carried columns) with the classifier's probability ``p``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]):
        fitted, share = held.value
        if fitted is None:
            return [pa.array([float(share)] * len(texts))]
        mean, scale, w = fitted
        z = (np.array([statistics(t) for t in texts]) - mean) / scale @ w[:-1] + w[-1]
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

    return per_document(docs, score, "p double", carry)


def _strength(groups: DataFrame, prior: Column) -> float:
    """Prior strength by moments: how much more group means vary than their sizes explain."""
    r = groups.select(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - prior) ** 2).alias("spread"),
        F.sum(prior * (1 - prior)).alias("chance"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("weight"),
        F.sum("n").alias("n"),
    ).first()
    if not r["n"] or not r["weight"]:
        return _STRENGTH[1]
    between = (r["spread"] - r["chance"]) / r["n"]
    return float(np.clip(r["weight"] / r["n"] / between - 1, *_STRENGTH)) if between > 0 else _STRENGTH[1]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def with_site_priors(evidence: DataFrame) -> DataFrame:
    """``host, path, p`` rows with ``host_p``, ``path_p`` (posterior means) and the combined ``score``."""
    paths = pin(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = F.lit((total["s"] or 0.0) / total["n"] if total["n"] else 0.5)
    k = _strength(hosts, overall)
    hosts = hosts.select(
        F.col("host").alias("_host"), ((F.col("s") + k * overall) / (F.col("n") + k)).alias("host_p")
    )
    sites = paths.join(broadcast_if_small(hosts, 64), F.expr("host <=> _host")).drop("_host")
    k = _strength(sites, F.col("host_p"))
    sites = sites.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "host_p",
        ((F.col("s") + k * F.col("host_p")) / (F.col("n") + k)).alias("path_p"),
    )
    joined = evidence.join(broadcast_if_small(pin(sites), 128), F.expr("host <=> _host and path <=> _path"), "left")
    moved = _logit(F.col("p")) + SITE_WEIGHT * (_logit(F.col("path_p")) - _logit(overall))
    return joined.drop("_host", "_path").withColumn("score", 1 / (1 + F.exp(-moved)))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages within a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    scored = document_evidence(docs, fit(docs, labels), ["doc_id", "source", "lang"])
    evidence = pin(
        scored.select("row.doc_id", F.col("row.source").alias("host"), F.col("row.lang").alias("path"), "p")
    )
    return with_site_priors(evidence).withColumn("kept", F.col("score") >= KEEP_AT)
