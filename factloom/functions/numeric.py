"""Numeric values to vectors: per-relation scaling and the embedding forms, as expressions.

Fitted scalers hold a few numbers per relation and weight tables a few vectors; both are broadcast
only after a check of their size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vectors as V
from factloom.functions.hashing import unit
from factloom.functions.ordered import exact_quantiles
from factloom.session import broadcast_if_small, stored_broadcast

N_QUANTILES = 20
WEIGHT_ROW_BYTES = 8 * 1024  # a few vectors of some hundred numbers


def fit_quantiles(triples: DataFrame, n_quantiles: int = N_QUANTILES) -> DataFrame:
    """``(rel, quantiles array<double>)``: evenly spaced exact quantiles of each numeric relation."""
    numeric = triples.filter("kind = 'num'").select("rel", "tail_val")
    points = exact_quantiles(numeric, ["rel"], "tail_val", n_quantiles)
    ordered = F.sort_array(F.collect_list(F.struct("prob_index", "quantile")))  # n_quantiles long
    return points.groupBy("rel").agg(F.transform(ordered, lambda p: p["quantile"]).alias("quantiles"))


def quantile_position(x: Column, q: Column, at_most: Column, below: Column) -> Column:
    """Piecewise-linear rank of ``x`` among quantiles ``q``, in [0, 1].

    ``at_most`` and ``below`` count the quantiles ``<= x`` and ``< x``. Where quantiles repeat,
    the mean of the rank read from below and from above.
    """
    m = F.size(q)
    step = F.lit(1.0) / F.greatest(m - 1, F.lit(1))
    item = lambda i: F.get(q, i)  # noqa: E731  (null outside the array)
    upper = (
        F.when(at_most == 0, 0.0)
        .when(at_most >= m, 1.0)
        .otherwise(((at_most - 1) + (x - item(at_most - 1)) / (item(at_most) - item(at_most - 1))) * step)
    )
    lower = (
        F.when(below == 0, 0.0)
        .when(below >= m, 1.0)
        .otherwise((below - (item(below) - x) / (item(below) - item(below - 1))) * step)
    )
    return F.when(x <= item(F.lit(0)), 0.0).when(x >= item(m - 1), 1.0).otherwise((upper + lower) / 2)


def apply_quantiles(triples: DataFrame, fitted: DataFrame, out: str = "x") -> DataFrame:
    x, q = F.col("tail_val"), F.col("quantiles")
    counted = triples.join(stored_broadcast(fitted, 512), "rel").select(
        "*",
        F.size(F.filter(q, lambda v: v <= x)).alias("_at_most"),
        F.size(F.filter(q, lambda v: v < x)).alias("_below"),
    )
    position = quantile_position(x, q, F.col("_at_most"), F.col("_below"))
    return counted.withColumn(out, position).drop("quantiles", "_at_most", "_below")


def fit_min_max(triples: DataFrame) -> DataFrame:
    return (
        triples.filter("kind = 'num' and not isnan(tail_val)")
        .groupBy("rel")
        .agg(F.min("tail_val").alias("low"), F.max("tail_val").alias("high"))
    )


def apply_min_max(triples: DataFrame, fitted: DataFrame, out: str = "x") -> DataFrame:
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    scaled = (F.col("tail_val") - F.col("low")) / width
    return (
        triples.join(stored_broadcast(fitted, 512), "rel")
        .withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
        .drop("low", "high")
    )


def apply_identity(triples: DataFrame, out: str = "x") -> DataFrame:
    return triples.withColumn(out, F.col("tail_val"))


def scale_values(triples: DataFrame, transformer: str | None, out: str = "x") -> DataFrame:
    """Fit the named transformer on the numeric triples and apply it to them."""
    numeric = triples.filter("kind = 'num'")
    if transformer == "quantile":
        return apply_quantiles(numeric, fit_quantiles(numeric), out)
    if transformer == "min_max":
        return apply_min_max(numeric, fit_min_max(numeric), out)
    return apply_identity(numeric, out)


def normalize_rows(v: Column, p: int) -> Column:
    return V.scale(v, F.lit(1.0) / F.greatest(V.p_norm(v, p), F.lit(1e-12)))


def bin_row(x: Column, rel: Column, n_bins: int) -> Column:
    """Row of the bin-vector table: ``rel * n_bins`` + number of boundaries strictly below x."""
    bounds = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    return (rel * n_bins + F.size(F.filter(bounds, lambda b: b < x))).cast("long")


def bin_embedding(values: DataFrame, bins: DataFrame, n_bins: int, x: str = "x") -> DataFrame:
    """Attach the vector of each value's bin; ``bins`` has ``(bin, vec)``."""
    return values.withColumn("bin", bin_row(F.col(x), F.col("rel"), n_bins)).join(broadcast_if_small(bins, WEIGHT_ROW_BYTES), "bin")


def linear_form(x: Column, w: Column, b: Column, activation: str | None) -> Column:
    return V.activate(F.zip_with(w, b, lambda wi, bi: wi * x + bi), activation)


def interpolated_form(x: Column, e1: Column, e2: Column, activation: str | None) -> Column:
    return V.activate(F.zip_with(e1, e2, lambda a, b: x * a + (1 - x) * b), activation)


def mixture_form(
    x: Column, w1: Column, b1: Column, w2: Column, b2: Column, basis: Column, activation: str | None
) -> Column:
    """Softmax-weighted sum of the ``basis`` vectors; weights from a two-layer net on ``x``."""
    hidden = V.activate(F.zip_with(w1, b1, lambda w, b: w * x + b), "relu")
    logits = V.let(hidden, lambda h: V.add(V.matvec(w2, h), b2))
    powers = V.let(logits, lambda z: F.transform(z, lambda zi: F.exp(zi - F.array_max(z))))
    weights = V.let(powers, lambda p: V.scale(p, F.lit(1.0) / V.total(p)))
    mixed = F.aggregate(
        F.zip_with(weights, basis, lambda w, v: F.transform(v, lambda vi: vi * w)),
        F.transform(F.get(basis, F.lit(0)), lambda _: F.lit(0.0)),
        V.add,
    )
    return V.activate(mixed, activation)


def linear_embedding(values: DataFrame, weights: DataFrame, activation: str | None, x: str = "x") -> DataFrame:
    """``weights`` has ``(rel, w, b)``."""
    return (
        values.join(broadcast_if_small(weights, WEIGHT_ROW_BYTES), "rel")
        .withColumn("vec", linear_form(F.col(x), F.col("w"), F.col("b"), activation))
        .drop("w", "b")
    )


def interp_embedding(values: DataFrame, weights: DataFrame, activation: str | None, x: str = "x") -> DataFrame:
    """``weights`` has ``(rel, e1, e2)``."""
    return (
        values.join(broadcast_if_small(weights, WEIGHT_ROW_BYTES), "rel")
        .withColumn("vec", interpolated_form(F.col(x), F.col("e1"), F.col("e2"), activation))
        .drop("e1", "e2")
    )


def mixture_embedding(values: DataFrame, weights: DataFrame, activation: str | None, x: str = "x") -> DataFrame:
    """``weights`` has ``(rel, w1, b1, w2, b2, basis)``."""
    parts = [F.col(c) for c in ("w1", "b1", "w2", "b2", "basis")]
    return (
        values.join(broadcast_if_small(weights, WEIGHT_ROW_BYTES), "rel")
        .withColumn("vec", mixture_form(F.col(x), *parts, activation))
        .drop("w1", "b1", "w2", "b2", "basis")
    )


def random_vector(id_: Column, dim: int, how: str, seed: int, tag: str = "") -> Column:
    """Reproducible start vector of an id.

    ``xavier_uniform``: uniform within sqrt(6 / dim); ``xavier_normal``: normal with deviation
    sqrt(2 / dim); ``normal``: normal with deviation 1e-3; ``zeros``.
    """
    if how == "zeros":
        return F.array_repeat(F.lit(0.0), dim)
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    u = lambda i, part: unit(F.lit(seed), F.lit(tag), F.lit(part), id_, i)
    if how == "xavier_uniform":
        bound = math.sqrt(6.0 / dim)
        return F.transform(places, lambda i: (2 * u(i, "u") - 1) * bound)
    deviation = {"xavier_normal": math.sqrt(2.0 / dim), "normal": 1e-3}[how]
    return F.transform(
        places,
        lambda i: F.sqrt(-2 * F.log(u(i, "r"))) * F.cos(2 * math.pi * u(i, "a")) * deviation,
    )


# Start distribution per scoring model.
INITIALIZERS = {"translation": "xavier_uniform", "bilinear": "xavier_normal", "relation_scaled": "normal"}


def init_params(ids: DataFrame, id_col: str, dim: int, how: str, seed: int, tag: str = "") -> DataFrame:
    return ids.select(id_col, random_vector(F.col(id_col), dim, how, seed, tag).alias("vec"))
