"""Scores of triples under given vectors.

``entities``: ``(entity_id, vec[, bias_h, bias_t])``; ``relations``: ``(rel, r[, diag])``;
``numeric``: tail vectors of numeric triples keyed by ``tid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vectors as V
from factloom.functions.numeric import WEIGHT_ROW_BYTES, interpolated_form
from factloom.session import broadcast_if_small


def route_tails(
    triples: DataFrame,
    entities: DataFrame,
    weights: DataFrame | None = None,
    activation: str | None = "relu",
    x: str = "x",
    heads: bool = False,
) -> DataFrame:
    """Add the tail vector ``t``: the entity's for a categorical triple, the interpolated
    embedding of the scaled value ``x`` for a numeric one (``weights``: ``rel, e1, e2[, num_bias]``).

    With biases in ``entities``, also ``t_bias``; a numeric tail takes its relation's bias. With ``heads``, also
    what ``attach_heads`` adds, before the embeddings are made: numeric triples then move once and without a vector.
    """
    biased = "bias_t" in entities.columns
    tails = entities.select(
        F.col("entity_id").alias("_key"),
        F.col("vec").alias("_tail_vec"),
        *([F.col("bias_t").alias("_tail_bias")] if biased else []),
    )
    # sorted by tail, so that equal vectors lie together and shrink in the next shuffle
    found = triples.filter("tail_id is not null").join(
        tails.hint("merge"), F.col("tail_id") == F.col("_key"), "left"
    ).drop("_key")
    # rows without a tail entity match none, so they stay where they are
    without = triples.filter("tail_id is null").select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in tails.schema if f.name != "_key"]
    )
    if heads:
        found, without = attach_heads(found, entities), attach_heads(without, entities)
    joined = found.unionByName(without)
    if weights is None:
        routed = joined.withColumnRenamed("_tail_vec", "t")
        return routed.withColumnRenamed("_tail_bias", "t_bias") if biased else routed
    value_vec = interpolated_form(F.col(x), F.col("e1"), F.col("e2"), activation)
    joined = joined.join(broadcast_if_small(weights, WEIGHT_ROW_BYTES), "rel", "left")
    routed = joined.withColumn("t", F.when(F.col("kind") == "num", value_vec).otherwise(F.col("_tail_vec")))
    if biased:
        routed = routed.withColumn(
            "t_bias", F.when(F.col("kind") == "num", F.col("num_bias")).otherwise(F.col("_tail_bias"))
        ).drop("_tail_bias", "num_bias")
    return routed.drop("_tail_vec", "e1", "e2")


def attach_heads(triples: DataFrame, entities: DataFrame) -> DataFrame:
    heads = entities.select(
        F.col("entity_id").alias("head"),
        F.col("vec").alias("h"),
        *([F.col("bias_h").alias("h_bias")] if "bias_h" in entities.columns else []),
    )
    return triples.join(heads, "head")


def translation_score(h: Column, r: Column, t: Column, p: int = 1) -> Column:
    return -V.distance(V.add(h, r), t, p)


def bilinear_score(h: Column, r: Column, t: Column) -> Column:
    return V.dot(V.multiply(h, r), t)


def relation_scaled_score(
    h: Column, diag: Column, r: Column, t: Column, h_bias: Column, t_bias: Column
) -> Column:
    gap = V.add(V.subtract(V.multiply(diag, h), t), r)
    return -V.total(F.transform(gap, lambda g: g * g)) + h_bias + t_bias


def score_triples(triples: DataFrame, relations: DataFrame, model: str, p: int = 1) -> DataFrame:
    """Add ``score`` to triples that carry ``h`` and ``t``; relation vectors are broadcast if small."""
    rows = triples.join(broadcast_if_small(relations, WEIGHT_ROW_BYTES), "rel")
    score = {
        "translation": lambda: translation_score(F.col("h"), F.col("r"), F.col("t"), p),
        "bilinear": lambda: bilinear_score(F.col("h"), F.col("r"), F.col("t")),
        "relation_scaled": lambda: relation_scaled_score(
            *[F.col(c) for c in ("h", "diag", "r", "t", "h_bias", "t_bias")]
        ),
    }[model]()
    return rows.withColumn("score", score)


def gate_literals(vectors: DataFrame, literals: DataFrame, weights: DataFrame) -> DataFrame:
    """Entity vectors mixed with their literals: ``z * tanh(W[x;l] + b) + (1 - z) * x`` with
    ``z = sigmoid(Gx x + Gl l + c)``. ``weights`` is one row ``(w, b, gx, gl, c)``."""
    rows = (
        vectors.join(literals, "entity_id")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(weights.withColumn("_one", F.lit(1))), "_one")
    )
    x, lit = F.col("vec"), F.col("literals")
    h = V.let(F.concat(x, lit), lambda both: V.activate(V.add(V.matvec(F.col("w"), both), F.col("b")), "tanh"))
    z = V.activate(V.add(V.add(V.matvec(F.col("gx"), x), V.matvec(F.col("gl"), lit)), F.col("c")), "sigmoid")
    staged = rows.select("entity_id", x.alias("_x"), h.alias("_h"), z.alias("_z"))
    mixed = F.transform(
        F.arrays_zip("_z", "_h", "_x"), lambda e: e["_z"] * e["_h"] + (1 - e["_z"]) * e["_x"]
    )
    return staged.select("entity_id", mixed.alias("vec"))
