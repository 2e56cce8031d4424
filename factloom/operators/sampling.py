"""Corrupted negatives drawn from the members of the same relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.hashing import draw
from factloom.functions.ordered import ROWS_PER_BUCKET, number_in_groups
from factloom.session import pin, stored_broadcast

HEAD, TAIL = 0, 1


def corruption_candidates(triples: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(rel, side, cand_id, cand_val, position)``: the distinct heads of a relation followed by
    its distinct tails, numbered contiguously from 0."""
    side = lambda code, id_, val: F.struct(
        F.lit(code).alias("side"), id_.alias("cand_id"), val.alias("cand_val")
    )
    members = pin(
        triples.select(
            "rel",
            F.inline(
                F.array(
                    side(HEAD, F.col("head"), F.lit(None).cast("double")),
                    side(TAIL, F.col("tail_id"), F.col("tail_val")),
                )
            ),
        ).distinct()
    )
    numbered = number_in_groups(members, ["rel", "side"], ["cand_id", "cand_val"], "position", rows_per_bucket)
    heads = members.filter(F.col("side") == HEAD).groupBy("rel").agg(F.count(F.lit(1)).alias("n_heads"))
    shift = F.when(F.col("side") == TAIL, F.col("n_heads")).otherwise(0)
    return numbered.join(stored_broadcast(heads, 64), "rel").select(
        "rel", "side", "cand_id", "cand_val", (F.col("position") + shift).alias("position")
    )


def corrupt_triples(positives: DataFrame, candidates: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` negatives per positive; each replaces one side by a uniform draw over the relation's
    candidates (best a stored table: it is read twice). ``positives`` carries a ``pos_id`` on which
    the draws depend.

    A draw is an equi-join on (relation, drawn position): one row per draw, spread evenly even
    when one relation has most of the triples.
    """
    choices = candidates.groupBy("rel").agg(F.count(F.lit(1)).alias("n_choices"))
    draws = (
        positives.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .join(stored_broadcast(choices, 64), "rel")
        .withColumn("position", draw(F.col("n_choices"), F.lit(seed), "pos_id", "k"))
    )
    is_head = F.col("side") == HEAD
    return draws.join(candidates, ["rel", "position"]).select(
        "pos_id",
        "k",
        "rel",
        "kind",
        F.when(is_head, F.col("cand_id")).otherwise(F.col("head")).alias("head"),
        F.when(is_head, F.col("tail_id")).otherwise(F.col("cand_id")).alias("tail_id"),
        F.when(is_head, F.col("tail_val")).otherwise(F.col("cand_val")).alias("tail_val"),
    )
