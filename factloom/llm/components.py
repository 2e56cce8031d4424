"""Connected components of a large sparse graph by repeated joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import pin


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest reachable node for every node of ``edges(a, b)``.

    Each round, every node takes the smallest root among its own and its neighbours', and roots
    are then looked up in turn, which halves long chains. Rounds end when no root changes. Each
    round's table is written to the shared folder, so lineage stays short.
    """
    both = pin(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    state = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = (
            both.join(state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("r").alias("r"))
        )
        pulled = state.join(near, "node").select("node", F.least("root", "r").alias("next"), "root")
        # The old root may learn of a smaller one from any of its followers.
        hooked = pulled.groupBy(F.col("root").alias("node")).agg(F.min("next").alias("hook"))
        joined = pulled.join(hooked, "node", "left").select(
            "node", "root", F.least("next", F.coalesce("hook", "next")).alias("next")
        )
        jumped = joined.join(
            joined.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left"
        ).select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "root")
        done = pin(jumped)
        state = done.select("node", F.col("new").alias("root"))
        if done.filter("new <> root").isEmpty():
            return state
