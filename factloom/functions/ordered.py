"""Numbering, running sums and exact quantiles that no single task has to hold.

``dense_ids`` and ``number_in_groups`` depend only on the data, not on its partitioning: rows
are put in buckets by a hash of their key, numbered inside the bucket, and shifted by the bucket
sizes. ``running_totals`` needs value order, so it range-partitions and stores that layout once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.hashing import md5int
from factloom.session import broadcast_if_small, pin

HEX_DIGITS = 3  # 16^3 = 4096 buckets
ROWS_PER_BUCKET = 100_000
# Buckets of one round of narrowing, and the rows that are sorted as a list.
BUCKETS = 4096
SORTED_ROWS = 4096


def dense_ids(keys: DataFrame, key: str, out: str) -> DataFrame:
    """0-based dense ids for distinct string keys, ordered by (md5 prefix, key).

    The keys are stored first, as they are read once for the bucket sizes and once for the ids.
    """
    keys = pin(keys)
    bucketed = keys.withColumn("_bucket", F.substring(F.md5(F.col(key)), 1, HEX_DIGITS))
    # at most 4096 rows whatever the data: safe in one task and safe to broadcast
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(Window.orderBy("_bucket")))
        .select("_bucket", (F.col("_end") - F.col("_n")).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)).cast("long") - 1
    return (
        bucketed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_bucket")
        .select((F.col("_offset") + F.col("_inside")).alias(out), *keys.columns)
    )


def group_sizes(df: DataFrame, group: Sequence[str], out: str = "group_size") -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias(out))


def number_in_groups(
    df: DataFrame,
    group: Sequence[str],
    key: Sequence[str],
    out: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """0-based contiguous number of every row inside its group.

    A group of more than ``rows_per_bucket`` rows is cut into hash buckets that are numbered
    by different tasks, so a group may hold any share of the rows. Order inside a group is
    (bucket, key); small groups have one bucket.
    """
    group, key = list(group), list(key)
    hot = (
        group_sizes(df, group, "_size")
        .filter(F.col("_size") > rows_per_bucket)
        .select(*group, F.ceil(F.col("_size") / rows_per_bucket).alias("_buckets"))
    )
    # at most one row for every rows_per_bucket rows: joined where the rows are
    bucketed = df.join(broadcast_if_small(pin(hot), 128), group, "left").withColumn(
        "_bucket", F.coalesce(F.pmod(md5int(*key), F.col("_buckets")), F.lit(0).cast("long"))
    )
    offsets = (
        bucketed.filter(F.col("_buckets").isNotNull())
        .groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")))
        .select(*group, "_bucket", (F.col("_end") - F.col("_n")).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*key)).cast("long") - 1
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, [*group, "_bucket"], "left")
        .select(*df.columns, (F.col("_inside") + F.coalesce("_offset", F.lit(0))).alias(out))
    )


COPIES_PER_CHUNK = 100_000


def number_copies(df: DataFrame, out: str) -> DataFrame:
    """Every row with a 0-based number among its exact copies.

    Copies are counted before the shuffle and written out again where they were counted; only rows of more than
    ``COPIES_PER_CHUNK`` copies move once more, in chunks to different tasks, so one row may be repeated any number of times.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.filter(F.col("_n") <= COPIES_PER_CHUNK)
    chunks = counted.filter(F.col("_n") > COPIES_PER_CHUNK).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES_PER_CHUNK)))
    ).repartition(*df.columns, "_chunk")
    first = F.col("_chunk") * COPIES_PER_CHUNK
    last = F.least(F.col("_n"), first + COPIES_PER_CHUNK) - 1
    written = lambda rows, low, high: rows.select(*df.columns, F.explode(F.sequence(low, high)).alias(out))
    return written(few, F.lit(0).cast("long"), F.col("_n") - 1).unionByName(written(chunks, first, last))


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Inclusive running sums ``out`` of the columns ``sums[out]`` per group along ``order``, and the
    group totals ``<out>_total``.

    ``(group, order)`` must be unique. Rows are range-partitioned, so a group spans as many
    tasks as it needs; only partition totals are combined across tasks.
    """
    group, order = list(group), list(order)
    parts = pin(
        df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = parts.select("*", *[F.sum(c).over(inside).alias(f"_in_{o}") for o, c in sums.items()])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_part", *group)
        .agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
        .select(
            "_part",
            *group,
            *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums],
            *[F.sum(f"_sum_{o}").over(whole).alias(f"{o}_total") for o in sums],
        )
    )
    return local.join(offsets, ["_part", *group]).select(
        *df.columns,
        *[(F.col(f"_in_{o}") + F.col(f"_off_{o}")).alias(o) for o in sums],
        *[f"{o}_total" for o in sums],
    )


def _magnitude(x: Column) -> Column:
    """Grows with ``x``, by equal steps for equal factors; no positive double is below ``exp(-750)``."""
    return F.signum(x) * F.coalesce(F.ln(F.nullif(F.abs(x), F.lit(0.0))) + 750, F.lit(0.0))


def _cells_of(rows: DataFrame, cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` with the cell ``_lo.._hi`` of their group that holds them; others are dropped."""
    lists = cells.groupBy(*group).agg(F.collect_list(F.struct("_lo", "_hi", "_below")).alias("_cells"))
    holds = F.filter("_cells", lambda c: (c["_lo"] <= F.col("_v")) & (F.col("_v") <= c["_hi"]))
    # most rows lie in no cell: joined where they are, unless there are very many large groups
    held = rows.join(broadcast_if_small(pin(lists), 4096), group).select(*group, "_v", F.explode(holds).alias("_c"))
    return held.select(*group, "_v", "_c.*")


def _ranked_values(rows: DataFrame, group: Sequence[str], targets: DataFrame, sorted_rows: int) -> DataFrame:
    """``(group…, _rank, _value)``: the values at ``targets(group…, _n, _lo, _hi, _rank)``, ranks counted from 0, of
    groups with ``_n`` rows from ``_lo`` to ``_hi``.

    A round cuts the cell that holds a rank into ``BUCKETS`` of equal width, on a scale of magnitudes and on that of the
    values in turn, and counts them; the rank's bucket, from its least to its greatest value, is the next cell. Cells
    of one value or of ``sorted_rows`` rows end it, so the rows that are ever brought together are that few.
    """
    done, turn = None, 0
    state = pin(targets.withColumn("_below", F.lit(0).cast("long")).withColumnRenamed("_n", "_size"))
    cell = [*group, "_lo"]
    while True:
        wide = (F.col("_lo") < F.col("_hi")) & (F.col("_size") > sorted_rows)
        ended = state.filter(~wide)
        done = ended if done is None else done.unionByName(ended)
        state = state.filter(wide)
        if state.isEmpty():
            break
        cells = state.select(*group, "_lo", "_hi", "_below").distinct()
        low, high, here = (_magnitude(x) if turn % 2 == 0 else x for x in (F.col(c).cast("double") for c in ("_lo", "_hi", "_v")))
        turn += 1
        share = F.coalesce((here - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counted = (
            _cells_of(rows, cells, group)
            .groupBy(*cell, "_below", bucket.alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        )
        before = Window.partitionBy(*cell).orderBy("_bucket")  # at most BUCKETS rows
        placed = counted.withColumn("_start", F.col("_below") + F.sum("_n").over(before) - F.col("_n")).drop("_below")
        inside = (F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_n"))
        state = pin(
            state.select(*cell, "_rank").join(placed, cell).filter(inside).select(
                *group, F.col("_n").alias("_size"), F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), "_rank",
                F.col("_start").alias("_below"),
            )
        )
    done = pin(done)
    same = done.filter("_lo = _hi").select(*group, "_rank", F.col("_lo").alias("_value"))
    few = done.filter("_lo < _hi")
    cells = few.select(*group, "_lo", "_hi", "_below").distinct()
    sorted_cells = _cells_of(rows, cells, group).groupBy(*cell).agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
    at = F.get("_sorted", (F.col("_rank") - F.col("_below")).cast("int"))
    return same.unionByName(few.join(sorted_cells, cell).select(*group, "_rank", at.alias("_value")))


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Sequence[float] | int,
    min_rows: int = 0,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles per group: ``(group…, prob_index, quantile)``.

    ``probs`` may be a count of evenly spaced quantiles; a group of fewer rows gets one per row.

    A group of at most ``sorted_rows`` rows is sorted as a list. The ranks of larger ones are narrowed down by counts
    (``_ranked_values``), all groups and ranks at once, so group size is unbounded and no row is moved before
    few are left. Groups of ``min_rows`` rows or fewer are left out.
    """
    group = list(group)
    if not group:
        whole = df.withColumn("_all", F.lit(0))
        return exact_quantiles(whole, ["_all"], value, probs, min_rows, sorted_rows).drop("_all")
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = pin(df.filter(known).select(*group, F.col(value).alias("_v")))
    sizes = pin(
        rows.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .filter(F.col("_n") > min_rows)
    )
    last = F.col("_n") - 1
    if isinstance(probs, int):
        steps = F.least(F.lit(probs), F.col("_n")).cast("int") - 1
        wanted = F.transform(
            F.sequence(F.lit(0), steps),
            lambda i: F.struct(i.alias("prob_index"), (i * last / F.greatest(steps, F.lit(1))).alias("pos")),
        )
    else:
        wanted = F.transform(
            F.array(*[F.lit(float(p)) for p in probs]),
            lambda p, i: F.struct(i.alias("prob_index"), (p * last).alias("pos")),
        )
    between = lambda low, high, pos: low + (high - low) * (pos - F.floor(pos))
    small = sizes.filter(F.col("_n") <= sorted_rows).select(*group, "_n")
    # rows of large groups end before the shuffle: only lists of small ones are made
    large = sizes.filter(F.col("_n") > sorted_rows)
    sorted_groups = (
        rows.join(broadcast_if_small(large.select(*group), 64), group, "left_anti")
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
        .join(small, group)
    )
    item = lambda i: F.get("_sorted", i.cast("int"))
    direct = sorted_groups.select(*group, "_sorted", F.explode(wanted).alias("w")).select(
        *group,
        F.col("w.prob_index").alias("prob_index"),
        between(item(F.floor("w.pos")), item(F.ceil("w.pos")), F.col("w.pos")).alias("quantile"),
    )
    if large.isEmpty():
        return direct
    asked = large.select(*group, "_n", "_lo", "_hi", F.explode(wanted).alias("w"))
    ranks = F.explode(F.array_distinct(F.array(F.floor("w.pos"), F.ceil("w.pos")))).alias("_rank")
    targets = asked.select(*group, "_n", "_lo", "_hi", ranks).distinct()
    found = pin(_ranked_values(rows, group, targets, sorted_rows))
    side = lambda name: found.select(*group, F.col("_rank").alias(f"_{name}"), F.col("_value").alias(f"_{name}_value"))
    narrowed = (
        asked.select(*group, "w.*", F.floor("w.pos").alias("_floor"), F.ceil("w.pos").alias("_ceil"))
        .join(side("floor"), [*group, "_floor"])
        .join(side("ceil"), [*group, "_ceil"])
        .select(*group, "prob_index", between(F.col("_floor_value"), F.col("_ceil_value"), F.col("pos")).alias("quantile"))
    )
    return direct.unionByName(narrowed)
