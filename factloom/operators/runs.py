"""Run catalogue: configuration ids, result logs, pending work, and summaries of scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions import vectors as V

# --- configurations ----------------------------------------------------------------------------


def _leaves(schema: StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for field in schema.fields:
        path = (*prefix, field.name)
        found += _leaves(field.dataType, path) if isinstance(field.dataType, StructType) else [path]
    return found


def _path(path: Sequence[str]) -> str:
    return ".".join(f"`{p}`" for p in path)


def flatten_config(configs: DataFrame) -> DataFrame:
    """Nested parameters as ``a_b`` columns."""
    return configs.select(*[F.col(_path(p)).alias("_".join(p)) for p in _leaves(configs.schema)])


def _sorted_struct(schema: StructType, skip: Sequence[str], prefix: tuple[str, ...] = ()) -> Column:
    parts = []
    for field in sorted(schema.fields, key=lambda f: f.name):
        path = (*prefix, field.name)
        if field.name in skip:
            continue
        nested = isinstance(field.dataType, StructType)
        value = _sorted_struct(field.dataType, skip, path) if nested else F.col(_path(path))
        parts.append(value.alias(field.name))
    return F.struct(*parts)


def config_id(configs: DataFrame, skip: Sequence[str] = ("device", "preferred_device")) -> DataFrame:
    """Add ``id``: SHA-256 of the key-sorted JSON of all parameters but the device."""
    text = F.to_json(_sorted_struct(configs.schema, skip), {"ignoreNullFields": "false"})
    return configs.withColumn("id", F.sha2(text, 256))


# --- result logs -------------------------------------------------------------------------------


def append_results(results: DataFrame, path: str) -> None:
    """Add rows to a log; they may have columns the stored rows lack."""
    results.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def expand_epochs(configs: DataFrame) -> DataFrame:
    """One row per configuration and stored epoch."""
    return configs.withColumn("epoch", F.explode("epochs")).drop("epochs")


def pending_runs(wanted: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Runs whose full key is not in the log yet."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def find_checkpoint(configs: DataFrame, params: Mapping[str, Any], epoch: int) -> DataFrame:
    """The one configuration with these parameters that stored this epoch."""
    found = configs.filter(F.array_contains("epochs", epoch))
    for name, value in params.items():
        found = found.filter(F.col(name) == value)
    if found.limit(2).count() != 1:
        raise ValueError("checkpoint is not uniquely defined")
    return found


def best_epoch(scores: DataFrame, group: Sequence[str], score: str = "mean_score") -> DataFrame:
    """Per group the epoch of the best score; the earlier of equals."""
    return scores.groupBy(*group).agg(
        F.max_by("epoch", F.struct(F.col(score), -F.col("epoch"))).alias("epoch"), F.max(score).alias(score)
    )


def resume_epoch(checkpoints: DataFrame, config: str, epoch: int) -> DataFrame:
    """``(epoch)``: the largest stored epoch of a configuration up to ``epoch``, else 0."""
    stored = checkpoints.filter((F.col("config_id") == config) & (F.col("epoch") <= epoch))
    return stored.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("epoch"))


# --- summaries ---------------------------------------------------------------------------------


def dataset_names(df: DataFrame, path: str, names: Mapping[str, str], out: str, marker: str = "experiments/") -> DataFrame:
    """Short name of the path tail after ``marker``; null where the tail is not listed."""
    table = df.sparkSession.createDataFrame(list(names.items()), f"_tail string, `{out}` string")
    tail = F.element_at(F.split(F.col(path), marker), -1)
    return df.withColumn("_tail", tail).join(F.broadcast(table), "_tail", "left").drop("_tail")


def score_summary(df: DataFrame, scores: str = "scores") -> DataFrame:
    """``mean_scores`` and population ``std_scores`` of an array column."""
    return df.withColumns({"mean_scores": V.mean(F.col(scores)), "std_scores": V.std_pop(F.col(scores))})


def filter_by_values(df: DataFrame, conditions: Sequence[tuple[str, Any]]) -> DataFrame:
    """Rows meeting every ``(column, value or list of values)``."""
    for name, value in conditions:
        many = isinstance(value, list | tuple)
        df = df.filter(F.col(name).isin(list(value)) if many else F.col(name) == value)
    return df


def group_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every existing combination of the label columns, with its printed form; null prints as None."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in cols]
    return df.select(*shown).distinct().withColumn("label", F.concat_ws(", ", *cols))


def best_per_seed_mean(df: DataFrame, group: Sequence[str], seed: str = "random_state") -> DataFrame:
    """Best row per seed by mean score (of equals the earlier epoch, then the smaller deviation),
    averaged over seeds."""
    order = F.struct(F.col("mean_scores"), -F.col("epoch"), -F.col("std_scores"))
    best = df.groupBy(*group, seed).agg(
        F.max("mean_scores").alias("_mean"), F.max_by("std_scores", order).alias("_std")
    )
    return best.groupBy(*group).agg(F.avg("_mean").alias("mean_scores"), F.avg("_std").alias("std_scores"))


def epoch_curve(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group, "epoch").agg(F.avg("mean_scores").alias("mean_scores")).orderBy(*group, "epoch")


def epoch_pivot(df: DataFrame, epochs: Sequence[int], row: str = "dataset", col: str = "n_epochs") -> DataFrame:
    return df.groupBy(row).pivot(col, list(epochs)).agg(F.avg("mean_scores"))


def evaluation_cost(df: DataFrame, group: str = "dataset") -> DataFrame:
    """Mean duration per dataset, runs of 20 repeats scaled to 5."""
    scaled = F.when(F.col("n_repeats") == 20, F.col("duration") / 4).otherwise(F.col("duration"))
    return df.groupBy(group).agg(F.avg(scaled).alias("duration"))


def training_cost(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Least time and memory per group."""
    return df.groupBy(*group).agg(
        F.min("duration").alias("duration"), F.min("peak_memory_usage").alias("peak_memory_usage")
    )


def total_duration(df: DataFrame, *parts: str) -> DataFrame:
    return df.withColumn("duration", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def join_config(scores: DataFrame, configs: DataFrame, on: str, suffix: str = "_x") -> DataFrame:
    """Left join in which the configuration's clashing columns get a suffix."""
    clash = {c: c + suffix for c in configs.columns if c in scores.columns and c != on}
    return scores.join(configs.withColumnsRenamed(clash), on, "left")


def report_rows(
    df: DataFrame,
    keep: Sequence[str],
    sort: str,
    defaults: Mapping[str, str] | None = None,
    exclude: Mapping[str, str] | None = None,
    label: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Printed rows: defaults for nulls, one excluded combination, and a label
    ``(out, column, flag)`` reading ``<column> numeric = <flag>``."""
    if defaults:
        df = df.fillna(dict(defaults))
    if exclude:
        match = F.lit(True)
        for name, value in exclude.items():
            match = match & F.coalesce(F.col(name) == value, F.lit(False))
        df = df.filter(~match)
    if label:
        out, name, flag = label
        df = df.withColumn(out, F.concat(name, F.lit(" numeric = "), F.initcap(F.col(flag).cast("string"))))
    return df.select(*keep).orderBy(sort)
