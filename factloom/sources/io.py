"""Reading and writing: delimited text, parquet, and the triple and vector stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Headered CSV with a declared schema; unread columns are pruned in the scan."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=False, escape='"')
    return df.select(*columns) if columns else df


def read_tsv(
    spark: SparkSession, path: str, names: Sequence[str], columns: Sequence[str], skip_first: bool = True
) -> DataFrame:
    """Tab-separated text with supplied string columns; the first line of each file is skipped."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, sep="\t", header=skip_first, quote="", enforceSchema=True).select(
        *columns
    )


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def save_triples(encoded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Encoded triples as parquet, one directory per kind so a kind filter prunes files."""
    encoded.write.mode(mode).partitionBy("kind").parquet(path)


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    schema = "head long, rel int, tail_id long, tail_val double, kind string"
    return spark.read.schema(schema).parquet(path)


def save_dictionaries(entities: DataFrame, relations: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")


def load_dictionaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")


def save_vectors(vectors: DataFrame, path: str, config_id: str, epoch: int) -> None:
    """Entity vectors of one configuration and epoch; other epochs are left in place."""
    target = f"{path}/config_id={config_id}/epoch={epoch}"
    vectors.write.mode("overwrite").parquet(target)


def load_vectors(spark: SparkSession, path: str, config_id: str, epoch: int) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.filter((F.col("config_id") == config_id) & (F.col("epoch") == epoch)).drop("config_id", "epoch")
