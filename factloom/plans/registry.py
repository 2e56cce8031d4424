"""Registration of queries and of the SQL each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import hash_small_sides, shared_dir, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what the result must equal."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(hash_small_sides(tune(spark)), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sums in another order differ in their last digits, so derived doubles are compared at four
# decimals; the nudge keeps short decimal values away from the rounding boundary.
def r4(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + 1e-7, 4) + 0.0


def sql_r4(expr: str) -> str:
    return f"(round(({expr}) + 1e-7, 4) + 0.0)"


def sql_md5int(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"
