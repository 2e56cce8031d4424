"""Entity vectors in two dimensions, with the attributes shown next to them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.ordered import exact_quantiles, running_totals


def one_vector_per_name(vectors: DataFrame, name: str, key: str, vec: str = "vec") -> DataFrame:
    """The vector of the smallest key of each name."""
    return vectors.groupBy(name).agg(F.min_by(vec, key).alias(vec))


def l1_scale_columns(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Each dimension divided by its total absolute value over all rows."""
    totals = (
        vectors.select(array_to_vector(vec).alias("_v"))
        .agg(vector_to_array(Summarizer.normL1(F.col("_v"))).alias("_total"))
        .withColumn("_one", F.lit(1))
    )
    scaled = F.zip_with(F.col(vec), F.col("_total"), lambda x, t: x / F.nullif(t, F.lit(0.0)))
    return (
        vectors.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").withColumn(vec, scaled).drop("_one", "_total")
    )


def project_2d(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Add ``x`` and ``y``: two principal components of the centred vectors.

    The largest loading of a component is made positive, so signs do not depend on the solver.
    """
    rows = vectors.withColumn("_in", array_to_vector(vec))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_in", outputCol="_centred").fit(rows).transform(rows)
    model = PCA(k=2, inputCol="_centred", outputCol="_out").fit(centred)
    loadings = model.pc.toArray()
    signs = [float(np.sign(c[np.argmax(np.abs(c))])) for c in loadings.T]
    out = vector_to_array("_out")
    return (
        model.transform(centred)
        .withColumns({"x": out[0] * signs[0], "y": out[1] * signs[1]})
        .drop("_in", "_centred", "_out")
    )


def clean_place_name(name: Column, suffix: str = " County") -> Column:
    """Enclosing characters off, ``_`` as spaces, the suffix removed."""
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    return F.replace(F.translate(inner, "_", " "), F.lit(suffix), F.lit(""))


def clean_place_names(df: DataFrame, name: str) -> DataFrame:
    """Cleaned names; rows with a space other than the one after a comma are dropped."""
    cleaned = df.withColumn(name, clean_place_name(F.col(name)))
    return cleaned.filter(~F.replace(F.col(name), F.lit(", "), F.lit("")).contains(" "))


def attach_attributes(df: DataFrame, attributes: DataFrame, name: str, population: str) -> DataFrame:
    """Left-join attributes; add ``state`` (text after the last comma), its 0-based sorted ``state_code``,
    and ``log_population``."""
    state = F.element_at(F.split(F.col(name), ", "), -1)
    rows = df.join(attributes, name, "left").withColumn("state", state)
    states = rows.select("state").distinct().withColumn("_n", F.lit(1))
    codes = running_totals(states, [], ["state"], {"_rank": "_n"})
    return rows.join(codes.select("state", (F.col("_rank") - 1).alias("state_code")), "state").withColumn(
        "log_population", F.log(population)
    )


def extreme_rows(df: DataFrame, value: str, key: str, top: int = 4, bottom: int = 1, q: float = 0.1) -> DataFrame:
    """The ``top`` largest (null as 0) and ``bottom`` smallest (null as 10^6) rows, with a test against
    the ``q`` quantile."""
    quantile = exact_quantiles(df, [], value, [q]).select(F.col("quantile").alias("_q"), F.lit(1).alias("_one"))
    high = df.orderBy(F.desc(F.coalesce(value, F.lit(0.0))), key).limit(top).withColumn("place", F.lit("top"))
    low = df.orderBy(F.coalesce(value, F.lit(1e6)), key).limit(bottom).withColumn("place", F.lit("bottom"))
    return (
        high.unionByName(low)
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(quantile), "_one")
        .withColumn("below_quantile", F.coalesce(F.col(value) < F.col("_q"), F.lit(False)))
        .drop("_one", "_q")
    )
