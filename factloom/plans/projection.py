"""Projection of vectors and place attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import project as P
from factloom.plans.registry import query, r4, sql_r4, table

DIMS = 64  # of the embeddings table
SQL_PLACES = """places AS (SELECT c_custkey, '<' || replace(c_name, '#', CASE WHEN c_custkey % 5 = 0 THEN '_' ELSE '' END) || '_County,_' || replace(n_name, '_', '') || '>' AS raw,
  CASE WHEN c_custkey % 4 > 0 THEN c_acctbal + 2000 END AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey),
  cleaned AS (SELECT c_custkey, pop, replace(replace(raw[2:-2], '_', ' '), ' County', '') AS place FROM places),
  kept AS (SELECT * FROM cleaned WHERE replace(place, ', ', '') NOT LIKE '% %')"""


def places(spark, d):
    filler = F.when(F.col("c_custkey") % 5 == 0, "_").otherwise("")
    return (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.concat(
                F.lit("<"),
                F.replace("c_name", F.lit("#"), filler),
                F.lit("_County,_"),
                F.replace("n_name", F.lit("_"), F.lit("")),
                F.lit(">"),
            ).alias("place"),
            F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") + 2000).alias("pop"),
        )
    )


def named_vectors(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.concat(F.lit("name"), (F.col("vec_id") % 100).cast("string")).alias("name"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


@query(
    "one_vector_per_name",
    "SELECT name, " + ", ".join(f"{sql_r4(f'v[{i + 1}]')} AS v{i}" for i in range(DIMS))
    + " FROM (SELECT 'name' || vec_id % 100 AS name, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY 1)",
)
def one_vector_per_name(spark, d):
    rows = P.one_vector_per_name(named_vectors(spark, d), "name", "vec_id")
    return rows.select("name", *[r4(F.col("vec")[i]).alias(f"v{i}") for i in range(DIMS)])


@query(
    "l1_scale_columns",
    "WITH t AS (SELECT " + ", ".join(f"sum(abs(embedding[{i + 1}]::DOUBLE)) AS t{i}" for i in range(DIMS)) + " FROM embeddings) SELECT vec_id, "
    + ", ".join(f"{sql_r4(f'100 * embedding[{i + 1}]::DOUBLE / t{i}')} AS v{i}" for i in range(DIMS))
    + " FROM embeddings, t",
)
def l1_scale_columns(spark, d):
    rows = P.l1_scale_columns(named_vectors(spark, d))
    return rows.select("vec_id", *[r4(100 * F.col("vec")[i]).alias(f"v{i}") for i in range(DIMS)])


@query("project_2d")
def project_2d(spark, d):
    return P.project_2d(P.l1_scale_columns(named_vectors(spark, d))).select("vec_id", "name", "x", "y")


@query("clean_place_names", f"WITH {SQL_PLACES} SELECT c_custkey, place, pop FROM kept")
def clean_place_names(spark, d):
    return P.clean_place_names(places(spark, d), "place")


@query(
    "attach_attributes",
    f"""WITH {SQL_PLACES}, a AS (SELECT place, split_part(place, ', ', 2) AS state FROM kept)
  SELECT a.place, state, dense_rank() OVER (ORDER BY state) - 1 AS state_code, {sql_r4('CASE WHEN pop > 0 THEN ln(pop) END')} AS log_population FROM a LEFT JOIN
    (SELECT place, pop FROM kept WHERE pop IS NOT NULL) USING (place)""",
)
def attach_attributes(spark, d):
    rows = P.clean_place_names(places(spark, d), "place")
    attributes = rows.filter("pop is not null").select("place", "pop")
    shown = P.attach_attributes(rows.select("place"), attributes, "place", "pop")
    return shown.select("place", "state", "state_code", r4("log_population").alias("log_population"))


@query(
    "extreme_rows",
    f"""WITH {SQL_PLACES}, q AS (SELECT quantile_cont(pop, 0.1) AS q FROM kept),
  h AS (SELECT c_custkey, place, pop, 'top' AS loc FROM kept ORDER BY coalesce(pop, 0.0) DESC, c_custkey LIMIT 4),
  l AS (SELECT c_custkey, place, pop, 'bottom' AS loc FROM kept ORDER BY coalesce(pop, 1e6), c_custkey LIMIT 1)
  SELECT c_custkey, place AS name, {sql_r4('pop')} AS pop, loc, coalesce(pop < q, false) AS below_quantile FROM (SELECT * FROM h UNION ALL SELECT * FROM l), q""",
)
def extreme_rows(spark, d):
    rows = P.clean_place_names(places(spark, d), "place").withColumnRenamed("place", "name")
    found = P.extreme_rows(rows, "pop", "c_custkey").withColumnRenamed("place", "loc")
    return found.withColumn("pop", r4("pop"))
