"""Run catalogue and summaries over run logs derived from the test tables.

Every part stands for a training run (its configuration) and every order line for one scored
epoch of that run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import runs as R
from factloom.plans.registry import query, r4, scratch, sql_r4, table

SQL_CKPT = """ckpt AS (SELECT p_partkey AS id, p_brand AS emb_model_name, CASE WHEN p_size % 3 > 0 THEN p_type END AS num_emb_model_name,
  '/data/experiments/datasets/' || split_part(p_name, ' ', 1) || '/triplets' AS triples_dir, [2, 4, p_size] AS epochs, (p_partkey % 3)::INTEGER AS random_state,
  p_retailprice AS duration, p_size * 1.5 AS peak_memory_usage FROM part)"""
SQL_SCORES = """scores AS (SELECT l_partkey AS id, l_linenumber AS epoch, l_orderkey, '/mnt/experiments/datasets/' || l_returnflag || '/target.parquet' AS target_file,
  CASE l_linestatus WHEN 'F' THEN 20 ELSE 5 END AS n_repeats, (l_suppkey % 3)::INTEGER AS random_state, l_extendedprice AS duration,
  CASE WHEN l_discount < 0.05 THEN 'r2' ELSE 'average_precision' END AS scoring, [l_discount, l_tax, l_quantity / 50] AS scores FROM lineitem),
  summed AS (SELECT *, (scores[1] + scores[2] + scores[3]) / 3 AS mean_scores FROM scores),
  s AS (SELECT *, sqrt((pow(scores[1] - mean_scores, 2) + pow(scores[2] - mean_scores, 2) + pow(scores[3] - mean_scores, 2)) / 3) AS std_scores,
    CASE split_part(target_file, 'experiments/', 2) WHEN 'datasets/A/target.parquet' THEN 'set A' WHEN 'datasets/N/target.parquet' THEN 'set N' END AS dataset FROM summed)"""
NAMES = {"datasets/A/target.parquet": "set A", "datasets/N/target.parquet": "set N"}


def checkpoints(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("emb_model_name"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("num_emb_model_name"),
        F.concat(F.lit("/data/experiments/datasets/"), F.split("p_name", " ")[0], F.lit("/triplets")).alias("triples_dir"),
        F.array(F.lit(2), F.lit(4), F.col("p_size")).alias("epochs"),
        (F.col("p_partkey") % 3).cast("int").alias("random_state"),
        F.col("p_retailprice").alias("duration"),
        (F.col("p_size") * 1.5).alias("peak_memory_usage"),
    )


def raw_scores(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id"),
        F.col("l_linenumber").alias("epoch"),
        "l_orderkey",
        F.concat(F.lit("/mnt/experiments/datasets/"), "l_returnflag", F.lit("/target.parquet")).alias("target_file"),
        F.when(F.col("l_linestatus") == "F", 20).otherwise(5).alias("n_repeats"),
        (F.col("l_suppkey") % 3).cast("int").alias("random_state"),
        F.col("l_extendedprice").alias("duration"),
        F.when(F.col("l_discount") < 0.05, "r2").otherwise("average_precision").alias("scoring"),
        F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50).alias("scores"),
    )


def scores(spark, d):
    return R.dataset_names(R.score_summary(raw_scores(spark, d)), "target_file", NAMES, "dataset")


# --- catalogue -----------------------------------------------------------------------------------


def nested(spark, d):
    return table(spark, d, "part").select(
        F.struct(F.col("p_brand").alias("name"), F.col("p_size").alias("dim"), F.lit("cuda:0").alias("preferred_device")).alias("emb_model"),
        F.struct(F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("name")).alias("num_emb_model"),
        F.col("p_partkey").alias("random_state"),
        F.lit("all").alias("use_features"),
    )


@query(
    "config_id",
    """SELECT p_partkey AS random_state, sha256(to_json({'emb_model': {'dim': p_size, 'name': p_brand},
      'num_emb_model': {'name': CASE WHEN p_size % 3 > 0 THEN p_type END}, 'random_state': p_partkey, 'use_features': 'all'})::VARCHAR) AS id FROM part""",
)
def config_id(spark, d):
    return R.config_id(nested(spark, d)).select("random_state", "id")


@query(
    "flatten_config",
    """SELECT p_brand AS emb_model_name, p_size AS emb_model_dim, 'cuda:0' AS emb_model_preferred_device,
      CASE WHEN p_size % 3 > 0 THEN p_type END AS num_emb_model_name, p_partkey AS random_state, 'all' AS use_features FROM part""",
)
def flatten_config(spark, d):
    return R.flatten_config(nested(spark, d))


@query(
    "append_results",
    "SELECT l_orderkey, l_linenumber, l_tax, NULL::DOUBLE AS l_discount FROM lineitem WHERE l_returnflag = 'A' "
    "UNION ALL SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_returnflag <> 'A'",
)
def append_results(spark, d):
    """Two appends, the second with a column more."""
    path = scratch(spark, "log")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount", "l_returnflag")
    R.append_results(lines.filter("l_returnflag = 'A'").drop("l_discount", "l_returnflag"), path)
    R.append_results(lines.filter("l_returnflag <> 'A'").drop("l_returnflag"), path)
    return R.read_results(spark, path)


@query("expand_epochs", f"WITH {SQL_CKPT} SELECT id, random_state, unnest(epochs) AS epoch FROM ckpt")
def expand_epochs(spark, d):
    return R.expand_epochs(checkpoints(spark, d).select("id", "random_state", "epochs"))


@query(
    "pending_runs",
    f"WITH {SQL_CKPT}, {SQL_SCORES}, w AS (SELECT id, random_state, unnest(epochs) AS epoch FROM ckpt) "
    "SELECT id, random_state, epoch FROM w WHERE NOT EXISTS (SELECT 1 FROM scores o WHERE o.id = w.id AND o.epoch = w.epoch AND o.random_state = w.random_state)",
)
def pending_runs(spark, d):
    wanted = R.expand_epochs(checkpoints(spark, d).select("id", "random_state", "epochs"))
    return R.pending_runs(wanted, raw_scores(spark, d), ["id", "epoch", "random_state"])


@query(
    "find_checkpoint",
    f"WITH {SQL_CKPT} SELECT id, duration FROM ckpt WHERE id = 17 AND random_state = 2 AND list_contains(epochs, 4)",
)
def find_checkpoint(spark, d):
    return R.find_checkpoint(checkpoints(spark, d), {"id": 17, "random_state": 2}, 4).select("id", "duration")


@query(
    "best_epoch",
    f"WITH {SQL_SCORES}, t AS (SELECT id, random_state, epoch, max(mean_scores) AS m FROM s GROUP BY ALL) SELECT id, random_state, epoch, {sql_r4('m')} AS mean_score "
    "FROM (SELECT *, row_number() OVER (PARTITION BY id, random_state ORDER BY m DESC, epoch) AS rn FROM t) WHERE rn = 1",
)
def best_epoch(spark, d):
    best = R.best_epoch(scores(spark, d).withColumnRenamed("mean_scores", "mean_score"), ["id", "random_state"])
    return best.withColumn("mean_score", r4("mean_score"))


@query(
    "resume_epoch",
    "SELECT coalesce(max(l_linenumber), 0)::INTEGER AS epoch FROM lineitem WHERE l_partkey = 17 AND l_linenumber <= 4",
)
def resume_epoch(spark, d):
    stored = table(spark, d, "lineitem").select(F.col("l_partkey").alias("config_id"), F.col("l_linenumber").alias("epoch"))
    return R.resume_epoch(stored, 17, 4)


# --- summaries -----------------------------------------------------------------------------------


@query("dataset_names", f"WITH {SQL_SCORES} SELECT l_orderkey, target_file, dataset FROM s")
def dataset_names(spark, d):
    return R.dataset_names(raw_scores(spark, d), "target_file", NAMES, "dataset").select("l_orderkey", "target_file", "dataset")


@query(
    "score_summary",
    f"WITH {SQL_SCORES} SELECT l_orderkey, {sql_r4('mean_scores')} AS mean_scores, {sql_r4('std_scores')} AS std_scores FROM s",
)
def score_summary(spark, d):
    rows = R.score_summary(raw_scores(spark, d))
    return rows.select("l_orderkey", r4("mean_scores").alias("mean_scores"), r4("std_scores").alias("std_scores"))


@query(
    "filter_by_values",
    f"WITH {SQL_SCORES} SELECT id, epoch, l_orderkey, scoring FROM s WHERE scoring = 'r2' AND epoch IN (1, 3) AND random_state = 1",
)
def filter_by_values(spark, d):
    rows = R.filter_by_values(raw_scores(spark, d), [("scoring", "r2"), ("epoch", [1, 3]), ("random_state", 1)])
    return rows.select("id", "epoch", "l_orderkey", "scoring")


@query(
    "group_labels",
    f"WITH {SQL_CKPT}, l AS (SELECT DISTINCT emb_model_name, coalesce(num_emb_model_name, 'None') AS num_emb_model_name FROM ckpt) "
    "SELECT *, emb_model_name || ', ' || num_emb_model_name AS label FROM l",
)
def group_labels(spark, d):
    return R.group_labels(checkpoints(spark, d), ["emb_model_name", "num_emb_model_name"])


@query(
    "best_per_seed_mean",
    f"""WITH {SQL_SCORES}, b AS (SELECT scoring, n_repeats, random_state, mean_scores, std_scores,
    row_number() OVER (PARTITION BY scoring, n_repeats, random_state ORDER BY mean_scores DESC, epoch, std_scores) AS rn FROM s)
  SELECT scoring, n_repeats, {sql_r4('avg(mean_scores)')} AS mean_scores, {sql_r4('avg(std_scores)')} AS std_scores FROM b WHERE rn = 1 GROUP BY scoring, n_repeats""",
)
def best_per_seed_mean(spark, d):
    rows = R.best_per_seed_mean(scores(spark, d), ["scoring", "n_repeats"])
    return rows.withColumns({c: r4(c) for c in ("mean_scores", "std_scores")})


@query(
    "epoch_curve",
    f"WITH {SQL_SCORES} SELECT scoring, epoch, {sql_r4('avg(mean_scores)')} AS mean_scores FROM s GROUP BY scoring, epoch",
)
def epoch_curve(spark, d):
    return R.epoch_curve(scores(spark, d), ["scoring"]).withColumn("mean_scores", r4("mean_scores"))


@query(
    "epoch_pivot",
    f"WITH {SQL_SCORES} SELECT dataset, "
    + ", ".join(f"{sql_r4(f'avg(mean_scores) FILTER (epoch = {e})')} AS \"{e}\"" for e in range(1, 8))
    + " FROM s GROUP BY dataset",
)
def epoch_pivot(spark, d):
    rows = R.epoch_pivot(scores(spark, d), range(1, 8), col="epoch")
    return rows.select("dataset", *[r4(F.col(f"`{e}`")).alias(str(e)) for e in range(1, 8)])


@query(
    "evaluation_cost",
    f"WITH {SQL_SCORES} SELECT dataset, {sql_r4('avg(CASE n_repeats WHEN 20 THEN duration / 4 ELSE duration END)')} AS duration FROM s GROUP BY dataset",
)
def evaluation_cost(spark, d):
    return R.evaluation_cost(scores(spark, d)).withColumn("duration", r4("duration"))


@query(
    "training_cost",
    f"WITH {SQL_CKPT} SELECT emb_model_name, num_emb_model_name, min(duration) AS duration, min(peak_memory_usage)::DOUBLE AS peak_memory_usage FROM ckpt GROUP BY ALL",
)
def training_cost(spark, d):
    return R.training_cost(checkpoints(spark, d), ["emb_model_name", "num_emb_model_name"])


@query("total_duration", f"SELECT l_orderkey, l_linenumber, {sql_r4('l_extendedprice + l_tax')} AS duration FROM lineitem")
def total_duration(spark, d):
    rows = R.total_duration(table(spark, d, "lineitem"), "l_extendedprice", "l_tax")
    return rows.select("l_orderkey", "l_linenumber", r4("duration").alias("duration"))


@query(
    "report_rows",
    f"""WITH {SQL_CKPT}, {SQL_SCORES} SELECT coalesce(dataset, 'other') AS dataset, scoring, l_orderkey, {sql_r4('s.duration')} AS duration, {sql_r4('c.duration')} AS duration_x,
    emb_model_name || ' numeric = ' || CASE WHEN num_emb_model_name IS NOT NULL THEN 'True' ELSE 'False' END AS model
  FROM s LEFT JOIN ckpt c USING (id) WHERE NOT coalesce(dataset = 'set A' AND scoring = 'average_precision', false)""",
)
def report_rows(spark, d):
    runs = checkpoints(spark, d).withColumn("numeric", F.col("num_emb_model_name").isNotNull())
    rows = R.join_config(scores(spark, d), runs.select("id", "duration", "emb_model_name", "numeric"), "id")
    report = R.report_rows(
        rows,
        ["dataset", "scoring", "l_orderkey", "duration", "duration_x", "model"],
        "dataset",
        defaults={"dataset": "other"},
        exclude={"dataset": "set A", "scoring": "average_precision"},
        label=("model", "emb_model_name", "numeric"),
    )
    return report.withColumns({c: r4(c) for c in ("duration", "duration_x")})
