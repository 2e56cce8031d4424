"""Design matrices, repeated folds, model scores and attribute reconstruction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import pin
from factloom.functions.hashing import md5int
from factloom.functions.ordered import exact_quantiles, running_totals
from factloom.operators.handmade import one_hot
from factloom.operators.linear import cv_linear, present
from factloom.operators.neighbours import K_VALUES, inner_neighbours, knn_neighbours, knn_predictions
from factloom.operators.resolve import attach_vectors, in_vocabulary, resolve_entities

N_FOLDS = 5

# --- design matrices ---------------------------------------------------------------------------


def design_matrix(
    targets: DataFrame,
    entities: DataFrame,
    vectors: DataFrame | None = None,
    features: DataFrame | None = None,
    dim: int | None = None,
) -> DataFrame:
    """``(entity_id, target, feature columns…)`` for the target rows the graph knows.

    ``vectors`` (``entity_id, vec``) or a wide feature table with ``head`` are attached; raw names
    are dropped and ``party`` is one-hot encoded.
    """
    rows = targets.drop("raw_entities")
    rows = resolve_entities(in_vocabulary(rows, entities), entities).drop("col_to_embed")
    if "party" in rows.columns:
        rows = one_hot(rows, "party", sep="_")
    if vectors is not None:
        rows = attach_vectors(rows, vectors, how="left")
        size = dim if dim is not None else len(vectors.first()["vec"])
        rows = rows.select("*", *[F.col("vec")[i].alias(f"X{i}") for i in range(size)]).drop("vec")
    if features is not None:
        rows = rows.join(features.withColumnRenamed("head", "entity_id"), "entity_id", "left")
    return rows


def feature_columns(matrix: DataFrame, drop: Sequence[str] = ("entity_id", "target", "fold", "repeat")) -> list[str]:
    return [c for c in matrix.columns if c not in drop]


# --- folds -------------------------------------------------------------------------------------


def _repeated(rows: DataFrame, n_repeats: int) -> DataFrame:
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))


def _ranked_folds(rows: DataFrame, group: Sequence[str], key: str, seed: int, n_folds: int) -> DataFrame:
    ordered = rows.withColumn("_order", md5int(F.lit(seed), "repeat", key)).withColumn("_n", F.lit(1))
    ranked = running_totals(ordered, group, ["_order", key], {"_rank": "_n"})
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(n_folds)).cast("int")).drop(
        "_order", "_n", "_rank", "_rank_total"
    )


def repeated_folds(
    rows: DataFrame, key: str, n_repeats: int, seed: int, n_folds: int = N_FOLDS, exact: bool = False
) -> DataFrame:
    """Each row once per repeat with its ``fold``; ``exact`` makes fold sizes differ by at most one."""
    many = _repeated(rows, n_repeats)
    if exact:
        return _ranked_folds(many, ["repeat"], key, seed, n_folds)
    return many.withColumn("fold", F.pmod(md5int(F.lit(seed), "repeat", key), F.lit(n_folds)).cast("int"))


def stratified_folds(
    rows: DataFrame, key: str, label: str, n_repeats: int, seed: int, n_folds: int = N_FOLDS
) -> DataFrame:
    """Repeated folds that are balanced within every class."""
    return _ranked_folds(_repeated(rows, n_repeats), ["repeat", label], key, seed, n_folds)


# --- metrics -----------------------------------------------------------------------------------


def r2_score(predictions: DataFrame, group: Sequence[str], y: str = "y", pred: str = "prediction") -> DataFrame:
    residual = F.sum((F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred)))
    spread = F.var_pop(y) * F.count(y)
    return predictions.groupBy(*group).agg((1 - residual / F.nullif(spread, F.lit(0.0))).alias("r2"))


def _by_threshold(predictions: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return predictions.groupBy(*group, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )


def average_precision(
    predictions: DataFrame, group: Sequence[str], label: str = "label", score: str = "score"
) -> DataFrame:
    """Sum over distinct thresholds of (recall step) x precision."""
    steps = _by_threshold(predictions, group, label, score).select(
        *group, (-F.col("_score")).alias("_order"), "_pos", (F.col("_pos") + F.col("_neg")).alias("_n")
    )
    curve = running_totals(steps, group, ["_order"], {"_tp": "_pos", "_seen": "_n"})
    weighted = F.sum(F.col("_pos") * F.col("_tp") / F.col("_seen"))
    return curve.groupBy(*group).agg(
        (weighted / F.nullif(F.sum("_pos"), F.lit(0))).alias("average_precision")
    )


def roc_auc(predictions: DataFrame, group: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    steps = _by_threshold(predictions, group, label, score)
    curve = running_totals(steps, group, ["_score"], {"_below": "_neg"})
    won = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return curve.groupBy(*group).agg((won / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


# --- boosted trees -----------------------------------------------------------------------------

GRID = {"maxDepth": (2, 4, 6, 12), "minInstancesPerNode": (4, 6, 10, 20)}


# Beyond every value, so that a split can send the missing rows to either side of all others.
FAR = 1e300


def _prepared(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list]:
    """Numeric columns without nulls, and the stage that assembles them.

    A feature with missing values comes twice, with them below and above all values: a tree that splits on
    one copy or the other learns the direction that missing rows take, as well as a split of their own.
    """
    double = [present(F.col(f"`{c}`")) for c in columns]
    gaps = rows.agg(*[F.count_if(x.isNull()).alias(f"_{i}") for i, x in enumerate(double)]).first()
    cells = {f"_f{i}": F.coalesce(x, F.lit(-FAR)) for i, x in enumerate(double)}
    cells |= {f"_f{i}_above": F.coalesce(x, F.lit(FAR)) for i, x in enumerate(double) if gaps[i]}
    keep = [F.col(c) for c in rows.columns if c in ("repeat", "fold", "target", "entity_id")]
    assembler = VectorAssembler(inputCols=list(cells), outputCol="features")
    return rows.select(*keep, *[x.alias(n) for n, x in cells.items()]), [assembler]


def _estimator(is_regression: bool, seed: int, max_iter: int):
    cls = GBTRegressor if is_regression else GBTClassifier
    return cls(featuresCol="features", labelCol="target", seed=seed, maxIter=max_iter)


def _metric(scored: DataFrame, group: Sequence[str], scoring: str) -> DataFrame:
    """``(group…, <scoring>)`` of ``scored(target, score)``, exact."""
    if scoring == "r2":
        return r2_score(scored, group, y="target", pred="score")
    metric = {"average_precision": average_precision, "roc_auc": roc_auc}[scoring]
    return metric(scored, group, label="target", score="score")


def _scored(model, rows: DataFrame, is_regression: bool) -> DataFrame:
    score = F.col("prediction") if is_regression else vector_to_array("probability")[1]
    return model.transform(rows).withColumn("score", score)


def grid_search(
    train: DataFrame,
    stages: list,
    is_regression: bool,
    scoring: str,
    seed: int,
    max_iter: int,
    grid: Mapping[str, Sequence[int]] = GRID,
    inner_folds: int = 3,
    parallelism: int = 8,
):
    """The model of the tree depth and leaf size that inner cross-validation on the scoring metric prefers.

    The out-of-fold scores of all grid points are one table, so the exact metric of every point and inner fold
    comes from one pass over it. Of equal points the first of the grid wins.
    """
    estimator = Pipeline(stages=[*stages, _estimator(is_regression, seed, max_iter)])
    inner = pin(train.withColumn("_inner", F.pmod(md5int(F.lit(seed), "entity_id"), F.lit(inner_folds)).cast("int")))
    params = estimator.getStages()[-1]
    points = [{params.getParam(n): v for n, v in zip(grid, values)} for values in product(*grid.values())]

    def out_of_fold(task: tuple[int, int]) -> DataFrame:
        point, fold = task
        model = estimator.fit(inner.filter(F.col("_inner") != fold), points[point])
        scored = _scored(model, inner.filter(F.col("_inner") == fold), is_regression)
        return scored.select(F.lit(point).alias("point"), F.lit(fold).alias("inner"), "target", "score")

    tasks = [(point, fold) for point in range(len(points)) for fold in range(inner_folds)]
    with ThreadPool(parallelism) as pool:
        parts = pool.map(inheritable_thread_target(train.sparkSession)(out_of_fold), tasks)
    scores = _metric(pin(reduce(DataFrame.unionByName, parts)), ["point", "inner"], scoring)
    means = {r["point"]: r["mean"] for r in scores.groupBy("point").agg(F.avg(scoring).alias("mean")).collect()}
    best = max(range(len(points)), key=lambda p: (means.get(p) is not None, means.get(p) or 0.0, -p))
    return estimator.fit(train, points[best])


def cv_boosted(
    rows: DataFrame,
    columns: Sequence[str],
    is_regression: bool,
    scoring: str,
    seed: int = 0,
    tune: bool = False,
    max_iter: int = 20,
    grid: Mapping[str, Sequence[int]] = GRID,
) -> DataFrame:
    """Out-of-fold predictions of boosted trees: ``(entity_id, repeat, fold, target, prediction, score)``.

    Missing features take the side that a tree learns for them (``_prepared``).
    """
    prepared, stages = _prepared(rows, columns)
    prepared = pin(prepared)
    parts = []
    for r in prepared.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect():
        same = F.col("repeat") == r["repeat"]
        train = prepared.filter(same & (F.col("fold") != r["fold"]))
        test = prepared.filter(same & (F.col("fold") == r["fold"]))
        if tune:
            model = grid_search(train, stages, is_regression, scoring, seed, max_iter, grid)
        else:
            model = Pipeline(stages=[*stages, _estimator(is_regression, seed, max_iter)]).fit(train)
        parts.append(_scored(model, test, is_regression).select("entity_id", "repeat", "fold", "target", "prediction", "score"))
    return reduce(DataFrame.unionByName, parts)


def cross_validated_scores(
    rows: DataFrame,
    columns: Sequence[str],
    is_regression: bool,
    scoring: str,
    prediction_model: str = "boosted",
    tune: bool = False,
    seed: int = 0,
    **boosting,
) -> DataFrame:
    """``(repeat, fold, <scoring>)``. Classification always uses boosted trees."""
    if is_regression and prediction_model == "linear":
        predictions = cv_linear(rows, columns)
    else:
        predictions = cv_boosted(rows, columns, is_regression, scoring, seed, tune, **boosting)
    if "score" not in predictions.columns:
        predictions = predictions.withColumn("score", F.col("prediction"))
    return _metric(predictions, ["repeat", "fold"], scoring)


# --- attribute reconstruction ------------------------------------------------------------------

MIN_VALUES = 30
SAMPLE_CAP = 10_000


def attribute_target(
    triples: DataFrame, targets: DataFrame, rel: int, stat: str = "none", min_values: int = MIN_VALUES
) -> DataFrame:
    """``(entity_id, y)``: a relation's value per target entity: every value (``none``), the mean,
    or a quartile over heads with more than ``min_values`` values."""
    wanted = targets.select("entity_id").filter("entity_id is not null").distinct()
    values = triples.filter(F.col("rel") == rel).select(F.col("head").alias("entity_id"), F.col("tail_val").alias("y"))
    values = values.join(wanted, "entity_id", "left_semi")
    if stat == "none":
        return values
    if stat == "mean":
        return values.groupBy("entity_id").agg(F.avg("y").alias("y"))
    prob = {"Q1": 0.25, "Q3": 0.75}[stat]
    quartiles = exact_quantiles(values, ["entity_id"], "y", [prob], min_rows=min_values)
    return quartiles.select("entity_id", F.col("quantile").alias("y"))


def sample_cap(rows: DataFrame, key: str, seed: int, cap: int = SAMPLE_CAP) -> DataFrame:
    """A reproducible random sample of at most ``cap`` rows."""
    return rows.withColumn("_order", md5int(F.lit(seed), key)).orderBy("_order", key).limit(cap).drop("_order")


def knn_regression(rows: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Mean out-of-fold r2 of every (k, p, weights)."""
    predictions = knn_predictions(knn_neighbours(rows, max(k_values)), k_values)
    return r2_score(predictions, ["repeat", "fold", "k", "p", "weights"])


def knn_cross_validation(
    rows: DataFrame, seed: int = 0, inner_folds: int = 3, k_values: Sequence[int] = K_VALUES
) -> DataFrame:
    """Nested search: per outer (repeat, fold), the (k, p, weights) with the best mean inner r2 on the
    training rows, and its r2 on the held-out rows. ``rows``: ``(id, repeat, fold, y, vec)``."""
    # every row is a training row of the other folds: one inner split per (repeat, outer fold)
    split = F.pmod(md5int(F.lit(seed), "id"), F.lit(inner_folds)).cast("int")
    outer, inner = inner_neighbours(rows, split, max(k_values))
    held_out = r2_score(knn_predictions(outer, k_values), ["repeat", "fold", "k", "p", "weights"])
    scored = r2_score(knn_predictions(inner, k_values), ["repeat", "fold", "inner", "k", "p", "weights"])
    mean = scored.groupBy("repeat", "fold", "k", "p", "weights").agg(F.round(F.avg("r2"), 9).alias("inner_r2"))
    # the last digits differ between runs; of equal scores the smallest k and p win, then uniform weights
    order = F.struct("inner_r2", -F.col("k"), -F.col("p"), "weights")
    chosen = (
        mean.groupBy("repeat", "fold")
        .agg(F.max_by(F.struct("k", "p", "weights"), order).alias("best"))
        .select("repeat", "fold", "best.*")
    )
    return held_out.join(chosen, ["repeat", "fold", "k", "p", "weights"])
