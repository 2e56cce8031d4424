"""Least squares and nearest neighbours against plain computations, whatever the layout of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluate as E
from factloom.operators import linear, neighbours


def linear_rows(spark, n=100, missing=7):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2)) + [1000.0, 0.0]
    y = 3 + x @ [2.0, -1.0] + 0.1 * rng.normal(size=n)
    x[::missing, 0] = np.nan
    x[3::11, 1] = np.nan
    rows = [(i, float(a), None if np.isnan(b) else float(b), float(t), i % 5) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "entity_id long, `a.b` double, b double, target double, fold int")
    return df.withColumn("repeat", F.lit(0)), x, y


def predicted(x, y, folds):
    out = np.empty(len(y))
    for fold in set(folds):
        train = folds != fold
        filled = np.where(np.isnan(x), np.nanmean(x[train], axis=0), x)
        design = np.column_stack([np.ones(len(y)), filled])
        out[~train] = (design @ np.linalg.lstsq(design[train], y[train], rcond=None)[0])[~train]
    return out


@pytest.mark.parametrize("partitions", [1, 2, 8, 25])
def test_missing_features_take_the_training_mean_on_any_partitioning(spark, partitions):
    df, x, y = linear_rows(spark)
    got = E.cv_linear(df.repartition(partitions), ["a.b", "b"]).orderBy("entity_id").collect()
    assert [r["prediction"] for r in got] == pytest.approx(list(predicted(x, y, np.arange(100) % 5)))


@pytest.mark.parametrize(("tile", "held"), [(128, 16_000_000), (2, 16_000_000), (3, 1)])
def test_tiles_and_flushes_do_not_change_the_fit(spark, monkeypatch, tile, held):
    monkeypatch.setattr(linear, "TILE", tile)
    monkeypatch.setattr(linear, "CELLS_HELD", held)
    df, x, y = linear_rows(spark)
    got = E.cv_linear(df.repartition(3), ["a.b", "b"]).orderBy("entity_id").collect()
    assert [r["prediction"] for r in got] == pytest.approx(list(predicted(x, y, np.arange(100) % 5)))


def test_rows_without_target_are_predicted_but_not_learnt_from(spark):
    df, x, y = linear_rows(spark)
    hidden = df.withColumn("target", F.when(F.col("entity_id") >= 20, F.col("target")))
    got = {r["entity_id"]: r["prediction"] for r in E.cv_linear(hidden, ["a.b", "b"]).collect()}
    want = predicted(x[20:], y[20:], np.arange(20, 100) % 5)
    assert len(got) == 100 and [got[i] for i in range(20, 100)] == pytest.approx(list(want))
    assert all(got[i] is not None for i in range(20))


def test_a_feature_missing_throughout_and_a_constant_one_have_no_weight(spark):
    df, _, y = linear_rows(spark)
    rows = df.withColumn("none", F.lit(None).cast("double")).withColumn("same", F.lit(4.0))
    got = E.cv_linear(rows, ["none", "same"]).orderBy("entity_id").collect()
    folds = np.arange(100) % 5
    assert [r["prediction"] for r in got] == pytest.approx([y[folds != f].mean() for f in folds])


def nearest_by_hand(ids, ys, xs, folds, k, p):
    out = {}
    for i in range(len(ids)):
        gap = np.abs(xs - xs[i])
        far = gap.sum(1) if p == 1 else np.sqrt((gap * gap).sum(1))
        allowed = [j for j in range(len(ids)) if folds[j] != folds[i]]
        best = sorted(allowed, key=lambda j: (far[j], ids[j]))[:k]
        out[ids[i]] = [(far[j], ys[j]) for j in best]
    return out


@pytest.mark.parametrize(("block_rows", "pivots"), [(4096, 256), (20, 12), (7, 3)])
def test_neighbours_equal_a_full_search(spark, monkeypatch, block_rows, pivots):
    """Far clusters, so that blocks are left out, with equal points and equal distances between them."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(neighbours, "MAX_PIVOTS", pivots)
    rng = np.random.default_rng(5)
    xs = np.concatenate([rng.integers(0, 4, (60, 3)) + 100.0 * c for c in range(4)] + [rng.normal(size=(20, 3))])
    ids, ys, folds = rng.permutation(len(xs)), rng.normal(size=len(xs)), rng.integers(0, 3, len(xs))
    rows = [(int(i), 0, int(f), float(y), x.tolist()) for i, f, y, x in zip(ids, folds, ys, xs)]
    df = spark.createDataFrame(rows, "id long, repeat int, fold int, y double, vec array<double>")
    got = E.knn_neighbours(df, 5).collect()
    assert len(got) == 2 * len(xs)
    for p in (1, 2):
        want = nearest_by_hand(ids, ys, xs, folds, 5, p)
        for r in got:
            if r["p"] == p:
                assert list(zip(r["distances"], r["values"])) == want[r["id"]]


def test_inner_neighbours_stay_outside_the_outer_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, i % 3, float(i), rng.normal(size=2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, repeat int, fold int, y double, vec array<double>")
    inner = F.pmod(F.col("id") * 7, F.lit(2)).cast("int")
    _, found = neighbours.inner_neighbours(df, inner, 4)
    ids, xs = np.arange(60), np.array([r[4] for r in rows])
    for fold in range(3):
        part = ids[ids % 3 != fold]
        want = nearest_by_hand(part, part.astype(float), xs[part], part * 7 % 2, 4, 2)
        got = {r["id"]: list(zip(r["distances"], r["values"])) for r in found.filter(f"fold = {fold} AND p = 2").collect()}
        assert got == want


def test_more_points_than_any_one_block(spark):
    rows = spark.range(12_000).select(
        "id", F.lit(0).alias("repeat"), (F.col("id") % 2).cast("int").alias("fold"), F.col("id").cast("double").alias("y"),
        F.array(F.col("id").cast("double")).alias("vec"),
    )
    found = E.knn_neighbours(rows, 2, [1])
    assert found.count() == 12_000
    assert found.filter("id > 0 AND id < 11999 AND values[0] <> id - 1").count() == 0


def boosted_rows(spark, n=400):
    """The target is high where the feature is missing, low at zero, and in between elsewhere."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        x = [None, 0.0, float(rng.normal() + 3), float(rng.normal() - 3)][i % 4]
        rows.append((i, x, {0: 5.0, 1: -5.0}.get(i % 4, 0.0) + 0.1 * rng.normal(), i % 3))
    return spark.createDataFrame(rows, "entity_id long, x double, target double, fold int").withColumn("repeat", F.lit(0))


def test_trees_tell_missing_from_zero(spark):
    scores = E.cross_validated_scores(boosted_rows(spark), ["x"], True, "r2", max_iter=5).collect()
    assert len(scores) == 3 and all(r["r2"] > 0.9 for r in scores)


def test_grid_search_chooses_what_brute_force_chooses(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, x), float(x[0] * x[1] > 0), i % 2) for i, x in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, target double, fold int").withColumn("repeat", F.lit(0))
    prepared, stages = E._prepared(df, ["a", "b"])
    grid = {"maxDepth": (1, 4), "minInstancesPerNode": (4, 60)}
    model = E.grid_search(prepared, stages, False, "average_precision", 0, 3, grid).stages[-1]
    inner = prepared.withColumn("inner", F.pmod(E.md5int(F.lit(0), "entity_id"), F.lit(3)).cast("int"))
    best, chosen = -1.0, None
    for depth in grid["maxDepth"]:
        for leaf in grid["minInstancesPerNode"]:
            total = 0.0
            for fold in range(3):
                estimator = E._estimator(False, 0, 3).setMaxDepth(depth).setMinInstancesPerNode(leaf)
                fitted = E.Pipeline(stages=[*stages, estimator]).fit(inner.filter(F.col("inner") != fold))
                scored = E._scored(fitted, inner.filter(F.col("inner") == fold), False).toPandas().sort_values("score", ascending=False)
                hits = scored["target"].to_numpy().cumsum()
                ends = scored["score"].to_numpy() != np.append(scored["score"].to_numpy()[1:], np.nan)
                steps, seen = hits[ends], np.flatnonzero(ends) + 1
                total += (np.diff(np.append(0, steps)) * steps / seen).sum() / hits[-1]
            if total > best + 1e-12:
                best, chosen = total, (depth, leaf)
    assert (model.getMaxDepth(), model.getMinInstancesPerNode()) == chosen
