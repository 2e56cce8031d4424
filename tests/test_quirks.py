"""The pinned semantics, one small fixture each."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import numeric as N
from factloom.operators import deep as D
from factloom.operators import evaluate as E
from factloom.operators import handmade as H
from factloom.operators import project as P
from factloom.operators import resolve as R
from factloom.operators import runs
from factloom.operators import sampling as S
from factloom.operators import triples as T
from factloom.operators import walks as W

ENC = "head long, rel int, kind string, tail_id long, tail_val double"
SPEC = T.TableSpec("id", "thing", {"colour": "colour", "owner": "person"}, ("size",))


@pytest.fixture(scope="module")
def things(spark):
    return spark.createDataFrame(
        [(1, "red", 7, 1.0), (2, None, 7, None), (3, None, None, 3.0)],
        "id long, colour string, owner long, size double",
    )


def tails(df):
    return Counter((r["rel"].split(" ")[-1], r["tail"]) for r in df.collect() if r["kind"] == "cat")


def test_missing_categories(things):
    per = T.tables_to_triples({"t": things}, {"t": SPEC})
    assert tails(per)["colour", "NaN_id -> colour"] == 2 and tails(per)["owner", "NaN_id -> owner"] == 1
    shared = T.tables_to_triples({"t": things}, {"t": SPEC}, missing="shared")
    assert tails(shared)["colour", "NaN"] == 2 and tails(shared)["owner", "NaN"] == 1
    assert sum(tails(T.tables_to_triples({"t": things}, {"t": SPEC}, missing="drop")).values()) == 3


def test_missing_numbers_are_dropped_unless_kept(things):
    count = lambda **o: T.tables_to_triples({"t": things}, {"t": SPEC}, **o).filter("kind = 'num'").count()
    assert count() == 2 and count(keep_null_numeric=True) == 3


def test_a_foreign_key_and_its_head_are_one_entity(spark, things):
    people = spark.createDataFrame([(7, 30.0)], "pid long, age double")
    specs = {"t": SPEC, "p": T.TableSpec("pid", "person", {}, ("age",))}
    graph = T.build_graph({"t": things, "p": people}, specs)
    names = [r["name"] for r in graph.entities.collect()]
    assert names.count("person:7") == 1
    reference = T.tables_to_triples({"t": things, "p": people}, specs, naming="reference")
    named = {r["head"] for r in reference.collect()} | {r["tail"] for r in reference.collect()}
    assert {"pid7", "id -> owner7"} <= named


def test_relation_ids_put_numbers_first_and_keep_absent_ones(things):
    named = T.tables_to_triples({"t": things}, {"t": SPEC})
    rels = T.relation_dictionary(named, {"id -> absent": "cat"}).orderBy("rel_id").collect()
    assert [(r["name"], r["kind"]) for r in rels] == [
        ("id -> size", "num"),
        ("id -> absent", "cat"),
        ("id -> colour", "cat"),
        ("id -> owner", "cat"),
    ]


def test_encode_then_decode(things):
    named = T.tables_to_triples({"t": things}, {"t": SPEC})
    graph = T.build_graph({"t": things}, {"t": SPEC})
    back = T.decode_triples(graph.triples, graph.entities, graph.relations)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, named.select(*back.columns).collect()))


def test_kind_filter_is_honoured_both_ways(spark):
    rows = spark.createDataFrame([(1, 0, "num", None, 2.0), (1, 1, "cat", 5, None)], ENC)
    assert [r["rel"] for r in T.triples_by_kind(rows, "numerical").collect()] == [0]
    assert [r["rel"] for r in T.triples_by_kind(rows, "categorical").collect()] == [1]


def test_best_epoch_is_the_row_of_the_best_score(spark):
    rows = spark.createDataFrame([("a", 2, 0.9), ("a", 8, 0.5), ("a", 4, 0.9)], "id string, epoch int, mean_score double")
    assert runs.best_epoch(rows, ["id"]).first()["epoch"] == 2


def test_inverse_relations_include_the_first_categorical_one(spark):
    triples = spark.createDataFrame([(1, 0, "num", None, 2.0), (1, 1, "cat", 9, None)], ENC)
    found = H.covering_relations(spark.createDataFrame([(9,)], "entity_id long"), triples)
    assert [(r["rel"], r["inverse"]) for r in found.collect()] == [(1, True)]


def test_one_hot_is_prefixed_by_its_own_column(spark):
    out = H.one_hot(spark.createDataFrame([("a",), ("b",), (None,)], "course string"), "course", missing=True)
    assert out.columns == ["course == a", "course == b", "course == nan"]
    assert sorted(map(tuple, out.collect())) == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]


@pytest.mark.parametrize("name, fn", [("sigmoid", lambda x: 1 / (1 + math.exp(-x))), ("tanh", math.tanh), ("relu", lambda x: max(x, 0)), (None, lambda x: x)])
def test_the_requested_activation_is_applied(spark, name, fn):
    weights = spark.createDataFrame([(0, [2.0, -1.0], [-3.0, 0.5])], "rel int, e1 array<double>, e2 array<double>")
    values = spark.createDataFrame([(0, 0.25)], "rel int, x double")
    vec = N.interp_embedding(values, weights, name).first()["vec"]
    assert vec == pytest.approx([fn(0.25 * 2 - 0.75 * 3), fn(-0.25 + 0.75 * 0.5)])


def test_draws_replace_one_side_within_the_relation(spark):
    rows = [(h, h % 2, "cat", 100 + h % 7, None) for h in range(60)]
    pos = spark.createDataFrame(rows, ENC).withColumn("pos_id", F.col("head"))
    neg = S.corrupt_triples(pos, S.corruption_candidates(pos, rows_per_bucket=5), 10, 0).collect()
    members = {r: ({x[0] for x in rows if x[1] == r}, {x[3] for x in rows if x[1] == r}) for r in (0, 1)}
    assert len(neg) == 600
    sides = Counter()
    for n in neg:
        h, rel, _, t, _ = rows[n["pos_id"]]
        assert n["rel"] == rel and (n["head"] == h or n["tail_id"] == t)
        assert n["head"] in members[rel][0] and n["tail_id"] in members[rel][1]
        sides["head" if n["head"] != h else "tail" if n["tail_id"] != t else "same"] += 1
    assert sides["head"] > 300 and sides["tail"] > 30  # heads outnumber tails among candidates


@pytest.mark.parametrize("rows_per_bucket", [2, 100_000])
def test_every_walk_step_is_an_edge(spark, rows_per_bucket):
    rows = [(1, 0, "cat", 100 + i, None) for i in range(30)] + [(100 + i, 1, "cat", 7, None) for i in range(30)]
    triples = spark.createDataFrame(rows, ENC)
    starts = spark.createDataFrame([(1,), (7,), (105,)], "entity_id long")
    edges = {(str(h), f"r{r}", str(t)) for h, r, _, t, _ in rows}
    walks = W.random_walks(W.graph_edges(triples), starts, 0, 10, 2, rows_per_bucket).collect()
    for w in walks:
        steps = w["walk"]
        assert str(w["start"]) in steps
        assert all(tuple(steps[i : i + 3]) in edges for i in range(0, len(steps) - 2, 2))
    assert max(len(w["walk"]) for w in walks) == 5 and len({tuple(w["walk"]) for w in walks if w["start"] == 1}) > 3


def test_pending_runs_compare_the_full_key(spark):
    wanted = spark.createDataFrame([("f", "t1"), ("f", "t2")], "filename string, target string")
    left = runs.pending_runs(wanted, wanted.filter("target = 't1'"), ["filename", "target"]).collect()
    assert [r["target"] for r in left] == ["t2"]


def test_values_are_kept_one_row_each_without_a_statistic(spark):
    triples = spark.createDataFrame([(1, 0, "num", None, 2.0), (1, 0, "num", None, 4.0)], ENC)
    targets = spark.createDataFrame([(1,), (1,)], "entity_id long")
    assert E.attribute_target(triples, targets, 0).count() == 2
    assert E.attribute_target(triples, targets, 0, "mean").first()["y"] == 3.0
    assert E.attribute_target(triples, targets, 0, "Q1").count() == 0  # not more than 30 values


def test_deep_features_stop_at_depth_three(spark):
    with pytest.raises(ValueError):
        D.long_features(spark.createDataFrame([], ENC), None, 4, 0, 1)


def test_shuffle_is_a_seeded_permutation(spark):
    triples = spark.createDataFrame([(h % 9, 0, "cat", h % 4, None) for h in range(90)], ENC)
    a = [tuple(r) for r in T.shuffle_triples(triples, 1).collect()]
    assert a == [tuple(r) for r in T.shuffle_triples(triples.repartition(7), 1).collect()]
    assert Counter(r[:5] for r in a) == Counter(map(tuple, triples.collect()))
    assert a != [tuple(r) for r in T.shuffle_triples(triples, 2).collect()]


def test_quantile_transform_is_monotone_and_averages_ties(spark):
    values = [1.0, 2.0, 2.0, 2.0, 3.0, 9.0]
    rows = spark.createDataFrame([(i, 0, "num", None, v) for i, v in enumerate(values)], ENC)
    out = {r["tail_val"]: r["x"] for r in N.scale_values(rows, "quantile").collect()}
    assert out == pytest.approx({1.0: 0.0, 2.0: 0.4, 3.0: 0.8, 9.0: 1.0})
    constant = spark.createDataFrame([(i, 0, "num", None, 4.0) for i in range(3)], ENC)
    assert {r["x"] for r in N.scale_values(constant, "quantile").collect()} == {0.0}
    assert {r["x"] for r in N.scale_values(constant, "min_max").collect()} == {0.0}


def test_ranking_metrics(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.8), (0, 0, 0.1), (1, 1, 0.2), (1, 0, 0.3)]
    df = spark.createDataFrame(rows, "fold int, label int, score double")
    ap = {r["fold"]: r["average_precision"] for r in E.average_precision(df, ["fold"]).collect()}
    auc = {r["fold"]: r["roc_auc"] for r in E.roc_auc(df, ["fold"]).collect()}
    assert ap == pytest.approx({0: 0.5 * 1 + 0.5 * 2 / 3, 1: 0.5})
    assert auc == pytest.approx({0: (2 + 1.5) / 4, 1: 0.0})


def test_linear_predictions_equal_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ [2.0, -1.0] + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "entity_id long, a double, b double, target double")
    folded = E.repeated_folds(df, "entity_id", 1, 0)
    got = {r["entity_id"]: (r["fold"], r["prediction"]) for r in E.cv_linear(folded, ["a", "b"]).collect()}
    design = np.column_stack([np.ones(60), x])
    folds = np.array([got[i][0] for i in range(60)])
    for i in range(60):
        train = folds != folds[i]
        coef = np.linalg.lstsq(design[train], y[train], rcond=None)[0]
        assert got[i][1] == pytest.approx(design[i] @ coef)


def test_folds_partition_the_rows(spark):
    df = spark.range(101).withColumn("label", F.col("id") % 2)
    exact = E.repeated_folds(df, "id", 2, 0, exact=True).groupBy("repeat", "fold").count().collect()
    assert sorted(r["count"] for r in exact) == [20] * 8 + [21] * 2
    strata = E.stratified_folds(df, "id", "label", 1, 0).groupBy("fold", "label").count().collect()
    assert all(r["count"] in (10, 11) for r in strata) and len(strata) == 10


def test_planted_attribute_is_read_back_from_vectors(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(120, 3))
    rows = [(i, float(v[0]), [float(e) for e in v]) for i, v in enumerate(vecs)]
    df = E.repeated_folds(spark.createDataFrame(rows, "id long, y double, vec array<double>"), "id", 1, 0)
    score = lambda d: d.filter("k = 4 AND p = 2 AND weights = 'distance'").agg(F.avg("r2")).first()[0]
    shuffled = df.withColumn("y", F.lit(0.0) + F.col("vec")[1] * 0 + F.pmod(F.col("id") * 37, F.lit(11)))
    assert score(E.knn_regression(df)) > 0.6 > score(E.knn_regression(shuffled))


def test_exact_matches_alone_count_under_distance_weights(spark):
    rows = [(0, 1.0, [0.0], 0), (1, 5.0, [0.0], 1), (2, 100.0, [1.0], 1)]
    df = spark.createDataFrame(rows, "id long, y double, vec array<double>, fold int").withColumn("repeat", F.lit(0))
    out = E.knn_predictions(E.knn_neighbours(df, 2), [2]).filter("id = 0 AND p = 1").collect()
    assert {r["weights"]: r["prediction"] for r in out} == {"uniform": 52.5, "distance": 5.0}


def test_one_checkpoint_is_required(spark):
    rows = spark.createDataFrame([("a", [2, 4]), ("a", [4])], "model string, epochs array<int>")
    assert runs.find_checkpoint(rows, {"model": "a"}, 2).count() == 1
    with pytest.raises(ValueError):
        runs.find_checkpoint(rows, {"model": "a"}, 4)


def test_labels_are_distinct_and_of_one_language(spark):
    labels = spark.createDataFrame([("a", "x@eng"), ("a", "x@eng"), ("a", "y@fra"), ("a", None), ("b", "z@eng")], "entity string, label string")
    out = R.entity_labels(labels, spark.createDataFrame([("a",)], "entity string")).collect()
    assert [tuple(r) for r in out] == [("a", "x@eng")]


def test_place_names(spark):
    df = spark.createDataFrame([("<King_County,_Texas>",), ("<New_York_County,_Texas>",)], "c string")
    assert [r["c"] for r in P.clean_place_names(df, "c").collect()] == ["King, Texas"]


def test_encoding_marks_other_and_missing_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 1, 2, 2, 3, None])], "head long, f long")
    out = D.encode_top_n(df, ["f"], 2)
    assert out.columns == ["head", "f = 1", "f = 2", "f is unknown"]
    assert [tuple(r)[1:] for r in out.orderBy("head").collect()] == [(1, 0, 0)] * 3 + [(0, 1, 0)] * 2 + [(0, 0, 1)] * 2


def test_nan_is_a_missing_number(spark):
    named = spark.createDataFrame(
        [("a", "x", "num", None, 1.0), ("b", "x", "num", None, float("nan")), ("c", "x", "num", None, 3.0)],
        "head string, rel string, kind string, tail string, value double",
    )
    assert sorted(r.head for r in T.fill_missing_tails(named).collect()) == ["a", "c"]
    coded = spark.createDataFrame(
        [(1, 0, "num", None, 1.0), (2, 0, "num", None, float("nan")), (3, 0, "num", None, 3.0)],
        "head long, rel int, kind string, tail_id long, tail_val double",
    )
    from factloom.functions import numeric as N

    scaled = {r["head"]: r["x"] for r in N.scale_values(coded, "min_max").collect()}
    assert scaled[1] == 0.0 and scaled[3] == 1.0
    assert N.fit_quantiles(coded).first()["quantiles"] == [1.0, 3.0]


def test_shuffle_takes_any_number(spark):
    coded = spark.createDataFrame(
        [(1, 0, "num", None, 1e300), (2, 0, "num", None, float("nan")), (3, 0, "num", None, -9.9e12)],
        "head long, rel int, kind string, tail_id long, tail_val double",
    )
    assert {r["head"] for r in T.shuffle_triples(coded, 1).collect()} == {1, 2, 3}


def test_undeclared_edge_relation_keeps_its_tails(spark):
    edges = spark.createDataFrame([("a", "knows", "b"), ("a", "owns", "c")], "h string, r string, t string")
    spec = T.TableSpec("h", "person", rel_col="r", tail_col="t", edge_domains={"knows": "person"})
    assert {r["tail"] for r in T.edge_table(edges, spec).collect()} == {"person:b", "owns:c"}


def test_one_hot_index_takes_any_number_of_values(spark):
    rows = spark.range(1_000_000).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("_value"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, 1), (-2, "other", 1)], "id long, v string, _value int").withColumn("_value", F.lit(1)))
    dictionary = H.category_dictionary(rows.filter("id >= 0"), "v")
    out = H.one_hot_index(rows.drop("_value"), "v", dictionary, "hot", missing=True)
    found = out.agg(F.count("*"), F.count_distinct("hot.index"), F.max("hot.index"), F.max("hot.size")).first()
    assert tuple(found) == (1_000_002, 1_000_001, 1_000_000, 1_000_001)
    special = {r["id"]: r["hot"]["index"] for r in out.filter("id < 0").collect()}
    assert special == {-1: 1_000_000, -2: None}
