import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value with a third of them."""
    rng = random.Random(0)
    rows = [("hot", 5.0 if rng.random() < 0.4 else rng.gauss(0, 10), i) for i in range(3000)]
    rows += [(f"g{i % 40}", rng.random(), 3000 + i) for i in range(400)]
    return rows, spark.createDataFrame(rows, "g string, x double, id long")


def test_dense_ids_are_a_bijection_and_ignore_partitioning(spark):
    names = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name"))
    ids = {r["name"]: r["e"] for r in O.dense_ids(names, "name", "e").collect()}
    assert sorted(ids.values()) == list(range(5000))
    assert ids == {r["name"]: r["e"] for r in O.dense_ids(names.repartition(13), "name", "e").collect()}


@pytest.mark.parametrize("rows_per_bucket", [100, 100_000])
def test_numbers_are_contiguous_in_every_group(skewed, rows_per_bucket):
    rows, df = skewed
    out = O.number_in_groups(df, ["g"], ["id"], "n", rows_per_bucket).collect()
    seen = defaultdict(list)
    for r in out:
        seen[r["g"]].append(r["n"])
    assert {g: len(v) for g, v in seen.items()} == Counter(r[0] for r in rows)
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())
    again = O.number_in_groups(df.repartition(9), ["g"], ["id"], "n", rows_per_bucket).collect()
    assert {(r["id"], r["n"]) for r in out} == {(r["id"], r["n"]) for r in again}


def test_running_totals(skewed):
    rows, df = skewed
    out = O.running_totals(df.withColumn("one", F.lit(1)), ["g"], ["x", "id"], {"rank": "one"}).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((x, id_) for gg, x, id_ in rows if gg == g)):
            want[r[1]] = i + 1
    assert {r["id"]: r["rank"] for r in out} == want
    sizes = Counter(r[0] for r in rows)
    assert all(r["rank_total"] == sizes[r["g"]] for r in out)


@pytest.mark.parametrize(("sorted_rows", "buckets"), [(4096, 4096), (50, 4), (1, 3)])
def test_exact_quantiles(skewed, monkeypatch, sorted_rows, buckets):
    monkeypatch.setattr(O, "BUCKETS", buckets)
    rows, df = skewed
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = O.exact_quantiles(df, ["g"], "x", probs, sorted_rows=sorted_rows)
    got = {(r["g"], r["prob_index"]): r["quantile"] for r in found.collect()}
    for g in {r[0] for r in rows}:
        want = np.quantile([r[1] for r in rows if r[0] == g], probs)
        assert [got[g, i] for i in range(5)] == pytest.approx(list(want))


def test_evenly_spaced_quantiles_of_a_small_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 10.0), ("b", 2.0)], "g string, x double")
    rows = O.exact_quantiles(df, ["g"], "x", 20).orderBy("g", "prob_index").collect()
    assert [(r["g"], r["quantile"]) for r in rows] == [("a", 1.0), ("a", 3.0), ("a", 10.0), ("b", 2.0)]


def test_quantiles_of_values_over_many_magnitudes_and_of_whole_numbers(spark):
    rng = random.Random(2)
    rows = [("a", rng.choice([1, -1]) * 10.0 ** rng.randint(-200, 200)) for _ in range(2000)] + [("b", -0.0), ("b", 0.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = [r["quantile"] for r in O.exact_quantiles(df, ["g"], "x", 20, sorted_rows=10).filter("g = 'a'").orderBy("prob_index").collect()]
    assert got == pytest.approx(list(np.quantile([x for g, x in rows if g == "a"], np.linspace(0, 1, 20))))
    whole = spark.range(10_000).select(F.lit("a").alias("g"), (F.col("id") % 7).alias("x"))
    assert [r["quantile"] for r in O.exact_quantiles(whole, ["g"], "x", [0.5, 1.0], sorted_rows=10).orderBy("prob_index").collect()] == [3.0, 6.0]


def test_min_rows_drops_small_groups(skewed):
    _, df = skewed
    assert {r["g"] for r in O.exact_quantiles(df, ["g"], "x", [0.5], min_rows=10).collect()} == {"hot"}


def test_number_copies(spark, monkeypatch):
    monkeypatch.setattr(O, "COPIES_PER_CHUNK", 7)
    df = spark.createDataFrame([("a", None)] * 50 + [("b", 1)], "k string, v int")
    out = O.number_copies(df, "copy").collect()
    assert sorted(r["copy"] for r in out if r["k"] == "a") == list(range(50))
    assert [r["copy"] for r in out if r["k"] == "b"] == [0]


def plan_lines(df):
    return [line.strip(" :+-*") for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]


def test_sizes_of_large_groups_are_joined_without_moving_the_rows(skewed):
    rows, df = skewed
    lines = plan_lines(O.number_in_groups(df, ["g"], ["id"], "n", 100))
    # the one by group alone moves the offsets, a row for each bucket
    assert len([line for line in lines if line.startswith("Exchange hashpartitioning(g#") and "_bucket" not in line]) == 1


def test_only_rows_of_many_copies_move_twice(spark, monkeypatch):
    df = spark.createDataFrame([(i % 7,) for i in range(40)] + [(8,)] * 25, "x int")
    monkeypatch.setattr(O, "COPIES_PER_CHUNK", 10)
    lines = plan_lines(O.number_copies(df, "c"))
    second = next(k for k, line in enumerate(lines) if "REPARTITION_BY_COL" in line)
    assert any(line.startswith("Filter") and "> 10)" in line for line in lines[second:])
    out = sorted((r["x"], r["c"]) for r in O.number_copies(df, "c").collect())
    want = Counter([i % 7 for i in range(40)] + [8] * 25)
    assert out == sorted((x, k) for x, n in want.items() for k in range(n))


def test_tasks_are_bounded_and_smaller_sizes_stay(spark):
    from factloom import session

    key = session.TASK_SIZES[0]
    before = spark.conf.get(key)
    try:
        for size, want in (("512m", f"{session.TASK_BYTES}b"), ("1m", "1m")):
            spark.conf.set(key, size)
            session.tune(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
