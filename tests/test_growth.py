"""What must not grow faster than the input: what is moved, made twice or copied."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import deep as D
from factloom.operators import neighbours as N
from factloom.operators import resolve as R
from factloom.operators import scoring as C
from factloom.plans import QUERIES

TRIPLES = "head long, rel int, kind string, tail_id long, tail_val double, x double"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def tables(spark, tmp_path):
    """Two customers, three orders and their lines."""
    made = {
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", [(1, 0, "A", 1.5), (2, 1, "BUILDING", 2.5)]),
        "nation": ("n_nationkey int, n_regionkey int, n_name string", [(0, 0, "X"), (1, 0, "Y")]),
        "orders": (
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double",
            [(1, 1, "F", "1", 10.0), (2, 1, "O", "2", 20.0), (3, 2, "O", "1", 30.0)],
        ),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double",
            [(1, 1, 1, 2.0, 5.0), (1, 2, 1, 3.0, 6.0), (2, 1, 2, 4.0, 7.0), (3, 2, 1, 5.0, 8.0)],
        ),
        "part": ("p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "b", "t", 1, 1.0), (2, "c", "t", 2, 2.0)]),
        "supplier": ("s_suppkey long, s_nationkey int, s_acctbal double", [(1, 0, 1.0), (2, 1, 2.0)]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_triples_are_encoded_once_before_they_are_decoded(spark, tables):
    decoded = QUERIES["decode_triples"](spark, tables)
    assert "Generate" not in plan(decoded)  # the tables are not turned into triples again
    rows = {tuple(r) for r in decoded.collect()}
    assert ("order:2", "contains", "cat", "part:1", None) in rows and ("order:3", "l_quantity", "num", None, 5.0) in rows
    assert ("customer:2", "c_custkey -> c_mktsegment", "cat", "NaN_c_custkey -> c_mktsegment", None) in rows


def test_numbers_are_not_moved_to_find_their_tails(spark):
    numbers = [(i, 0, "num", None, float(i), 0.5) for i in range(50)]
    tailed = [(i, 1, "cat", i + 1, None, None) for i in range(50)]
    triples = spark.createDataFrame(numbers + tailed + [(7, 1, "cat", None, None, None)], TRIPLES).coalesce(1)
    entities = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "entity_id long, vec array<double>")
    weights = spark.createDataFrame([(0, [1.0, 1.0], [0.0, 0.0])], "rel int, e1 array<double>, e2 array<double>")
    routed = C.route_tails(triples, entities.repartition(4), weights).withColumn("at", F.spark_partition_id()).collect()
    assert len(routed) == 101 and len({r["at"] for r in routed if r["kind"] == "num"}) == 1
    assert {(r["tail_id"], tuple(r["t"])) for r in routed if r["t"] and r["kind"] == "cat"} == {(i, (float(i), 1.0)) for i in range(1, 50)}
    assert {tuple(r["t"]) for r in routed if r["kind"] == "num"} == {(0.5, 0.5)}
    both = C.route_tails(triples, entities, weights, heads=True).collect()
    after = C.attach_heads(C.route_tails(triples, entities, weights), entities).collect()
    same = lambda rows: sorted(str(sorted(r.asDict().items())) for r in rows)
    assert same(both) == same(after)


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e200])
def test_fast_distances_lose_no_neighbour(shift):
    rng = np.random.default_rng(3)
    a, b = (np.round(rng.normal(size=(n, 7)), 1) + shift for n in (60, 300))
    b[:60] = a
    mask = rng.random((60, 300)) < 0.5
    for p in (1, 2):
        far = N.distances(a, b, p)
        want = N.smallest(np.where(mask, far, np.inf), 16)
        ((row, col, exact),) = N.nearest_pairs(a, b, p, [mask], 16)
        assert (row == want[0]).all() and (col == want[1]).all() and (exact == far[row, col]).all()


def test_a_text_is_not_moved_once_for_each_of_its_words(spark):
    names = spark.createDataFrame([("One two two",), ("three",), (None,)], "text string")
    words = spark.createDataFrame([("One", [3.0, 4.0]), ("Two", [0.0, 2.0])], "word string, vec array<double>")
    got = R.name_vectors(names, "text", words, 2)
    assert "groupingExpressions" not in plan(got) and "Aggregate [text" not in plan(got)
    assert {r["text"]: r["vec"] for r in got.collect()} == {
        "One two two": pytest.approx([0.2, (0.8 + 2) / 3]), "three": [0.0, 0.0], None: [0.0, 0.0],
    }


def test_a_relation_with_many_links_for_a_head_sends_one_row(spark):
    rows = [("C1", "cat", i // 2) for i in range(100)] + [("N0", "num", i) for i in range(100)] + [("C2", "cat", 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["col", "kind", "head"])
    sent = [r for b in D._heads_once()([batch, batch]) for r in b.to_pylist()]
    assert [r["again"] for r in sent if r["col"] == "C1"] == [True]
    assert sum(r["col"] == "N0" for r in sent) == 200  # a repeat in another batch is found by counting
    links = spark.createDataFrame(rows, "col string, kind string, head long").repartition(3)
    found = {r["col"]: r["is_functional"] for r in D.functional_relations(links).collect()}
    assert found == {"C1": False, "N0": True, "C2": True}


def test_shapes_of_relations_are_found_once_for_all_depths(spark, tables, monkeypatch):
    calls, found = [], D.functional_relations
    monkeypatch.setattr(D, "functional_relations", lambda links: calls.append(1) or found(links))
    matrix = QUERIES["feature_registry"](spark, tables)
    assert len(calls) == 1 and matrix.count() == 2
