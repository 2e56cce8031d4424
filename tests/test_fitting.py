import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import fitting as FT

TRIPLES = "head long, rel int, kind string, tail_id long, tail_val double"


def toy(spark):
    cat = [(h, 1 + h % 2, "cat", 100 + h % 5, None) for h in range(40)]
    num = [(h, 0, "num", None, float(h % 5) + h / 100) for h in range(40)]
    return spark.createDataFrame(cat + num, TRIPLES)


def chunk(config, n=5, seed=0):
    rng = np.random.default_rng(seed)
    s = config.negatives + 2
    numeric = np.arange(n) % 2 == 0 if config.numeric else np.zeros(n, bool)
    sides = np.concatenate([np.tile([0, 1], (n, 1)), rng.integers(0, 2, (n, s - 2))], 1)
    return dict(
        rel=np.arange(n),
        numeric=numeric,
        ids=np.arange(n * s).reshape(n, s),
        sides=sides,
        xs=rng.random((n, s)),
        vecs=rng.normal(size=(n, s, config.width)),
        rel_vec=rng.normal(size=(n, config.relation_width)),
        num_vec=rng.normal(size=(n, config.number_width)),
    )


CASES = [
    dict(model="translation", p=1),
    dict(model="translation", p=2, numeric="interp", loss="margin"),
    dict(model="bilinear", numeric="interp", activation="tanh"),
    dict(model="bilinear", numeric="bins"),
    dict(model="relation_scaled", numeric="interp", activation="relu"),
    dict(model="relation_scaled", numeric="interp", activation="sigmoid", loss="margin"),
    dict(model="relation_scaled", numeric="bins"),
    dict(model="dot"),
]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_gradients_equal_finite_differences(case):
    config = FT.FitConfig(dim=3, negatives=3, **case)
    data = chunk(config)
    out = {kind: (keys, grads) for kind, keys, grads in FT.chunk_gradients(config, **data)}
    loss = lambda: next(g[0, 0] for k, _, g in FT.chunk_gradients(config, **data) if k == FT.LOSS)
    eps = 1e-6
    checks = [(FT.RELATION, "rel_vec", lambda key: key)]
    checks.append((FT.ENTITY, "vecs", lambda key: np.unravel_index(key, data["ids"].shape)))
    if FT.NUMBER in out:
        checks.append((FT.NUMBER, "num_vec", lambda key: key))
    for kind, name, where in checks:
        for key, grad in zip(*out[kind]):
            cell = data[name][where(key)]
            for i in range(len(cell)):
                cell[i] += eps
                up = loss()
                cell[i] -= 2 * eps
                down = loss()
                cell[i] += eps
                assert (up - down) / (2 * eps) == pytest.approx(grad[i], abs=1e-4), (name, key, i)


@pytest.mark.parametrize(
    "case",
    [dict(model="relation_scaled", numeric="interp"), dict(model="translation", numeric="bins", loss="margin"), dict(model="bilinear")],
    ids=str,
)
def test_loss_decreases(spark, tmp_path, case):
    config = FT.FitConfig(dim=4, negatives=4, lr=0.1, **case)
    params = FT.fit_vectors(toy(spark), config, 4, str(tmp_path))
    losses = [r["loss"] for r in FT.epoch_loss(params, config, 80).orderBy("epoch").collect()]
    assert len(losses) == 4 and losses[-1] < losses[0]
    vectors = FT.export_vectors(params, config)
    assert vectors.count() == 45 and all(len(r["vec"]) == 4 for r in vectors.collect())


def rows(params):
    return {(r["kind"], r["id"]): r["vec"] for r in params.collect()}


def test_repeatable_and_resumable(spark, tmp_path):
    config = FT.FitConfig(dim=4, numeric="interp", negatives=2, lr=0.1, batch_size=40)
    once = rows(FT.fit_vectors(toy(spark), config, 3, str(tmp_path / "a")))
    FT.fit_vectors(toy(spark).repartition(7), config, 2, str(tmp_path / "b"), save_epochs=(1, 2))
    assert FT.stored_epoch(spark, str(tmp_path / "b"), "run", 9) == 2
    resumed = rows(FT.fit_vectors(toy(spark).repartition(3), config, 3, str(tmp_path / "b")))
    assert once.keys() == resumed.keys()
    for key, vec in once.items():
        assert resumed[key] == pytest.approx(vec, abs=1e-6)


def test_copies_of_a_triple_stay_separate_instances(spark):
    triples = spark.createDataFrame([(1, 0, "cat", 2, None)] * 30 + [(3, 0, "cat", 2, None)], TRIPLES)
    out = FT.training_rows(triples, FT.FitConfig())
    assert out.count() == 31 and out.select("pos_id").distinct().count() == 31


def test_skipgram_vectors_cover_the_vocabulary(spark, tmp_path):
    walks = spark.createDataFrame([(["a", "r1", "b"],), (["c", "r1", "b"],)], "walk array<string>")
    out = {r["word"]: r["vec"] for r in FT.fit_skipgram_vectors(walks, 4, 2, 0, str(tmp_path)).collect()}
    assert set(out) == {"a", "b", "c", "r1"} and all(len(v) == 4 for v in out.values())
    pairs = FT.skipgram_triples(walks, walks.select(F.explode("walk").alias("word")).distinct().withColumn("word_id", F.lit(0)), 1)
    assert pairs.count() == 8


def test_step_sends_each_vector_once_and_moves_no_parameters(spark, tmp_path):
    """Groups hold every vector that their positives use, once; the update joins buckets without an exchange."""
    config = FT.FitConfig(dim=4, numeric="interp", negatives=2, batch_size=40)
    rows = FT.training_rows(toy(spark), config)
    candidates = FT.corruption_candidates(rows)
    choices = candidates.groupBy("rel").agg(F.count("*").alias("n_choices"))
    state = FT.Generations(spark, str(tmp_path))
    state.write(FT.start_params(rows, config).repartition(state.buckets, "kind", "id"))
    grouped = FT.grouped_positives(FT.batch_slots(rows, candidates, choices, config, 1), 3)
    sent = FT.group_vectors(grouped, state.read(), config)
    keys = [(r["grp"], r["kind"], r["id"]) for r in sent.collect()]
    assert len(keys) == len(set(keys))
    used = {(r["grp"], FT.ENTITY, s["id"]) for r in grouped.collect() for s in r["s"] if s["id"] is not None}
    assert used == {k for k in keys if k[1] == FT.ENTITY}
    updated = FT.adam_update(state.read(), FT.batch_gradients(grouped, state.read(), config, 1), config, 1, 80 * 3, 1)
    plan = updated._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "m#" in line]
    assert scans and "Bucketed: true" in scans[0]
    state.close()


def test_pending_epochs_are_scored_once(spark, tmp_path):
    from factloom.operators import scoring_runs as SR

    configs = {"a": FT.FitConfig(dim=3, negatives=2, lr=0.1), "b": FT.FitConfig(model="bilinear", dim=4, negatives=2)}
    for name, config in configs.items():
        FT.fit_vectors(toy(spark), config, 2, str(tmp_path), name, save_epochs=(1, 2) if name == "a" else (2,))
    entities = spark.range(40).select(F.col("id").alias("entity_id"), F.concat(F.lit("e"), "id").alias("name"))
    targets = entities.select(F.col("name").alias("col_to_embed"), (F.col("entity_id") % 5).cast("double").alias("target"))
    score = lambda which: SR.score_pending(
        spark, str(tmp_path), str(tmp_path / "log"), which, "toy", targets, entities, "r2", "linear", 2
    )
    assert score({"a": configs["a"]}).count() == 2
    log = score(configs).orderBy("config_id", "epoch").collect()
    assert [(r["config_id"], r["epoch"], r["n_rows"], len(r["scores"])) for r in log] == [
        ("a", 1, 40, 10), ("a", 2, 40, 10), ("b", 2, 40, 10),
    ]


def test_negatives_of_an_epoch_are_drawn_in_one_pass(spark, tmp_path, monkeypatch):
    """Steps read neither candidates nor other batches: one pass over both for each epoch, not for each batch."""
    calls, drawn = [], FT.batch_slots
    monkeypatch.setattr(FT, "batch_slots", lambda *args: calls.append(1) or drawn(*args))
    config = FT.FitConfig(dim=3, numeric="interp", negatives=2, batch_size=20)
    params = FT.fit_vectors(toy(spark), config, 2, str(tmp_path))
    steps = params.filter(F.col("kind") == FT.LOSS).count()
    assert steps == 8 and len(calls) == 2


def test_update_sums_the_gradients_of_all_groups(spark):
    """Also where a parameter's gradients come in several Arrow batches."""
    config = FT.FitConfig(model="dot", dim=2, lr=0.5)
    params = spark.createDataFrame(
        [(0, i, [1.0, float(i)], [0.5, 0.0], [0.25, 1.0]) for i in range(6)] + [(3, 1, [7.0], [1.0], [])], FT.PARAM_SCHEMA
    )
    grads = [(0, i, [float(g), 2.0]) for i in range(5) for g in range(i + 1)] + [(3, 2, [3.0])] * 4
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        made = FT.adam_update(params, spark.createDataFrame(grads, "kind int, id long, grad array<double>"), config, 2, 10, 3)
        out = {(r["kind"], r["id"]): r for r in made.collect()}
    finally:
        spark.conf.set(name, before)
    assert len(out) == 8 and made.count() == 8
    for i in range(6):
        g = np.array([sum(range(i + 1)), 2.0 * (i + 1)]) / 10 * (i < 5)
        m = 0.9 * np.array([0.5, 0.0]) + 0.1 * g
        v = 0.999 * np.array([0.25, 1.0]) + 0.001 * g * g
        vec = np.array([1.0, i]) - 0.5 / (1 - 0.9**2) * m / (np.sqrt(v) / np.sqrt(1 - 0.999**2) + 1e-8)
        for name, value in (("vec", vec), ("m", m), ("v", v)):
            assert out[0, i][name] == pytest.approx(value, rel=1e-5), (i, name)
    assert (out[3, 1]["vec"], out[3, 1]["m"]) == ([7.0], [1.0])
    assert out[3, 2]["vec"] == pytest.approx([1.2]) and out[3, 2]["m"] == [3.0]


def test_buckets_follow_cores_and_bytes_not_shuffle_partitions(spark, tmp_path):
    """A step has a task for each core; between steps a vector is one value."""
    cores = spark.sparkContext.defaultParallelism
    assert FT.bucket_count(spark, 1000, 8) == cores
    assert FT.bucket_count(spark, 10**8, 8) >= 10**8 * 12 * 8 / FT.BUCKET_BYTES
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        state = FT.Generations(spark, str(tmp_path))
        assert state.buckets == cores
        params = spark.createDataFrame([(0, 5, [1.5, -2.0], [0.5, 0.0], [0.25, 1.0]), (3, 1, [7.0], [1.0], [])], FT.PARAM_SCHEMA)
        state.write(params)
        assert dict(state.read().dtypes)["vec"] == "binary"
        assert sorted(state.close().collect()) == sorted(params.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_negatives_are_drawn_for_a_bounded_number_of_slots(spark, tmp_path, monkeypatch):
    """Many batches are drawn in several passes, each over its own positives; the fit is the same."""
    config = FT.FitConfig(dim=3, numeric="interp", negatives=2, batch_size=20)
    whole = rows(FT.fit_vectors(toy(spark), config, 1, str(tmp_path / "a")))
    passes, drawn, dropped = [], FT.batch_slots, []
    monkeypatch.setattr(FT, "batch_slots", lambda positives, *args: passes.append(positives.count()) or drawn(positives, *args))
    monkeypatch.setattr(FT, "SLOTS_AT_ONCE", 1)
    monkeypatch.setattr(FT, "drop_finished", lambda session: dropped.append(1))
    cut = rows(FT.fit_vectors(toy(spark), config, 1, str(tmp_path / "b")))
    assert len(passes) == len(dropped) == 4 and sum(passes) == 80
    assert whole.keys() == cut.keys()
    for key, vec in whole.items():
        assert cut[key] == pytest.approx(vec, abs=1e-6)


def test_slots_of_a_positive_are_not_gathered_as_lists(spark):
    config = FT.FitConfig(dim=3, numeric="interp", negatives=3)
    positives = FT.training_rows(toy(spark), config)
    candidates = FT.corruption_candidates(positives)
    choices = candidates.groupBy("rel").agg(F.count("*").alias("n_choices"))
    slots = FT.batch_slots(positives, candidates, choices, config, 1)
    made = FT.grouped_positives(slots, 3)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in slots.collect():
        want.setdefault(r["pos_id"], set()).add((r["slot"], r["side"], r["id"], r["x"]))
    got = {r["pos_id"]: [tuple(s) for s in r["s"]] for r in made.collect()}
    assert {k: set(v) for k, v in got.items()} == want
    assert all([s[0] for s in v] == list(range(5)) for v in got.values())


def test_skipgram_pairs_are_made_of_numbers(spark):
    """Words are looked up for each place of a walk, not for each pair; an unknown word keeps its place."""
    walks = spark.createDataFrame([(["a", "x", "b", None, "a"],), (["a", "x", "b", None, "a"],), (["b"],)], "walk array<string>")
    words = spark.createDataFrame([("a", 0), ("b", 1)], "word string, word_id long")
    pairs = FT.skipgram_triples(walks, words, 2)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted((r["head"], r["tail_id"]) for r in pairs.collect()) == sorted([(0, 3), (2, 1), (2, 1), (0, 3)] * 2)
