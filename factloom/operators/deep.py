"""Deep feature synthesis over triples, in long form.

Links: ``(col, kind, head, tail_id, tail_val)`` where ``col`` names a relation and direction:
``N<rel>`` numeric, ``C<k>`` categorical, ``C<n_cat + k>`` its inverse. Features stay long
``(head, feature, num, cat)`` until one grouped aggregate turns them into sparse rows over a dictionary
of features, from which ``feature_matrix`` makes columns; joins and aggregates do not grow with the relations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import broadcast_if_small, pin, stored_broadcast

NUMERIC_STATS = ("SUM", "MEAN", "MIN", "MAX", "STD", "SKEW")
CATEGORICAL_STATS = ("NUM_UNIQUE", "MODE")
TOP_N = 10
# An id in a broadcast table, and how much of them is broadcast, so that the links of all others are not shuffled.
TARGET_BYTES, TARGETS_BYTES = 32, 256 * 2**20


def relation_tables(triples: DataFrame, n_numeric: int, n_categorical: int) -> DataFrame:
    """Triples as links, each categorical one also reversed; one long table."""
    k = F.col("rel") - n_numeric
    name = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    link = lambda col, head, tail: F.struct(
        col.alias("col"), F.col(head).alias("head"), F.col(tail).alias("tail_id")
    )
    forward = F.when(F.col("kind") == "num", name("N", F.col("rel"))).otherwise(name("C", k))
    backward = name("C", k + n_categorical)
    both = F.array(link(forward, "head", "tail_id"), link(backward, "tail_id", "head"))
    # a numeric triple has no tail entity, so its reverse has no head
    links = triples.select("kind", "tail_val", F.inline(both)).filter("head is not null")
    return links.select("col", "kind", "head", "tail_id", "tail_val")


def functional_relations(links: DataFrame) -> DataFrame:
    """``(col, kind, is_functional)``: whether every head occurs once."""
    # per-head counts first, so a relation with most of the links is counted by many tasks
    seen = links.select("col", "kind", F.col("head").cast("long").alias("head"))
    once = seen.mapInArrow(_heads_once(), "col string, kind string, head long, again boolean")
    heads = once.groupBy("col", "kind", "head").agg(F.count(F.lit(1)).alias("_n"), F.max("again").alias("_again"))
    return heads.groupBy("col", "kind").agg((~F.max("_again") & (F.max("_n") == 1)).alias("is_functional"))


def _heads_once():
    """The heads of a task's relations, until one occurs again in a batch; that relation then has one row ``again``.
    So a relation with many links for a head is hardly shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            cols, kinds = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            key = cols.indices.to_numpy().astype(np.int64) * len(kinds.dictionary) + kinds.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            found, starts = np.unique(key[order], return_index=True)
            for code, rows in zip(found, np.split(order, starts[1:]), strict=True):
                name = tuple(x.dictionary[int(i)].as_py() for x, i in zip((cols, kinds), divmod(code, len(kinds.dictionary)), strict=True))
                if name in done:
                    continue
                heads = batch.column(2).take(pa.array(rows))
                if again := len(heads.unique()) < len(heads):
                    done.add(name)
                    heads = heads.slice(0, 1)
                n = len(heads)
                made = [pa.array([name[0]] * n, pa.string()), pa.array([name[1]] * n, pa.string()), heads, pa.array([again] * n)]
                yield pa.RecordBatch.from_arrays(made, ["col", "kind", "head", "again"])

    return run


@dataclass(frozen=True)
class Catalogue:
    """Relation names by shape: schema-sized driver metadata."""

    functional_num: tuple[str, ...]
    functional_cat: tuple[str, ...]
    multi_num: tuple[str, ...]
    multi_cat: tuple[str, ...]

    @property
    def functional(self) -> list[str]:
        return [*self.functional_num, *self.functional_cat]


def _number(name: str) -> int:
    return int(name[1:])


def catalogue(functional: DataFrame) -> Catalogue:
    """Collect the relation shapes (one row per relation and direction)."""
    rows = functional.collect()
    pick = lambda kind, flag: tuple(
        sorted((r["col"] for r in rows if r["kind"] == kind and r["is_functional"] == flag), key=_number)
    )
    return Catalogue(pick("num", True), pick("cat", True), pick("num", False), pick("cat", False))


def target_scope(links: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Links of the target entities only (``targets``: ``entity_id``); all when None."""
    if targets is None:
        return links
    heads = targets.select(F.col("entity_id").alias("head")).distinct()
    return links.join(stored_broadcast(heads, TARGET_BYTES, TARGETS_BYTES), "head", "left_semi")


def of_columns(links: DataFrame, cols: Sequence[str]) -> DataFrame:
    return links.filter(F.col("col").isin(list(cols)))


def direct_features(links: DataFrame, functional: Sequence[str]) -> DataFrame:
    """Depth 0, long: the single value of every functional relation."""
    return of_columns(links, functional).select(
        "head", F.col("col").alias("feature"), F.col("tail_val").alias("num"), F.col("tail_id").alias("cat")
    )


def sample_skew(value: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 for equal values."""
    n = F.count(value)
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n < 3, None).when(F.min(value) == F.max(value), 0.0).otherwise(corrected)


def numeric_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys…, COUNT, SUM, MEAN, MIN, MAX, STD, SKEW)`` in one partial-and-final aggregate."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("COUNT"),
        F.sum(v).alias("SUM"),
        F.avg(v).alias("MEAN"),
        F.min(v).alias("MIN"),
        F.max(v).alias("MAX"),
        F.stddev_samp(v).alias("STD"),
        sample_skew(v).alias("SKEW"),
    )


def categorical_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys…, COUNT, NUM_UNIQUE, MODE)``; the smallest of equally common values is the mode.

    Equal values are counted first: no group is ever held as a set or map.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    present = F.col(value).isNotNull()
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("COUNT"),
        F.count_if(present).alias("NUM_UNIQUE"),
        F.max_by(value, F.when(present, F.struct(F.col("_n"), -F.col(value)))).alias("MODE"),
    )


def _long(rows: DataFrame, keys: Sequence[str], name: Column, nums: Sequence[str], cats: Sequence[str]) -> DataFrame:
    cell = lambda s, num, cat: F.struct(
        F.lit(s).alias("stat"), num.cast("double").alias("num"), cat.cast("long").alias("cat")
    )
    null = F.lit(None)
    cells = [cell(s, F.col(s), null) for s in nums] + [cell(s, null, F.col(s)) for s in cats]
    return rows.select(*keys, name.alias("_of"), F.inline(F.array(*cells))).select(
        *keys, F.concat("stat", F.lit("("), "_of", F.lit(")")).alias("feature"), "num", "cat"
    )


def numeric_child_features(links: DataFrame, multi_num: Sequence[str]) -> DataFrame:
    """Depth 1, long: statistics of every multi-valued numeric relation."""
    stats = numeric_stats(of_columns(links, multi_num), ["head", "col"], "tail_val")
    return _long(stats, ["head"], F.col("col"), [*NUMERIC_STATS, "COUNT"], [])


def categorical_child_features(links: DataFrame, multi_cat: Sequence[str]) -> DataFrame:
    """Depth 1, long: count, distinct count and mode of every multi-valued categorical relation."""
    stats = categorical_stats(of_columns(links, multi_cat), ["head", "col"], "tail_id")
    return _long(stats, ["head"], F.col("col"), ["COUNT", "NUM_UNIQUE"], ["MODE"])


def through_tails(links: DataFrame, multi_cat: Sequence[str], features: DataFrame) -> DataFrame:
    """Long features of the tail entities, aggregated back to the heads.

    Numeric ones get the numeric statistics, categorical ones the distinct count and mode.
    """
    edges = of_columns(links, multi_cat).select("head", "col", F.col("tail_id").alias("_tail"))
    reached = edges.join(features.withColumnRenamed("head", "_tail"), "_tail")
    keys, name = ["head", "col", "feature"], F.concat("col", F.lit("."), "feature")
    # a feature is numeric or categorical by name: cat is null on every row of a numeric one
    num = numeric_stats(reached.filter("cat is null and num is not null"), keys, "num")
    cat = categorical_stats(reached.filter("cat is not null"), keys, "cat")
    return _long(num, ["head"], name, NUMERIC_STATS, []).unionByName(
        _long(cat, ["head"], name, ["NUM_UNIQUE"], ["MODE"])
    )


def two_hop_features(links: DataFrame, all_links: DataFrame, cat: Catalogue) -> DataFrame:
    """Depth 2: functional attributes of the tails, aggregated."""
    return through_tails(links, cat.multi_cat, direct_features(all_links, cat.functional))


def three_hop_features(links: DataFrame, all_links: DataFrame, cat: Catalogue) -> DataFrame:
    """Depth 3: the tails' own child aggregates, aggregated again."""
    children = numeric_child_features(all_links, cat.multi_num).unionByName(
        categorical_child_features(all_links, cat.multi_cat)
    )
    return through_tails(links, cat.multi_cat, children)


def feature_names(cat: Catalogue, depth: int) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names of a depth, from the relation shapes alone."""
    num, nominal = list(cat.functional_num), list(cat.functional_cat)
    children_num = [f"{s}({c})" for c in cat.multi_num for s in (*NUMERIC_STATS, "COUNT")] + [
        f"{s}({c})" for c in cat.multi_cat for s in ("COUNT", "NUM_UNIQUE")
    ]
    children_cat = [f"MODE({c})" for c in cat.multi_cat]
    if depth >= 1:
        num, nominal = num + children_num, nominal + children_cat
    for at, (tail_num, tail_cat) in ((2, (cat.functional_num, cat.functional_cat)), (3, (children_num, children_cat))):
        if depth >= at:
            num += [f"{s}({c}.{f})" for c in cat.multi_cat for f in tail_num for s in NUMERIC_STATS]
            num += [f"NUM_UNIQUE({c}.{f})" for c in cat.multi_cat for f in tail_cat]
            nominal += [f"MODE({c}.{f})" for c in cat.multi_cat for f in tail_cat]
    return num, nominal


def feature_count(cat: Catalogue, depth: int) -> int:
    """Number of features after one-hot encoding: nine more per mode feature."""
    num, nominal = feature_names(cat, depth)
    modes = sum(1 for f in nominal if f.startswith("MODE"))
    return len(num) + len(nominal) + 9 * modes


def long_features(
    triples: DataFrame,
    targets: DataFrame | None,
    depth: int,
    n_numeric: int,
    n_categorical: int,
    cat: Catalogue | None = None,
) -> tuple[DataFrame, Catalogue]:
    """All features up to ``depth`` (0 to 3) in long form; ``cat`` where the relations' shapes are known."""
    if not 0 <= depth <= 3:
        raise ValueError("depth must be 0, 1, 2 or 3")
    all_links = relation_tables(triples, n_numeric, n_categorical)
    cat = cat or catalogue(functional_relations(all_links))
    links = target_scope(all_links, targets)
    if targets is not None and depth >= 1:
        links = pin(links)  # read by every kind of feature
    features = direct_features(links, cat.functional)
    if depth >= 1:
        features = features.unionByName(numeric_child_features(links, cat.multi_num)).unionByName(
            categorical_child_features(links, cat.multi_cat)
        )
    if depth >= 2:
        features = features.unionByName(two_hop_features(links, all_links, cat))
    if depth >= 3:
        features = features.unionByName(three_hop_features(links, all_links, cat))
    return features, cat


def feature_dictionary(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``(index, feature)``: the features' numbers, in the order of ``names``."""
    return spark.createDataFrame(list(enumerate(names)), "index int, feature string")


def feature_vectors(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(head, index, num, cat)``: one sparse row per entity, the numbers and values of its features in the
    dictionary's order; one grouped aggregate whatever the number of features."""
    numbered = features.join(broadcast_if_small(dictionary, 128), "feature").filter("num is not null or cat is not null")
    cells = F.sort_array(F.collect_list(F.struct("index", "num", "cat")))
    field = lambda name: F.transform("cells", lambda c: c[name]).alias(name)
    return numbered.groupBy("head").agg(cells.alias("cells")).select("head", *map(field, ("index", "num", "cat")))


def vector_features(vectors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sparse rows back in long form ``(head, feature, num, cat)``."""
    long = vectors.select("head", F.inline(F.arrays_zip("index", "num", "cat")))
    return long.join(broadcast_if_small(dictionary, 128), "index").select("head", "feature", "num", "cat")


def _columns(n_numeric: int, zero: Sequence[bool], names: Sequence[str]):
    """Sparse rows as one column per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lengths = pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy()
            row = np.repeat(np.arange(n), lengths)
            index, num, cat = (batch.column(k).flatten() for k in (1, 2, 3))
            index = index.to_numpy()
            order = np.argsort(index, kind="stable")
            ends = np.searchsorted(index[order], np.arange(len(names) + 1))
            made = [batch.column(0)]
            for k in range(len(names)):
                at = order[ends[k] : ends[k + 1]]
                missing = np.ones(n, dtype=bool)
                if k < n_numeric:
                    values = np.zeros(n)
                    values[row[at]] = num.take(pa.array(at)).to_numpy(zero_copy_only=False)
                    missing[row[at]] = False
                    made.append(pa.array(values, mask=missing & (not zero[k])))
                else:
                    values = np.zeros(n, dtype=np.int64)
                    values[row[at]] = cat.take(pa.array(at)).to_numpy(zero_copy_only=False)
                    missing[row[at]] = False
                    made.append(pa.array(values, mask=missing))
            yield pa.RecordBatch.from_arrays(made, ["head", *names])

    return run


def feature_matrix(
    features: DataFrame, entities: DataFrame, numeric: Sequence[str], nominal: Sequence[str]
) -> DataFrame:
    """One row per entity and one column per named feature; counts and sums of nothing are 0."""
    names = [*numeric, *nominal]
    vectors = feature_vectors(features, feature_dictionary(features.sparkSession, names))
    heads = entities.select(F.col("entity_id").alias("head")).distinct()
    zero = [f.startswith(("COUNT(", "SUM(")) for f in names]
    kinds = ["head long", *[f"`{f}` double" for f in numeric], *[f"`{f}` long" for f in nominal]]
    rows = heads.select(F.col("head").cast("long")).join(vectors, "head", "left")
    return rows.mapInArrow(_columns(len(numeric), zero, names), ", ".join(kinds))


def deep_features(
    triples: DataFrame,
    targets: DataFrame,
    depth: int,
    n_numeric: int,
    n_categorical: int,
    cat: Catalogue | None = None,
) -> DataFrame:
    """The feature matrix of the target entities."""
    features, cat = long_features(triples, targets, depth, n_numeric, n_categorical, cat)
    return feature_matrix(features, targets, *feature_names(cat, depth))


# --- encoding and selection --------------------------------------------------------------------


def top_values(matrix: DataFrame, nominal: Sequence[str], n: int = TOP_N) -> dict[str, list[int]]:
    """The ``n`` most common values of each feature (ties: larger value first); ``n`` per feature
    is all that reaches the driver."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value")) for f in nominal])
    counts = (
        matrix.select(F.inline(cells))
        .filter("value is not null")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy("feature").orderBy(F.desc("_n"), F.desc("value"))
    best = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    found: dict[str, list] = {f: [] for f in nominal}
    for row in best.orderBy("feature", "_rank").collect():
        found[row["feature"]].append(row["value"])
    return found


def encode_top_n(matrix: DataFrame, nominal: Sequence[str], n: int = TOP_N) -> DataFrame:
    """Replace each nominal feature by 0/1 columns for its commonest values and one for all others."""
    if not nominal:
        return matrix
    columns = []
    for feature, values in top_values(matrix, nominal, n).items():
        col = F.col(f"`{feature}`")
        columns += [F.coalesce((col == v).cast("int"), F.lit(0)).alias(f"{feature} = {v}") for v in values]
        known = F.coalesce(col.isin(values), F.lit(False)) if values else F.lit(False)
        columns.append((~known).cast("int").alias(f"{feature} is unknown"))
    kept = [F.col(f"`{c}`") for c in matrix.columns if c not in set(nominal)]
    return matrix.select(*kept, *columns)


def drop_constant_features(matrix: DataFrame, keep: Sequence[str] = ("head",)) -> DataFrame:
    """Remove columns with a single value, null counting as a value; one pass, fixed-size state."""
    names = [c for c in matrix.columns if c not in keep]
    checks = []
    for i, name in enumerate(names):
        col = F.col(f"`{name}`")
        nulls = F.count_if(col.isNull())
        varied = (F.min(col) < F.max(col)) | ((nulls > 0) & (F.count(col) > 0))
        checks.append(F.coalesce(varied, F.lit(False)).alias(f"_{i}"))
    flags = matrix.agg(*checks).first()
    kept = [n for i, n in enumerate(names) if flags[i]]
    return matrix.select(*keep, *[F.col(f"`{n}`") for n in kept])


# --- registry of stored matrices ---------------------------------------------------------------

REGISTRY_SCHEMA = (
    "dataset string, target_entities string, depth int, n_features int, n_features_encoded int, path string"
)


def register_features(spark: SparkSession, registry: str, **entry) -> None:
    row = [tuple(entry[f.split()[0]] for f in REGISTRY_SCHEMA.split(", "))]
    spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(registry)


def find_features(spark: SparkSession, registry: str, dataset: str, target_entities: str, depth: int) -> DataFrame:
    """The stored run of a dataset, target list and depth; the first path where several exist."""
    rows = spark.read.schema(REGISTRY_SCHEMA).parquet(registry)
    same = (F.col("dataset") == dataset) & (F.col("target_entities") == target_entities) & (F.col("depth") == depth)
    return rows.filter(same).orderBy("path").limit(1)
