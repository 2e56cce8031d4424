"""Tables to triples, dictionaries, encoding, and views over the encoded triples.

Named triples: ``(head string, rel string, kind 'cat'|'num', tail string, value double)``.
Encoded triples: ``(head long, rel int, kind, tail_id long, tail_val double)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.hashing import md5int
from factloom.functions.ordered import dense_ids, number_copies
from factloom.session import pin, stored_broadcast


@dataclass(frozen=True)
class TableSpec:
    """How one table becomes triples.

    ``categorical`` maps a column to the domain its values live in, so that a foreign key and
    the head it points at get the same name. ``rel_col``/``tail_col`` mark an edge table.
    """

    head_col: str
    domain: str
    categorical: Mapping[str, str] = field(default_factory=dict)
    numeric: Sequence[str] = ()
    rel_col: str | None = None
    tail_col: str | None = None
    edge_domains: Mapping[str, str] = field(default_factory=dict)  # relation -> tail domain
    edge_numeric: Sequence[str] = ()  # relations whose tail is a number


def relation_name(spec: TableSpec, column: str) -> str:
    return f"{spec.head_col} -> {column}"


def head_name(spec: TableSpec, naming: str = "domain") -> Column:
    key = F.col(spec.head_col).cast("string")
    prefix = {"domain": spec.domain + ":", "reference": spec.head_col, "plain": ""}[naming]
    return F.concat(F.lit(prefix), key)


def tail_name(value: Column, rel: str, domain: str, naming: str = "domain") -> Column:
    prefix = {"domain": domain + ":", "reference": rel, "plain": ""}[naming]
    return F.concat(F.lit(prefix), value.cast("string"))


def missing_tail(tail: Column, rel: Column, missing: str) -> Column:
    """Replacement for a missing categorical tail: one missing entity per relation or one in all."""
    if missing == "drop":
        return tail
    return F.coalesce(tail, F.concat(F.lit("NaN_"), rel) if missing == "per_relation" else F.lit("NaN"))


def unpivot_table(df: DataFrame, spec: TableSpec, naming: str = "domain") -> DataFrame:
    """One named triple per row and described column, missing tails kept, in one scan."""

    def entry(rel: str, kind: str, tail: Column, value: Column) -> Column:
        return F.struct(
            F.lit(rel).alias("rel"),
            F.lit(kind).alias("kind"),
            tail.cast("string").alias("tail"),
            value.cast("double").alias("value"),
        )

    null = F.lit(None)
    entries = [
        entry(relation_name(spec, c), "cat", tail_name(F.col(c), relation_name(spec, c), dom, naming), null)
        for c, dom in spec.categorical.items()
    ] + [entry(relation_name(spec, c), "num", null, F.col(c)) for c in spec.numeric]
    return df.select(head_name(spec, naming).alias("head"), F.inline(F.array(*entries)))


def edge_table(df: DataFrame, spec: TableSpec, naming: str = "domain") -> DataFrame:
    """Named triples from a table that already has one edge per row."""
    rel, tail = F.col(spec.rel_col), F.col(spec.tail_col)
    numeric = rel.isin(list(spec.edge_numeric)) if spec.edge_numeric else F.lit(False)
    if naming == "domain" and spec.edge_domains:
        domains = F.create_map(*[F.lit(x) for pair in spec.edge_domains.items() for x in pair])
        # A relation without a declared domain is a domain of its own.
        named = F.concat(F.coalesce(domains[rel], rel), F.lit(":"), tail.cast("string"))
    elif naming == "reference":
        named = F.concat(rel, tail.cast("string"))
    else:
        named = tail.cast("string")
    return df.select(
        head_name(spec, naming).alias("head"),
        rel.alias("rel"),
        F.when(numeric, "num").otherwise("cat").alias("kind"),
        F.when(~numeric, named).alias("tail"),
        F.when(numeric, tail.try_cast("double")).alias("value"),
    )


def union_triples(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def classify_relations(triples: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Set ``kind`` from the declared categorical relations."""
    return triples.withColumn("kind", F.when(F.col("rel").isin(list(categorical)), "cat").otherwise("num"))


def fill_missing_tails(
    triples: DataFrame, missing: str = "per_relation", keep_null_numeric: bool = False
) -> DataFrame:
    """Missing categories by the chosen rule; numbers that are null or NaN are dropped or null."""
    cat = F.col("kind") == "cat"
    filled = triples.withColumn(
        "tail", F.when(cat, missing_tail(F.col("tail"), F.col("rel"), missing))
    ).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    keep = F.lit(keep_null_numeric) | F.col("value").isNotNull()
    return filled.filter((cat & F.col("tail").isNotNull()) | (~cat & keep))


def tables_to_triples(
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    naming: str = "domain",
    missing: str = "per_relation",
    keep_null_numeric: bool = False,
) -> DataFrame:
    """All tables as one bag of named triples."""
    frames = [
        (edge_table if specs[name].rel_col else unpivot_table)(df, specs[name], naming)
        for name, df in tables.items()
    ]
    return fill_missing_tails(union_triples(*frames), missing, keep_null_numeric)


def entity_dictionary(triples: DataFrame) -> DataFrame:
    """``(entity_id, name)`` over heads and categorical tails: dense, 0-based, reproducible."""
    # one scan: both names of a triple come out of the same row, and copies are dropped
    # before the shuffle
    names = triples.select(F.explode(F.array("head", "tail")).alias("name")).filter("name is not null")
    return dense_ids(names.distinct(), "name", "entity_id")


def relation_dictionary(triples: DataFrame, declared: Mapping[str, str] | None = None) -> DataFrame:
    """``(rel_id, name, kind)``: numeric relations first, each kind sorted by name."""
    rels = triples.select(F.col("rel").alias("name"), "kind")
    if declared:
        extra = triples.sparkSession.createDataFrame(list(declared.items()), "name string, kind string")
        rels = rels.unionByName(extra)
    order = Window.orderBy(F.when(F.col("kind") == "num", 0).otherwise(1), "name")
    return rels.distinct().select((F.row_number().over(order) - 1).alias("rel_id"), "name", "kind")


def encode_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    heads = entities.select(F.col("name").alias("head_name"), F.col("entity_id").alias("head_id"))
    tails = entities.select(F.col("name").alias("_tail_key"), F.col("entity_id").alias("tail_id"))
    rels = relations.select(F.col("name").alias("rel"), "rel_id")
    # rows without a tail name match no entity, so they skip that join
    numbered = triples.join(stored_broadcast(rels, 128), "rel").drop("rel")
    found = numbered.filter("tail is not null").join(tails, F.col("tail") == F.col("_tail_key"), "left")
    without = numbered.filter("tail is null").withColumn("tail_id", F.lit(None).cast("long"))
    columns = ["head", "rel_id", "kind", "tail_id", "value"]
    return (
        found.select(*columns)
        .unionByName(without.select(*columns))
        .join(heads, F.col("head") == F.col("head_name"))
        .select(
            F.col("head_id").alias("head"),
            F.col("rel_id").alias("rel"),
            "kind",
            "tail_id",
            F.col("value").alias("tail_val"),
        )
    )


@dataclass(frozen=True)
class Graph:
    """Encoded triples with their dictionaries, stored once and read by everything after."""

    triples: DataFrame
    entities: DataFrame
    relations: DataFrame
    relation_ids: Mapping[str, tuple[int, str]]  # name -> (id, kind): schema-sized

    @property
    def n_numeric(self) -> int:
        return sum(kind == "num" for _, kind in self.relation_ids.values())

    @property
    def n_categorical(self) -> int:
        return len(self.relation_ids) - self.n_numeric


def build_graph(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], **options) -> Graph:
    """Tables to a stored graph. The dictionary is written before the triples are encoded with it,
    so the names are collected once."""
    named = tables_to_triples(tables, specs, **options)
    entities, relations = pin(entity_dictionary(named)), pin(relation_dictionary(named))
    ids = {r["name"]: (r["rel_id"], r["kind"]) for r in relations.collect()}
    return Graph(pin(encode_triples(named, entities, relations)), entities, relations, ids)


def decode_triples(encoded: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Back to named triples."""
    heads = entities.select(F.col("entity_id").alias("head"), F.col("name").alias("head_name"))
    tails = entities.select(F.col("entity_id").alias("tail_id"), F.col("name").alias("tail"))
    rels = relations.select(F.col("rel_id").alias("rel"), F.col("name").alias("rel_name"))
    cat = encoded.filter("tail_id is not null").join(tails, "tail_id")
    num = encoded.filter("tail_id is null").withColumn("tail", F.lit(None).cast("string"))
    return (
        cat.unionByName(num)
        .join(stored_broadcast(rels, 128), "rel")
        .join(heads, "head")
        .select(
            F.col("head_name").alias("head"),
            F.col("rel_name").alias("rel"),
            "kind",
            "tail",
            F.col("tail_val").alias("value"),
        )
    )


def shuffle_triples(encoded: DataFrame, seed: int) -> DataFrame:
    """Seeded random permutation, reproducible whatever the input order."""
    # copies of a triple and values of one head hash apart, so no key gathers many rows
    numbered = number_copies(encoded, "_copy")
    # numbers beyond the range of a long, and NaN, count as null here and are told apart by the last sort key
    value = F.round(F.col("tail_val") * 1_000_000).try_cast("long")
    keyed = numbered.withColumn("shuffle_key", md5int(F.lit(seed), "head", "rel", "tail_id", value, "_copy"))
    return keyed.orderBy("shuffle_key", "head", "rel", "tail_id", "tail_val").drop("_copy")


def dataset_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts and relation lists."""
    names = lambda kind: F.concat_ws(
        ",", F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))
    )
    tally = lambda kind: F.count_if(F.col("kind") == kind)
    rel = relations.agg(
        F.count(F.lit(1)).alias("n_relations"),
        tally("cat").alias("n_cat_attr"),
        tally("num").alias("n_num_attr"),
        names("cat").alias("cat_attr"),
        names("num").alias("num_attr"),
    ).withColumn("_one", F.lit(1))
    ent = entities.agg(F.count(F.lit(1)).alias("n_entities")).withColumn("_one", F.lit(1))
    return ent.join(rel, "_one").drop("_one")


# --- views over encoded triples -------------------------------------------------------------


def triples_by_kind(encoded: DataFrame, use_features: str = "all") -> DataFrame:
    kind = {"all": None, "categorical": "cat", "numerical": "num"}[use_features]
    return encoded if kind is None else encoded.filter(F.col("kind") == kind)


def split_triples(encoded: DataFrame, n_numeric: int) -> tuple[DataFrame, DataFrame]:
    """Categorical triples with relations counted from 0, and numeric triples."""
    cat = encoded.filter("kind = 'cat'").select(
        "head", (F.col("rel") - n_numeric).alias("rel"), F.col("tail_id").alias("tail")
    )
    num = encoded.filter("kind = 'num'").select("head", "rel", F.col("tail_val").alias("tail"))
    return cat, num


def literal_means(encoded: DataFrame) -> DataFrame:
    return encoded.filter("kind = 'num'").groupBy("head", "rel").agg(F.avg("tail_val").alias("value"))


def literal_matrix(encoded: DataFrame, entities: DataFrame, numeric_rels: Sequence[int]) -> DataFrame:
    """``(entity_id, literals array<double>)`` for every entity, 0 where a value is absent."""
    means = [F.avg(F.when(F.col("rel") == r, F.col("tail_val"))).alias(f"_{r}") for r in numeric_rels]
    rows = encoded.filter("kind = 'num'").groupBy(F.col("head").alias("entity_id")).agg(*means)
    cells = F.array(*[F.coalesce(f"_{r}", F.lit(0.0)) for r in numeric_rels])
    return entities.select("entity_id").join(rows, "entity_id", "left").select("entity_id", cells.alias("literals"))


def hrt_columns(encoded: DataFrame) -> DataFrame:
    """Head, relation and the one used tail side as text-free columns."""
    return encoded.select("head", "rel", "tail_id", "tail_val")
