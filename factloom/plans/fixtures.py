"""Shared inputs built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.hashing import md5int
from factloom.operators.triples import TableSpec, union_triples
from factloom.plans.registry import sql_md5int, table

SPECS = {
    "nation": TableSpec("n_nationkey", "nation", {"n_regionkey": "region", "n_name": "nation_name"}),
    "customer": TableSpec(
        "c_custkey", "customer", {"c_nationkey": "nation", "c_mktsegment": "segment"}, ("c_acctbal",)
    ),
    "supplier": TableSpec("s_suppkey", "supplier", {"s_nationkey": "nation"}, ("s_acctbal",)),
    "part": TableSpec("p_partkey", "part", {"p_brand": "brand", "p_type": "type"}, ("p_size", "p_retailprice")),
    "orders": TableSpec(
        "o_orderkey",
        "order",
        {"o_custkey": "customer", "o_orderstatus": "status", "o_orderpriority": "priority"},
        ("o_totalprice",),
    ),
}

EDGE_SPEC = TableSpec(
    "l_orderkey",
    "order",
    rel_col="rel",
    tail_col="tail",
    edge_domains={"contains": "part", "supplied_by": "supplier"},
    edge_numeric=("l_quantity",),
)

# Relations of the id-coded graph: numeric ones first, each kind in name order.
RELATIONS = {
    "c_acctbal": 0,
    "l_extendedprice": 1,
    "l_quantity": 2,
    "o_totalprice": 3,
    "p_retailprice": 4,
    "p_size": 5,
    "s_acctbal": 6,
    "c_mktsegment": 7,
    "c_nationkey": 8,
    "contains": 9,
    "n_regionkey": 10,
    "o_custkey": 11,
    "o_orderpriority": 12,
    "o_orderstatus": 13,
    "p_brand": 14,
    "p_type": 15,
    "s_nationkey": 16,
    "supplied_by": 17,
}
N_NUMERIC = 7
NUMERIC = list(range(N_NUMERIC))
CATEGORICAL = list(range(N_NUMERIC, len(RELATIONS)))

# Entities of keyed domains are numbered key * 8 + code; text values by hash.
DOMAIN_CODES = {"customer": 1, "order": 2, "part": 3, "supplier": 4, "nation": 5, "region": 6}

# table -> (head column, head domain, {relation: (column, tail domain or None for a number)})
GRAPH = {
    "customer": (
        "c_custkey",
        "customer",
        {
            "c_acctbal": ("c_acctbal", None),
            "c_mktsegment": ("c_mktsegment", "segment"),
            "c_nationkey": ("c_nationkey", "nation"),
        },
    ),
    "lineitem": (
        "l_orderkey",
        "order",
        {
            "l_extendedprice": ("l_extendedprice", None),
            "l_quantity": ("l_quantity", None),
            "contains": ("l_partkey", "part"),
            "supplied_by": ("l_suppkey", "supplier"),
        },
    ),
    "orders": (
        "o_orderkey",
        "order",
        {
            "o_totalprice": ("o_totalprice", None),
            "o_custkey": ("o_custkey", "customer"),
            "o_orderpriority": ("o_orderpriority", "priority"),
            "o_orderstatus": ("o_orderstatus", "status"),
        },
    ),
    "part": (
        "p_partkey",
        "part",
        {
            "p_retailprice": ("p_retailprice", None),
            "p_size": ("p_size", None),
            "p_brand": ("p_brand", "brand"),
            "p_type": ("p_type", "type"),
        },
    ),
    "supplier": (
        "s_suppkey",
        "supplier",
        {"s_acctbal": ("s_acctbal", None), "s_nationkey": ("s_nationkey", "nation")},
    ),
    "nation": ("n_nationkey", "nation", {"n_regionkey": ("n_regionkey", "region")}),
}


def entity(column: str, domain: str):
    if domain in DOMAIN_CODES:
        return F.col(column).cast("long") * 8 + DOMAIN_CODES[domain]
    return md5int(F.concat(F.lit(domain + ":"), F.col(column)))


def sql_entity(column: str, domain: str) -> str:
    if domain in DOMAIN_CODES:
        return f"({column}::BIGINT * 8 + {DOMAIN_CODES[domain]})"
    return sql_md5int(f"'{domain}:' || {column}")


def graph(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    """The encoded triples of the test tables; with ``relations``, only those (and only the
    tables they come from are scanned)."""
    frames = []
    for name, (head, domain, rels) in GRAPH.items():
        entries = [
            F.struct(
                F.lit(RELATIONS[rel]).alias("rel"),
                F.lit("cat" if dom else "num").alias("kind"),
                (entity(col, dom) if dom else F.lit(None).cast("long")).alias("tail_id"),
                (F.lit(None).cast("double") if dom else F.col(col).cast("double")).alias("tail_val"),
            )
            for rel, (col, dom) in rels.items()
            if not relations or rel in relations
        ]
        if entries:
            rows = table(spark, sf_dir, name)
            frames.append(rows.select(entity(head, domain).alias("head"), F.inline(F.array(*entries))))
    return union_triples(*frames)


def sql_graph(*relations: str) -> str:
    """The same triples as a subquery named by the caller."""
    selects = []
    for name, (head, domain, rels) in GRAPH.items():
        for rel, (col, dom) in rels.items():
            if relations and rel not in relations:
                continue
            tail = sql_entity(col, dom) if dom else "NULL::BIGINT"
            value = "NULL::DOUBLE" if dom else f"{col}::DOUBLE"
            kind = "cat" if dom else "num"
            selects.append(
                f"SELECT {sql_entity(head, domain)} AS head, {RELATIONS[rel]} AS rel, '{kind}' AS kind, "
                f"{tail} AS tail_id, {value} AS tail_val FROM {name}"
            )
    return " UNION ALL ".join(selects)


def graph_entities(triples: DataFrame) -> DataFrame:
    """Ids occurring as head or tail."""
    return (
        triples.select(F.explode(F.array("head", "tail_id")).alias("entity_id"))
        .filter("entity_id is not null")
        .distinct()
    )


SQL_ENTITIES = (
    "SELECT head AS entity_id FROM graph UNION SELECT tail_id FROM graph WHERE tail_id IS NOT NULL"
)


def customer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target table over customers in which every seventh key is unknown to the graph."""
    unknown = F.when(F.col("c_custkey") % 7 == 0, 1_000_000_000).otherwise(0)
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + unknown).alias("key"),
        F.concat(F.lit("customer:"), (F.col("c_custkey") + unknown).cast("string")).alias("col_to_embed"),
        F.col("c_acctbal").alias("target"),
        F.col("c_mktsegment").alias("party"),
    )


SQL_TARGETS = (
    "SELECT c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1000000000 ELSE 0 END AS key, "
    "'customer:' || (c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1000000000 ELSE 0 END) AS col_to_embed, "
    "c_acctbal AS target, c_mktsegment AS party FROM customer"
)
