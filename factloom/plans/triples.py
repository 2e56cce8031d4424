"""Tables to triples and views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import triples as T
from factloom.plans import fixtures as X
from factloom.plans.registry import query, r4, scratch, sql_md5int, sql_r4, table
from factloom.session import pin
from factloom.sources import io

SQL_SEGMENT = "nullif(c_mktsegment, 'BUILDING')"


def customers(spark, d) -> DataFrame:
    """Customers with some segments and balances missing."""
    return table(spark, d, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.expr(SQL_SEGMENT).alias("c_mktsegment"),
        F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END").alias("c_acctbal"),
    )


def edges(spark, d) -> DataFrame:
    """Order lines as an edge table (relation, tail text)."""
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        F.inline(
            F.array(
                F.struct(F.lit("contains").alias("rel"), F.col("l_partkey").cast("string").alias("tail")),
                F.struct(F.lit("supplied_by").alias("rel"), F.col("l_suppkey").cast("string").alias("tail")),
                F.struct(F.lit("l_quantity").alias("rel"), F.col("l_quantity").cast("string").alias("tail")),
            )
        ),
    )


def sql_customer(cat_prefix: str = "domain", raw: bool = False) -> str:
    """Unpivoted customers; ``raw`` keeps missing tails."""
    rel = lambda c: f"'c_custkey -> {c}'"
    head = {"domain": "'customer:' || c_custkey", "reference": "'c_custkey' || c_custkey"}[cat_prefix]
    pre = lambda c, dom: f"'{dom}:'" if cat_prefix == "domain" else rel(c)
    return f"""
      SELECT {head} AS head, {rel('c_nationkey')} AS rel, 'cat' AS kind,
             {pre('c_nationkey', 'nation')} || c_nationkey::VARCHAR AS tail, NULL::DOUBLE AS value FROM customer
      UNION ALL SELECT {head}, {rel('c_mktsegment')}, 'cat',
             {pre('c_mktsegment', 'segment')} || {SQL_SEGMENT}, NULL FROM customer
      UNION ALL SELECT {head}, {rel('c_acctbal')}, 'num', NULL,
             CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END FROM customer"""


SQL_EDGES = """
      SELECT 'order:' || l_orderkey AS head, 'contains' AS rel, 'cat' AS kind, 'part:' || l_partkey AS tail,
             NULL::DOUBLE AS value FROM lineitem
      UNION ALL SELECT 'order:' || l_orderkey, 'supplied_by', 'cat', 'supplier:' || l_suppkey, NULL FROM lineitem
      UNION ALL SELECT 'order:' || l_orderkey, 'l_quantity', 'num', NULL, l_quantity FROM lineitem"""

SQL_FILL = """
      SELECT head, rel, kind, CASE WHEN kind = 'cat' THEN coalesce(tail, 'NaN_' || rel) END AS tail, value
      FROM raw WHERE kind = 'cat' OR value IS NOT NULL"""

SQL_SIMPLE = """
      SELECT 'order:' || o_orderkey AS head, 'o_orderkey -> o_custkey' AS rel, 'cat' AS kind,
             'customer:' || o_custkey AS tail, NULL::DOUBLE AS value FROM orders
      UNION ALL SELECT 'order:' || o_orderkey, 'o_orderkey -> o_orderstatus', 'cat', 'status:' || o_orderstatus, NULL FROM orders
      UNION ALL SELECT 'order:' || o_orderkey, 'o_orderkey -> o_orderpriority', 'cat', 'priority:' || o_orderpriority, NULL FROM orders
      UNION ALL SELECT 'order:' || o_orderkey, 'o_orderkey -> o_totalprice', 'num', NULL, o_totalprice FROM orders
      UNION ALL SELECT 'nation:' || n_nationkey, 'n_nationkey -> n_regionkey', 'cat', 'region:' || n_regionkey, NULL FROM nation
      UNION ALL SELECT 'nation:' || n_nationkey, 'n_nationkey -> n_name', 'cat', 'nation_name:' || n_name, NULL FROM nation"""

SQL_RAW = f"{sql_customer()} UNION ALL {SQL_SIMPLE} UNION ALL {SQL_EDGES}"
SQL_TRIPLES = f"WITH raw AS ({SQL_RAW}), triples AS ({SQL_FILL})"
SQL_DICTS = f"""{SQL_TRIPLES},
  names AS (SELECT head AS name FROM triples UNION SELECT tail FROM triples WHERE tail IS NOT NULL),
  entities AS (SELECT row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) - 1 AS entity_id, name FROM names),
  relations AS (SELECT (row_number() OVER (ORDER BY CASE kind WHEN 'num' THEN 0 ELSE 1 END, name) - 1)::INTEGER AS rel_id,
                       name, kind FROM (SELECT DISTINCT rel AS name, kind FROM triples))"""
SQL_ENCODED = f"""{SQL_DICTS},
  encoded AS (SELECT h.entity_id AS head, r.rel_id AS rel, t.kind, e.entity_id AS tail_id, t.value AS tail_val
              FROM triples t JOIN entities h ON t.head = h.name JOIN relations r ON t.rel = r.name
              LEFT JOIN entities e ON t.tail = e.name)"""


def named(spark, d) -> DataFrame:
    """Customers, orders, nations and order lines as one bag of named triples."""
    tables = {
        "customer": customers(spark, d),
        "orders": table(spark, d, "orders"),
        "nation": table(spark, d, "nation"),
        "lineitem": edges(spark, d),
    }
    return T.tables_to_triples(tables, {**X.SPECS, "lineitem": X.EDGE_SPEC})


def encoded(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    triples = named(spark, d)
    entities, relations = pin(T.entity_dictionary(triples)), pin(T.relation_dictionary(triples))
    return T.encode_triples(triples, entities, relations), entities, relations


@query("unpivot_table", sql_customer())
def unpivot_table(spark, d):
    return T.unpivot_table(customers(spark, d), X.SPECS["customer"])


@query("edge_table", SQL_EDGES)
def edge_table(spark, d):
    return T.edge_table(edges(spark, d), X.EDGE_SPEC)


@query("union_triples", f"{sql_customer()} UNION ALL {SQL_EDGES}")
def union_triples(spark, d):
    return T.union_triples(unpivot_table(spark, d), edge_table(spark, d))


@query(
    "qualify_relations",
    f"WITH t AS ({sql_customer()}) SELECT rel, count(*) AS n FROM t GROUP BY rel",
)
def qualify_relations(spark, d):
    return unpivot_table(spark, d).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("namespace_entities", sql_customer("reference"))
def namespace_entities(spark, d):
    return T.unpivot_table(customers(spark, d), X.SPECS["customer"], naming="reference")


@query(
    "classify_relations",
    f"WITH t AS ({SQL_RAW}) SELECT head, rel, tail, value, CASE WHEN rel IN "
    "('c_custkey -> c_nationkey', 'c_custkey -> c_mktsegment', 'o_orderkey -> o_custkey', "
    "'o_orderkey -> o_orderstatus', 'o_orderkey -> o_orderpriority', 'n_nationkey -> n_regionkey', "
    "'n_nationkey -> n_name', 'contains', 'supplied_by') THEN 'cat' ELSE 'num' END AS kind FROM t",
)
def classify_relations(spark, d):
    raw = T.union_triples(
        unpivot_table(spark, d),
        T.unpivot_table(table(spark, d, "orders"), X.SPECS["orders"]),
        T.unpivot_table(table(spark, d, "nation"), X.SPECS["nation"]),
        edge_table(spark, d),
    ).drop("kind")
    declared = [
        T.relation_name(X.SPECS[t], c) for t in ("customer", "orders", "nation") for c in X.SPECS[t].categorical
    ]
    return T.classify_relations(raw, [*declared, "contains", "supplied_by"])


@query("fill_missing_tails", f"WITH raw AS ({sql_customer()}) {SQL_FILL}")
def fill_missing_tails(spark, d):
    return T.fill_missing_tails(unpivot_table(spark, d))


@query("tables_to_triples", f"{SQL_TRIPLES} SELECT * FROM triples")
def tables_to_triples(spark, d):
    return named(spark, d)


@query("entity_dictionary", f"{SQL_DICTS} SELECT entity_id, name FROM entities")
def entity_dictionary(spark, d):
    return T.entity_dictionary(named(spark, d))


@query("relation_dictionary", f"{SQL_DICTS} SELECT rel_id, name, kind FROM relations")
def relation_dictionary(spark, d):
    return T.relation_dictionary(named(spark, d))


@query("encode_triples", f"{SQL_ENCODED} SELECT * FROM encoded")
def encode_triples(spark, d):
    return encoded(spark, d)[0]


@query("decode_triples", f"{SQL_TRIPLES} SELECT head, rel, kind, tail, value FROM triples")
def decode_triples(spark, d):
    triples, entities, relations = encoded(spark, d)
    # triples with and without a tail are read apart: stored, they are encoded once
    return T.decode_triples(pin(triples), entities, relations)


@query(
    "shuffle_triples",
    f"WITH graph AS ({X.sql_graph()}), c AS (SELECT *, row_number() OVER (PARTITION BY head, rel, tail_id, tail_val) - 1 AS copy FROM graph) "
    f"SELECT head, rel, kind, tail_id, tail_val, {sql_md5int('7', 'head', 'rel', 'tail_id', 'round(tail_val * 1000000)::BIGINT', 'copy')} AS shuffle_key FROM c",
)
def shuffle_triples(spark, d):
    return T.shuffle_triples(X.graph(spark, d), seed=7)


@query(
    "dataset_stats",
    f"""{SQL_DICTS} SELECT (SELECT count(*) FROM entities) AS n_entities, count(*) AS n_relations,
        count(*) FILTER (kind = 'cat') AS n_cat_attr, count(*) FILTER (kind = 'num') AS n_num_attr,
        string_agg(name, ',' ORDER BY name) FILTER (kind = 'cat') AS cat_attr,
        string_agg(name, ',' ORDER BY name) FILTER (kind = 'num') AS num_attr FROM relations""",
)
def dataset_stats(spark, d):
    triples = named(spark, d)
    return T.dataset_stats(T.entity_dictionary(triples), T.relation_dictionary(triples))


@query(
    "save_load_triples",
    f"WITH graph AS ({X.sql_graph()}) SELECT head, rel, tail_id, tail_val, kind FROM graph WHERE kind = 'cat'",
)
def save_load_triples(spark, d):
    path = scratch(spark, "triples")
    io.save_triples(X.graph(spark, d), path)
    return io.load_triples(spark, path).filter("kind = 'cat'")


@query("read_csv_source", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def read_csv_source(spark, d):
    path = scratch(spark, "orders-csv")
    orders = table(spark, d, "orders").drop("o_orderdate")
    orders.write.csv(path, header=True)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return io.read_csv(spark, path, schema, ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query(
    "read_tsv_source",
    "SELECT c_name AS entity, c_mktsegment || '@eng' AS label FROM customer",
)
def read_tsv_source(spark, d):
    path = scratch(spark, "labels-tsv")
    (
        table(spark, d, "customer")
        .select(
            F.col("c_custkey").alias("C0"),
            F.col("c_name").alias("entity"),
            F.lit("label").alias("relation"),
            F.concat("c_mktsegment", F.lit("@eng")).alias("label"),
            F.lit("x").alias("C4"),
        )
        .write.csv(path, sep="\t", header=True)
    )
    return io.read_tsv(spark, path, ["C0", "entity", "relation", "label", "C4"], ["entity", "label"])


@query("read_parquet_source", "SELECT s_suppkey, s_acctbal FROM supplier")
def read_parquet_source(spark, d):
    return io.read_parquet(spark, f"{d}/supplier.parquet", ["s_suppkey", "s_acctbal"])


for _kind, _where in (("all", "true"), ("categorical", "kind = 'cat'"), ("numerical", "kind = 'num'")):

    @query(
        f"triples_by_kind_{_kind}",
        f"WITH graph AS ({X.sql_graph()}) SELECT * FROM graph WHERE {_where}",
    )
    def triples_by_kind(spark, d, _kind=_kind):
        return T.triples_by_kind(X.graph(spark, d), _kind)


@query(
    "split_triples_categorical",
    f"WITH graph AS ({X.sql_graph()}) SELECT head, rel - {X.N_NUMERIC} AS rel, tail_id AS tail FROM graph WHERE kind = 'cat'",
)
def split_categorical(spark, d):
    return T.split_triples(X.graph(spark, d), X.N_NUMERIC)[0]


@query(
    "split_triples_numerical",
    f"WITH graph AS ({X.sql_graph()}) SELECT head, rel, tail_val AS tail FROM graph WHERE kind = 'num'",
)
def split_numerical(spark, d):
    return T.split_triples(X.graph(spark, d), X.N_NUMERIC)[1]


@query(
    "literal_means",
    f"WITH graph AS ({X.sql_graph()}) SELECT head, rel, {sql_r4('avg(tail_val)')} AS value FROM graph "
    "WHERE kind = 'num' GROUP BY head, rel",
)
def literal_means(spark, d):
    return T.literal_means(X.graph(spark, d)).withColumn("value", r4("value"))


@query(
    "literal_matrix",
    f"WITH graph AS ({X.sql_graph()}), e AS ({X.SQL_ENTITIES}), m AS (SELECT head, "
    + ", ".join(f"avg(tail_val) FILTER (rel = {r}) AS v{r}" for r in X.NUMERIC)
    + " FROM graph WHERE kind = 'num' GROUP BY head) SELECT entity_id, "
    + ", ".join(f"{sql_r4(f'coalesce(v{r}, 0.0)')} AS lit_{r}" for r in X.NUMERIC)
    + " FROM e LEFT JOIN m ON entity_id = head",
)
def literal_matrix(spark, d):
    triples = X.graph(spark, d)
    wide = T.literal_matrix(triples, X.graph_entities(triples), X.NUMERIC)
    return wide.select("entity_id", *[r4(F.col("literals")[r]).alias(f"lit_{r}") for r in X.NUMERIC])


@query("hrt_columns", f"WITH graph AS ({X.sql_graph()}) SELECT head, rel, tail_id, tail_val FROM graph")
def hrt_columns(spark, d):
    return T.hrt_columns(X.graph(spark, d))
