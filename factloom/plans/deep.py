"""Deep feature synthesis over the graph of the test tables, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import deep as D
from factloom.operators import triples as T
from factloom.plans import fixtures as X
from factloom.plans.registry import query, r4, scratch, sql_r4, table
from factloom.session import pin

N_CAT = len(X.RELATIONS) - X.N_NUMERIC
RELS = tuple(X.RELATIONS)


def col_name(rel: str, inverse: bool = False) -> str:
    r = X.RELATIONS[rel]
    return f"N{r}" if r < X.N_NUMERIC else f"C{r - X.N_NUMERIC + N_CAT * inverse}"


SQL_LINKS = f"""WITH graph AS ({X.sql_graph(*RELS)}),
  links AS (SELECT CASE kind WHEN 'num' THEN 'N' || rel ELSE 'C' || (rel - {X.N_NUMERIC}) END AS col, kind, head, tail_id, tail_val FROM graph
    UNION ALL SELECT 'C' || (rel - {X.N_NUMERIC} + {N_CAT}), kind, tail_id, head, NULL FROM graph WHERE kind = 'cat'),
  shape AS (SELECT col, kind, count(*) = count(DISTINCT head) AS is_functional FROM links GROUP BY ALL),
  direct AS (SELECT head, col AS feature, tail_val AS num, tail_id AS cat FROM links JOIN shape USING (col, kind) WHERE is_functional),
  multi AS (SELECT links.* FROM links JOIN shape USING (col, kind) WHERE NOT is_functional)"""
SQL_SKEW = "CASE WHEN count({v}) < 3 THEN NULL WHEN min({v}) = max({v}) THEN 0.0 ELSE skewness({v}) END"
SQL_STATS = {
    "SUM": "sum({v})",
    "MEAN": "avg({v})",
    "MIN": "min({v})",
    "MAX": "max({v})",
    "STD": "stddev_samp({v})",
    "SKEW": SQL_SKEW,
}


def sql_num_stats(value: str, of: str, source: str, where: str = "true", count: bool = False) -> str:
    stats = {**SQL_STATS, **({"COUNT": "count(*)::DOUBLE"} if count else {})}
    return " UNION ALL ".join(
        f"SELECT head, '{s}(' || {of} || ')' AS feature, {e.format(v=value)} AS num, NULL::BIGINT AS cat FROM {source} WHERE {where} GROUP BY head, {of}"
        for s, e in stats.items()
    )


def sql_cat_stats(value: str, of: str, source: str, where: str = "true", count: bool = False) -> str:
    counts = f"(SELECT head, {of} AS o, {value} AS v, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL)"
    parts = [
        f"SELECT head, 'NUM_UNIQUE(' || o || ')' AS feature, count(v)::DOUBLE AS num, NULL::BIGINT AS cat FROM {counts} GROUP BY head, o",
        f"SELECT head, 'MODE(' || o || ')', NULL, arg_max(v, n * 10000000000000000000::HUGEINT - v) FROM {counts} GROUP BY head, o",
    ]
    if count:
        parts.append(f"SELECT head, 'COUNT(' || o || ')', sum(n)::DOUBLE, NULL FROM {counts} GROUP BY head, o")
    return " UNION ALL ".join(parts)


SQL_CHILDREN = (
    f"children AS ({sql_num_stats('tail_val', 'col', 'multi', 'kind = ' + repr('num'), count=True)} UNION ALL "
    f"{sql_cat_stats('tail_id', 'col', 'multi', 'kind = ' + repr('cat'), count=True)})"
)


def sql_through(features: str, out: str) -> str:
    return (
        f"{out}_r AS (SELECT m.head, m.col || '.' || f.feature AS o2, f.num, f.cat FROM multi m JOIN {features} f ON m.tail_id = f.head WHERE m.kind = 'cat'), "
        f"{out} AS ({sql_num_stats('num', 'o2', out + '_r', 'cat IS NULL AND num IS NOT NULL')} UNION ALL "
        f"{sql_cat_stats('cat', 'o2', out + '_r', 'cat IS NOT NULL')})"
    )


SQL_LONG = "SELECT head, feature, {num} AS num, cat FROM {t}"


def sql_long(name: str) -> str:
    return SQL_LONG.format(num=sql_r4("num"), t=name)


def links(spark, d, *rels):
    return D.relation_tables(X.graph(spark, d, *(rels or RELS)), X.N_NUMERIC, N_CAT)


def shaped(spark, d):
    """Links over a stored graph, and the shapes of its relations."""
    stored = D.relation_tables(pin(X.graph(spark, d, *RELS)), X.N_NUMERIC, N_CAT)
    return stored, D.catalogue(D.functional_relations(stored))


def rounded(features):
    return features.withColumn("num", r4("num"))


@query("relation_tables", f"{SQL_LINKS} SELECT * FROM links")
def relation_tables(spark, d):
    return links(spark, d)


@query("functional_relations", f"{SQL_LINKS} SELECT col, kind, is_functional FROM shape")
def functional_relations(spark, d):
    return D.functional_relations(links(spark, d))


@query("direct_features", f"{SQL_LINKS} {sql_long('direct')}")
def direct_features(spark, d):
    stored, cat = shaped(spark, d)
    return rounded(D.direct_features(stored, cat.functional))


@query(
    "numeric_child_features",
    f"{SQL_LINKS}, {SQL_CHILDREN} SELECT head, feature, {sql_r4('num')} AS num FROM children WHERE feature LIKE '%(N%'",
)
def numeric_child_features(spark, d):
    stored, cat = shaped(spark, d)
    return rounded(D.numeric_child_features(stored, cat.multi_num)).drop("cat")


@query("categorical_child_features", f"{SQL_LINKS}, {SQL_CHILDREN} {sql_long('children')} WHERE feature LIKE '%(C%'")
def categorical_child_features(spark, d):
    stored, cat = shaped(spark, d)
    return rounded(D.categorical_child_features(stored, cat.multi_cat))


@query("two_hop_features", f"{SQL_LINKS}, {sql_through('direct', 'hop2')} {sql_long('hop2')}")
def two_hop_features(spark, d):
    stored, cat = shaped(spark, d)
    return rounded(D.two_hop_features(stored, stored, cat))


SQL_CUSTOMERS = f"SELECT {X.sql_entity('c_custkey', 'customer')} AS entity_id FROM customer"


def customers(spark, d):
    return table(spark, d, "customer").select(X.entity("c_custkey", "customer").alias("entity_id"))


@query(
    "three_hop_features",
    f"{SQL_LINKS}, {SQL_CHILDREN}, {sql_through('children', 'hop3')} {sql_long('hop3')} WHERE head IN ({SQL_CUSTOMERS})",
)
def three_hop_features(spark, d):
    stored, cat = shaped(spark, d)
    return rounded(D.three_hop_features(D.target_scope(stored, customers(spark, d)), stored, cat))


@query("target_scope", f"{SQL_LINKS} SELECT * FROM links WHERE head IN ({SQL_CUSTOMERS})")
def target_scope(spark, d):
    return D.target_scope(links(spark, d), customers(spark, d))


_ORD, _PRICE, _STATUS = col_name("o_custkey", True), col_name("o_totalprice"), col_name("o_orderstatus")


@query(
    "deep_features_depth2",
    f"""SELECT {X.sql_entity('c_custkey', 'customer')} AS head, {sql_r4('any_value(c_acctbal)')} AS balance,
  any_value({X.sql_entity('c_nationkey', 'nation')}) AS nation, count(o_orderkey)::DOUBLE AS n_orders,
  {sql_r4('coalesce(sum(o_totalprice), 0)')} AS total, {sql_r4('avg(o_totalprice)')} AS average, {sql_r4('stddev_samp(o_totalprice)')} AS deviation,
  {sql_r4(SQL_SKEW.format(v='o_totalprice'))} AS skew, count(DISTINCT o_orderstatus)::DOUBLE AS n_status
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def deep_features_depth2(spark, d):
    triples = pin(X.graph(spark, d, *RELS))
    matrix = D.deep_features(triples, customers(spark, d), 2, X.N_NUMERIC, N_CAT)
    col = lambda name: F.col(f"`{name}`")
    return matrix.select(
        "head",
        r4(col(col_name("c_acctbal"))).alias("balance"),
        col(col_name("c_nationkey")).alias("nation"),
        col(f"COUNT({_ORD})").alias("n_orders"),
        r4(col(f"SUM({_ORD}.{_PRICE})")).alias("total"),
        r4(col(f"MEAN({_ORD}.{_PRICE})")).alias("average"),
        r4(col(f"STD({_ORD}.{_PRICE})")).alias("deviation"),
        r4(col(f"SKEW({_ORD}.{_PRICE})")).alias("skew"),
        F.coalesce(col(f"NUM_UNIQUE({_ORD}.{_STATUS})"), F.lit(0.0)).alias("n_status"),
    )


def through_vectors(features, cat, depth):
    """Features as sparse rows over the dictionary of a depth, read back in long form."""
    num, nominal = D.feature_names(cat, depth)
    dictionary = D.feature_dictionary(features.sparkSession, [*num, *nominal])
    return rounded(D.vector_features(pin(D.feature_vectors(features, dictionary)), dictionary))


SQL_PRESENT = "num IS NOT NULL OR cat IS NOT NULL"


@query(
    "deep_vectors_depth3",
    f"""{SQL_LINKS}, {SQL_CHILDREN}, {sql_through('direct', 'hop2')}, {sql_through('children', 'hop3')},
  every AS (SELECT * FROM direct UNION ALL SELECT * FROM children UNION ALL SELECT * FROM hop2 UNION ALL SELECT * FROM hop3)
  {sql_long('every')} WHERE head IN ({SQL_CUSTOMERS}) AND ({SQL_PRESENT})""",
)
def deep_vectors_depth3(spark, d):
    """Sparse feature rows of depth 3 for every customer."""
    features, cat = D.long_features(pin(X.graph(spark, d, *RELS)), customers(spark, d), 3, X.N_NUMERIC, N_CAT)
    return through_vectors(features, cat, 3)


@query(
    "deep_vectors_all_entities",
    f"""{SQL_LINKS}, {SQL_CHILDREN}, every AS (SELECT * FROM direct UNION ALL SELECT * FROM children)
  {sql_long('every')} WHERE {SQL_PRESENT}""",
)
def deep_vectors_all_entities(spark, d):
    """Sparse feature rows of depth 1 for every entity of the graph."""
    features, cat = D.long_features(pin(X.graph(spark, d, *RELS)), None, 1, X.N_NUMERIC, N_CAT)
    return through_vectors(features, cat, 1)


SQL_FLAGSHIP = f"""SELECT 'customer:' || c_custkey AS customer, {sql_r4('any_value(c_acctbal)')} AS balance,
  'segment:' || any_value(c_mktsegment) AS segment, count(o_orderkey)::DOUBLE AS n_orders,
  {sql_r4('coalesce(sum(o_totalprice), 0)')} AS total_price, {sql_r4('avg(o_totalprice)')} AS mean_price,
  {sql_r4('max(o_totalprice)')} AS max_price
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


@query("flagship", SQL_FLAGSHIP)
def flagship(spark, d):
    """Customers and orders to encoded triples, then depth-2 features of every customer."""
    graph = T.build_graph({name: table(spark, d, name) for name in ("customer", "orders")}, X.SPECS)
    entities = graph.entities

    def code(rel, inverse=False):
        number, kind = graph.relation_ids[rel]
        return f"N{number}" if kind == "num" else f"C{number - graph.n_numeric + graph.n_categorical * inverse}"

    orders, price = code("o_orderkey -> o_custkey", True), code("o_orderkey -> o_totalprice")
    targets = entities.filter(F.col("name").startswith("customer:"))
    matrix = D.deep_features(graph.triples, targets, 2, graph.n_numeric, graph.n_categorical)
    col = lambda name: F.col(f"`{name}`")
    segments = entities.select(F.col("entity_id").alias("_seg"), F.col("name").alias("segment"))
    return (
        matrix.join(targets.select(F.col("entity_id").alias("head"), F.col("name").alias("customer")), "head")
        .join(segments, F.col("_seg") == col(code("c_custkey -> c_mktsegment")), "left")
        .select(
            "customer",
            r4(col(code("c_custkey -> c_acctbal"))).alias("balance"),
            "segment",
            col(f"COUNT({orders})").alias("n_orders"),
            r4(col(f"SUM({orders}.{price})")).alias("total_price"),
            r4(col(f"MEAN({orders}.{price})")).alias("mean_price"),
            r4(col(f"MAX({orders}.{price})")).alias("max_price"),
        )
    )


SQL_MATRIX = f"SELECT c_custkey AS head, c_nationkey::BIGINT AS nation, CASE WHEN c_custkey % 4 > 0 THEN length(c_mktsegment)::BIGINT END AS seg, c_acctbal AS balance FROM customer"


def small_matrix(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("head"),
        F.col("c_nationkey").cast("long").alias("nation"),
        F.when(F.col("c_custkey") % 4 > 0, F.length("c_mktsegment")).cast("long").alias("seg"),
        F.col("c_acctbal").alias("balance"),
    )


def _sql_top(feature: str) -> str:
    return f"SELECT {feature} AS v, row_number() OVER (ORDER BY count(*) DESC, {feature} DESC) AS rn FROM m WHERE {feature} IS NOT NULL GROUP BY {feature}"


@query(
    "encode_top_n",
    f"WITH m AS ({SQL_MATRIX}), tn AS ({_sql_top('nation')}), ts AS ({_sql_top('seg')}) SELECT head, balance, "
    + ", ".join(
        f"coalesce((nation = (SELECT v FROM tn WHERE rn = {i}))::INTEGER, 0) AS nation_{i}" for i in range(1, 11)
    )
    + ", (nation NOT IN (SELECT v FROM tn WHERE rn <= 10))::INTEGER AS nation_unknown, "
    + ", ".join(f"coalesce((seg = (SELECT v FROM ts WHERE rn = {i}))::INTEGER, 0) AS seg_{i}" for i in range(1, 4))
    + ", (seg IS NULL)::INTEGER AS seg_unknown FROM m",
)
def encode_top_n(spark, d):
    encoded = D.encode_top_n(small_matrix(spark, d), ["nation", "seg"])
    renamed, seen = [], {}
    for name in encoded.columns[2:]:
        feature = name.split(" ")[0]
        seen[feature] = seen.get(feature, 0) + 1
        new = f"{feature}_unknown" if name.endswith("is unknown") else f"{feature}_{seen[feature]}"
        renamed.append(F.col(f"`{name}`").alias(new))
    return encoded.select("head", "balance", *renamed)


@query(
    "drop_constant_features",
    "SELECT c_custkey AS head, c_nationkey AS varied, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS half_missing FROM customer",
)
def drop_constant_features(spark, d):
    matrix = table(spark, d, "customer").select(
        F.col("c_custkey").alias("head"),
        F.col("c_nationkey").alias("varied"),
        F.when(F.col("c_custkey") % 2 == 0, 1).alias("half_missing"),
        (F.col("c_nationkey") * 0).alias("constant"),
        F.when(F.col("c_custkey") < 0, 1).alias("absent"),
    )
    return D.drop_constant_features(matrix)


@query(
    "feature_count",
    f"""{SQL_LINKS}, c AS (SELECT count(*) FILTER (is_functional AND kind = 'num') AS fn, count(*) FILTER (is_functional AND kind = 'cat') AS fc,
    count(*) FILTER (NOT is_functional AND kind = 'num') AS mn, count(*) FILTER (NOT is_functional AND kind = 'cat') AS mc FROM shape),
  k AS (SELECT *, 7 * mn + 2 * mc AS kn, mc AS kc FROM c)
  SELECT depth::BIGINT AS depth, (fn + fc + CASE WHEN depth >= 1 THEN kn + kc * 10 ELSE 0 END
    + CASE WHEN depth >= 2 THEN mc * (6 * fn + fc + fc * 10) ELSE 0 END
    + CASE WHEN depth >= 3 THEN mc * (6 * kn + kc + kc * 10) ELSE 0 END)::BIGINT AS n_features FROM k, range(4) t(depth)""",
)
def feature_count(spark, d):
    _, cat = shaped(spark, d)
    return spark.createDataFrame([(i, D.feature_count(cat, i)) for i in range(4)], "depth long, n_features long")


@query("feature_registry")
def feature_registry(spark, d):
    """Features of two depths stored and registered, then the depth-1 matrix looked up and read."""
    root, triples = scratch(spark, "features"), pin(X.graph(spark, d, *RELS))
    shapes = D.catalogue(D.functional_relations(D.relation_tables(triples, X.N_NUMERIC, N_CAT)))
    for depth in (0, 1):
        matrix = D.deep_features(triples, customers(spark, d), depth, X.N_NUMERIC, N_CAT, shapes)
        path = f"{root}/depth={depth}"
        matrix.write.parquet(path)
        D.register_features(
            spark,
            f"{root}/registry",
            dataset="test",
            target_entities="customer",
            depth=depth,
            n_features=len(matrix.columns) - 1,
            n_features_encoded=0,
            path=path,
        )
    found = D.find_features(spark, f"{root}/registry", "test", "customer", 1).first()
    return spark.read.parquet(found["path"])
