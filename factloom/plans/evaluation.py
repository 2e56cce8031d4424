"""Folds, metrics, model scores and reconstruction over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.hashing import md5int
from factloom.operators import deep as D
from factloom.operators import evaluate as E
from factloom.operators import triples as T
from factloom.operators import walks as W
from factloom.plans import fixtures as X
from factloom.plans.numeric import DIM, vector
from factloom.plans.registry import query, r4, scratch, sql_md5int, sql_r4, table
from factloom.plans.resolution import known
from factloom.session import pin

# --- folds -------------------------------------------------------------------------------------

SQL_ORDER = sql_md5int("'3'", "repeat", "c_custkey")


@query(
    "repeated_folds",
    f"SELECT c_custkey, repeat::INTEGER AS repeat, ({SQL_ORDER} % 5)::INTEGER AS fold FROM customer, range(3) t(repeat)",
)
def repeated_folds(spark, d):
    return E.repeated_folds(table(spark, d, "customer").select("c_custkey"), "c_custkey", 3, seed=3)


@query(
    "repeated_folds_exact",
    f"SELECT c_custkey, repeat::INTEGER AS repeat, ((row_number() OVER (PARTITION BY repeat ORDER BY {SQL_ORDER}, c_custkey) - 1) % 5)::INTEGER AS fold "
    "FROM customer, range(3) t(repeat)",
)
def repeated_folds_exact(spark, d):
    return E.repeated_folds(table(spark, d, "customer").select("c_custkey"), "c_custkey", 3, seed=3, exact=True)


@query(
    "stratified_folds",
    f"SELECT c_custkey, c_mktsegment, repeat::INTEGER AS repeat, ((row_number() OVER (PARTITION BY repeat, c_mktsegment ORDER BY {SQL_ORDER}, c_custkey) - 1) % 5)::INTEGER AS fold "
    "FROM customer, range(3) t(repeat)",
)
def stratified_folds(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return E.stratified_folds(rows, "c_custkey", "c_mktsegment", 3, seed=3)


# --- metrics -----------------------------------------------------------------------------------

SQL_SCORED = f"""WITH s AS (SELECT l.doc_id, quality AS label, n_chars::DOUBLE AS score, {sql_md5int("'0'", "'0'", 'l.doc_id')} % 5 AS fold
  FROM labels l JOIN documents USING (doc_id))"""


def scored(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return E.repeated_folds(
        rows.select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score")),
        "doc_id",
        1,
        seed=0,
    ).withColumn("fold", F.col("fold").cast("long")).drop("repeat")


@query(
    "r2_score",
    "SELECT o_orderpriority, " + sql_r4("1 - sum(pow(o_totalprice - p, 2)) / (var_pop(o_totalprice) * count(*))") + " AS r2 "
    "FROM (SELECT o_orderpriority, o_totalprice, 1000.0 * (o_orderkey % 300) AS p FROM orders) GROUP BY o_orderpriority",
)
def r2_score(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderpriority",
        F.col("o_totalprice").alias("y"),
        (1000.0 * (F.col("o_orderkey") % 300)).alias("prediction"),
    )
    return E.r2_score(rows, ["o_orderpriority"]).withColumn("r2", r4("r2"))


@query(
    "average_precision",
    f"""{SQL_SCORED}, g AS (SELECT fold, score, sum(label) AS pos, count(*) AS n FROM s GROUP BY ALL),
  c AS (SELECT fold, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
  SELECT fold, {sql_r4('sum(pos * tp / seen) / sum(pos)')} AS average_precision FROM c GROUP BY fold""",
)
def average_precision(spark, d):
    return E.average_precision(scored(spark, d), ["fold"]).withColumn("average_precision", r4("average_precision"))


@query(
    "roc_auc",
    f"""{SQL_SCORED}, g AS (SELECT fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL),
  c AS (SELECT fold, pos, neg, sum(neg) OVER (PARTITION BY fold ORDER BY score) - neg / 2.0 AS below FROM g)
  SELECT fold, {sql_r4('sum(pos * below) / (sum(pos) * sum(neg))')} AS roc_auc FROM c GROUP BY fold""",
)
def roc_auc(spark, d):
    return E.roc_auc(scored(spark, d), ["fold"]).withColumn("roc_auc", r4("roc_auc"))


# --- design matrices and models ------------------------------------------------------------------


def customer_vectors(entities):
    return entities.select("entity_id", vector("vec", F.col("entity_id")).alias("vec"))


@query("design_matrix_vectors")
def design_matrix_vectors(spark, d):
    entities = known(spark, d)
    return E.design_matrix(X.customer_targets(spark, d).drop("key"), entities, vectors=customer_vectors(entities), dim=DIM)


@query("design_matrix_deep")
def design_matrix_deep(spark, d):
    """Customers with encoded depth-1 features."""
    graph = T.build_graph({t: table(spark, d, t) for t in ("customer", "orders")}, X.SPECS)
    ids = graph.entities.filter(F.col("name").startswith("customer:"))
    features, cat = D.long_features(graph.triples, ids, 1, graph.n_numeric, graph.n_categorical)
    numeric, nominal = D.feature_names(cat, 1)
    matrix = pin(D.feature_matrix(features, ids, numeric, nominal))
    encoded = pin(D.encode_top_n(matrix, nominal))
    return E.design_matrix(
        X.customer_targets(spark, d).drop("key"), graph.entities, features=D.drop_constant_features(encoded)
    )


@query("design_matrix_walks")
def design_matrix_walks(spark, d):
    """Customers with walk vectors of the keyed tables; entities outside the vocabulary get the default."""
    graph = T.build_graph({t: table(spark, d, t) for t in X.SPECS}, X.SPECS)
    ids = graph.entities.filter(F.col("name").startswith("customer:"))
    starts = W.start_entities(graph.triples, targets=ids)
    walks = pin(W.random_walks(W.graph_edges(graph.triples), starts, seed=1))
    vectors = W.vectors_or_default(graph.entities, W.fit_walk_vectors(walks, 8, 1, 0, scratch(spark, "walks")), 8)
    return E.design_matrix(X.customer_targets(spark, d).drop("key"), graph.entities, vectors=vectors, dim=8)


def orders_matrix(spark, d):
    """Total price explained by line statistics of the order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("x0"), F.count(F.lit(1)).cast("double").alias("x1")
    )
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.select(F.col("o_orderkey").alias("entity_id"), F.col("o_totalprice").alias("target"), "x0", "x1")
    return E.repeated_folds(rows, "entity_id", 2, seed=9)


SQL_FOLD = sql_md5int("'9'", "repeat", "o_orderkey")


@query(
    "cv_linear",
    f"""WITH x AS (SELECT l_orderkey, sum(l_extendedprice) / 1000 AS x0 FROM lineitem GROUP BY 1),
  r AS (SELECT o_orderkey, o_totalprice / 1000 AS y, x0, repeat, {SQL_FOLD} % 5 AS fold FROM orders JOIN x ON l_orderkey = o_orderkey, range(2) t(repeat)),
  f AS (SELECT fold, repeat FROM r GROUP BY ALL),
  m AS (SELECT f.repeat, f.fold, regr_slope(y, x0) AS b, regr_intercept(y, x0) AS a FROM f JOIN r ON r.repeat = f.repeat AND r.fold <> f.fold GROUP BY ALL)
  SELECT repeat::INTEGER AS repeat, fold::INTEGER AS fold, {sql_r4('1 - sum(pow(y - a - b * x0, 2)) / (var_pop(y) * count(*))')} AS r2 FROM r JOIN m USING (repeat, fold) GROUP BY ALL""",
)
def cv_linear(spark, d):
    rows = orders_matrix(spark, d).withColumns({"target": F.col("target") / 1000, "x0": F.col("x0") / 1000})
    scores = E.cross_validated_scores(rows, ["x0"], True, "r2", "linear")
    return scores.withColumn("r2", r4("r2"))


SQL_CV2 = f"""WITH x AS (SELECT l_orderkey, sum(l_extendedprice) / 1000 AS x0, count(*)::DOUBLE AS x1 FROM lineitem GROUP BY 1),
  r AS (SELECT o_orderkey, o_totalprice / 1000 AS y, x0, x1, repeat, {SQL_FOLD} % 5 AS fold FROM orders JOIN x ON l_orderkey = o_orderkey, range(2) t(repeat)),
  f AS (SELECT fold, repeat FROM r GROUP BY ALL),
  c AS (SELECT f.repeat, f.fold, avg(x0) AS m0, avg(x1) AS m1, avg(y) AS my, var_pop(x0) AS s00, var_pop(x1) AS s11, covar_pop(x0, x1) AS s01,
          covar_pop(x0, y) AS s0y, covar_pop(x1, y) AS s1y FROM f JOIN r ON r.repeat = f.repeat AND r.fold <> f.fold GROUP BY ALL),
  b AS (SELECT *, (s0y * s11 - s1y * s01) / (s00 * s11 - s01 * s01) AS b0, (s1y * s00 - s0y * s01) / (s00 * s11 - s01 * s01) AS b1 FROM c)
  SELECT repeat::INTEGER AS repeat, fold::INTEGER AS fold,
    {sql_r4('1 - sum(pow(y - my - b0 * (x0 - m0) - b1 * (x1 - m1), 2)) / (var_pop(y) * count(*))')} AS r2 FROM r JOIN b USING (repeat, fold) GROUP BY ALL"""


@query("cv_linear_many_features", SQL_CV2)
def cv_linear_many_features(spark, d):
    rows = orders_matrix(spark, d).withColumns({"target": F.col("target") / 1000, "x0": F.col("x0") / 1000})
    scores = E.cross_validated_scores(rows, ["x0", "x1"], True, "r2", "linear")
    return scores.withColumn("r2", r4("r2"))


XS = [f"x{i}" for i in range(64)]


def labelled_vectors(spark, d, label, stratified=False, n_folds=E.N_FOLDS):
    """All embeddings, in all dimensions, as features of rows in folds."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("entity_id"), label.cast("double").alias("target"), *[F.col("embedding")[i].alias(x) for i, x in enumerate(XS)]
    )
    if stratified:
        return E.stratified_folds(rows, "entity_id", "target", 1, seed=2)
    return E.repeated_folds(rows, "entity_id", 1, seed=2, n_folds=n_folds)


@query("cv_boosted_regression")
def cv_boosted_regression(spark, d):
    rows = labelled_vectors(spark, d, F.col("label"))
    return E.cross_validated_scores(rows, XS, True, "r2", max_iter=5)


@query("cv_boosted_classification")
def cv_boosted_classification(spark, d):
    rows = labelled_vectors(spark, d, F.col("label") < 5, stratified=True)
    return E.cross_validated_scores(rows, XS, False, "roc_auc", max_iter=5)


@query("grid_search")
def grid_search(spark, d):
    """The full grid with three inner folds, in each of two outer folds."""
    rows = labelled_vectors(spark, d, F.col("label"), n_folds=2)
    return E.cross_validated_scores(rows, XS, True, "r2", tune=True, max_iter=3)


# --- reconstruction ------------------------------------------------------------------------------

SQL_ATTR = f"WITH graph AS ({X.sql_graph('l_extendedprice', 'l_quantity')}), t AS (SELECT DISTINCT {X.sql_entity('o_orderkey', 'order')} AS entity_id FROM orders WHERE o_orderstatus <> 'P')"


def attribute(spark, d, stat):
    targets = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(X.entity("o_orderkey", "order").alias("entity_id"))
    triples = X.graph(spark, d, "l_extendedprice", "l_quantity")
    rows = E.attribute_target(triples, targets, X.RELATIONS["l_extendedprice"], stat, min_values=3)
    return rows.withColumn("y", r4("y"))


_WHERE = f"rel = {X.RELATIONS['l_extendedprice']} AND head IN (SELECT entity_id FROM t)"
for _stat, _sql in (
    ("none", f"SELECT head AS entity_id, {sql_r4('tail_val')} AS y FROM graph WHERE {_WHERE}"),
    ("mean", f"SELECT head AS entity_id, {sql_r4('avg(tail_val)')} AS y FROM graph WHERE {_WHERE} GROUP BY head"),
    ("Q1", f"SELECT head AS entity_id, {sql_r4('quantile_cont(tail_val, 0.25)')} AS y FROM graph WHERE {_WHERE} GROUP BY head HAVING count(*) > 3"),
    ("Q3", f"SELECT head AS entity_id, {sql_r4('quantile_cont(tail_val, 0.75)')} AS y FROM graph WHERE {_WHERE} GROUP BY head HAVING count(*) > 3"),
):

    @query(f"attribute_target_{_stat}", f"{SQL_ATTR} {_sql}")
    def attribute_target(spark, d, _stat=_stat):
        return attribute(spark, d, _stat)


@query(
    "sample_cap",
    f"SELECT o_orderkey FROM orders ORDER BY {sql_md5int(chr(39) + '4' + chr(39), 'o_orderkey')}, o_orderkey LIMIT 10000",
)
def sample_cap(spark, d):
    return E.sample_cap(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=4)


def points(spark, d, repeats=1):
    """All embeddings with their label, in folds."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"), F.col("embedding").cast("array<double>").alias("vec")
    )
    return E.repeated_folds(rows, "id", repeats, seed=6)


SQL_KNN = f"""WITH s AS (SELECT vec_id AS id, label::DOUBLE AS y, embedding::DOUBLE[] AS v, {sql_md5int("'6'", "'0'", 'vec_id')} % 5 AS fold FROM embeddings),
  pairs AS (SELECT a.id, a.fold, a.y, b.id AS other, b.y AS yo, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) AS d1,
      sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS d2 FROM s a JOIN s b ON a.fold <> b.fold),
  near AS (SELECT id, fold, y, yo, 1 AS p, d1 AS dist, row_number() OVER (PARTITION BY id ORDER BY d1, other) AS rn FROM pairs
    UNION ALL SELECT id, fold, y, yo, 2, d2, row_number() OVER (PARTITION BY id ORDER BY d2, other) FROM pairs),
  ks AS (SELECT unnest([1, 2, 3, 4, 8, 16]) AS k),
  preds AS (SELECT id, fold, p, y, k, avg(yo) AS u, CASE WHEN min(dist) = 0 THEN avg(yo) FILTER (dist = 0) ELSE sum(yo / dist) / sum(1 / dist) END AS w
    FROM near JOIN ks ON rn <= k GROUP BY ALL)"""


@query(
    "knn_regression",
    f"""{SQL_KNN} SELECT 0 AS repeat, fold::INTEGER AS fold, k::INTEGER AS k, p::INTEGER AS p, 'uniform' AS weights,
    {sql_r4('1 - sum(pow(y - u, 2)) / (var_pop(y) * count(*))')} AS r2 FROM preds GROUP BY fold, k, p
  UNION ALL SELECT 0, fold::INTEGER, k::INTEGER, p::INTEGER, 'distance', {sql_r4('1 - sum(pow(y - w, 2)) / (var_pop(y) * count(*))')} FROM preds GROUP BY fold, k, p""",
)
def knn_regression(spark, d):
    return E.knn_regression(points(spark, d)).withColumn("r2", r4("r2"))


SQL_NESTED = f"""WITH s AS (SELECT vec_id AS id, label::DOUBLE AS y, embedding::DOUBLE[] AS v, {sql_md5int("'6'", "'0'", 'vec_id')} % 5 AS fold,
    {sql_md5int("'0'", 'vec_id')} % 3 AS inside FROM embeddings),
  pairs AS (SELECT a.id, a.fold, a.inside, a.y, b.id AS other, b.fold AS other_fold, b.inside AS other_inside, b.y AS yo,
      list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) AS d1,
      sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS d2 FROM s a JOIN s b ON a.id <> b.id),
  held AS (SELECT unnest(range(5)) AS held),
  views AS (SELECT id, y, NULL AS held, fold AS part, other, yo, d1, d2 FROM pairs WHERE fold <> other_fold
    UNION ALL SELECT id, y, held, inside, other, yo, d1, d2 FROM pairs, held WHERE fold <> held AND other_fold <> held AND inside <> other_inside),
  near AS (SELECT *, 1 AS p, d1 AS dist, row_number() OVER (PARTITION BY id, held ORDER BY d1, other) AS rn FROM views
    UNION ALL SELECT *, 2, d2, row_number() OVER (PARTITION BY id, held ORDER BY d2, other) FROM views),
  ks AS (SELECT unnest([1, 2, 3, 4, 8, 16]) AS k),
  preds AS (SELECT id, held, part, p, y, k, avg(yo) AS uniform, CASE WHEN min(dist) = 0 THEN avg(yo) FILTER (dist = 0) ELSE sum(yo / dist) / sum(1 / dist) END AS distance
    FROM near JOIN ks ON rn <= k GROUP BY ALL),
  long AS (UNPIVOT preds ON uniform, distance INTO NAME weights VALUE pred),
  scores AS (SELECT held, part, k, p, weights, 1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(*)) AS r2 FROM long GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY inner_r2 DESC, k, p, weights DESC) AS rn FROM
    (SELECT held, k, p, weights, round(avg(r2), 9) AS inner_r2 FROM scores WHERE held IS NOT NULL GROUP BY ALL))
  SELECT 0 AS repeat, part::INTEGER AS fold, k::INTEGER AS k, p::INTEGER AS p, s.weights, {sql_r4('r2')} AS r2
  FROM scores s JOIN best USING (k, p, weights) WHERE s.held IS NULL AND best.held = s.part AND rn = 1"""


@query("knn_cross_validation", SQL_NESTED)
def knn_cross_validation(spark, d):
    return E.knn_cross_validation(points(spark, d)).withColumn("r2", r4("r2"))
