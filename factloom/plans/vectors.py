"""Negatives, scores and fitted vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numeric as N
from factloom.functions.hashing import md5int
from factloom.operators import fitting as FT
from factloom.operators import sampling as S
from factloom.operators import scoring as C
from factloom.operators import scoring_runs as SR
from factloom.operators import triples as T
from factloom.plans import fixtures as X
from factloom.plans.numeric import DIM, rels, sql_spread, sql_vector, sql_weight, vector, weight
from factloom.plans.registry import query, r4, scratch, sql_md5int, sql_r4, table
from factloom.session import pin

PART = tuple(X.RELATIONS)
SQL_KEY = sql_md5int("head", "rel", "coalesce(tail_id, round(tail_val * 100)::BIGINT)")
SQL_POS = f"WITH graph AS ({X.sql_graph(*PART)}), pos AS (SELECT DISTINCT {SQL_KEY} AS pos_id, * FROM graph)"
SQL_CAND = f"""members AS (SELECT DISTINCT rel, 0 AS side, head AS cand_id, NULL::DOUBLE AS cand_val FROM graph
    UNION ALL SELECT DISTINCT rel, 1, tail_id, tail_val FROM graph),
  sized AS (SELECT *, count(*) OVER (PARTITION BY rel, side) AS n FROM members),
  heads AS (SELECT rel, count(*) AS n_heads FROM members WHERE side = 0 GROUP BY rel),
  cand AS (SELECT rel, side, cand_id, cand_val, row_number() OVER (PARTITION BY rel, side
             ORDER BY CASE WHEN n > {S.ROWS_PER_BUCKET} THEN {sql_md5int('cand_id', 'cand_val')} % ceil(n / {S.ROWS_PER_BUCKET}.0)::BIGINT ELSE 0 END, cand_id, cand_val)
             - 1 + CASE side WHEN 1 THEN n_heads ELSE 0 END AS position FROM sized JOIN heads USING (rel))"""


def positives(spark, d):
    triples = X.graph(spark, d, *PART)
    cents = F.round(F.col("tail_val") * 100).cast("long")
    # the id follows from the triple, so copies go before it is made
    return triples.distinct().withColumn("pos_id", md5int("head", "rel", F.coalesce("tail_id", cents)))


@query("corruption_candidates", f"{SQL_POS}, {SQL_CAND} SELECT * FROM cand")
def corruption_candidates(spark, d):
    return S.corruption_candidates(positives(spark, d))


@query(
    "corrupt_triples",
    f"""{SQL_POS}, {SQL_CAND}, n AS (SELECT rel, count(*) AS n FROM cand GROUP BY rel),
  draws AS (SELECT pos.*, k, {sql_md5int('11', 'pos_id', 'k')} % n AS position FROM pos JOIN n USING (rel), range(3) t(k))
  SELECT pos_id, k::INTEGER AS k, rel, kind, CASE side WHEN 0 THEN cand_id ELSE head END AS head,
    CASE side WHEN 0 THEN tail_id ELSE cand_id END AS tail_id, CASE side WHEN 0 THEN tail_val ELSE cand_val END AS tail_val
  FROM draws JOIN cand USING (rel, position)""",
)
def corrupt_triples(spark, d):
    pos = pin(positives(spark, d))
    return S.corrupt_triples(pos, pin(S.corruption_candidates(pos)), k=3, seed=11)


# --- scores under vectors derived from the ids -------------------------------------------------

SQL_SCORED = f"""WITH graph AS ({X.sql_graph(*PART)}), b AS (SELECT rel, min(tail_val) AS lo, max(tail_val) AS hi FROM graph WHERE kind = 'num' GROUP BY rel),
  xs AS (SELECT graph.*, (tail_val - lo) / (hi - lo) AS x FROM graph LEFT JOIN b USING (rel)),
  e AS (SELECT entity_id, {sql_vector('ent', 'entity_id')} AS vec, {sql_weight('bh', 'entity_id')} AS bias_h, {sql_weight('bt', 'entity_id')} AS bias_t FROM ({X.SQL_ENTITIES})),
  p AS (SELECT DISTINCT rel, {sql_vector('r', 'rel')} AS r, {sql_vector('diag', 'rel')} AS diag, {sql_vector('e1', 'rel')} AS e1,
        {sql_vector('e2', 'rel')} AS e2, {sql_weight('nb', 'rel')} AS num_bias FROM graph),
  routed AS (SELECT xs.head, xs.rel, xs.kind, xs.tail_id, xs.tail_val, p.r, p.diag,
       CASE WHEN kind = 'num' THEN list_transform(range(1, 5), lambda i: greatest(x * e1[i] + (1 - x) * e2[i], 0.0)) ELSE e.vec END AS t,
       CASE WHEN kind = 'num' THEN num_bias ELSE e.bias_t END AS t_bias
     FROM xs JOIN p USING (rel) LEFT JOIN e ON xs.tail_id = e.entity_id),
  s AS (SELECT routed.*, e.vec AS h, e.bias_h AS h_bias FROM routed JOIN e ON head = entity_id)"""


def entity_vectors(triples):
    ids = X.graph_entities(triples)
    return ids.select(
        "entity_id",
        vector("ent", F.col("entity_id")).alias("vec"),
        weight("bh", F.col("entity_id")).alias("bias_h"),
        weight("bt", F.col("entity_id")).alias("bias_t"),
    )


def relation_vectors(triples):
    rel = F.col("rel")
    return rels(triples).select(
        "rel", *[vector(tag, rel).alias(tag) for tag in ("r", "diag", "e1", "e2")], weight("nb", rel).alias("num_bias")
    )


def routed(spark, d, heads=False):
    """Triples with their tail vectors, and with ``heads`` those of the heads, the entities and relation vectors."""
    triples = X.graph(spark, d, *PART)
    scaled = N.apply_min_max(triples.filter("kind = 'num'"), N.fit_min_max(triples))
    cat = triples.filter("kind = 'cat'").withColumn("x", F.lit(None).cast("double"))
    entities, params = entity_vectors(triples), relation_vectors(triples)
    weights = params.select("rel", "e1", "e2", "num_bias")
    rows = C.route_tails(scaled.unionByName(cat), entities, weights, "relu", heads=heads)
    return rows, entities, params.select("rel", "r", "diag")


KEYS = ("head", "rel", "tail_id", "tail_val")


@query(
    "route_tails",
    f"{SQL_SCORED} SELECT {', '.join(KEYS)}, {sql_spread('t')}, {sql_r4('t_bias')} AS t_bias FROM routed",
)
def route_tails(spark, d):
    rows, _, _ = routed(spark, d)
    return rows.select(*KEYS, *[r4(F.col("t")[i]).alias(f"v{i}") for i in range(DIM)], r4("t_bias").alias("t_bias"))


_EACH = "list_sum(list_transform(range(1, 5), lambda i: {}))"
for _name, _model, _p, _expr in (
    ("score_translation_l1", "translation", 1, "-" + _EACH.format("abs(h[i] + r[i] - t[i])")),
    ("score_translation_l2", "translation", 2, "-sqrt(" + _EACH.format("pow(h[i] + r[i] - t[i], 2)") + ")"),
    ("score_bilinear", "bilinear", 0, _EACH.format("h[i] * r[i] * t[i]")),
    (
        "score_relation_scaled",
        "relation_scaled",
        0,
        "-" + _EACH.format("pow(diag[i] * h[i] - t[i] + r[i], 2)") + " + h_bias + t_bias",
    ),
):

    @query(_name, f"{SQL_SCORED} SELECT {', '.join(KEYS)}, {sql_r4(_expr)} AS score FROM s")
    def score(spark, d, _model=_model, _p=_p):
        rows, _, params = routed(spark, d, heads=True)
        scored = C.score_triples(rows, params, _model, _p)
        return scored.select(*KEYS, r4("score").alias("score"))


N_LIT = X.N_NUMERIC


def sql_matrix(tag: str, cols: int) -> str:
    rows = [", ".join(sql_weight(tag, str(i), str(j)) for j in range(cols)) for i in range(DIM)]
    return "[" + ", ".join(f"[{r}]" for r in rows) + "]"


def matrix(tag: str, cols: int):
    return F.array(*[F.array(*[weight(tag, F.lit(i), F.lit(j)) for j in range(cols)]) for i in range(DIM)])


def bias(tag: str):
    return F.array(*[weight(tag, F.lit(i)) for i in range(DIM)])


_DOT = "list_sum(list_transform(range(1, {n} + 1), lambda j: {m}[i][j] * {v}[j]))"


@query(
    "gate_literals",
    f"""WITH graph AS ({X.sql_graph()}), e AS ({X.SQL_ENTITIES}),
  b AS (SELECT rel, min(tail_val) AS lo, max(tail_val) AS hi FROM graph WHERE kind = 'num' GROUP BY rel),
  m AS (SELECT head, {', '.join(f'avg((tail_val - lo) / (hi - lo)) FILTER (rel = {r}) AS v{r}' for r in X.NUMERIC)} FROM graph JOIN b USING (rel) GROUP BY head),
  v AS (SELECT entity_id, {sql_vector('ent', 'entity_id')} AS x, [{', '.join(f'coalesce(v{r}, 0.0)' for r in X.NUMERIC)}] AS l FROM e LEFT JOIN m ON entity_id = head),
  w AS (SELECT {sql_matrix('W', DIM + N_LIT)} AS w, {sql_matrix('Gx', DIM)} AS gx, {sql_matrix('Gl', N_LIT)} AS gl,
        [{', '.join(sql_weight('gb', str(i)) for i in range(DIM))}] AS b, [{', '.join(sql_weight('gc', str(i)) for i in range(DIM))}] AS c),
  g AS (SELECT entity_id, x, list_transform(range(1, 5), lambda i: tanh({_DOT.format(n=DIM + N_LIT, m='w', v='list_concat(x, l)')} + b[i])) AS h,
        list_transform(range(1, 5), lambda i: 1 / (1 + exp(-({_DOT.format(n=DIM, m='gx', v='x')} + {_DOT.format(n=N_LIT, m='gl', v='l')} + c[i])))) AS z FROM v, w)
  SELECT entity_id, {', '.join(f"{sql_r4(f'z[{i}] * h[{i}] + (1 - z[{i}]) * x[{i}]')} AS v{i - 1}" for i in range(1, DIM + 1))} FROM g""",
)
def gate_literals(spark, d):
    triples = X.graph(spark, d)
    numeric = triples.filter("kind = 'num'")
    scaled = N.apply_min_max(numeric, N.fit_min_max(numeric)).withColumn("tail_val", F.col("x"))
    entities = X.graph_entities(triples)
    literals = T.literal_matrix(scaled, entities, X.NUMERIC)
    vectors = entities.select("entity_id", vector("ent", F.col("entity_id")).alias("vec"))
    weights = spark.range(1).select(
        matrix("W", DIM + N_LIT).alias("w"),
        matrix("Gx", DIM).alias("gx"),
        matrix("Gl", N_LIT).alias("gl"),
        bias("gb").alias("b"),
        bias("gc").alias("c"),
    )
    gated = C.gate_literals(vectors, literals, weights)
    return gated.select("entity_id", *[r4(F.col("vec")[i]).alias(f"v{i}") for i in range(DIM)])


# --- fitting -------------------------------------------------------------------------------------

FIT = FT.FitConfig(model="relation_scaled", dim=8, numeric="interp", negatives=2, lr=0.05, batch_size=250_000, seed=3)


def fitted(spark, d, config=FIT, epochs=2):
    folder = scratch(spark, "fit")
    triples = X.graph(spark, d, *PART)
    return FT.fit_vectors(triples, config, epochs, folder, save_epochs=(1, 2)), triples, folder


for _model, _numeric, _loss in (
    ("relation_scaled", "interp", "softplus"),
    ("translation", "bins", "margin"),
    ("bilinear", None, "softplus"),
):

    @query(f"fit_vectors_{_model}")
    def fit_vectors(spark, d, _model=_model, _numeric=_numeric, _loss=_loss):
        config = FT.FitConfig(
            model=_model, dim=8, numeric=_numeric, loss=_loss, negatives=2, lr=0.05, batch_size=250_000, seed=3
        )
        params, _, _ = fitted(spark, d, config, epochs=1)
        return params


SCORED = {
    "scaled": FIT,
    "translated": FT.FitConfig(model="translation", dim=8, numeric="bins", loss="margin", negatives=2, lr=0.05, batch_size=250_000, seed=3),
}


@query(
    "scoring_run",
    """SELECT config_id, epoch::INTEGER AS epoch, 'customer' AS dataset, 'r2' AS scoring, 'linear' AS prediction_model,
  (SELECT count(*) FROM customer WHERE c_custkey % 7 > 0) AS n_rows, 15 AS n_scores, true AS all_scored
  FROM (VALUES ('scaled', 1), ('scaled', 2), ('translated', 1)) t(config_id, epoch)""",
)
def scoring_run(spark, d):
    """Two configurations fitted on the whole graph, their stored epochs scored on the customers' targets.

    The second call finds nothing pending, so no run is logged twice.
    """
    folder = scratch(spark, "scoring")
    triples = pin(X.graph(spark, d, *PART))
    for name, epochs in (("scaled", (1, 2)), ("translated", (1,))):
        FT.fit_vectors(triples, SCORED[name], max(epochs), folder, name, save_epochs=epochs)
    targets = X.customer_targets(spark, d).drop("key")
    name = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("name")
    entities = table(spark, d, "customer").select(X.entity("c_custkey", "customer").alias("entity_id"), name)
    for _ in range(2):
        log = SR.score_pending(spark, folder, f"{folder}/log", SCORED, "customer", targets, entities, "r2", "linear", 3)
    every = F.forall("scores", lambda s: s.isNotNull() & (s <= 1))
    return log.select(*SR.KEY, "n_rows", F.size("scores").alias("n_scores"), every.alias("all_scored"))


@query("epoch_loss")
def epoch_loss(spark, d):
    params, triples, _ = fitted(spark, d)
    return FT.epoch_loss(params, FIT, triples.count())


@query("checkpoint_epochs")
def checkpoint_epochs(spark, d):
    _, _, folder = fitted(spark, d)
    return FT.checkpoint_catalogue(spark, folder)


@query("export_vectors")
def export_vectors(spark, d):
    params, _, _ = fitted(spark, d, epochs=1)
    return FT.export_vectors(params, FIT)
