"""Scaling and embedding of numeric tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numeric as N
from factloom.functions.hashing import unit
from factloom.plans import fixtures as X
from factloom.plans.registry import query, r4, sql_md5int, sql_r4
from factloom.session import pin

DIM = 4
NUM_RELS = [r for r in X.RELATIONS if X.RELATIONS[r] < X.N_NUMERIC]
SQL_NUM = f"WITH num AS ({X.sql_graph(*NUM_RELS)})"
# One knot per row at most: a relation of fewer than 20 rows has as many quantiles as rows.
SQL_QUANTILES = (
    f"{SQL_NUM}, sorted AS (SELECT rel, list(tail_val ORDER BY tail_val) AS s, least(20, count(tail_val)) AS m "
    "FROM num WHERE tail_val IS NOT NULL AND NOT isnan(tail_val) GROUP BY rel), "
    "knots AS (SELECT rel, s, i, i * (len(s) - 1) / greatest(m - 1, 1)::DOUBLE AS pos FROM (SELECT *, unnest(range(m)) AS i FROM sorted)), "
    "points AS (SELECT rel, i, s[floor(pos)::BIGINT + 1] + (s[ceil(pos)::BIGINT + 1] - s[floor(pos)::BIGINT + 1]) * (pos - floor(pos)) AS v FROM knots), "
    "fitted AS (SELECT rel, list(v ORDER BY i) AS q FROM points GROUP BY rel)"
)
SQL_POSITION = """CASE WHEN tail_val <= q[1] THEN 0.0 WHEN tail_val >= q[len(q)] THEN 1.0 ELSE
  ((le - 1 + (tail_val - q[le]) / (q[le + 1] - q[le])) / (len(q) - 1.0) + (lt - (q[lt + 1] - tail_val) / (q[lt + 1] - q[lt])) / (len(q) - 1.0)) / 2 END"""
SQL_SCALED = f"""{SQL_QUANTILES}, counted AS (SELECT num.*, q, len(list_filter(q, lambda v: v <= tail_val)) AS le,
  len(list_filter(q, lambda v: v < tail_val)) AS lt FROM num JOIN fitted USING (rel)),
  scaled AS (SELECT head, rel, tail_val, {SQL_POSITION} AS x FROM counted)"""


def sql_unit(*parts: str) -> str:
    return f"(({sql_md5int(*parts)} + 0.5) / 1152921504606846976.0)"


def weight(tag: str, *ids):
    """A reproducible weight in (-1, 1)."""
    return 2 * unit(F.lit(tag), *ids) - 1


def sql_weight(tag: str, *ids: str) -> str:
    quoted = "'" + tag + "'"
    return f"(2 * {sql_unit(quoted, *ids)} - 1)"


def vector(tag: str, id_, dim: int = DIM):
    return F.array(*[weight(tag, id_, F.lit(i)) for i in range(dim)])


def sql_vector(tag: str, id_: str, dim: int = DIM) -> str:
    return "[" + ", ".join(sql_weight(tag, id_, str(i)) for i in range(dim)) + "]"


def numeric(spark, d):
    return X.graph(spark, d, *NUM_RELS)


def rels(df):
    """Relations present, stored: weights are derived from them."""
    return pin(df.select("rel").distinct())


def spread(df, vec: str = "vec", dim: int = DIM, **keep):
    """Vector elements as rounded columns."""
    return df.select(*keep.values(), *[r4(F.col(vec)[i]).alias(f"v{i}") for i in range(dim)])


def sql_spread(vec: str, dim: int = DIM) -> str:
    return ", ".join(f"{sql_r4(f'{vec}[{i + 1}]')} AS v{i}" for i in range(dim))


@query(
    "fit_quantiles",
    f"{SQL_QUANTILES} SELECT rel, i::INTEGER AS prob_index, {sql_r4('v')} AS quantile FROM points",
)
def fit_quantiles(spark, d):
    fitted = N.fit_quantiles(numeric(spark, d))
    points = fitted.select("rel", F.posexplode("quantiles").alias("prob_index", "quantile"))
    return points.select("rel", "prob_index", r4("quantile").alias("quantile"))


@query("apply_quantiles", f"{SQL_SCALED} SELECT head, rel, tail_val, {sql_r4('x')} AS x FROM scaled")
def apply_quantiles(spark, d):
    triples = numeric(spark, d)
    scaled = N.apply_quantiles(triples, N.fit_quantiles(triples))
    return scaled.select("head", "rel", "tail_val", r4("x").alias("x"))


@query(
    "minmax_scale",
    f"{SQL_NUM}, b AS (SELECT rel, min(tail_val) AS lo, max(tail_val) AS hi FROM num GROUP BY rel) "
    f"SELECT head, rel, tail_val, {sql_r4('CASE WHEN hi > lo THEN (tail_val - lo) / (hi - lo) ELSE 0.0 END')} AS x FROM num JOIN b USING (rel)",
)
def minmax_scale(spark, d):
    return N.scale_values(numeric(spark, d), "min_max").select("head", "rel", "tail_val", r4("x").alias("x"))


@query("identity_scale", f"{SQL_NUM} SELECT head, rel, tail_val AS x FROM num")
def identity_scale(spark, d):
    return N.scale_values(numeric(spark, d), None).select("head", "rel", "x")


SQL_SIMPLE_X = (
    f"{SQL_NUM}, b AS (SELECT rel, min(tail_val) AS lo, max(tail_val) AS hi FROM num GROUP BY rel), "
    "xs AS (SELECT head, rel, tail_val, CASE WHEN hi > lo THEN (tail_val - lo) / (hi - lo) ELSE 0.0 END AS x FROM num JOIN b USING (rel))"
)


def scaled(spark, d):
    return N.scale_values(numeric(spark, d), "min_max").select("head", "rel", "tail_val", "x")


for _p in (1, 2):
    _norm = {1: "abs(v[1]) + abs(v[2]) + abs(v[3]) + abs(v[4])", 2: "sqrt(v[1]*v[1] + v[2]*v[2] + v[3]*v[3] + v[4]*v[4])"}[_p]

    @query(
        f"normalize_rows_l{_p}",
        f"WITH e AS (SELECT c_custkey, {sql_vector('e', 'c_custkey')} AS v FROM customer) SELECT c_custkey, "
        + ", ".join(f"{sql_r4(f'v[{i + 1}] / ({_norm})')} AS v{i}" for i in range(DIM))
        + " FROM e",
    )
    def normalize_rows(spark, d, _p=_p):
        from factloom.plans.registry import table

        rows = table(spark, d, "customer").select("c_custkey", vector("e", F.col("c_custkey")).alias("vec"))
        return spread(rows.withColumn("vec", N.normalize_rows(F.col("vec"), _p)), k=F.col("c_custkey"))


N_BINS = 20


@query(
    "bin_embedding",
    f"{SQL_SIMPLE_X}, bins AS (SELECT head, rel, tail_val, (rel * {N_BINS} + len(list_filter([{', '.join(f'{i}/{N_BINS}.0' for i in range(1, N_BINS))}], lambda b: b < x)))::BIGINT AS bin FROM xs), "
    f"v AS (SELECT *, {sql_vector('bin', 'bin')} AS v FROM bins) SELECT head, rel, tail_val, bin, {sql_spread('v')} FROM v",
)
def bin_embedding(spark, d):
    values = scaled(spark, d)
    bins = spark.range(N_BINS * X.N_NUMERIC).select(
        F.col("id").alias("bin"), vector("bin", F.col("id")).alias("vec")
    )
    rows = N.bin_embedding(values, bins, N_BINS)
    return spread(rows, h=F.col("head"), r=F.col("rel"), t=F.col("tail_val"), b=F.col("bin"))


for _act, _fn in ((None, "{}"), ("relu", "greatest({}, 0.0)"), ("sigmoid", "1 / (1 + exp(-({})))"), ("tanh", "tanh({})")):
    _cells = ", ".join(
        f"{sql_r4(_fn.format(f'w[{i + 1}] * x + b[{i + 1}]'))} AS v{i}" for i in range(DIM)
    )

    @query(
        f"linear_embedding_{_act or 'identity'}",
        f"{SQL_SIMPLE_X}, p AS (SELECT DISTINCT rel, {sql_vector('w', 'rel')} AS w, {sql_vector('b', 'rel')} AS b FROM num) "
        f"SELECT head, rel, tail_val, {_cells} FROM xs JOIN p USING (rel)",
    )
    def linear_embedding(spark, d, _act=_act):
        weights = rels(numeric(spark, d)).select(
            "rel", vector("w", F.col("rel")).alias("w"), vector("b", F.col("rel")).alias("b")
        )
        rows = N.linear_embedding(scaled(spark, d), weights, _act)
        return spread(rows, h=F.col("head"), r=F.col("rel"), t=F.col("tail_val"))


SQL_INTERP = (
    "list_transform(range(1, 5), lambda i: greatest(x * e1[i] + (1 - x) * e2[i], 0.0))"
)


@query(
    "interp_embedding",
    f"{SQL_SCALED}, p AS (SELECT DISTINCT rel, {sql_vector('e1', 'rel')} AS e1, {sql_vector('e2', 'rel')} AS e2 FROM num), "
    f"v AS (SELECT head, rel, tail_val, {SQL_INTERP} AS v FROM scaled JOIN p USING (rel)) SELECT head, rel, tail_val, {sql_spread('v')} FROM v",
)
def interp_embedding(spark, d):
    triples = numeric(spark, d)
    weights = rels(triples).select(
        "rel", vector("e1", F.col("rel")).alias("e1"), vector("e2", F.col("rel")).alias("e2")
    )
    rows = N.interp_embedding(N.scale_values(triples, "quantile"), weights, "relu")
    return spread(rows, h=F.col("head"), r=F.col("rel"), t=F.col("tail_val"))


SQL_MIX = f"""{SQL_SIMPLE_X},
  p AS (SELECT DISTINCT rel, {sql_vector('w1', 'rel')} AS w1, {sql_vector('b1', 'rel')} AS b1, {sql_vector('b2', 'rel')} AS b2,
        [{', '.join(sql_vector(f'w2{i}', 'rel') for i in range(4))}] AS w2, [{', '.join(sql_vector(f'u{i}', 'rel') for i in range(4))}] AS u FROM num),
  h AS (SELECT head, rel, tail_val, list_transform(range(1, 5), lambda i: greatest(w1[i] * x + b1[i], 0.0)) AS h, w2, b2, u FROM xs JOIN p USING (rel)),
  z AS (SELECT head, rel, tail_val, u, list_transform(range(1, 5), lambda i: exp(w2[i][1] * h[1] + w2[i][2] * h[2] + w2[i][3] * h[3] + w2[i][4] * h[4] + b2[i])) AS z FROM h),
  v AS (SELECT head, rel, tail_val, list_transform(range(1, 5), lambda j: (z[1] * u[1][j] + z[2] * u[2][j] + z[3] * u[3][j] + z[4] * u[4][j]) / (z[1] + z[2] + z[3] + z[4])) AS v FROM z)
  SELECT head, rel, tail_val, {sql_spread('v')} FROM v"""


@query("mixture_embedding", SQL_MIX)
def mixture_embedding(spark, d):
    stack = lambda tag: F.array(*[vector(f"{tag}{i}", F.col("rel")) for i in range(4)])
    weights = rels(numeric(spark, d)).select(
        "rel",
        vector("w1", F.col("rel")).alias("w1"),
        vector("b1", F.col("rel")).alias("b1"),
        stack("w2").alias("w2"),
        vector("b2", F.col("rel")).alias("b2"),
        stack("u").alias("basis"),
    )
    rows = N.mixture_embedding(scaled(spark, d), weights, None)
    return spread(rows, h=F.col("head"), r=F.col("rel"), t=F.col("tail_val"))


@query(
    "init_params_uniform",
    "SELECT c_custkey, "
    + ", ".join(
        f"{sql_r4(f'(2 * ' + sql_unit('0', chr(39) + chr(39), chr(39) + 'u' + chr(39), 'c_custkey', str(i)) + f' - 1) * sqrt(6.0 / {DIM})')} AS v{i}"
        for i in range(DIM)
    )
    + " FROM customer",
)
def init_params_uniform(spark, d):
    from factloom.plans.registry import table

    return spread(
        N.init_params(table(spark, d, "customer"), "c_custkey", DIM, "xavier_uniform", seed=0), k=F.col("c_custkey")
    )


@query(
    "init_params_normal",
    "SELECT c_custkey, "
    + ", ".join(
        sql_r4(
            f"1000 * sqrt(-2 * ln({sql_unit('0', repr(''), repr('r'), 'c_custkey', str(i))})) * "
            f"cos(2 * pi() * {sql_unit('0', repr(''), repr('a'), 'c_custkey', str(i))}) * 0.001"
        )
        + f" AS v{i}"
        for i in range(DIM)
    )
    + " FROM customer",
)
def init_params_normal(spark, d):
    from factloom.plans.registry import table

    rows = N.init_params(table(spark, d, "customer"), "c_custkey", DIM, "normal", seed=0)
    return spread(
        rows.withColumn("vec", F.transform("vec", lambda x: x * 1000)), k=F.col("c_custkey")
    )
