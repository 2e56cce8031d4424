"""Hand-written features and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import handmade as H
from factloom.plans import fixtures as X
from factloom.plans.registry import query, r4, sql_r4, table

SQL_TARGET = "SELECT c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1000000000 ELSE 0 END AS key FROM customer"
SQL_FACTS = "SELECT o_custkey AS key, o_totalprice AS value, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS note FROM orders"


def target(spark, d):
    return X.customer_targets(spark, d).select("key")


def facts(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"),
        F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("note"),
    )


def _by_key(agg: str) -> str:
    return f"WITH t AS ({SQL_TARGET}), f AS ({SQL_FACTS}), g AS (SELECT key, {agg} AS v FROM f GROUP BY key) "


@query("mean_by_key", _by_key("avg(value)") + f"SELECT key, {sql_r4('v')} AS v FROM t LEFT JOIN g USING (key)")
def mean_by_key(spark, d):
    return H.mean_by_key(target(spark, d), facts(spark, d), "key", "value", "v").withColumn("v", r4("v"))


@query(
    "mean_text_length",
    _by_key("avg(length(coalesce(note, '')))") + f"SELECT key, {sql_r4('v')} AS v FROM t LEFT JOIN g USING (key)",
)
def mean_text_length(spark, d):
    return H.mean_text_length(target(spark, d), facts(spark, d), "key", "note", "v").withColumn("v", r4("v"))


@query("count_by_key", _by_key("count(*)") + "SELECT key, v FROM t LEFT JOIN g USING (key)")
def count_by_key(spark, d):
    return H.count_by_key(target(spark, d), facts(spark, d), "key", "v")


@query("count_by_key_zero", _by_key("count(*)") + "SELECT key, coalesce(v, 0) AS v FROM t LEFT JOIN g USING (key)")
def count_by_key_zero(spark, d):
    return H.count_by_key(target(spark, d), facts(spark, d), "key", "v", fill_zero=True)


SQL_FLAG = "CASE o_orderstatus WHEN 'F' THEN 't' WHEN 'O' THEN 'f' END"


@query("flag_to_int", f"SELECT o_orderkey, CASE WHEN {SQL_FLAG} = 't' THEN 1 ELSE 0 END AS flag FROM orders")
def flag_to_int(spark, d):
    flags = table(spark, d, "orders").select("o_orderkey", F.expr(SQL_FLAG).alias("flag"))
    return flags.withColumn("flag", H.flag_to_int("flag"))


@query(
    "fill_category",
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Missing') AS segment FROM customer",
)
def fill_category(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    return H.fill_category(rows, ["segment"])


SEGMENTS = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot",
    "WITH s AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer) SELECT c_custkey, "
    + ", ".join(f"coalesce((segment = '{s}')::INTEGER, 0) AS \"segment == {s}\"" for s in SEGMENTS)
    + ', (segment IS NULL)::INTEGER AS "segment == nan" FROM s',
)
def one_hot(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    return H.one_hot(rows, "segment", missing=True)


@query(
    "one_hot_index",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS name FROM part),
  v AS (SELECT name, row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) - 1 AS i FROM (SELECT DISTINCT name FROM p WHERE name IS NOT NULL)),
  n AS (SELECT count(*) + 1 AS n FROM v)
  SELECT p_partkey, n::BIGINT AS size, coalesce(i, n - 1)::BIGINT AS index FROM p LEFT JOIN v USING (name), n""",
)
def one_hot_index(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).alias("name"))
    hot = H.one_hot_index(rows, "name", H.category_dictionary(rows, "name"), "hot", missing=True)
    return hot.select("p_partkey", "hot.size", "hot.index")


SQL_COURSES = """logs AS (SELECT user_id AS enrollment_id, ts AS time FROM events),
  enrol AS (SELECT DISTINCT user_id AS enrollment_id, 'course' || user_id % 5 AS course_id FROM events),
  dates AS (SELECT 'course' || user_id % 5 AS course_id, min(ts) AS "from", max(ts) AS "to" FROM events GROUP BY 1)"""


def course_tables(spark, d):
    events = table(spark, d, "events")
    course = F.concat(F.lit("course"), (F.col("user_id") % 5).cast("string")).alias("course_id")
    logs = events.select(F.col("user_id").alias("enrollment_id"), F.col("ts").alias("time"))
    enrollments = events.select(F.col("user_id").alias("enrollment_id"), course).distinct()
    dates = events.groupBy(course).agg(F.min("ts").alias("from"), F.max("ts").alias("to"))
    return logs, enrollments, dates


SQL_REL = """avg((epoch_us(time) - epoch_us("from"))::DOUBLE / (epoch_us("to") - epoch_us("from")))"""


@query(
    "relative_time",
    f"WITH {SQL_COURSES} SELECT enrollment_id, {sql_r4(SQL_REL)} AS rel_time FROM logs JOIN enrol USING (enrollment_id) JOIN dates USING (course_id) GROUP BY enrollment_id",
)
def relative_time(spark, d):
    logs, enrollments, dates = course_tables(spark, d)
    timed = logs.join(enrollments, "enrollment_id").join(dates, "course_id")
    return timed.groupBy("enrollment_id").agg(r4(F.avg(H.relative_time("time", "from", "to"))).alias("rel_time"))


@query(
    "days_since_first",
    "SELECT o_orderkey, ((epoch_us(o_orderdate) - (SELECT min(epoch_us(o_orderdate)) FROM orders)) // 86400000000)::BIGINT AS days FROM orders",
)
def days_since_first(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return H.days_since_first(rows, "o_orderdate", "days").drop("o_orderdate")


# --- triples -----------------------------------------------------------------------------------

PLACE_RELS = ("l_quantity", "l_extendedprice", "o_totalprice")
SQL_ORDER_TARGETS = f"SELECT {X.sql_entity('o_orderkey', 'order')} AS entity_id, o_orderstatus AS party FROM orders"


def order_targets(spark, d):
    return table(spark, d, "orders").select(X.entity("o_orderkey", "order").alias("entity_id"), F.col("o_orderstatus").alias("party"))


def sql_means(rels, keys="entity_id, party") -> str:
    return (
        f"SELECT {keys}, " + ", ".join(f"{sql_r4(f'avg(tail_val) FILTER (rel = {X.RELATIONS[r]})')} AS {r}" for r in rels)
        + f" FROM t LEFT JOIN graph ON head = entity_id GROUP BY {keys}"
    )


@query("relation_mean", f"WITH graph AS ({X.sql_graph(*PLACE_RELS)}), t AS ({SQL_ORDER_TARGETS}) {sql_means(PLACE_RELS)}")
def relation_mean(spark, d):
    rows = H.relation_mean(order_targets(spark, d), X.graph(spark, d, *PLACE_RELS), {r: X.RELATIONS[r] for r in PLACE_RELS})
    return rows.select("entity_id", "party", *[r4(r).alias(r) for r in PLACE_RELS])


@query(
    "relation_first",
    f"WITH graph AS ({X.sql_graph('contains')}), t AS ({SQL_ORDER_TARGETS}) SELECT entity_id, party, min(tail_id) AS part FROM t LEFT JOIN graph ON head = entity_id GROUP BY ALL",
)
def relation_first(spark, d):
    return H.relation_first(order_targets(spark, d), X.graph(spark, d, "contains"), X.RELATIONS["contains"], "part")


SQL_RARE = """top AS (SELECT nation FROM c WHERE nation IS NOT NULL GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 5)"""


@query(
    "rare_category",
    f"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey END AS nation FROM customer), {SQL_RARE} "
    "SELECT c_custkey, CASE WHEN nation IN (SELECT nation FROM top) THEN nation::VARCHAR WHEN nation IS NOT NULL THEN 'Rare nation' END AS nation FROM c",
)
def rare_category(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 6 > 0, F.col("c_nationkey")).alias("nation")
    )
    return H.rare_category(rows, "nation", "Rare nation")


PART_RELS = ("p_retailprice", "p_size", "p_brand", "p_type", "contains")
SQL_PARTS = f"SELECT {X.sql_entity('p_partkey', 'part')} AS entity_id, p_retailprice AS target FROM part"


def part_targets(spark, d):
    return table(spark, d, "part").select(X.entity("p_partkey", "part").alias("entity_id"), F.col("p_retailprice").alias("target"))


@query(
    "inverse_count",
    f"WITH graph AS ({X.sql_graph('contains')}), t AS ({SQL_PARTS}), g AS (SELECT tail_id, count(*) AS n FROM graph GROUP BY tail_id) "
    "SELECT entity_id, target, n AS n_orders FROM t LEFT JOIN g ON tail_id = entity_id",
)
def inverse_count(spark, d):
    return H.inverse_count(part_targets(spark, d), X.graph(spark, d, "contains"), {"n_orders": X.RELATIONS["contains"]})


COVER_RELS = tuple(X.RELATIONS)
SQL_COVER = f"""WITH graph AS ({X.sql_graph(*COVER_RELS)}), t AS (SELECT {X.sql_entity('c_custkey', 'customer')} AS entity_id FROM customer
    UNION ALL SELECT {X.sql_entity('s_suppkey', 'supplier')} FROM supplier WHERE s_acctbal > 5000),
  places AS (SELECT DISTINCT rel, kind, false AS inverse, head AS e FROM graph UNION ALL SELECT DISTINCT rel, kind, true, tail_id FROM graph WHERE kind = 'cat')
  SELECT rel, kind, inverse FROM t JOIN places ON e = entity_id GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM t)"""


@query("covering_relations", SQL_COVER)
def covering_relations(spark, d):
    customers = table(spark, d, "customer").select(X.entity("c_custkey", "customer").alias("entity_id"))
    suppliers = table(spark, d, "supplier").filter("s_acctbal > 5000").select(X.entity("s_suppkey", "supplier").alias("entity_id"))
    return H.covering_relations(customers.unionByName(suppliers), X.graph(spark, d, *COVER_RELS))


# --- recipes -----------------------------------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SQL_PROJECTS = """SELECT o_orderkey AS projectid, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS primary_focus_subject,
   o_orderstatus AS primary_focus_area, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END AS resource_type,
   'level' || o_custkey % 3 AS poverty_level, 'grade' || o_orderkey % 4 AS grade_level,
   CASE WHEN o_custkey % 2 = 0 THEN 't' ELSE 'f' END AS eligible_double_your_impact_match,
   CASE WHEN o_custkey % 3 = 0 THEN 't' END AS eligible_almost_home_match,
   o_totalprice AS total_price_including_optional_support, o_custkey AS students_reached FROM orders"""


def _dummies(col: str, values) -> str:
    return ", ".join(f"coalesce(({col} = '{v}')::INTEGER, 0) AS \"{col} == {v}\"" for v in values)


SQL_DONATIONS = f"""WITH projects AS ({SQL_PROJECTS}), filled AS (SELECT * REPLACE (coalesce(primary_focus_subject, 'Missing') AS primary_focus_subject,
    coalesce(resource_type, 'Missing') AS resource_type) FROM projects),
  g AS (SELECT l_orderkey AS projectid, avg(l_extendedprice) AS a, avg(length(coalesce(nullif(l_returnflag, 'N'), ''))) AS b, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT projectid, {sql_r4('a')} AS "MEAN(donation_to_project)", {sql_r4('b')} AS "MEAN(LENGTH(donation_message))", coalesce(n, 0) AS "COUNT(donations)",
    CASE eligible_double_your_impact_match WHEN 't' THEN 1 ELSE 0 END AS eligible_double_your_impact_match,
    CASE eligible_almost_home_match WHEN 't' THEN 1 ELSE 0 END AS eligible_almost_home_match,
    total_price_including_optional_support, students_reached, {_dummies('primary_focus_subject', (*PRIORITIES, 'Missing'))},
    {_dummies('primary_focus_area', ('F', 'O', 'P'))}, {_dummies('resource_type', ('Missing', 'even'))},
    {_dummies('poverty_level', ('level0', 'level1', 'level2'))}, {_dummies('grade_level', ('grade0', 'grade1', 'grade2', 'grade3'))}
  FROM filled LEFT JOIN g USING (projectid)"""


@query("recipe_donations", SQL_DONATIONS)
def recipe_donations(spark, d):
    donations = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("projectid"),
        F.col("l_extendedprice").alias("donation_to_project"),
        F.expr("nullif(l_returnflag, 'N')").alias("donation_message"),
    )
    o = table(spark, d, "orders")
    projects = o.selectExpr(*[p.strip() for p in _select_list(SQL_PROJECTS)])
    rows = H.donation_features(projects.select("projectid"), donations, projects)
    for c in ("MEAN(donation_to_project)", "MEAN(LENGTH(donation_message))"):
        rows = rows.withColumn(c, r4(F.col(f"`{c}`")))
    return rows


def _select_list(sql: str) -> list[str]:
    """The select expressions of a flat statement without commas inside expressions."""
    return sql[len("SELECT ") : sql.rindex(" FROM ")].split(",")


COURSES = [f"course{i}" for i in range(5)]


@query(
    "recipe_courses",
    f"""WITH {SQL_COURSES}, m AS (SELECT 'course' || doc_id % 5 AS course_id, count(*) AS n FROM documents GROUP BY 1),
  s AS (SELECT course_id, ((epoch_us("from") - (SELECT min(epoch_us("from")) FROM dates)) // 86400000000)::BIGINT AS course_start_date FROM dates)
  SELECT enrollment_id, count(*) AS "COUNT(logs)", {sql_r4(SQL_REL)} AS "MEAN(relative_log_time)", any_value(course_start_date) AS course_start_date,
    any_value(n) AS "COUNT(course.modules)", {', '.join(f"(any_value(course_id) = '{c}')::INTEGER AS " + chr(34) + f"course_id == {c}" + chr(34) for c in COURSES)}
  FROM logs JOIN enrol USING (enrollment_id) JOIN dates USING (course_id) JOIN m USING (course_id) JOIN s USING (course_id) GROUP BY enrollment_id""",
)
def recipe_courses(spark, d):
    logs, enrollments, dates = course_tables(spark, d)
    modules = table(spark, d, "documents").select(
        F.concat(F.lit("course"), (F.col("doc_id") % 5).cast("string")).alias("course_id")
    )
    rows = H.course_features(enrollments.select("enrollment_id"), logs, enrollments, dates, modules)
    return rows.withColumn("MEAN(relative_log_time)", r4(F.col("`MEAN(relative_log_time)`")))


@query(
    "recipe_places",
    f"WITH graph AS ({X.sql_graph(*PLACE_RELS)}), t AS ({SQL_ORDER_TARGETS}), m AS ({sql_means(PLACE_RELS)}) SELECT entity_id, {', '.join(PLACE_RELS)}, "
    + ", ".join(f"(party = '{p}')::INTEGER AS \"party == {p}\"" for p in ("F", "O", "P"))
    + " FROM m",
)
def recipe_places(spark, d):
    rows = H.place_features(
        order_targets(spark, d), X.graph(spark, d, *PLACE_RELS), {r: X.RELATIONS[r] for r in PLACE_RELS}, "party"
    )
    return rows.withColumns({r: r4(r) for r in PLACE_RELS})


SQL_FILMS = f"""WITH graph AS ({X.sql_graph(*PART_RELS)}), t AS ({SQL_PARTS}),
  m AS (SELECT entity_id, target, {sql_r4('avg(tail_val)')} AS p_size FROM t LEFT JOIN graph ON head = entity_id AND rel = {X.RELATIONS['p_size']} GROUP BY ALL),
  b AS (SELECT m.*, tail_id AS nation FROM m LEFT JOIN graph ON head = entity_id AND rel = {X.RELATIONS['p_brand']}), c AS (SELECT * FROM b), {SQL_RARE},
  n AS (SELECT tail_id, count(*) AS n FROM graph WHERE rel = {X.RELATIONS['contains']} GROUP BY tail_id)
  SELECT entity_id, target, p_size, n AS "COUNT(contains)", coalesce((nation NOT IN (SELECT nation FROM top))::INTEGER, 0) AS rare, (nation IS NULL)::INTEGER AS missing,
    CASE WHEN nation IN (SELECT nation FROM top) THEN 1 ELSE 0 END AS common FROM b LEFT JOIN n ON tail_id = entity_id"""


@query("recipe_films", SQL_FILMS)
def recipe_films(spark, d):
    rows = H.film_features(
        part_targets(spark, d),
        X.graph(spark, d, *PART_RELS),
        {"p_size": X.RELATIONS["p_size"]},
        ("brand", X.RELATIONS["p_brand"]),
        {"contains": X.RELATIONS["contains"]},
    )
    named = {c: c.split(" == ")[1] for c in rows.columns if c.startswith("brand == ")}
    common = sum((F.col(f"`{c}`") for c, v in named.items() if v.isdigit()), F.lit(0))
    return rows.select(
        "entity_id",
        "target",
        r4("p_size").alias("p_size"),
        F.col("`COUNT(contains)`"),
        F.col("`brand == Rare country`").alias("rare"),
        F.col("`brand == nan`").alias("missing"),
        common.alias("common"),
    )


@query(
    "recipe_companies",
    f"""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
  SELECT {X.sql_entity('c_custkey', 'customer')} AS entity_id, {sql_r4('c_acctbal')} AS c_acctbal, 1::BIGINT AS "COUNT(c_mktsegment)",
    1::BIGINT AS "COUNT(c_nationkey)", n AS "COUNT(inv_o_custkey)" FROM customer LEFT JOIN o ON k = c_custkey""",
)
def recipe_companies(spark, d):
    targets = table(spark, d, "customer").select(X.entity("c_custkey", "customer").alias("entity_id"))
    names = {r: n for n, r in X.RELATIONS.items()}
    rows = H.company_features(targets, X.graph(spark, d, *COVER_RELS), names)
    return rows.withColumn("c_acctbal", r4("c_acctbal"))
