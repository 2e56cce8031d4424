"""Reusable feature operators and the multi-table recipes built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.ordered import dense_ids
from factloom.session import pin


def aggregate_by_key(target: DataFrame, facts: DataFrame, key: str, **features: Column) -> DataFrame:
    """Left-join aggregates of ``facts`` per key; all features in one pass over the facts."""
    return target.join(facts.groupBy(key).agg(*[c.alias(n) for n, c in features.items()]), key, "left")


def mean_by_key(target: DataFrame, facts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    return aggregate_by_key(target, facts, key, **{out: F.avg(value)})


def text_length(col: str) -> Column:
    return F.length(F.coalesce(F.col(col), F.lit("")))


def mean_text_length(target: DataFrame, facts: DataFrame, key: str, text: str, out: str) -> DataFrame:
    return aggregate_by_key(target, facts, key, **{out: F.avg(text_length(text))})


def count_by_key(target: DataFrame, facts: DataFrame, key: str, out: str, fill_zero: bool = False) -> DataFrame:
    counted = aggregate_by_key(target, facts, key, **{out: F.count(F.lit(1))})
    return counted.fillna(0, subset=[f"`{out}`"]) if fill_zero else counted


def flag_to_int(col: str) -> Column:
    return F.coalesce((F.col(col) == "t").cast("int"), F.lit(0))


def fill_category(df: DataFrame, cols: Sequence[str], token: str = "Missing") -> DataFrame:
    return df.fillna(token, subset=list(cols))


def one_hot(
    df: DataFrame, col: str, prefix: str | None = None, sep: str = " == ", missing: bool = False
) -> DataFrame:
    """Replace ``col`` by a 0/1 column per distinct value, in value order; with ``missing``, one more
    for nulls. The values become column names; ``one_hot_index`` takes any number of them."""
    prefix = col if prefix is None else prefix
    values = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect()]
    columns = [
        F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{prefix}{sep}{v}") for v in sorted(values)
    ]
    if missing:
        columns.append(F.col(col).isNull().cast("int").alias(f"{prefix}{sep}nan"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != col]
    return df.select(*kept, *columns)


def category_dictionary(df: DataFrame, col: str) -> DataFrame:
    """``(index, value)``: a dense number for every distinct value, as text; stored."""
    values = df.select(F.col(col).cast("string").alias("value")).filter("value is not null").distinct()
    return pin(dense_ids(values, "value", "index"))


def one_hot_index(df: DataFrame, col: str, dictionary: DataFrame, out: str, missing: bool = False) -> DataFrame:
    """``col`` as a sparse one-hot row: ``out`` has the ``size`` and the ``index`` of the only 1.

    Values outside the dictionary have no 1; with ``missing`` a null has the last place.
    """
    size = dictionary.count() + missing
    keys = dictionary.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
    null = F.lit(size - 1 if missing else None).cast("long")
    # nulls match nothing; spread-out keys keep them from meeting in one task
    rows = df.withColumn("_value", F.coalesce(F.col(col).cast("string"), F.concat(F.lit("\0"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))))
    joined = rows.join(keys, "_value", "left")
    index = F.when(F.col(col).isNull(), null).otherwise(F.col("_index"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != col]
    return joined.select(*kept, F.struct(F.lit(size).cast("long").alias("size"), index.alias("index")).alias(out))


def micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def relative_time(time: str, start: str, end: str) -> Column:
    """Position of ``time`` between ``start`` (0) and ``end`` (1)."""
    return (micros(time) - micros(start)) / F.nullif(micros(end) - micros(start), F.lit(0))


def days_since_first(df: DataFrame, date: str, out: str) -> DataFrame:
    """Whole elapsed days since the earliest date of the table."""
    first = df.agg(F.min(micros(date)).alias("_first")).withColumn("_one", F.lit(1))
    days = F.floor((micros(date) - F.col("_first")) / F.lit(86_400_000_000))
    return (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(first), "_one")
        .withColumn(out, days)
        .drop("_one", "_first")
    )


# --- features from triples ---------------------------------------------------------------------


def of_targets(triples: DataFrame, targets: DataFrame, side: str = "head") -> DataFrame:
    return triples.join(targets.select(F.col("entity_id").alias(side)).distinct(), side, "left_semi")


def relation_mean(targets: DataFrame, triples: DataFrame, rels: Mapping[str, int]) -> DataFrame:
    """Mean of each numeric relation per target entity: one aggregate for all relations."""
    rows = of_targets(triples.filter(F.col("rel").isin(list(rels.values()))), targets)
    means = [F.avg(F.when(F.col("rel") == r, F.col("tail_val"))).alias(n) for n, r in rels.items()]
    return targets.join(rows.groupBy(F.col("head").alias("entity_id")).agg(*means), "entity_id", "left")


def relation_first(targets: DataFrame, triples: DataFrame, rel: int, out: str) -> DataFrame:
    """One tail of a multi-valued relation per target entity: the smallest."""
    rows = of_targets(triples.filter(F.col("rel") == rel), targets)
    one = rows.groupBy(F.col("head").alias("entity_id")).agg(F.min("tail_id").alias(out))
    return targets.join(one, "entity_id", "left")


def rare_category(df: DataFrame, col: str, token: str, keep: int = 5) -> DataFrame:
    """Text of the value for the ``keep`` commonest (ties: smaller value), ``token`` for the others."""
    common = (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), col)
        .limit(keep)
        .select(col, F.lit(True).alias("_common"))
    )
    value = F.when(F.col("_common"), F.col(col).cast("string")).when(F.col(col).isNotNull(), token)
    return df.join(F.broadcast(common), col, "left").withColumn(col, value).drop("_common").select(*df.columns)


def inverse_count(targets: DataFrame, triples: DataFrame, rels: Mapping[str, int]) -> DataFrame:
    """How many heads point at each target entity, per relation; null where none does."""
    rows = of_targets(triples.filter(F.col("rel").isin(list(rels.values()))), targets, "tail_id")
    counts = [F.nullif(F.count_if(F.col("rel") == r), F.lit(0)).alias(n) for n, r in rels.items()]
    return targets.join(rows.groupBy(F.col("tail_id").alias("entity_id")).agg(*counts), "entity_id", "left")


def covering_relations(targets: DataFrame, triples: DataFrame, share: float = 0.05) -> DataFrame:
    """``(rel, kind, inverse)`` present for at least ``share`` of the target rows."""
    weights = targets.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_rows"))
    total = targets.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    place = lambda id_, inverse: F.struct(F.col(id_).alias("entity_id"), F.lit(inverse).alias("inverse"))
    # a numeric triple has no tail entity and so no inverse place
    places = F.inline(F.array(place("head", False), place("tail_id", True)))
    present = triples.select("rel", "kind", places).filter("entity_id is not null").join(
        targets.select("entity_id").distinct(), "entity_id", "left_semi"
    )
    return (
        present.distinct()
        .join(weights, "entity_id")
        .groupBy("rel", "kind", "inverse")
        .agg(F.sum("_rows").alias("_covered"))
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .filter(F.col("_covered") >= F.col("_total") * share)
        .select("rel", "kind", "inverse")
    )


# --- recipes -----------------------------------------------------------------------------------

DONATION_CATEGORIES = ("primary_focus_subject", "primary_focus_area", "resource_type", "poverty_level", "grade_level")
DONATION_FLAGS = ("eligible_double_your_impact_match", "eligible_almost_home_match")


def donation_features(target: DataFrame, donations: DataFrame, projects: DataFrame) -> DataFrame:
    """Donation statistics and encoded project attributes per project."""
    features = aggregate_by_key(
        target,
        donations,
        "projectid",
        **{
            "MEAN(donation_to_project)": F.avg("donation_to_project"),
            "MEAN(LENGTH(donation_message))": F.avg(text_length("donation_message")),
            "COUNT(donations)": F.count(F.lit(1)),
        },
    ).fillna(0, subset=["`COUNT(donations)`"])
    attributes = fill_category(
        projects.withColumns({f: flag_to_int(f) for f in DONATION_FLAGS}),
        [c for c in DONATION_CATEGORIES if c != "poverty_level"],
    )
    features = features.join(attributes, "projectid", "left")
    for col in DONATION_CATEGORIES:
        features = one_hot(features, col)
    return features


def course_features(
    target: DataFrame, logs: DataFrame, enrollments: DataFrame, dates: DataFrame, modules: DataFrame
) -> DataFrame:
    """Log counts and times per enrolment, with attributes of its course.

    The logs are reduced to a count and a mean time per enrolment before any join; the mean
    relative time follows from the mean time, being linear in it.
    """
    courses = enrollments.select("enrollment_id", "course_id")
    per_enrollment = logs.groupBy("enrollment_id").agg(
        F.count(F.lit(1)).alias("COUNT(logs)"), F.avg(micros("time")).alias("_time")
    )
    span = micros("to") - micros("from")
    mean_times = (
        per_enrollment.join(courses, "enrollment_id")
        .join(dates, "course_id")
        .groupBy("enrollment_id")
        .agg(F.avg((F.col("_time") - micros("from")) / F.nullif(span, F.lit(0))).alias("MEAN(relative_log_time)"))
    )
    starts = days_since_first(dates, "from", "course_start_date").select("course_id", "course_start_date")
    counts = modules.groupBy("course_id").agg(F.count(F.lit(1)).alias("COUNT(course.modules)"))
    features = (
        target.join(per_enrollment.drop("_time"), "enrollment_id", "left")
        .join(mean_times, "enrollment_id", "left")
        .join(courses, "enrollment_id")
        .join(starts, "course_id")
        .join(counts, "course_id")
    )
    return one_hot(features, "course_id")


def place_features(
    targets: DataFrame, triples: DataFrame, rels: Mapping[str, int], category: str | None = None
) -> DataFrame:
    """Means of numeric relations, with one optional encoded target column."""
    features = relation_mean(targets, triples, rels)
    return one_hot(features, category) if category else features


def film_features(
    targets: DataFrame,
    triples: DataFrame,
    means: Mapping[str, int],
    country: tuple[str, int],
    inverse: Mapping[str, int],
) -> DataFrame:
    """Numeric means, the encoded commonest values of one relation, and inverse counts."""
    name, rel = country
    features = relation_first(relation_mean(targets, triples, means), triples, rel, name)
    features = one_hot(rare_category(features, name, "Rare country"), name, missing=True)
    return inverse_count(features, triples, {f"COUNT({n})": r for n, r in inverse.items()})


def company_features(
    targets: DataFrame, triples: DataFrame, names: Mapping[int, str], share: float = 0.05
) -> DataFrame:
    """Every relation present for enough targets: mean if numeric, else count, both directions."""
    # one row per relation: schema-sized
    found = covering_relations(targets, triples, share).orderBy("inverse", "rel").collect()
    means = {names[r["rel"]]: r["rel"] for r in found if r["kind"] == "num"}
    counts = {f"COUNT({names[r['rel']]})": r["rel"] for r in found if r["kind"] == "cat" and not r["inverse"]}
    inverse = {f"COUNT(inv_{names[r['rel']]})": r["rel"] for r in found if r["inverse"]}
    rows = of_targets(triples.filter(F.col("rel").isin([*means.values(), *counts.values()])), targets)
    forward = [F.avg(F.when(F.col("rel") == r, F.col("tail_val"))).alias(n) for n, r in means.items()] + [
        F.nullif(F.count_if(F.col("rel") == r), F.lit(0)).alias(n) for n, r in counts.items()
    ]
    features = targets
    if forward:
        features = features.join(rows.groupBy(F.col("head").alias("entity_id")).agg(*forward), "entity_id", "left")
    return inverse_count(features, triples, inverse) if inverse else features
