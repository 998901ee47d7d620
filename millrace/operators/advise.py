"""Target, leakage and feature advice over the profile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import names
from millrace.functions import types as ty
from millrace.operators.correlate import correlation_matrix
from millrace.operators.rows import union_all

# Scoring weights and thresholds.
STRONG, POSSIBLE, WEAK = 0.85, 0.50, 0.14
POST_EVENT_BOOST, PRE_EVENT_PENALTY = 0.35, 0.40
NAME_BOOST, NUMERIC_BOOST, ROLE_BOOST = 0.20, 0.25, 0.15
CATEGORY_BOOST, BOOLEAN_BOOST = 0.15, 0.10
NULL_PENALTY, NULL_PENALTY_PCT = 0.15, 30.0
CORRELATION_TIERS = [(0.98, "HIGH", 0.98), (0.90, "MEDIUM", 0.85), (0.75, "LOW", 0.65)]
MIN_PAIRS = 3
MOSTLY_NULL_PCT = 80.0


def _has(role: str) -> Column:
    return F.array_contains("roles", role)


def target_candidates(roles: DataFrame) -> DataFrame:
    """(dataset, column, rank, score, tier, target_type) of columns that look like outcomes."""
    name = F.col("column")
    targeted, post = names.matches(name, names.TARGET), names.matches(name, names.POST_EVENT)
    excluded = (
        _has("foreign_key")
        | F.col("is_datetime")
        | (_has("timestamp") & ~post)
        | _has("metadata")
        | (_has("distractor") & ~targeted & ~post)
        | (_has("identifier") & ~targeted)
        | names.matches(name, names.COORDINATE)
    )
    numeric = F.col("is_numeric") & (F.col("unique_count") > 1)
    category = F.col("is_categorical") & F.col("unique_count").between(2, 20)
    # The first of the three shapes that fits decides, as listed.
    shape_boost = (
        F.when(numeric, NUMERIC_BOOST)
        .when(category, F.when(targeted, CATEGORY_BOOST).otherwise(0.0))
        .when(F.col("is_boolean") & targeted, BOOLEAN_BOOST)
        .otherwise(0.0)
    )
    target_type = (
        F.when(numeric, "regression")
        .when(category, F.when(targeted, "classification").otherwise("unknown"))
        .when(F.col("is_boolean") & targeted, "classification")
        .otherwise("unknown")
    )
    points = [
        (_has("potential_target"), ROLE_BOOST),
        (post, POST_EVENT_BOOST),
        (names.matches(name, names.PRE_EVENT), -PRE_EVENT_PENALTY),
        (targeted, NAME_BOOST),
        (F.col("null_pct") > NULL_PENALTY_PCT, -NULL_PENALTY),
    ]
    raw = shape_boost
    for condition, weight in points:
        raw = raw + F.when(condition, weight).otherwise(0.0)
    # Rounded so that tier edges do not depend on the order of additions.
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 4)))
    tier = F.when(F.col("score") >= STRONG, "strong").when(F.col("score") >= POSSIBLE, "possible").otherwise("weak")
    # A result table: one row per profiled column.
    order = Window.orderBy(F.desc("score"), "dataset", "position")
    return (
        roles.where(~excluded)
        .select("dataset", "column", "position", score.alias("score"), target_type.alias("target_type"))
        .where(F.col("score") >= WEAK)
        .select(
            "dataset",
            "column",
            F.row_number().over(order).alias("rank"),
            "score",
            tier.alias("tier"),
            "target_type",
        )
    )


def checked_targets(targets: DataFrame) -> DataFrame:
    """Strong and possible targets, or the three best when there are none."""
    best = targets.where(F.col("tier") != "weak")
    any_best = targets.agg(F.count_if(F.col("tier") != "weak").alias("best_count"))
    return (
        targets.crossJoin(F.broadcast(any_best))  # one row
        .where((F.col("tier") != "weak") | ((F.col("best_count") == 0) & (F.col("rank") <= 3)))
        .select("dataset", F.col("column").alias("target"))
    )


def leakage_scan(tables: dict[str, DataFrame], roles: DataFrame, targets: DataFrame) -> DataFrame:
    """(dataset, column, target, severity, confidence, rule): the first rule that fits.

    Correlations of each table come from one aggregate over its numeric columns.
    """
    parts = []
    for name, df in tables.items():
        numeric = ty.numeric_columns(df)
        if len(numeric) > 1:
            matrix = correlation_matrix(df, numeric)
            parts.append(
                matrix.select(
                    F.lit(name).alias("dataset"), F.col("x").alias("column"), F.col("y").alias("target"), "pairs", "r"
                )
            )
    keyed = checked_targets(targets)
    pairs = roles.select("dataset", "column", "roles", "is_datetime").join(F.broadcast(keyed), "dataset")
    pairs = pairs.where(F.col("column") != F.col("target"))
    if parts:
        pairs = pairs.join(F.broadcast(union_all(parts)), ["dataset", "column", "target"], "left")
    else:
        pairs = pairs.withColumns({"pairs": F.lit(0), "r": F.lit(None).cast("double")})

    column, target = F.lower("column"), F.lower("target")
    late = names.matches(F.col("column"), names.LEAKAGE) & (_has("timestamp") | F.col("is_datetime"))
    named = column.contains(target) & (column != target)
    enough = F.col("pairs") >= MIN_PAIRS
    severity, confidence = F.when(late, "HIGH").when(named, "HIGH"), F.when(late, 0.95).when(named, 0.92)
    rule = F.when(late, "post_event_timestamp").when(named, "name_contains_target")
    for floor, label, value in CORRELATION_TIERS:
        hit = enough & (F.abs("r") >= floor)
        severity, confidence, rule = severity.when(hit, label), confidence.when(hit, value), rule.when(hit, "correlation")
    return pairs.select(
        "dataset",
        "column",
        "target",
        severity.alias("severity"),
        confidence.alias("confidence"),
        rule.alias("rule"),
        F.when(rule == "correlation", F.round("r", 3)).alias("correlation"),
    ).where("severity IS NOT NULL")


def feature_advice(roles: DataFrame) -> DataFrame:
    """First matching rule per column: classification, recommendation, encoding, scaling, derived features."""
    few = F.col("unique_count") <= 20
    mostly_unique = F.col("unique_pct") > 90
    none = F.lit("none")
    rules = [
        # condition, classification, recommendation, confidence, encoding, scaling, derived
        (_has("identifier"), "identifier", "ignore", 0.95, None, None, ""),
        (_has("foreign_key"), "identifier", "ignore", 0.90, None, None, ""),
        (_has("pii"), "pii", "ignore", 0.98, None, None, ""),
        (_has("metadata"), "metadata", "ignore", 0.92, None, None, ""),
        (_has("potential_leakage"), "leakage", "ignore", 0.96, None, None, ""),
        (_has("potential_target"), "target", "ignore", 0.94, None, None, ""),
        (_has("distractor"), "distractor", "ignore", 0.88, None, None, ""),
        (F.col("null_pct") > MOSTLY_NULL_PCT, "optional_feature", "weak_feature", 0.35, None, None, ""),
        (
            F.col("is_datetime"),
            "derived_feature",
            "derived_feature_candidate",
            0.88,
            none,
            none,
            "extract_year,extract_month,extract_day_of_week,extract_hour",
        ),
        (
            F.col("is_text"),
            "derived_feature",
            "derived_feature_candidate",
            0.62,
            None,
            None,
            "text_length,token_count,embedding_candidate",
        ),
        (
            F.col("is_numeric"),
            F.when(mostly_unique, "optional_feature").otherwise("recommended_feature"),
            "useful_feature",
            F.when(mostly_unique, 0.55).otherwise(0.82),
            none,
            F.lit("standard_scaler"),
            "",
        ),
        (F.col("is_boolean"), "recommended_feature", "useful_feature", 0.78, none, none, ""),
        (
            F.col("is_categorical"),
            F.when(few, "recommended_feature").otherwise("optional_feature"),
            "useful_feature",
            F.when(few, 0.80).otherwise(0.58),
            F.when(few, "one_hot").otherwise("target_encoding"),
            none,
            "",
        ),
        (
            F.col("is_high_cardinality"),
            "optional_feature",
            "weak_feature",
            0.48,
            F.lit("hashing_or_embedding"),
            None,
            "",
        ),
        (F.lit(True), "unknown", "weak_feature", 0.30, None, None, ""),
    ]
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = F
    for condition, group, recommendation, confidence, encoding, scaling, derived in rules:
        answer = F.struct(
            as_column(group).alias("classification"),
            F.lit(recommendation).alias("recommendation"),
            as_column(confidence).alias("confidence"),
            as_column(encoding).cast("string").alias("encoding"),
            as_column(scaling).cast("string").alias("scaling"),
            F.lit(derived).alias("derived"),
        )
        chain = chain.when(condition, answer)
    return roles.select("dataset", "column", chain.alias("advice")).select("dataset", "column", "advice.*")


def intelligence_score(
    profile: DataFrame, relationships: DataFrame, advice: DataFrame, targets: DataFrame
) -> DataFrame:
    """One row: five 0-100 part scores and their mean."""
    hundred = lambda c: F.round(c * 100, 2)
    discovery = profile.agg(
        F.when(F.count(F.lit(1)) > 0, 100.0).otherwise(0.0).alias("discovery_quality"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("logical_dtype").isNotNull()), F.count(F.lit(1))), F.lit(0.0)
        ).alias("schema"),
    )
    related = relationships.agg(F.coalesce(F.avg("join_confidence"), F.lit(0.5)).alias("relationship"))
    usable = ~F.col("classification").isin("identifier", "metadata", "pii")
    featured = advice.agg(F.coalesce(F.avg(F.when(usable, F.col("confidence"))), F.lit(0.5)).alias("feature"))
    strong = F.avg(F.when(F.col("tier") == "strong", F.col("score")))
    top = F.avg(F.when(F.col("rank") <= 3, F.col("score")))
    aimed = targets.agg(F.coalesce(strong, top, F.lit(0.0)).alias("target"))
    one = discovery.crossJoin(F.broadcast(related)).crossJoin(F.broadcast(featured)).crossJoin(F.broadcast(aimed))
    parts = [F.col("schema"), F.col("relationship"), F.col("feature"), F.col("target")]
    overall = (F.col("discovery_quality") + sum((p * 100 for p in parts), F.lit(0.0))) * 0.20
    return one.select(
        "discovery_quality",
        hundred(F.col("relationship")).alias("relationship_confidence"),
        hundred(F.col("schema")).alias("schema_confidence"),
        hundred(F.col("feature")).alias("feature_confidence"),
        hundred(F.col("target")).alias("target_confidence"),
        F.round(overall, 2).alias("overall_score"),
    )
