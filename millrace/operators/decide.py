"""From findings to an ordered cleaning plan; every input is a small finding table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import names
from millrace.operators import checks
from millrace.operators.rows import literal_table, union_all
from millrace.spec import TableSpec

# Thresholds, priorities and per-issue confidence.
DROP_ABOVE_PCT = 80.0
HIGH_NULL_PCT, SEVERE_NULL_PCT = 5.0, 50.0
PRIORITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
ACTION_RULES = {
    # issue: (action, confidence); IMPUTE turns into DROP above the null threshold
    "null_violation": ("IMPUTE", 0.95),
    "duplicate_rows": ("REMOVE_DUPLICATES", 1.0),
    "foreign_key_orphan": ("REPAIR_FOREIGN_KEY", 0.90),
    "gps_invalid_bounds": ("FIX_GPS", 0.95),
    "high_null_rate": ("IMPUTE", 0.85),
    "negative_value_anomaly": ("REMOVE_OUTLIERS", 0.95),
    "outlier_detected": ("REMOVE_OUTLIERS", 0.80),
    "pii_column": ("DROP", 1.0),
    "target_leakage": ("DROP", 0.98),
    "target_contains_nulls": ("DROP", 0.99),
}
IMPACT_DEFAULTS = {"nulls": 95.0, "duplicates": 95.0, "schema": 90.0, "foreign_key": 90.0, "gps": 100.0}
DEFAULT_QUALITY = 70.0
QUALITY_CEILING = 98.0
CEILING_RESULT = 98.5

ISSUE_COLUMNS = ["issue_type", "dataset", "column", "severity", "null_pct", "count"]


def _issue(df: DataFrame, issue: str, column: Column, severity: Column | str, null_pct=None, count=None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    null_pct = F.lit(None) if null_pct is None else null_pct
    count = F.lit(None) if count is None else count
    return df.select(
        F.lit(issue).alias("issue_type"),
        "dataset",
        column.cast("string").alias("column"),
        severity.alias("severity"),
        null_pct.cast("double").alias("null_pct"),
        count.cast("bigint").alias("count"),
    )


def issues_from_validation(tables: dict[str, DataFrame], specs: list[TableSpec]) -> DataFrame:
    """Issues found by the schema, null, duplicate, foreign-key and coordinate checks."""
    parts = []
    nothing = F.lit(None)
    for spec in specs:
        df = tables[spec.name]
        tag = lambda found: found.withColumn("dataset", F.lit(spec.name))  # noqa: B023, E731
        missing, extra = checks.schema_gaps(df, spec)
        gaps = [("schema_missing_columns", "CRITICAL", missing), ("schema_extra_columns", "LOW", extra)]
        for issue, severity, gap in gaps:
            if gap:
                one = literal_table(df.sparkSession, [(spec.name, len(gap))], "dataset string,size bigint")
                parts.append(_issue(one, issue, nothing, severity, count=F.col("size")))
        cells = checks.cell_checks(df, spec, ["nulls", "gps"])
        bad = tag(cells.where("violations > 0"))
        null_pct = F.round(F.try_divide("violations", "checked") * 100, 2)
        strict = (F.col("check") == "nulls") & ~F.col("column").isin(spec.nullable)
        parts.append(
            _issue(bad.where(strict), "null_violation", F.col("column"), "HIGH", null_pct, F.col("violations"))
        )
        if spec.latitude or spec.longitude:
            off = bad.where(F.col("check") == "gps")
            parts.append(_issue(off, "gps_invalid_bounds", F.col("column"), "HIGH", count=F.col("violations")))
        repeated = tag(checks.duplicate_rows(df).where("duplicate_rows > 0"))
        parts.append(_issue(repeated, "duplicate_rows", nothing, "HIGH", count=F.col("duplicate_rows")))
        for fk in spec.foreign_keys:
            orphans = tag(checks.fk_orphans(df, fk, tables).where("orphans > 0"))
            severity = F.when(F.col("parent_missing"), "HIGH").otherwise("MEDIUM")
            parts.append(_issue(orphans, "foreign_key_orphan", F.col("column"), severity, count=F.col("orphans")))
    return union_all(parts)


def issues_from_profile(profile: DataFrame) -> DataFrame:
    """High null rates, negative minima of positive-only columns, values beyond three sigma."""
    column, spread = F.col("column"), F.coalesce(F.col("std") > 0, F.lit(False))
    rate = F.when(F.col("null_pct") < SEVERE_NULL_PCT, "MEDIUM").otherwise("HIGH")
    high = _issue(
        profile.where(F.col("null_pct") > HIGH_NULL_PCT),
        "high_null_rate",
        column,
        rate,
        F.col("null_pct"),
        F.col("null_count"),
    )
    negative = spread & (F.col("min") < 0) & names.matches(column, names.POSITIVE_ONLY)
    upper, lower = F.col("mean") + 3 * F.col("std"), F.col("mean") - 3 * F.col("std")
    beyond = spread & ((F.col("max") > upper) | (F.col("min") < lower))
    return union_all(
        [
            high,
            _issue(profile.where(negative), "negative_value_anomaly", column, "HIGH"),
            _issue(profile.where(beyond), "outlier_detected", column, "MEDIUM"),
        ]
    )


def issues_from_features(advice: DataFrame) -> DataFrame:
    """Personal data, and recommended features that need encoding or scaling."""
    column = F.col("column")
    wanted = advice.where(F.col("classification") == "recommended_feature")
    return union_all(
        [
            _issue(advice.where(F.col("classification") == "pii"), "pii_column", column, "HIGH"),
            _issue(wanted.where("encoding != 'none'"), "categorical_needs_encoding", column, "INFO"),
            _issue(wanted.where("scaling != 'none'"), "numeric_needs_scaling", column, "INFO"),
        ]
    )


def issues_from_leakage(findings: DataFrame) -> DataFrame:
    severity = F.when(F.col("severity").isin("HIGH", "MEDIUM", "LOW"), F.col("severity")).otherwise("MEDIUM")
    return _issue(findings, "target_leakage", F.col("column"), severity)


def issues_from_target(targets: DataFrame, profile: DataFrame) -> DataFrame:
    """Strong targets that contain nulls."""
    strong = targets.where("tier = 'strong'").select("dataset", "column")
    hit = profile.where("null_count > 0").join(F.broadcast(strong), ["dataset", "column"])
    return _issue(
        hit, "target_contains_nulls", F.col("column"), "CRITICAL", F.col("null_pct"), F.col("null_count")
    )


def recommend_actions(issues: DataFrame) -> DataFrame:
    """(action, dataset, column, confidence, priority, rationale); some issues need no action."""
    mostly_null = F.coalesce(F.col("null_pct") > DROP_ABOVE_PCT, F.lit(False))
    kind, action, confidence = F.col("issue_type"), F, F
    for issue, (verb, value) in ACTION_RULES.items():
        chosen = F.when(mostly_null, "DROP").otherwise(verb) if verb == "IMPUTE" else F.lit(verb)
        action, confidence = action.when(kind == issue, chosen), confidence.when(kind == issue, value)
    return (
        issues.withColumns({"action": action, "confidence": confidence})
        .where("action IS NOT NULL")
        .select(
            "action",
            "dataset",
            "column",
            "confidence",
            F.col("severity").alias("priority"),
            F.concat(kind, F.lit(" on "), "dataset", F.coalesce(F.concat(F.lit("."), "column"), F.lit(""))).alias(
                "rationale"
            ),
        )
    )


def default_actions(recommendations: DataFrame, registry: DataFrame) -> DataFrame:
    """KEEP for every untouched column, LEAVE_UNCHANGED for every untouched table."""
    handled = recommendations.select("dataset", F.coalesce("column", F.lit("")).alias("slot")).distinct()
    slots = registry.select("dataset", "column").unionByName(
        registry.select("dataset").distinct().withColumn("column", F.lit(None).cast("string"))
    )
    slots = slots.withColumn("slot", F.coalesce("column", F.lit("")))
    untouched = slots.join(F.broadcast(handled), ["dataset", "slot"], "left_anti")
    whole = F.col("column").isNull()
    return untouched.select(
        F.when(whole, "LEAVE_UNCHANGED").otherwise("KEEP").alias("action"),
        "dataset",
        "column",
        F.lit(1.0).alias("confidence"),
        F.lit("INFO").alias("priority"),
        F.when(whole, "no issue on the table").otherwise("no issue on the column").alias("rationale"),
    )


def calibrate_priority(recommendations: DataFrame, targets: DataFrame) -> DataFrame:
    """Issues on a strong target become CRITICAL; confidence is clamped to [0, 1]."""
    strong = targets.where("tier = 'strong'").select("dataset", "column").distinct().withColumn("hit", F.lit(True))
    raised = F.coalesce(F.col("hit"), F.lit(False)) & F.col("priority").isin("HIGH", "MEDIUM")
    return recommendations.join(F.broadcast(strong), ["dataset", "column"], "left").select(
        "action",
        "dataset",
        "column",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"),
        F.when(raised, "CRITICAL").otherwise(F.col("priority")).alias("priority"),
        F.when(raised, F.concat(F.lit("[target column] "), "rationale"))
        .otherwise(F.col("rationale"))
        .alias("rationale"),
    )


def approval_manifest(recommendations: DataFrame) -> DataFrame:
    """Numbered decisions awaiting approval, most urgent first.

    The plan has a few rows per column of the schema, so one sort numbers it.
    """
    urgency = F.array_position(F.array(*[F.lit(p) for p in PRIORITY_ORDER]), F.col("priority"))
    order = Window.orderBy(
        urgency, F.desc("confidence"), "dataset", F.coalesce("column", F.lit("")), "action", "rationale"
    )
    return recommendations.select(
        F.format_string("DEC-%03d", F.row_number().over(order)).alias("decision_id"),
        "dataset",
        "column",
        "action",
        "priority",
        "confidence",
        "rationale",
        F.lit("PENDING_APPROVAL").alias("status"),
    )


def decision_summary(recommendations: DataFrame) -> DataFrame:
    """(kind, name, decisions, mean_confidence) by priority and by action, and in total."""
    sets = F.explode(
        F.array(
            F.struct(F.lit("priority").alias("kind"), F.col("priority").alias("name")),
            F.struct(F.lit("action").alias("kind"), F.col("action").alias("name")),
            F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")),
        )
    )
    return (
        recommendations.select(sets.alias("s"), "confidence")
        .groupBy("s.kind", "s.name")
        .agg(F.count(F.lit(1)).alias("decisions"), F.round(F.avg("confidence"), 10).alias("mean_confidence"))
    )


def impact_estimate(
    categories: DataFrame, quality: DataFrame, leaks: DataFrame, advice: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """(dimension, baseline, target, delta) for five quality dimensions."""
    scores = categories.agg(
        *[
            F.coalesce(F.max(F.when(F.col("category") == k, F.col("average"))), F.lit(v)).alias(k)
            for k, v in IMPACT_DEFAULTS.items()
        ]
    )
    overall = quality.agg(F.coalesce(F.max("overall_score"), F.lit(DEFAULT_QUALITY)).alias("quality"))
    risk = leaks.agg(F.count(F.lit(1)).alias("leaks"))
    personal = advice.agg(F.count_if(F.col("classification") == "pii").alias("pii"))
    verbs = ["IMPUTE", "DROP", "REMOVE_DUPLICATES", "FIX_DATATYPE", "FLAG", "REMOVE_OUTLIERS"]
    used = recommendations.agg(
        *[F.coalesce(F.bool_or(F.col("action") == v), F.lit(False)).alias(f"has_{v.lower()}") for v in verbs]
    )
    one = scores
    for frame in (overall, risk, personal, used):  # one row each
        one = one.crossJoin(F.broadcast(frame))
    has = lambda verb: F.col(f"has_{verb}")
    one = one.withColumn(
        "reliability", F.greatest(F.lit(10.0), 100.0 - 15.0 * F.col("leaks") - 20.0 * F.col("pii"))
    ).withColumns(
        {
            "completeness_1": F.when(has("impute") | has("drop"), 100.0).otherwise(F.col("nulls")),
            "consistency_1": F.when(has("remove_duplicates") & (has("fix_datatype") | has("drop")), 100.0)
            .when(has("remove_duplicates"), F.greatest(F.lit(99.0), "duplicates"))
            .otherwise((F.col("duplicates") + F.col("schema")) / 2),
            "integrity_1": F.when(has("flag"), F.greatest(F.lit(98.0), "foreign_key"))
            .when(has("remove_outliers"), 100.0)
            .otherwise(F.least("foreign_key", "gps")),
            "reliability_1": F.when(has("drop"), 100.0).otherwise(F.col("reliability")),
        }
    )
    mean = F.round(
        (F.col("completeness_1") + F.col("consistency_1") + F.col("integrity_1") + F.col("reliability_1")) / 4, 2
    )
    one = one.withColumn("quality_1", F.when(mean > QUALITY_CEILING, CEILING_RESULT).otherwise(mean))
    dimensions = [
        ("data_quality", F.col("quality"), F.col("quality_1")),
        ("completeness", F.col("nulls"), F.col("completeness_1")),
        ("consistency", F.least("duplicates", "schema"), F.col("consistency_1")),
        ("integrity", F.least("foreign_key", "gps"), F.col("integrity_1")),
        ("model_reliability", F.col("reliability"), F.col("reliability_1")),
    ]
    structs = [
        F.struct(
            F.lit(name).alias("dimension"),
            F.round(before, 2).alias("baseline"),
            F.round(after, 2).alias("target"),
            F.round(after - before, 2).alias("delta"),
        )
        for name, before, after in dimensions
    ]
    return one.select(F.inline(F.array(*structs)))
