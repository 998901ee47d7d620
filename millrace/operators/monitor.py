"""Prediction monitoring and feature drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.operators.encode import scaler_fit
from millrace.operators.rows import rows_of

DRIFT_THRESHOLD = 0.5
MIN_SIGMA = 1e-8


def monitor_batch(
    predictions: DataFrame,
    prediction: str,
    inputs: list[str] = (),
    bounds: dict[str, tuple[float, float]] | None = None,
    by: list[str] = (),
) -> DataFrame:
    """One monitoring record per group, or for the whole batch.

    Missing inputs count null cells; out-of-range inputs count cells outside
    their bounds.
    """
    value = F.col(prediction).cast("double")
    missing = sum((F.count_if(F.col(c).isNull()) for c in inputs), F.lit(0)).cast("bigint")
    outside = sum(
        (F.count_if(~F.col(c).between(low, high)) for c, (low, high) in (bounds or {}).items()), F.lit(0)
    ).cast("bigint")
    return predictions.groupBy(*by).agg(
        F.count(value).alias("prediction_count"),
        F.avg(value).alias("mean_prediction"),
        F.stddev_pop(value).alias("std_prediction"),
        F.min(value).alias("min_prediction"),
        F.max(value).alias("max_prediction"),
        missing.alias("missing_inputs"),
        outside.alias("out_of_range_inputs"),
    )


def monitor_latest(records: DataFrame, timestamp: str, by: list[str] = ()) -> DataFrame:
    """The newest record, overall or per group; equal times go to the larger record."""
    rest = [c for c in records.columns if c not in by]
    body = [timestamp, *[c for c in rest if c != timestamp]]
    newest = records.groupBy(*by).agg(F.max(F.struct(*body)).alias("newest"))
    return newest.select(*by, *[F.col("newest")[c].alias(c) for c in rest])


def monitor_list(records: DataFrame, timestamp: str) -> DataFrame:
    return records.orderBy(timestamp)


def mean_latency(records: DataFrame, candidates: list[str]) -> DataFrame:
    """One row: mean of the first latency field present on each record."""
    present = [F.col(c).cast("double") for c in candidates if c in records.columns]
    latency = F.coalesce(*present) if present else F.lit(None).cast("double")
    return records.agg(F.avg(latency).alias("mean_latency_ms"), F.count(latency).alias("samples"))


def drift_baseline(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(column, mean, std) per feature with the population sigma."""
    return scaler_fit(df, features or ty.numeric_columns(df))


def _means(df: DataFrame, features: list[str]) -> DataFrame:
    numbers = [V.to_number(F.col(c), ty.dtype_of(df, c)) for c in features]
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("current_mean")) for i, c in enumerate(features)]
    return rows_of(df.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(numbers)]), structs)


def _shift(mean0: Column, std0: Column, mean1: Column) -> Column:
    return F.abs(mean1 - mean0) / F.greatest(std0, F.lit(MIN_SIGMA))


def drift_scan(baseline: DataFrame, current: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """(feature, baseline_mean, current_mean, shift, drifted) against a stored baseline.

    The current table is read for the numeric columns it shares with the baseline.
    """
    means = _means(current, ty.numeric_columns(current))
    shift = _shift(F.col("mean"), F.col("std"), F.col("current_mean"))
    # One row per feature on both sides.
    return baseline.join(F.broadcast(means), "column").select(
        F.col("column").alias("feature"),
        F.col("mean").alias("baseline_mean"),
        "current_mean",
        shift.alias("shift"),
        (shift > threshold).alias("drifted"),
    )


def drift_any(scan: DataFrame) -> DataFrame:
    """One row (drift_detected, drifted_features, features)."""
    return scan.agg(
        F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("drift_detected"),
        F.count_if("drifted").alias("drifted_features"),
        F.count(F.lit(1)).alias("features"),
    )
