"""Feature groups: calendar, distance, load and business rules; column typing; split."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import numeric as N
from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.functions.quantiles import quantile_row
from millrace.operators.rows import literal_table

# Labels and edges of the derived features.
WEEKEND = ["Saturday", "Sunday"]
MEALS = [(5, 10, "Breakfast"), (11, 15, "Lunch"), (16, 20, "Evening")]
NIGHT = "Night"
PEAKS = [(7, 10), (17, 20)]
SAME_PLACE_KM = 0.05
HIGH_LOAD = 0.80
PREMIUM_RATING = 4.5
EXPERIENCE = [("Beginner", None, 500), ("Intermediate", 500, 1499), ("Experienced", 1500, 2999), ("Expert", 3000, None)]
QUALITY = [("Low", None, 3.5), ("Standard", 3.5, 4.2), ("Good", 4.2, 4.7), ("Premium", 4.7, None)]
UPPER_QUARTILE = 0.75
FEATURE_ACTIONS = {
    "Target": "Prediction Target",
    "Identifier": "Drop",
    "GPS": "Distance Engineering",
    "Datetime": "Extract Features",
    "Boolean": "Keep",
    "Numerical": "Scale",
    "Categorical": "Encode",
    "Unknown": "Review",
}


def _flag(condition: Column) -> Column:
    """Boolean feature: an unknown comparison counts as false."""
    return F.coalesce(condition, F.lit(False))


def temporal_features(df: DataFrame, timestamp: str) -> DataFrame:
    """hour, minute, day, month, weekday, is_weekend, meal_period and peak_hour."""
    ts = V.parse_timestamp(F.col(timestamp), ty.dtype_of(df, timestamp))
    hour, weekday = F.hour(ts), F.date_format(ts, "EEEE")
    meal = F.lit(NIGHT)
    for low, high, label in MEALS:
        meal = F.when(hour.between(low, high), label).otherwise(meal)
    peak = F.lit(False)
    for low, high in PEAKS:
        peak = peak | hour.between(low, high)
    return df.withColumns(
        {
            "hour": hour,
            "minute": F.minute(ts),
            "day": F.dayofmonth(ts),
            "month": F.month(ts),
            "weekday": weekday,
            "is_weekend": _flag(weekday.isin(WEEKEND)),
            "meal_period": meal,
            "peak_hour": _flag(peak),
        }
    )


def geo_features(df: DataFrame, start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
    """distance_km, latitude/longitude differences and same_location."""
    (lat1, lon1), (lat2, lon2) = start, end
    return df.withColumn(
        "distance_km", N.haversine_km(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2))
    ).withColumns(
        {
            "latitude_difference": F.abs(F.col(lat1) - F.col(lat2)),
            "longitude_difference": F.abs(F.col(lon1) - F.col(lon2)),
            "same_location": _flag(F.col("distance_km") < SAME_PLACE_KM),
        }
    )


@dataclass(frozen=True)
class OperationRoles:
    """Which columns play the operational roles."""

    capacity: str
    load: str
    completed: str
    shift_hours: str
    size: str
    value: str
    rating: str | None = None


def operational_features(df: DataFrame, roles: OperationRoles) -> DataFrame:
    """Load ratio, spare capacity, utilisation, orders per shift hour, value per item, workload flag."""
    number = lambda c: F.col(c).cast("double")
    load_ratio = N.safe_divide(number(roles.load), number(roles.capacity))
    return df.withColumn("load_ratio", load_ratio).withColumns(
        {
            "remaining_capacity": number(roles.capacity) - number(roles.load),
            "capacity_utilization_percent": F.col("load_ratio") * 100,
            "orders_per_shift_hour": N.safe_divide(number(roles.completed), number(roles.shift_hours)),
            "average_order_value_per_item": N.safe_divide(number(roles.value), number(roles.size)),
            "high_workload": F.col("load_ratio") >= HIGH_LOAD,
        }
    )


def tier(value: Column, steps: list[tuple[str, float | None, float | None]]) -> Column:
    """First step whose inclusive bounds hold the value; the first label when none does.

    The lowest step is open below its upper bound, the highest at its lower bound.
    """
    chain = F
    for label, low, high in steps:
        if low is None:
            hit = value < high
        elif high is None:
            hit = value >= low
        else:
            hit = value.between(low, high)
        chain = chain.when(hit, label)
    return chain.otherwise(steps[0][0])


def business_thresholds(df: DataFrame, roles: OperationRoles) -> DataFrame:
    """One row: upper quartiles of value and size, median capacity; all exact."""
    return quantile_row(
        df,
        {
            "value_threshold": (roles.value, UPPER_QUARTILE),
            "size_threshold": (roles.size, UPPER_QUARTILE),
            "capacity_median": (roles.capacity, 0.5),
        },
    )


def business_features(df: DataFrame, roles: OperationRoles) -> DataFrame:
    """Experience level, quality tier, high-value and large orders, premium and busy flags.

    Needs ``load_ratio`` from :func:`operational_features`.
    """
    number = lambda c: F.col(c).cast("double")
    wide = df.crossJoin(F.broadcast(business_thresholds(df, roles)))  # one row
    busy = (F.col("load_ratio") >= HIGH_LOAD) & (number(roles.capacity) > F.col("capacity_median"))
    return wide.withColumns(
        {
            "rider_experience_level": tier(number(roles.completed), EXPERIENCE),
            "restaurant_quality_tier": tier(number(roles.rating), QUALITY),
            "high_value_order": _flag(number(roles.value) >= F.col("value_threshold")),
            "large_order": _flag(number(roles.size) >= F.col("size_threshold")),
            "premium_restaurant": _flag(number(roles.rating) >= PREMIUM_RATING),
            "busy_restaurant": _flag(busy),
        }
    ).drop("value_threshold", "size_threshold", "capacity_median")


# --------------------------------------------------------------- column typing


def feature_type(name: str, dtype: T.DataType, target: str | None) -> str:
    low = name.lower()
    if target is not None and low == target.lower():
        return "Target"
    if re.search(r"(^|_)id($|_)", low):
        return "Identifier"
    if "lat" in low or "lon" in low:
        return "GPS"
    if "timestamp" in low or "datetime" in low or ty.is_moment(dtype):
        return "Datetime"
    if isinstance(dtype, T.BooleanType):
        return "Boolean"
    if ty.is_numeric(dtype):
        return "Numerical"
    return "Categorical" if isinstance(dtype, T.StringType) else "Unknown"


def feature_types(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column, feature_type, action); names and types decide, no row is read."""
    rows = []
    for f in df.schema.fields:
        kind = feature_type(f.name, f.dataType, target)
        rows.append((f.name, kind, FEATURE_ACTIONS[kind]))
    return literal_table(df.sparkSession, rows, "column string,feature_type string,action string")


# ----------------------------------------------------------------------- split


def split_bucket(key: Column, seed: int = 42) -> Column:
    """A number in 0…65535 that depends only on the key and the seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def train_test_split(
    df: DataFrame, key: str, target: str, test_share: float = 0.2, seed: int = 42, drop: list[str] | None = None
) -> DataFrame:
    """Feature columns, target and ``split`` ('train' or 'test').

    The bucket is a hash of the key, so the split is stable under re-reading,
    repartitioning and growth, and needs no shuffle. Identifier columns are dropped.
    """
    if drop is None:
        drop = [f.name for f in df.schema.fields if feature_type(f.name, f.dataType, target) == "Identifier"]
    is_test = split_bucket(F.col(key), seed) < int(65536 * test_share)
    split = df.withColumn("split", F.when(is_test, "test").otherwise("train"))
    return split.drop(*[c for c in drop if c != target])
