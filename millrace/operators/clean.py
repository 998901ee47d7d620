"""Cleaning operators.

Constants taken from the data (median, mode, mean, sigma) are one-row tables
joined by broadcast, so every operator stays lazy; ``plans.cleaning`` resolves
them to literals when many operators follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import names
from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.functions.quantiles import quantile_row
from millrace.functions.ranking import all_salts, is_small, sorted_codes, task_salt
from millrace.operators.checks import LATITUDE_RANGE, LONGITUDE_RANGE, is_null, paired_keys, parent_keys
from millrace.operators.profile import value_counts
from millrace.operators.rows import rows_of

BROADCAST_KEYS = 1_000_000
MISSING_TEXT = "Unknown"
# Words that mark a column as an identifier.
IDENTIFIER_WORDS = ["id", "restaurant", "rider", "customer", "order"]
SIGMAS = 3
STANDARDIZED_SLACK = 0.1


def _with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row table to every row."""
    return df.crossJoin(F.broadcast(one_row))


def drop_duplicates(df: DataFrame, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Remove copies: whole rows, nested cells included, or all but the first row of a key in the given order.

    The first row is a minimum over (order, row), so it is found with partial
    aggregation and a repeated key never fills one task. Nulls come last, so a
    row with missing cells does not win over a full one.
    """
    if not key:
        maps = {c: f"__{i}" for i, c in enumerate(df.columns) if ty.holds_map(ty.dtype_of(df, c))}
        wide = df.withColumns({t: ty.comparable(F.col(c), ty.dtype_of(df, c)) for c, t in maps.items()})
        return wide.dropDuplicates([maps.get(c, c) for c in df.columns]).drop(*maps.values())
    rest = [c for c in df.columns if c not in key]
    lead = [c for c in (order or []) if c in rest]
    body = [*lead, *[c for c in rest if c not in lead]]
    if not body:
        return df.dropDuplicates(key)
    cells = [
        F.struct(F.col(c).isNull().alias("absent"), ty.comparable(F.col(c), ty.dtype_of(df, c)).alias("value")).alias(f"c{i}")
        for i, c in enumerate(body)
    ]
    nested = [c for c in body if ty.holds_map(ty.dtype_of(df, c))]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*body), F.struct(*cells)).alias("first")) if nested else df.groupBy(*key).agg(
        F.min(F.struct(*cells)).alias("first")
    )
    if nested:
        return first.select(*[F.col(c) if c in key else F.col("first")[c].alias(c) for c in df.columns])
    return first.select(*[F.col(c) if c in key else F.col("first")[f"c{body.index(c)}"]["value"].alias(c) for c in df.columns])


# ----------------------------------------------------------------- imputation


def fill_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``fill_<column>``: median, or the most frequent value (smallest on ties)."""
    numeric = [c for c in columns if ty.is_numeric(ty.dtype_of(df, c))]
    other = [c for c in columns if c not in numeric]
    frames = []
    if numeric:
        medians = quantile_row(df, {c: (c, 0.5) for c in numeric})
        frames.append(
            medians.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(f"fill_{c}") for c in numeric])
        )
    if other:
        modes = (
            value_counts(df, other)
            .groupBy("column")
            .agg(F.min(F.struct((-F.col("copies")).alias("rank"), F.col("value"))).alias("top"))
        )
        picks = []
        for c in other:
            mode = F.max(F.when(F.col("column") == c, F.col("top.value")))
            if isinstance(ty.dtype_of(df, c), T.BooleanType):
                picks.append(F.coalesce(mode.try_cast("boolean"), F.lit(False)).alias(f"fill_{c}"))
            else:
                picks.append(F.coalesce(mode, F.lit(MISSING_TEXT)).alias(f"fill_{c}"))
        frames.append(modes.agg(*picks))
    row = frames[0]
    for frame in frames[1:]:
        row = row.crossJoin(F.broadcast(frame))  # one row each
    return row


def apply_fill(df: DataFrame, column: str, value) -> DataFrame:
    """Nulls of a column replaced by a plain value.

    Integers stay exact integers where there is nothing to fill or the value is
    whole; a fractional value makes the column double.
    """
    dtype = ty.dtype_of(df, column)
    present = F.when(~is_null(df, column), F.col(column))
    if ty.is_integral(dtype) and isinstance(value, float):
        if value.is_integer():
            return df.withColumn(column, F.coalesce(present, F.lit(int(value)).cast(dtype)))
        if df.where(is_null(df, column)).isEmpty():
            return df
        return df.withColumn(column, F.coalesce(present.cast("double"), F.lit(value)))
    if isinstance(dtype, (T.StringType, T.BooleanType)) or ty.is_numeric(dtype):
        return df.withColumn(column, F.coalesce(present, F.lit(value).cast(dtype)))
    return df.withColumn(column, F.coalesce(present, F.lit(value).try_cast(dtype)))


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls: numbers by the median, text and booleans by the most frequent value. Columns without nulls stay as they are."""
    row = fill_values(df, columns).first()
    for c in columns:
        df = apply_fill(df, c, row[f"fill_{c}"])
    return df


# ---------------------------------------------------------------------- types


def converted(c: Column, dtype: T.DataType, target: str) -> Column:
    if "int" in target:
        return F.rint(V.to_number(c, dtype)).try_cast("bigint")
    if target in ("float", "double"):
        return V.to_number(c, dtype)
    if target.startswith(("date", "time")):
        return V.parse_timestamp(c, dtype)
    if target.startswith("bool"):
        return V.to_boolean(c)
    return c.cast("string")


def fix_datatype(df: DataFrame, column: str, target: str) -> DataFrame:
    """Convert to integer, float, datetime, boolean or string; unreadable values become null."""
    return df.withColumn(column, converted(F.col(column), ty.dtype_of(df, column), target.lower()))


def standardize_timestamp(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, V.format_timestamp(F.col(column), ty.dtype_of(df, column)))


def timestamp_parse_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, parsed, failed) in one scan."""
    aggregates, structs = [F.count(F.lit(1)).alias("rows")], []
    for i, name in enumerate(columns):
        parsed = V.parse_timestamp(F.col(name), ty.dtype_of(df, name))
        aggregates += [
            F.count(parsed).alias(f"ok{i}"),
            F.count_if(F.col(name).isNotNull() & parsed.isNull()).alias(f"bad{i}"),
        ]
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col("rows"),
                F.col(f"ok{i}").alias("parsed"),
                F.col(f"bad{i}").alias("failed"),
            )
        )
    return rows_of(df.agg(*aggregates), structs)


# ---------------------------------------------------------------- coordinates


def _in_range(df: DataFrame, column: str, axis: str) -> Column:
    low, high = LATITUDE_RANGE if axis == "latitude" else LONGITUDE_RANGE
    return V.to_number(F.col(column), ty.dtype_of(df, column)).between(low, high)


def gps_nullify(df: DataFrame, column: str, axis: str = "latitude") -> DataFrame:
    return df.withColumn(column, F.when(_in_range(df, column, axis), F.col(column)))


def gps_drop(df: DataFrame, column: str, axis: str = "latitude") -> DataFrame:
    return df.where(F.col(column).isNull() | _in_range(df, column, axis))


# --------------------------------------------------------------- foreign keys


def _marked(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> tuple[DataFrame, Column, Column]:
    """Rows joined to the distinct parent keys.

    Keys are broadcast when counting them showed few. Otherwise child rows are
    salted and every salt gets the keys, so a key, or null, with a large share
    of the rows fills many tasks.
    """
    key, parent_key = paired_keys(df, column, parent, parent_column)
    keys = parent_keys(parent, parent_key)
    child = df.withColumn("child_key", key)
    if is_small(keys, BROADCAST_KEYS):
        joined = child.join(F.broadcast(keys), F.col("child_key") == F.col("parent_key"), "left")
    else:
        copies = keys.withColumn("parent_salt", all_salts())
        same = (F.col("child_key") == F.col("parent_key")) & (F.col("child_salt") == F.col("parent_salt"))
        joined = child.withColumn("child_salt", task_salt()).join(copies, same, "left")
    return joined, F.col("child_key"), F.col("child_key").isNotNull() & F.col("parent_key").isNull()


def fk_repair(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Normalise the key and drop rows whose key has no parent; null keys stay."""
    joined, key, orphan = _marked(df, column, parent, parent_column)
    return joined.where(~orphan).withColumn(column, key).select(*df.columns)


def fk_flag(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Normalise the key and add ``<column>_is_orphan``."""
    joined, key, orphan = _marked(df, column, parent, parent_column)
    return (
        joined.withColumn(f"{column}_is_orphan", orphan)
        .withColumn(column, key)
        .select(*df.columns, f"{column}_is_orphan")
    )


# ----------------------------------------------------------------------- text


def trim_whitespace(df: DataFrame, column: str) -> DataFrame:
    if not isinstance(ty.dtype_of(df, column), T.StringType):
        return df
    return df.withColumn(column, V.strip(F.col(column)))


def format_string(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, V.strip(F.col(column)))


# -------------------------------------------------------------------- outliers


def is_identifier_name(column: str) -> bool:
    low = column.lower()
    return low in IDENTIFIER_WORDS or low.endswith("_id") or any(f"{w}_id" in low for w in IDENTIFIER_WORDS)


def is_positive_only(column: str) -> bool:
    import re

    return re.search(names.POSITIVE_ONLY, column.lower()) is not None


def moments(df: DataFrame, column: str) -> DataFrame:
    number = V.to_number(F.col(column), ty.dtype_of(df, column))
    return df.agg(
        F.avg(number).alias("mean_value"), F.stddev_samp(number).alias("std_value"), F.count(F.lit(1)).alias("rows")
    )


def outlier_condition(number: Column, mean: Column, std: Column, positive_only: bool) -> Column:
    """Rows to keep: within three sigma, and not negative where negatives make no sense.

    A column that already looks standardised may be negative. Null values fail
    a bound, so they fall out as soon as one applies.
    """
    spread = F.coalesce(std > 0, F.lit(False))
    bounded = number.between(mean - SIGMAS * std, mean + SIGMAS * std)
    keep = ~spread | F.coalesce(bounded, F.lit(False))
    if positive_only:
        standardized = spread & (F.abs(mean) < STANDARDIZED_SLACK) & (F.abs(std - 1) < STANDARDIZED_SLACK)
        keep = keep & (standardized | F.coalesce(number >= 0, F.lit(False)))
    return keep


def remove_outliers(df: DataFrame, column: str, positive_only: bool | None = None) -> DataFrame:
    if is_identifier_name(column):
        return df
    positive = is_positive_only(column) if positive_only is None else positive_only
    number = V.to_number(F.col(column), ty.dtype_of(df, column))
    keep = outlier_condition(number, F.col("mean_value"), F.col("std_value"), positive)
    return _with_row(df, moments(df, column).drop("rows")).where(keep).select(*df.columns)


# --------------------------------------------------------------------- scaling


def standardize_column(df: DataFrame, column: str) -> DataFrame:
    """z-score with the sample sigma; unchanged when the column does not vary."""
    number = V.to_number(F.col(column), ty.dtype_of(df, column))
    scaled = F.when(F.col("std_value") > 0, (number - F.col("mean_value")) / F.col("std_value")).otherwise(number)
    return _with_row(df, moments(df, column).drop("rows")).withColumn(column, scaled).select(*df.columns)


def minmax_column(df: DataFrame, column: str) -> DataFrame:
    number = V.to_number(F.col(column), ty.dtype_of(df, column))
    span = df.agg(F.min(number).alias("low_value"), F.max(number).alias("high_value"))
    width = F.col("high_value") - F.col("low_value")
    scaled = F.when(width > 0, (number - F.col("low_value")) / width).otherwise(number)
    return _with_row(df, span).withColumn(column, scaled).select(*df.columns)


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Replace values by their position among the sorted distinct values; null is -1."""
    codes, small = sorted_codes(df, column)
    codes = codes.withColumnRenamed(column, "code_value")
    codes = F.broadcast(codes) if small else codes
    joined = df.join(codes, F.col(column) == F.col("code_value"), "left")
    return joined.withColumn(column, F.coalesce("code", F.lit(-1)).cast("bigint")).select(*df.columns)
