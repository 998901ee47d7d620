"""Encoding plans, encoders, scaler and feature pruning.

Fitted state is a small table (categories, means); applying it is a
projection or a join, so the same state serves training and scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.functions.quantiles import quantile_row
from millrace.functions.ranking import sorted_codes
from millrace.operators.checks import is_null
from millrace.operators.correlate import correlated_columns
from millrace.operators.features import feature_type
from millrace.operators.rows import rows_of, union_all

# Strategy names, limits and the default ordinal columns.
NO_ENCODING, ONE_HOT, ORDINAL = "No Encoding", "OneHot Encoding", "Ordinal Encoding"
SKIPPED = "Skipped (High Cardinality)"
ORDINAL_COLUMNS = ["rider_experience_level", "restaurant_quality_tier"]
MAX_CATEGORIES, MAX_CATEGORY_SHARE = 100, 0.10
AUTO_ONE_HOT_LIMIT = 10
NULL_CATEGORY = "nan"


def category(c: Column) -> Column:
    """Category text; null is a category of its own."""
    return F.coalesce(c.cast("string"), F.lit(NULL_CATEGORY))


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, categories, rows): distinct values, null included.

    Counting by (column, value) first keeps a frequent value to one row per task.
    """
    slim = df.select(*[category(F.col(c)).alias(c) for c in columns])
    counted = slim.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("value").alias("n"))
    return counted.groupBy("column").agg(F.count(F.lit(1)).alias("categories"), F.sum("n").alias("rows"))


def encoding_plan(
    df: DataFrame, target: str | None = None, ordinal: list[str] = ORDINAL_COLUMNS
) -> DataFrame:
    """(column, feature_type, strategy) from names, types and cardinality."""
    kinds = {f.name: feature_type(f.name, f.dataType, target) for f in df.schema.fields}
    fixed = [F.struct(F.lit(n).alias("column"), F.lit(k).alias("feature_type")) for n, k in kinds.items()]
    base = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*fixed)))
    nominal = [n for n, k in kinds.items() if k == "Categorical" and n.lower() not in ordinal]
    categorical = F.col("feature_type") == "Categorical"
    if not nominal:
        return base.withColumn("strategy", F.when(categorical, ORDINAL).otherwise(NO_ENCODING))
    many = (F.col("categories") > MAX_CATEGORIES) | (F.col("categories") / F.col("rows") > MAX_CATEGORY_SHARE)
    strategy = (
        F.when(~categorical, NO_ENCODING)
        .when(F.lower("column").isin(ordinal), ORDINAL)
        .when(many, SKIPPED)
        .otherwise(ONE_HOT)
    )
    # One row per column of the schema on both sides.
    sizes = F.broadcast(cardinality(df, nominal))
    return base.join(sizes, "column", "left").select("column", "feature_type", strategy.alias("strategy"))


def encoding_plan_auto(df: DataFrame) -> DataFrame:
    """(column, feature_type, strategy): numbers as they are, few categories one-hot, more ordinal."""
    numeric = [f.name for f in df.schema.fields if ty.is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType)]
    texts = [c for c in df.columns if c not in numeric]
    parts = []
    if numeric:
        rows = [F.struct(F.lit(c).alias("column"), F.lit("Numerical").alias("feature_type")) for c in numeric]
        plain = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
        parts.append(plain.withColumn("strategy", F.lit(NO_ENCODING)))
    if texts:
        few = F.when(F.col("categories") <= AUTO_ONE_HOT_LIMIT, ONE_HOT).otherwise(ORDINAL)
        parts.append(
            cardinality(df, texts).select("column", F.lit("Categorical").alias("feature_type"), few.alias("strategy"))
        )
    return union_all(parts)


def categories_of(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """Sorted categories of a column that the plan found to have few of them."""
    found = df.select(category(F.col(column)).alias("v")).distinct().orderBy("v").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories; use an ordinal encoding")
    return [r["v"] for r in found]


def few_categories(df: DataFrame, columns: list[str], most: int = AUTO_ONE_HOT_LIMIT) -> dict[str, list[str] | None]:
    """Sorted categories of each column, null included; None where there are more than ``most``.

    One job for all columns: values are counted once, and only the first few of
    each column leave a task.
    """
    if not columns:
        return {}
    slim = df.select(*[category(F.col(c)).alias(c) for c in columns])
    values = slim.unpivot([], columns, "column", "value").distinct()
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in values.withColumn("place", place).where(F.col("place") <= most + 1).collect():
        found[r["column"]].append(r["value"])
    return {c: sorted(v, key=str.encode) if len(v) <= most else None for c, v in found.items()}


def one_hot(df: DataFrame, fitted: dict[str, list[str]]) -> DataFrame:
    """Replace each column by 0/1 columns ``column_value``; unknown values give all zeros."""
    kept = [F.col(c) for c in df.columns if c not in fitted]
    flags = [
        F.when(category(F.col(c)) == v, 1).otherwise(0).alias(f"{c}_{v}") for c, values in fitted.items() for v in values
    ]
    return df.select(*kept, *flags)


def ordinal_fit(df: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """(category, code) in sorted order, and whether the table is small enough to broadcast."""
    codes, small = sorted_codes(df.select(category(F.col(column)).alias("category")), "category")
    return codes, small


def ordinal_encode(df: DataFrame, column: str, codes: DataFrame, small: bool) -> DataFrame:
    """Replace a column by its category index; unknown categories give -1."""
    table = codes.select(F.col("category").alias("known"), "code")
    table = F.broadcast(table) if small else table
    joined = df.join(table, category(F.col(column)) == F.col("known"), "left")
    return joined.withColumn(column, F.coalesce("code", F.lit(-1)).cast("bigint")).select(*df.columns)


# --------------------------------------------------------------------- scaling


def scaler_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) with the population sigma over non-null values."""
    aggregates, structs = [], []
    for i, name in enumerate(columns):
        number = V.to_number(F.col(name), ty.dtype_of(df, name))
        aggregates += [F.avg(number).alias(f"m{i}"), F.stddev_pop(number).alias(f"s{i}")]
        structs.append(
            F.struct(F.lit(name).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        )
    return rows_of(df.agg(*aggregates), structs)


def scaled(c: Column, mean: Column, std: Column) -> Column:
    """A column without spread is only centred."""
    return (c.cast("double") - mean) / F.when(std > 0, std).otherwise(1.0)


def standard_scale(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """z-score of the given columns; other columns pass through."""
    stats = scaler_fit(df, columns) if stats is None else stats
    pick = lambda c, what: F.max(F.when(F.col("column") == c, F.col(what)))
    row = stats.agg(
        *[pick(c, "mean").alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[pick(c, "std").alias(f"std_{i}") for i, c in enumerate(columns)],
    )
    wide = df.crossJoin(F.broadcast(row))  # one row
    index = {c: i for i, c in enumerate(columns)}
    return wide.select(
        *[
            scaled(F.col(c), F.col(f"mean_{index[c]}"), F.col(f"std_{index[c]}")).alias(c) if c in index else F.col(c)
            for c in df.columns
        ]
    )


def impute_median_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns by their exact median."""
    chosen = columns or ty.numeric_columns(df)
    medians = quantile_row(df, {f"median_{i}": (c, 0.5) for i, c in enumerate(chosen)})
    wide = df.crossJoin(F.broadcast(medians))  # one row
    index = {c: i for i, c in enumerate(chosen)}
    return wide.select(
        *[
            F.coalesce(
                F.when(~is_null(df, c), F.col(c).cast("double")), F.col(f"median_{index[c]}"), F.lit(0.0)
            ).alias(c)
            if c in index
            else F.col(c)
            for c in df.columns
        ]
    )


# --------------------------------------------------------------------- pruning


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, is_constant): at most one distinct value, null being a value."""
    chosen = columns or ty.numeric_columns(df)
    aggregates, structs = [], []
    for i, name in enumerate(chosen):
        c = F.col(name)
        filled = F.count_if(~is_null(df, name))
        varied = (F.min(c) < F.max(c)) | ((filled > 0) & (filled < F.count(F.lit(1))))
        aggregates.append(F.coalesce(varied, F.lit(False)).alias(f"v{i}"))
        structs.append(F.struct(F.lit(name).alias("column"), (~F.col(f"v{i}")).alias("is_constant")))
    return rows_of(df.agg(*aggregates), structs)


def drop_constant(df: DataFrame) -> DataFrame:
    """Numeric columns that vary."""
    numeric = ty.numeric_columns(df)
    constant = {r["column"] for r in constant_columns(df, numeric).where("is_constant").collect()}
    return df.select(*[c for c in numeric if c not in constant])


def drop_correlated(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Numeric columns that are not too close to an earlier one."""
    numeric = ty.numeric_columns(df)
    close = {r["column"] for r in correlated_columns(df, numeric, threshold).collect()}
    return df.select(*[c for c in numeric if c not in close])


def align_features(
    df: DataFrame, features: list[str], medians: dict[str, float] | None = None, strict: bool = False
) -> DataFrame:
    """Exactly the wanted columns in order; absent ones are filled, others dropped.

    ``strict`` raises on any difference, as the check of raw input does.
    """
    missing = [c for c in features if c not in df.columns]
    extra = [c for c in df.columns if c not in features]
    if strict and (missing or extra):
        raise ValueError(f"input schema differs from training: missing {missing}, extra {extra}")
    stored = medians or {}
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(float(stored.get(c, 0.0))).alias(c) for c in features]
    )


def align_width(vector: Column, width: int) -> Column:
    """An array of numbers padded with zeros, or cut, to ``width``."""
    padded = F.concat(vector, F.array_repeat(F.lit(0.0), width))
    return F.slice(padded, 1, width)


# --------------------------------------------------------------------- datetime


def datetime_columns(df: DataFrame, share: float = 0.5) -> list[str]:
    """Timestamp columns, and text columns that mostly parse as timestamps."""
    moments = [f.name for f in df.schema.fields if ty.is_moment(f.dataType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        parsed = [F.count(V.parse_timestamp(F.col(c), T.StringType())).alias(f"p{i}") for i, c in enumerate(texts)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *parsed).first()
        moments += [c for i, c in enumerate(texts) if row["rows"] and row[f"p{i}"] / row["rows"] > share]
    return [c for c in df.columns if c in moments]


def datetime_expand(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace timestamps by epoch, hour, minute, dayofweek (Monday 0) and is_weekend.

    A missing timestamp gives epoch 0, -1 for the parts and 0 for the flag.
    """
    derived = []
    for name in columns:
        ts = V.parse_timestamp(F.col(name), ty.dtype_of(df, name))
        day = F.weekday(ts)
        derived += [
            F.coalesce(F.unix_timestamp(ts), F.lit(0)).cast("bigint").alias(f"{name}_epoch"),
            F.coalesce(F.hour(ts), F.lit(-1)).alias(f"{name}_hour"),
            F.coalesce(F.minute(ts), F.lit(-1)).alias(f"{name}_minute"),
            F.coalesce(day, F.lit(-1)).alias(f"{name}_dayofweek"),
            F.coalesce((day >= 5).cast("int"), F.lit(0)).alias(f"{name}_is_weekend"),
        ]
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, *derived)
