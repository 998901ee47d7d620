"""Exploratory summaries as result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import numeric as N
from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.functions.quantiles import BROADCAST_ROWS, attach, exact_quantiles, melt_numbers
from millrace.functions.ranking import is_small
from millrace.operators.checks import duplicate_rows, is_null
from millrace.operators.correlate import correlation_matrix
from millrace.operators.profile import value_counts
from millrace.operators.rows import rows_of, union_all
from millrace.session import durable_checkpoint

# Bands and limits of the report.
STRENGTH_BANDS = [(0.80, "Very Strong"), (0.60, "Strong"), (0.40, "Moderate"), (0.20, "Weak")]
WEAKEST = "Very Weak"
SYMMETRIC_BELOW = 0.5
DISCRETE_BELOW = 15
WHISKER = 1.5
MISSING = "Missing"


def eda_columns(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, column, dtype, unique_values, missing, missing_pct) for every scalar column."""
    columns = ty.scalar_columns(df)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    structs = []
    for i, name in enumerate(columns):
        aggregates.append(F.count_if(is_null(df, name)).alias(f"n{i}"))
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(ty.dtype_of(df, name).simpleString()).alias("dtype"),
                F.col(f"n{i}").alias("missing"),
                F.col("rows"),
            )
        )
    base = rows_of(df.agg(*aggregates), structs)
    distinct = value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    # One row per column on both sides.
    return base.join(F.broadcast(distinct), "column", "left").select(
        F.lit(dataset).alias("dataset"),
        "column",
        "dtype",
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        "missing",
        F.round(F.coalesce(F.try_divide("missing", "rows"), F.lit(0.0)) * 100, 2).alias("missing_pct"),
    )


def eda_quality(df: DataFrame, dataset: str) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows and completeness."""
    missing = sum((F.count_if(is_null(df, c)) for c in df.columns), F.lit(0)).cast("bigint")
    width = len(df.columns)
    cells = F.col("row_count") * width
    complete = F.coalesce(F.try_divide(cells - F.col("missing"), cells), F.lit(0.0)) * 100
    return (
        duplicate_rows(df)
        .crossJoin(F.broadcast(df.agg(missing.alias("missing"))))  # one row each
        .select(
            F.lit(dataset).alias("dataset"),
            "row_count",
            F.lit(width).cast("bigint").alias("column_count"),
            "missing",
            "duplicate_rows",
            F.round(complete, 2).alias("completeness_pct"),
        )
    )


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    aggregates, structs = [], []
    measures = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "variance": F.var_samp,
        "min": F.min,
        "max": F.max,
        "skewness": N.skew_corrected,
        "kurtosis": N.kurtosis_corrected,
    }
    for i, name in enumerate(columns):
        number = V.to_number(F.col(name), ty.dtype_of(df, name))
        aggregates += [fn(number).alias(f"{what}{i}") for what, fn in measures.items()]
        structs.append(
            F.struct(F.lit(name).alias("column"), *[F.col(f"{what}{i}").alias(what) for what in measures])
        )
    return rows_of(df.agg(*aggregates), structs)


def _quartiles(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("quantile")))
    return (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75], by)
        .groupBy(*by, "column")
        .agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
    )


def describe_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, variance, min, quartiles, max, skewness and kurtosis per numeric column."""
    chosen = columns or ty.numeric_columns(df)
    return _moments(df, chosen).join(F.broadcast(_quartiles(df, chosen)), "column", "left")


def univariate_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """describe_stats plus the direction of skew and a flag for few distinct values."""
    chosen = columns or ty.numeric_columns(df)
    distinct = value_counts(df, chosen).groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    skew = F.col("skewness")
    direction = (
        F.when(F.abs(skew) < SYMMETRIC_BELOW, "symmetric").when(skew > SYMMETRIC_BELOW, "positive").otherwise("negative")
    )
    return (
        describe_stats(df, chosen)
        .join(F.broadcast(distinct), "column", "left")
        .select(
            "column",
            "min",
            "max",
            "mean",
            "median",
            "std",
            "skewness",
            "kurtosis",
            direction.alias("skew_direction"),
            (F.coalesce("unique_values", F.lit(0)) < DISCRETE_BELOW).alias("is_discrete"),
        )
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """(column, bin, low, high, rows) for equal-width bins; the maximum falls into the last bin.

    Empty bins are included. A constant column gets a range of one around its value.
    """
    long = melt_numbers(df, columns)
    spans = long.groupBy("column").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    flat = F.col("least") == F.col("most")
    spans = spans.select(
        "column",
        F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("least"),
        F.when(flat, F.col("most") + 0.5).otherwise(F.col("most")).alias("most"),
    )
    small = F.broadcast(spans)  # one row per column
    place = F.floor((F.col("value") - F.col("least")) * bins / (F.col("most") - F.col("least")))
    filled = (
        long.join(small, "column")
        .groupBy("column", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    width = (F.col("most") - F.col("least")) / bins
    frame = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(F.broadcast(filled), ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("least") + F.col("bin") * width).alias("low"),
        (F.col("least") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def box_summary(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and outlier count, overall or per category."""
    keys = [by] if by else []
    boxes = _quartiles(df, [value], keys)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    boxes = boxes.withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})
    small = True
    if by:
        boxes = durable_checkpoint(boxes)
        small = is_small(boxes, BROADCAST_ROWS)
    joined = attach(melt_numbers(df, [value], keys), boxes, [*keys, "column"], small)
    inside = F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("rows"),
    )


def frequency_table(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column, value, rows, pct): the most frequent values, null shown as Missing."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in columns]
    # One scan and one shuffle for all columns; the rank limit acts in every task.
    counted = df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("rows"), "value"))
    best = counted.withColumn("place", place).where(F.col("place") <= top).drop("place")
    pct = F.round(F.col("rows") / F.col("total") * 100, 2)
    return best.crossJoin(F.broadcast(total)).select("column", "value", "rows", pct.alias("pct"))


def calendar_columns(df: DataFrame, timestamp: str) -> DataFrame:
    ts = V.parse_timestamp(F.col(timestamp), ty.dtype_of(df, timestamp))
    return df.withColumns(
        {"hour": F.hour(ts), "day_of_week": F.date_format(ts, "EEEE"), "month_name": F.date_format(ts, "MMMM")}
    )


def strength_band(r: Column) -> Column:
    chain = F
    for floor, label in STRENGTH_BANDS:
        chain = chain.when(r >= floor, label)
    return chain.otherwise(WEAKEST)


def correlation_strength(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """(feature, correlation, relationship): absolute correlation with the target."""
    chosen = columns or ty.numeric_columns(df)
    matrix = correlation_matrix(df, chosen).where(F.col("y") == target)
    strength = F.abs("r")
    return matrix.select(
        F.col("x").alias("feature"), strength.alias("correlation"), strength_band(strength).alias("relationship")
    )


def group_mean(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(dimension, member, rows, mean) for several groupings in one pass."""
    number = V.to_number(F.col(value), ty.dtype_of(df, value)).alias("measure")
    slim = df.select(number, *[F.col(k).cast("string").alias(k) for k in keys])
    long = slim.unpivot(["measure"], keys, "dimension", "member").where("member IS NOT NULL")
    return long.groupBy("dimension", "member").agg(F.count("measure").alias("rows"), F.avg("measure").alias("mean"))


def pivot_mean(df: DataFrame, value: str, row: str, column: str, members: list) -> DataFrame:
    """Mean of ``value`` with one column per listed member of ``column``."""
    return df.groupBy(row).pivot(column, members).agg(F.avg(value))


def top_k(df: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """The k largest rows; every task keeps only its own k."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value), key).limit(k)


def peak_groups(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(dimension, highest, highest_mean, lowest, lowest_mean); ties go to the smaller member."""
    means = group_mean(df, value, keys).where("mean IS NOT NULL")
    highest = F.min(F.struct((-F.col("mean")).alias("rank"), "member", "mean"))
    lowest = F.min(F.struct("mean", "member"))
    return (
        means.groupBy("dimension")
        .agg(highest.alias("highest"), lowest.alias("lowest"))
        .select(
            "dimension",
            F.col("highest.member").alias("highest"),
            F.col("highest.mean").alias("highest_mean"),
            F.col("lowest.member").alias("lowest"),
            F.col("lowest.mean").alias("lowest_mean"),
        )
    )


def strongest_predictor(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """One row (feature, correlation) with the largest absolute correlation."""
    strengths = correlation_strength(df, target, columns).where("correlation IS NOT NULL")
    return strengths.orderBy(F.desc("correlation"), "feature").limit(1).select("feature", "correlation")


def insight_table(df: DataFrame, value: str, keys: list[str], predictors: list[str]) -> DataFrame:
    """(question, answer): central values, peak groups and the strongest predictor."""
    number = V.to_number(F.col(value), ty.dtype_of(df, value))
    shown = lambda c: F.format_string("%.2f", c)
    plain = df.agg(F.avg(number).alias("mean"), F.min(number).alias("min"), F.max(number).alias("max"))
    basics = plain.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f"{what} {value}").alias("question"), shown(F.col(what)).alias("answer"))
                    for what in ("mean", "min", "max")
                ]
            )
        )
    )
    median = exact_quantiles(df, [value], [0.5]).select(
        F.lit(f"median {value}").alias("question"), shown(F.col("quantile")).alias("answer")
    )
    peaks = peak_groups(df, value, keys).select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("highest "), "dimension").alias("question"), F.col("highest").alias("answer")),
                F.struct(F.concat(F.lit("lowest "), "dimension").alias("question"), F.col("lowest").alias("answer")),
            )
        )
    )
    best = strongest_predictor(df, value, [value, *predictors]).select(
        F.lit("strongest predictor").alias("question"), F.col("feature").alias("answer")
    )
    return union_all([basics, median, peaks, best])


