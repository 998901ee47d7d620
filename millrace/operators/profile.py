"""Dataset and column profiles over all rows.

Numeric statistics come from one aggregate. Distinct counts, repeats and the
value-based type flags come from (column, value) counts: each column is
counted by value with partial aggregation, so one shuffle per value type
serves all columns and a constant column costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import names
from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.operators.checks import duplicate_rows, is_null
from millrace.operators.rows import batches, literal_table, union_all
from millrace.session import durable_checkpoint

TEXT_LENGTH = 40.0
MATCH_RATIO = 0.8
CATEGORICAL_FLOOR = 50
CATEGORICAL_SHARE = 0.2
HIGH_CARDINALITY_PCT = 50.0
BUCKETS = ["numeric", "categorical", "boolean", "datetime", "text", "high_cardinality"]


def _long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text) of every non-null cell."""
    parts = []
    for group in batches(columns):
        texts = [F.when(~is_null(df, c), F.col(c).cast("string")).alias(c) for c in group]
        parts.append(df.select(*texts).unpivot([], group, "column", "value"))
    return union_all(parts).where("value IS NOT NULL")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value as text, copies) of every non-null value."""
    long = _long_values(df, columns or ty.scalar_columns(df))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("copies"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _null_sql(df: DataFrame, column: str) -> str:
    name = ty.quoted(column)
    if isinstance(ty.dtype_of(df, column), (T.FloatType, T.DoubleType)):
        return f"({name} IS NULL OR isnan({name}))"
    return f"({name} IS NULL)"


def _base_row(df: DataFrame, dataset: str, columns: list[str], start: int) -> DataFrame:
    """One row per column: position, types, rows, nulls and numeric statistics.

    Wide tables make many expressions, so they are handed over as SQL text.
    """
    aggregates, structs = ["count(1) AS rows"], []
    for i, name in enumerate(columns):
        dtype = ty.dtype_of(df, name)
        aggregates.append(f"count_if({_null_sql(df, name)}) AS null{i}")
        stats = ["CAST(NULL AS DOUBLE)"] * 4
        if ty.is_numeric(dtype):
            number = f"nanvl(CAST({ty.quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"
            aggregates += [
                f"min({number}) AS min{i}",
                f"max({number}) AS max{i}",
                f"avg({number}) AS mean{i}",
                f"stddev_samp({number}) AS std{i}",
            ]
            stats = [f"{s}{i}" for s in ("min", "max", "mean", "std")]
        values = {
            "dataset": _literal(dataset),
            "column": _literal(name),
            "position": str(start + i),
            "physical_dtype": _literal(dtype.simpleString()),
            "declared": _literal(ty.logical_name(dtype)),
            "row_count": "rows",
            "null_count": f"null{i}",
            **dict(zip(("min", "max", "mean", "std"), stats)),
        }
        structs.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(structs)}))")


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, 2)


def _text_flags(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per text column: distinct values, boolean words, length, date shapes and parses."""
    value, copies = F.col("value"), F.col("copies")
    shaped = F.lit(False)
    for pattern in names.DATETIME_VALUES:
        shaped = shaped | V.strip(value).rlike(pattern)
    parsed = V.parse_timestamp(value, T.StringType()).isNotNull()
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.count_if(~F.lower(value).isin(names.BOOLEAN_WORDS)).alias("odd_values"),
        F.sum(F.length(value) * copies).alias("length_sum"),
        F.sum(F.when(shaped, copies)).alias("shaped"),
        F.sum(F.when(parsed, copies)).alias("parsed"),
    )


def _plain_flags(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per number or timestamp column: distinct values, and values other than 0 and 1."""
    nothing = F.lit(None).cast("bigint")
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_count"), F.count_if(~F.col("value").isin(0, 1)).alias("odd_values")
    ).select(*keys, "unique_count", "odd_values", *[nothing.alias(c) for c in ("length_sum", "shaped", "parsed")])


def _typed_values(df: DataFrame, dataset: str, columns: list[str], kind: str) -> DataFrame:
    """(dataset, column, value) of every non-null cell, as one Spark type."""
    parts = []
    for group in batches(columns):
        cells = []
        for c in group:
            name = ty.quoted(c)
            cell = f"unix_micros(CAST({name} AS TIMESTAMP))" if ty.is_moment(ty.dtype_of(df, c)) else name
            cells.append(f"CASE WHEN NOT {_null_sql(df, c)} THEN CAST({cell} AS {kind}) END AS {name}")
        parts.append(df.selectExpr(*cells).unpivot([], [ty.quoted(c) for c in group], "column", "value"))
    return union_all(parts).selectExpr(f"{_literal(dataset)} AS dataset", "column", "value").where("value IS NOT NULL")


def _kind(dtype: T.DataType) -> str:
    if ty.is_integral(dtype) or ty.is_moment(dtype):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def profile_tables(tables: dict[str, DataFrame], columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per column of every table with counts, statistics and type flags.

    All tables share the shuffles of (dataset, column, value) counts: one for
    whole numbers and timestamps, one for fractions and one for text, so that
    numbers travel as eight bytes. The result has one row per column and feeds
    many operators, so it is written once to the checkpoint folder.
    """
    bases: list[DataFrame] = []
    values: dict[str, list[DataFrame]] = {"bigint": [], "double": [], "string": []}
    for name, df in tables.items():
        chosen = [c for c in ty.scalar_columns(df) if columns is None or (name, c) in columns]
        start = 0
        for group in batches(chosen):
            bases.append(_base_row(df, name, group, start))
            start += len(group)
        for kind, parts in values.items():
            mine = [c for c in chosen if _kind(ty.dtype_of(df, c)) == kind]
            if mine:
                parts.append(_typed_values(df, name, mine, kind))
    keys = ["dataset", "column"]
    flags = []
    for kind, parts in values.items():
        if parts:
            counts = union_all(parts).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("copies"))
            flags.append(_text_flags(counts, keys) if kind == "string" else _plain_flags(counts, keys))
    # One row per column on both sides.
    joined = union_all(bases).join(F.broadcast(union_all(flags)), keys, "left")
    return durable_checkpoint(_finish_profile(joined).coalesce(1))


def profile_columns(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """The profile of one table."""
    return profile_tables({dataset: df}, None if columns is None else [(dataset, c) for c in columns])


def _finish_profile(joined: DataFrame) -> DataFrame:
    filled = F.col("row_count") - F.col("null_count")
    unique = F.coalesce("unique_count", F.lit(0)).cast("bigint")
    dated = names.matches(F.col("column"), names.TIME) | (
        F.coalesce(F.try_divide("shaped", filled), F.lit(0.0)) >= MATCH_RATIO
    )
    parses = F.coalesce(F.try_divide("parsed", filled), F.lit(0.0)) >= MATCH_RATIO
    is_text_column = F.col("declared") == "string"
    logical = F.when(is_text_column & dated & parses, "datetime").otherwise(F.col("declared"))
    boolean = (F.col("logical_dtype") == "boolean") | (
        unique.between(1, 2) & (F.coalesce("odd_values", F.lit(0)) == 0)
    )
    text = (F.col("logical_dtype") == "string") & (
        F.coalesce(F.try_divide("length_sum", filled), F.lit(0.0)) >= TEXT_LENGTH
    )
    unique_pct = _percent(unique, F.col("row_count"))
    return (
        joined.withColumn("logical_dtype", logical)
        .withColumns({"is_boolean": boolean, "is_text": text, "distinct_values": unique, "unique_pct": unique_pct})
        .select(
            "dataset",
            "column",
            "position",
            "logical_dtype",
            "physical_dtype",
            "row_count",
            "null_count",
            _percent(F.col("null_count"), F.col("row_count")).alias("null_pct"),
            F.col("distinct_values").alias("unique_count"),
            "unique_pct",
            # Nulls are equal to each other, so all but one of them repeat.
            (
                F.col("row_count") - F.col("distinct_values") - F.least(F.col("null_count"), F.lit(1))
            ).alias("duplicate_rows"),
            "min",
            "max",
            "mean",
            "std",
            F.col("logical_dtype").isin("integer", "float").alias("is_numeric"),
            "is_boolean",
            (F.col("logical_dtype") == "datetime").alias("is_datetime"),
            "is_text",
            (
                (F.col("logical_dtype") == "string")
                & ~F.col("is_text")
                & (
                    F.col("distinct_values")
                    <= F.greatest(F.lit(float(CATEGORICAL_FLOOR)), F.col("row_count") * CATEGORICAL_SHARE)
                )
            ).alias("is_categorical"),
            (F.col("unique_pct") >= HIGH_CARDINALITY_PCT).alias("is_high_cardinality"),
        )
    )


def sample_values(df: DataFrame, columns: list[str] | None = None, size: int = 5) -> DataFrame:
    """(column, rank, value): the ``size`` smallest distinct values of each column.

    The rank filter is applied inside every task before the shuffle by column.
    """
    by_column = Window.partitionBy("column").orderBy("value")
    return (
        value_counts(df, columns)
        .select("column", "value", F.row_number().over(by_column).alias("rank"))
        .where(F.col("rank") <= size)
    )


def profile_dataset(df: DataFrame, dataset: str) -> DataFrame:
    """One row: rows, columns and exact duplicate rows."""
    return duplicate_rows(df).select(
        F.lit(dataset).alias("dataset"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.col("duplicate_rows").alias("duplicate_row_count"),
    )


def column_groups(profile: DataFrame) -> DataFrame:
    """(dataset, bucket, columns): names in column order per coarse type bucket."""
    flags = F.array_compact(
        F.array(*[F.when(F.col(f"is_{b}"), F.lit(b)) for b in BUCKETS])
    )
    members = F.array_sort(F.collect_list(F.struct("position", "column")))
    return (
        profile.select("dataset", "position", "column", F.explode(flags).alias("bucket"))
        .groupBy("dataset", "bucket")
        .agg(F.transform(members, lambda m: m["column"]).alias("columns"))
    )


def schema_registry(profile: DataFrame) -> DataFrame:
    return profile.select(
        "dataset",
        "column",
        "logical_dtype",
        "physical_dtype",
        (F.col("null_count") > 0).alias("nullable"),
        "unique_count",
        "row_count",
    )


def schema_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(dataset, column, change, previous, current) between two registry tables.

    Row-count changes carry a null column; only real changes are reported.
    """
    keys = ["dataset", "column"]
    old = previous.select(*keys, F.col("logical_dtype").alias("old"), F.lit(True).alias("was"))
    new = current.select(*keys, F.col("logical_dtype").alias("new"), F.lit(True).alias("now"))
    change = (
        F.when(F.col("was").isNull(), "added_column")
        .when(F.col("now").isNull(), "removed_column")
        .when(~F.col("old").eqNullSafe(F.col("new")), "datatype_change")
    )
    tables = lambda df, name: df.groupBy("dataset").agg(F.max("row_count").alias(name))
    columns = (
        old.join(new, keys, "full_outer")
        .select(*keys, change.alias("change"), F.col("old").alias("previous"), F.col("new").alias("current"))
        .where("change IS NOT NULL")
    )
    sizes = tables(previous, "old").join(tables(current, "new"), "dataset", "full_outer")
    size_change = (
        F.when(F.col("old").isNull(), "added_dataset")
        .when(F.col("new").isNull(), "removed_dataset")
        .when(F.col("old") != F.col("new"), "row_count_change")
    )
    datasets = sizes.select(
        "dataset",
        F.lit(None).cast("string").alias("column"),
        size_change.alias("change"),
        F.col("old").cast("string").alias("previous"),
        F.col("new").cast("string").alias("current"),
    ).where("change IS NOT NULL")
    kept = columns.join(
        F.broadcast(datasets.where("change IN ('added_dataset', 'removed_dataset')").select("dataset")),
        "dataset",
        "left_anti",
    )
    return kept.unionByName(datasets)


def column_roles(profile: DataFrame) -> DataFrame:
    """Profile rows plus ``roles``: every role that applies, in a fixed order."""
    name = F.col("column")
    identifier = names.matches(name, names.IDENTIFIER) | (F.col("unique_pct") / 100 >= 0.95)
    rules = [
        ("identifier", identifier),
        ("timestamp", (names.matches(name, names.TIME) | F.col("is_datetime")) & ~F.col("is_numeric")),
        ("pii", names.matches(name, names.PII)),
        ("metadata", names.matches(name, names.METADATA)),
        ("boolean_feature", F.col("is_boolean")),
        ("numeric_feature", F.col("is_numeric") & ~identifier),
        ("categorical_feature", F.col("is_categorical")),
        ("text", F.col("is_text")),
        ("high_cardinality", F.col("is_high_cardinality") & ~identifier),
        ("potential_target", names.matches(name, names.TARGET) & F.col("is_numeric")),
        ("distractor", (F.col("null_pct") >= 99) | ((F.col("unique_count") <= 1) & (F.col("row_count") > 1))),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(role)) for role, rule in rules]))
    return profile.withColumn("roles", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown"))))


def add_role(roles: DataFrame, hits: DataFrame, role: str) -> DataFrame:
    """Add a role to the columns listed in ``hits`` (dataset, column)."""
    marked = hits.select("dataset", "column").distinct().withColumn("hit", F.lit(True))
    extended = F.array_union(F.array_remove("roles", F.lit("unknown")), F.array(F.lit(role)))
    # The marks hold at most one row per profiled column.
    return (
        roles.join(F.broadcast(marked), ["dataset", "column"], "left")
        .withColumn("roles", F.when(F.col("hit"), extended).otherwise(F.col("roles")))
        .drop("hit")
    )


def literal_fk(spark, columns: list[tuple[str, str]]) -> DataFrame:
    """(dataset, column) of declared foreign keys."""
    return literal_table(spark, columns, "dataset string,column string")


def mark_foreign_keys(roles: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    return add_role(roles, foreign_keys, "foreign_key")


def data_dictionary(roles: DataFrame, advice: DataFrame) -> DataFrame:
    """Column facts next to the feature recommendation."""
    picked = advice.select("dataset", "column", "classification", "recommendation")
    return roles.select(
        "dataset", "column", "logical_dtype", "null_pct", "unique_count", F.array_join("roles", ",").alias("roles")
    ).join(F.broadcast(picked), ["dataset", "column"], "left")


def detect_datetime_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, named, shaped_share, parsed_share, is_datetime) of text columns, over all values."""
    counts = value_counts(df, columns)
    total = counts.groupBy("column").agg(F.sum("copies").alias("filled"))
    # One row per column on both sides.
    joined = _text_flags(counts, ["column"]).join(F.broadcast(total), "column")
    named = names.matches(F.col("column"), names.TIME)
    shaped = F.coalesce("shaped", F.lit(0)) / F.col("filled")
    parsed = F.coalesce("parsed", F.lit(0)) / F.col("filled")
    return joined.select(
        "column",
        named.alias("named"),
        shaped.alias("shaped_share"),
        parsed.alias("parsed_share"),
        ((named | (shaped >= MATCH_RATIO)) & (parsed >= MATCH_RATIO)).alias("is_datetime"),
    )
