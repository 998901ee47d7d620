"""Comparing a table before and after cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.operators.checks import is_null
from millrace.operators.rows import union_all


def _by_id(df: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """One row per id (null is one of them) with the compared columns as text; equal ids keep the smallest row."""
    plain = {c: ty.comparable(F.col(c), ty.dtype_of(df, c)) for c in columns}
    texts = [F.when(~is_null(df, c), plain[c].cast("string")).alias(c) for c in columns]
    slim = df.select(V.normalize_key(F.col(key), ty.dtype_of(df, key)).alias("record_id"), *texts)
    return slim.groupBy("record_id").agg(F.min(F.struct(*columns)).alias(prefix))


def _canonical(c: Column) -> Column:
    """Text of a cell with surrounding blanks and a trailing ``.0`` removed."""
    return F.regexp_replace(V.strip(c), r"\.0$", "")


def change_type(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull() & after.isNotNull(), "imputed")
        .when(before.isNotNull() & after.isNull(), "nullified")
        .when(before.endswith(".0") & ~after.contains("."), "id_float_to_int")
        .when(before.contains("/") & after.contains("-"), "timestamp_format")
        .otherwise("changed")
    )


def cell_diff(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """(record_id, column, before, after, change_type) of every changed cell, nested cells included."""
    columns = [c for c in raw.columns if c in cleaned.columns and c != key]
    old = _by_id(raw, key, columns, "old")
    new = _by_id(cleaned, key, columns, "new").withColumnRenamed("record_id", "other_id")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col("old")[c].alias("before"), F.col("new")[c].alias("after"))
            for c in columns
        ]
    )
    before, after = F.col("cell.before"), F.col("cell.after")
    return (
        old.join(new, old["record_id"].eqNullSafe(new["other_id"]))
        .select("record_id", F.explode(cells).alias("cell"))
        .where(~_canonical(before).eqNullSafe(_canonical(after)))
        .select(
            "record_id",
            "cell.column",
            before.alias("before"),
            after.alias("after"),
            change_type(before, after).alias("change_type"),
        )
    )


def diff_summary(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """One row: rows before, after and removed, changed cells, repaired and nullified rows."""
    changes = cell_diff(raw, cleaned, key)
    per_row = changes.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.bool_or(F.col("after").isNotNull()).alias("repaired"),
        F.bool_or(F.col("after").isNull()).alias("nullified"),
    )
    totals = per_row.agg(
        F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"),
        F.count_if("repaired").alias("rows_repaired"),
        F.count_if("nullified").alias("rows_nullified"),
    )
    sizes = raw.agg(F.count(F.lit(1)).alias("rows_before")).crossJoin(
        F.broadcast(cleaned.agg(F.count(F.lit(1)).alias("rows_after")))  # one row each
    )
    removed = F.col("rows_before") - F.col("rows_after")
    return sizes.crossJoin(F.broadcast(totals)).select(
        "rows_before",
        "rows_after",
        removed.alias("rows_removed"),
        (F.col("cells") + removed * len(raw.columns)).alias("cells_changed"),
        "rows_repaired",
        "rows_nullified",
    )


def table_health(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, row_count, null_cells, duplicate_rows)."""
    from millrace.operators.checks import duplicate_rows

    nulls = sum((F.count_if(is_null(df, c)) for c in df.columns), F.lit(0))
    one = df.agg(nulls.cast("bigint").alias("null_cells"))
    return (
        duplicate_rows(df)
        .crossJoin(F.broadcast(one))  # one row each
        .select(F.lit(dataset).alias("dataset"), "row_count", "null_cells", "duplicate_rows")
    )


def quality_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dataset, validator, score_before, score_after, delta) from two suite results."""
    key = ["dataset", "validator"]
    old = before.select(*key, F.col("score").alias("score_before"), F.col("violations").alias("violations_before"))
    new = after.select(*key, F.col("score").alias("score_after"), F.col("violations").alias("violations_after"))
    return old.join(F.broadcast(new), key, "left").withColumn("delta", F.col("score_after") - F.col("score_before"))


def tables_before_after(raw: dict[str, DataFrame], cleaned: dict[str, DataFrame]) -> DataFrame:
    """Rows, null cells and duplicates of every table, before and after."""
    old = union_all([table_health(raw[n], n) for n in cleaned])
    new = union_all([table_health(cleaned[n], n) for n in cleaned])
    names = ["row_count", "null_cells", "duplicate_rows"]
    old = old.select("dataset", *[F.col(c).alias(f"{c}_before") for c in names])
    new = new.select("dataset", *[F.col(c).alias(f"{c}_after") for c in names])
    return old.join(F.broadcast(new), "dataset")


