"""Turning one aggregated row into a small result table, and the reverse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE_BATCH = 200


def rows_of(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    """Explode structs built from a one-row aggregate into one row each."""
    return one_row.select(F.inline(F.array(*structs)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def batches(items: list, size: int = WIDE_BATCH) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def literal_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table held in the plan itself, so that no task reads Python data."""
    fields = [part.split() for part in schema.split(",")]
    structs = [
        "named_struct("
        + ", ".join(f"'{name}', CAST({_sql_literal(v)} AS {kind})" for v, (name, kind) in zip(row, fields))
        + ")"
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).selectExpr(f"inline(array({', '.join(structs)}))")
