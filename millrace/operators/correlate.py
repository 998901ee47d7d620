"""Pairwise correlations of numeric columns, all from one aggregate."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.operators.rows import batches, rows_of, union_all

PAIRS_PER_PASS = 600
#: Columns of a filled matrix that one compiled aggregate takes.
FEW_COLUMNS = 6


def _pair_sql(i: int, j: int, filled: bool) -> str:
    """Pearson correlation over complete pairs; a side without spread gives null.

    ``covar_pop`` skips incomplete pairs; the variances are restricted to the
    same pairs unless both columns are known to be filled, where they are shared.
    """
    a, b = f"c{i}", f"c{j}"
    if filled:
        return f"try_divide(covar_pop({a}, {b}), sqrt(var_pop({a})) * sqrt(var_pop({b})))"
    return (
        f"try_divide(covar_pop({a}, {b}), sqrt(var_pop({a}) FILTER (WHERE {b} IS NOT NULL))"
        f" * sqrt(var_pop({b}) FILTER (WHERE {a} IS NOT NULL)))"
    )


def upper_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, x_position, y_position, pairs, r) for every column pair, x before y."""
    chosen = columns or ty.numeric_columns(df)
    numbers = df.select(*[V.to_number(F.col(ty.quoted(c)), ty.dtype_of(df, c)).alias(f"c{i}") for i, c in enumerate(chosen)])
    optional = {i for i, f in enumerate(df.select(*[ty.quoted(c) for c in chosen]).schema.fields) if f.nullable}
    parts = []
    for group in batches(list(combinations(range(len(chosen)), 2)), PAIRS_PER_PASS):
        aggregates, structs = [], []
        for i, j in group:
            filled = i not in optional and j not in optional
            both = "count(1)" if filled else f"count_if(c{i} IS NOT NULL AND c{j} IS NOT NULL)"
            aggregates += [
                F.expr(both).alias(f"n_{i}_{j}"),
                F.expr(_pair_sql(i, j, filled)).alias(f"r_{i}_{j}"),
            ]
            structs.append(
                F.struct(
                    F.lit(chosen[i]).alias("x"),
                    F.lit(chosen[j]).alias("y"),
                    F.lit(i).alias("x_position"),
                    F.lit(j).alias("y_position"),
                    F.col(f"n_{i}_{j}").alias("pairs"),
                    F.col(f"r_{i}_{j}").alias("r"),
                )
            )
        parts.append(rows_of(numbers.agg(*aggregates), structs))
    return union_all(parts)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, pairs, r) in both directions, pairwise complete; the diagonal is left out."""
    pairs = upper_pairs(df, columns)
    both = F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y")),
        F.struct(F.col("y").alias("x"), F.col("x").alias("y")),
    )
    return pairs.select(F.explode(both).alias("pair"), "pairs", "r").select("pair.x", "pair.y", "pairs", "r")


def correlated_columns(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """(column, strongest): columns too close to an earlier one."""
    return (
        upper_pairs(df, columns)
        .where(F.abs("r") > threshold)
        .groupBy(F.col("y").alias("column"))
        .agg(F.max(F.abs("r")).alias("strongest"))
    )


def filled_matrix(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Correlation matrix of columns without nulls, columns by columns on the driver.

    A few columns are one aggregate. Of more, products of whole rows are summed
    inside the tasks, which costs far less than an aggregate per pair, though it
    takes two passes over rows made into vectors; it suits scaled features. A
    column without spread gives NaN.
    """
    if len(columns) <= FEW_COLUMNS:
        numbers = df.select(*[F.col(ty.quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
        pairs = list(combinations(range(len(columns)), 2))
        r = [F.expr(_pair_sql(i, j, True)).alias(f"r_{i}_{j}") for i, j in pairs]
        row = numbers.agg(F.count(F.lit(1)).alias("n"), *r).first()
        if row["n"] < 2:
            raise ValueError("correlations need two rows")
        known = {p: row[f"r_{p[0]}_{p[1]}"] for p in pairs}
        cell = lambda i, j: 1.0 if i == j else known[min(i, j), max(i, j)]
        return [[math.nan if cell(i, j) is None else cell(i, j) for j in range(len(columns))] for i in range(len(columns))]
    vectors = df.select(array_to_vector(F.array(*[F.col(ty.quoted(c)).cast("double") for c in columns])).alias("v"))
    return Correlation.corr(vectors, "v").first()[0].toArray().tolist()
