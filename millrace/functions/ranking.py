"""Consecutive codes for sorted distinct values, without one global sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import durable_checkpoint

SMALL_ROWS = 100_000
#: Salts at least; a larger cluster takes one for each of its shuffle partitions.
LEAST_SALTS = 32


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; stops counting there."""
    return df.limit(max(rows, 0) + 1).count() <= rows


def salts() -> int:
    session = SparkSession.getActiveSession()
    partitions = int(session.conf.get("spark.sql.shuffle.partitions")) if session else LEAST_SALTS
    return max(LEAST_SALTS, partitions)


def task_salt() -> Column:
    """A salt from the number of the reading task.

    It spreads equal rows as well as equal keys, and a task that runs again
    gives the same salt whatever order its rows arrive in.
    """
    return F.pmod(F.spark_partition_id(), F.lit(salts()))


def all_salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts() - 1)))


def lookup(rows: DataFrame, table: DataFrame, key: str, limit: int = SMALL_ROWS) -> DataFrame:
    """Left-join a table with one row per key.

    A table that counting showed to be small is broadcast. Otherwise the rows
    are salted and every salt gets the table, so a frequent key fills many tasks.
    """
    if is_small(table, limit):
        return rows.join(F.broadcast(table), key, "left")
    salted = rows.withColumn("salt", task_salt())
    return salted.join(table.withColumn("salt", all_salts()), [key, "salt"], "left").drop("salt")


def sorted_codes(values: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """(column, code) with code 0, 1, 2… in sort order, and whether the table is small.

    A small set is numbered by one window. A large one is range-partitioned and
    written to the checkpoint folder, which freezes the partitions; each
    partition numbers its own values after the sizes of those before it.
    """
    distinct = durable_checkpoint(values.select(column).where(F.col(column).isNotNull()).distinct())
    if is_small(distinct):
        code = F.row_number().over(Window.orderBy(column)) - 1
        return distinct.select(column, code.cast("bigint").alias("code")), True
    return distributed_codes(distinct, column), False


def distributed_codes(distinct: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    partitions = partitions or int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable_checkpoint(
        distinct.repartitionByRange(partitions, column).withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return placed.join(F.broadcast(offsets), "part").select(
        column, (within + F.col("offset")).cast("bigint").alias("code")
    )
