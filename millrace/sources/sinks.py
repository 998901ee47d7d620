"""Writers, checksums and rollback."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import types as ty
from millrace.session import durable_checkpoint
from millrace.sources.checksums import file_checksums  # noqa: F401

ROLLBACK_SCHEMA = (
    "dataset string, raw_path string, processed_path string, raw_rows bigint, raw_checksum string, "
    "processed_rows bigint, processed_checksum string"
)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    """Replace a table; CSV gets a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def sink_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON, one per line."""
    findings.write.mode("overwrite").json(path)


def sink_append(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append metric, leaderboard or fold rows."""
    writer = rows.write.mode("append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def read_if_any(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty one of the schema where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_once(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the Parquet table does not hold yet; returns how many that were.

    The table is read back before the append, so a call that is repeated, or that
    finishes what an interrupted one began, adds nothing twice. Keys are not null.
    """
    held = read_if_any(rows.sparkSession, path, rows.schema).select(*keys).distinct()
    new = durable_checkpoint(rows.join(held, list(keys), "left_anti").select(*rows.columns))
    count = new.count()
    if count:
        new.write.mode("append").parquet(path)
    return count


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, checksum): independent of row order, sensitive to repeated rows, nulls and nested cells.

    The checksum joins two sums of independent 64-bit hashes.
    """
    first, second = ty.row_digest(df)
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("string")
    hashed = df.select(first, second)
    checksum = F.concat_ws("/", total(F.col("digest_1")), total(F.col("digest_2")))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), checksum.alias("checksum"))


def rollback_entry(spark: SparkSession, dataset: str, raw_path: str, processed_path: str) -> DataFrame:
    """One manifest row for a raw table and its processed copy (both Parquet)."""
    raw = table_fingerprint(spark.read.parquet(raw_path))
    done = table_fingerprint(spark.read.parquet(processed_path))
    return raw.select(F.col("rows").alias("raw_rows"), F.col("checksum").alias("raw_checksum")).crossJoin(
        F.broadcast(done.select(F.col("rows").alias("processed_rows"), F.col("checksum").alias("processed_checksum")))
    ).select(
        F.lit(dataset).alias("dataset"),
        F.lit(raw_path).alias("raw_path"),
        F.lit(processed_path).alias("processed_path"),
        "raw_rows",
        "raw_checksum",
        "processed_rows",
        "processed_checksum",
    )


def rollback_table(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Restore every processed table from its raw one: (dataset, restored_rows, raw_unchanged)."""
    outcome = []
    for entry in manifest.collect():  # one row per table
        raw = spark.read.parquet(entry["raw_path"])
        now = table_fingerprint(raw).first()
        raw.write.mode("overwrite").parquet(entry["processed_path"])
        outcome.append((entry["dataset"], now["rows"], now["checksum"] == entry["raw_checksum"]))
    return spark.createDataFrame(outcome, "dataset string, restored_rows bigint, raw_unchanged boolean")
