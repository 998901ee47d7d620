"""Table scans: CSV, declared tables, discovery and inventory of folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_ROWS = 10_000
MANIFEST_SCHEMA = (
    "manifest array<struct<decision_id: string, dataset_id: string, column: string, action: string, "
    "priority: string, confidence: double, rationale: string, status: string, details: map<string,string>>>"
)


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Give a schema on large data: inference reads the files once more."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def scan_required_tables(
    spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Every declared table; raises FileNotFoundError naming all that are missing."""
    tables, missing = {}, []
    for name in names:
        path = f"{folder}/{name}.{fmt}"
        try:
            tables[name] = scan_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
        except AnalysisException:
            missing.append(path)
    if missing:
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    return tables


def _relative(path: Column, root: str) -> Column:
    folder = root.rstrip("/").split("/")[-1]
    return F.substring_index(path, f"/{folder}/", -1)


def dataset_slug(relative_path: Column) -> Column:
    """Dataset id of a relative path: lower case, other characters as one underscore, no extension."""
    stem = F.regexp_replace(F.lower(relative_path), r"\.[a-z0-9]+$", "")
    return F.btrim(F.regexp_replace(stem, "[^a-z0-9]+", "_"), F.lit("_"))


def scan_discover(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(dataset, relative_path, bytes) of every matching file below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )
    relative = _relative(F.col("path"), root)
    return files.select(
        dataset_slug(relative).alias("dataset"), relative.alias("relative_path"), F.col("length").alias("bytes")
    )


def scan_inventory(df: DataFrame, sample_limit: int = HEAD_ROWS) -> DataFrame:
    """(file, rows, columns, bytes, larger_than_sample) per file behind a scanned table."""
    meta = df.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )
    return (
        meta.groupBy("file", "bytes")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "file",
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            "bytes",
            (F.col("rows") > sample_limit).alias("larger_than_sample"),
        )
    )


def row_count(df: DataFrame, dataset: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(dataset).alias("dataset"), "row_count")


def head_sample(df: DataFrame, key: str, rows: int = HEAD_ROWS) -> DataFrame:
    """The first rows by key; every task keeps at most ``rows`` of its own."""
    return df.orderBy(key).limit(rows)


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample of exact size: the rows with the smallest hash of key and seed."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return df.withColumn("__hash", digest).orderBy("__hash", key).limit(rows).drop("__hash")


def key_set_read(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Distinct keys as text from the first candidate column the table has."""
    from millrace.functions import types as ty
    from millrace.functions.values import normalize_key

    name = next((c for c in candidates if c in df.columns), None)
    if name is None:
        raise ValueError(f"no key column among {candidates}")
    key = normalize_key(F.col(name), ty.dtype_of(df, name)).alias("key")
    return df.select(key).where("key IS NOT NULL").distinct()


def manifest_read(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a manifest file, one per row; empty when the file is absent."""
    try:
        raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    except AnalysisException:
        raw = spark.createDataFrame([], MANIFEST_SCHEMA)
    return raw.select(F.inline("manifest")).withColumnRenamed("dataset_id", "dataset")
