"""Experiment log: an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "experiment_id string, timestamp string, model_name string, dataset_version string, "
    "hyperparameters map<string,string>, metrics map<string,double>, "
    "training_time_seconds double, model_version bigint"
)


def experiment_log(spark: SparkSession, path: str, records: list[tuple]) -> None:
    """Append finished experiments; a handful per run."""
    spark.createDataFrame(records, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def experiment_append(records: DataFrame, path: str) -> None:
    """Append experiments that are already a table."""
    records.write.mode("append").parquet(path)


def experiment_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).orderBy("timestamp", "experiment_id")


def experiment_get(spark: SparkSession, path: str, experiment_id: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("experiment_id") == experiment_id)


def experiment_flat(experiments: DataFrame, metrics: list[str]) -> DataFrame:
    """One column per metric and the parameters as JSON text, for CSV export."""
    return experiments.select(
        "experiment_id",
        "timestamp",
        "model_name",
        "dataset_version",
        F.to_json("hyperparameters").alias("hyperparameters"),
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics],
        "training_time_seconds",
        "model_version",
    )
