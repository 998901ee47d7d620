"""Quality score over check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category weights, validator categories and score bands.
CATEGORY_WEIGHTS = {
    "schema": 0.30,
    "nulls": 0.20,
    "duplicates": 0.15,
    "foreign_key": 0.15,
    "gps": 0.10,
    "target": 0.10,
}
CATEGORY_OF = {"timestamp": "schema"}
BANDS = [(90, "excellent"), (80, "good"), (60, "fair"), (40, "poor")]
LOWEST_BAND = "critical"


def quality_band(score: Column) -> Column:
    bands = F.lit(LOWEST_BAND)
    for floor, label in reversed(BANDS):
        bands = F.when(score >= floor, label).otherwise(bands)
    return bands


def category_scores(results: DataFrame, weights: dict[str, float] = CATEGORY_WEIGHTS) -> DataFrame:
    """(category, average, weight); categories without a weight are left out."""
    category = F.col("validator")
    for validator, target in CATEGORY_OF.items():
        category = F.when(category == validator, target).otherwise(category)
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return (
        results.withColumn("category", category)
        .groupBy("category")
        .agg(F.avg("score").alias("average"))
        .withColumn("weight", F.try_element_at(weight, F.col("category")))
        .where("weight IS NOT NULL")
    )


def quality_score(results: DataFrame, weights: dict[str, float] = CATEGORY_WEIGHTS) -> DataFrame:
    """One row (overall_score, interpretation) over the categories present."""
    total = category_scores(results, weights).agg(
        F.round(
            F.coalesce(F.try_divide(F.sum(F.col("average") * F.col("weight")), F.sum("weight")), F.lit(0.0)), 2
        ).alias("overall_score")
    )
    return total.withColumn("interpretation", quality_band(F.col("overall_score")))
