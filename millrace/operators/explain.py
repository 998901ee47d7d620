"""Importances and per-row contributions.

A row's contributions are an array expression over its feature columns, so
ranking, confidence and text need no shuffle and work for every scored row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Confidence limits and the least bar width.
LEAST_CONFIDENCE, FALLBACK_CONFIDENCE = 0.05, 0.2
LEAST_WIDTH = 8.0


def importance_table(spark, weights: dict[str, float], method: str) -> DataFrame:
    """(feature, importance, importance_rank, method), largest first.

    One row per model feature; equal importances keep the feature order.
    """
    rows = [(i, n, float(w)) for i, (n, w) in enumerate(weights.items())]
    table = spark.createDataFrame(rows, "position int, feature string, importance double")
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "position"))
    return table.select("feature", "importance", rank.alias("importance_rank"), F.lit(method).alias("method"))


def model_weights(model, features: list[str]) -> tuple[dict[str, float], str]:
    """Importances of a fitted model and the method that gave them."""
    if hasattr(model, "featureImportances"):
        values, method = model.featureImportances.toArray(), "feature_importance"
    elif hasattr(model, "coefficients"):
        values, method = abs(model.coefficients.toArray()), "coefficients"
    else:
        values, method = [1.0 / len(features)] * len(features), "fallback"
    if len(values) != len(features):
        raise ValueError("feature names do not match the model")
    return dict(zip(features, (float(v) for v in values))), method


def global_importance(spark, model, features: list[str]) -> DataFrame:
    weights, method = model_weights(model, features)
    return importance_table(spark, weights, method)


def importance_top(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.where(F.col("importance_rank") <= k)


def _contributions(weights: dict[str, float]) -> Column:
    """Array of (position, feature, value, importance, contribution)."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(n).alias("feature"),
                F.col(n).cast("double").alias("value"),
                F.lit(float(w)).alias("importance"),
                (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * float(w)).alias("contribution"),
            )
            for i, (n, w) in enumerate(weights.items())
        ]
    )


def _by_impact(weights: dict[str, float]) -> Column:
    keyed = F.transform(
        _contributions(weights),
        lambda c: F.struct((-F.abs(c["contribution"])).alias("rank_key"), c["position"].alias("position"), c.alias("c")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def local_contributions(df: DataFrame, row_id: str, weights: dict[str, float]) -> DataFrame:
    """(row id, feature, value, importance, contribution): value times importance."""
    return df.select(row_id, F.explode(_contributions(weights)).alias("c")).select(
        row_id, "c.feature", "c.value", "c.importance", "c.contribution"
    )


def rank_impacts(df: DataFrame, row_id: str, weights: dict[str, float]) -> DataFrame:
    """(row id, feature, contribution, impact_rank) by absolute contribution."""
    ranked = df.select(row_id, F.posexplode(_by_impact(weights)).alias("place", "c"))
    return ranked.select(row_id, "c.feature", "c.contribution", (F.col("place") + 1).alias("impact_rank"))


def explain_confidence(df: DataFrame, row_id: str, weights: dict[str, float], method: str = "feature_importance"):
    """(row id, confidence, uncertainty) from the strength of the explanation."""
    total = sum(abs(w) for w in weights.values()) or 1.0
    base = min(1.0, max(LEAST_CONFIDENCE, max(abs(w) for w in weights.values()) / total))
    if method == "fallback":
        base = max(FALLBACK_CONFIDENCE, base)
    size = float(len(weights))
    summed = F.aggregate(_contributions(weights), F.lit(0.0), lambda acc, c: acc + F.abs(c["contribution"]))
    raised = F.least(F.lit(1.0), summed / size / max(total, 1.0))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(base), raised))
    return df.select(row_id, confidence.alias("exact")).select(
        row_id,
        F.round("exact", 4).alias("confidence"),
        F.round(F.greatest(F.lit(0.0), 1 - F.col("exact")), 4).alias("uncertainty"),
    )


def explain_text(df: DataFrame, row_id: str, weights: dict[str, float]) -> DataFrame:
    """(row id, explanation): a sentence naming the three strongest features."""
    part = lambda c: F.concat(
        F.replace(c["feature"], F.lit("_"), F.lit(" ")),
        F.when(c["contribution"] > 0, " (increasing)").otherwise(" (decreasing)"),
    )
    top = F.transform(F.slice(_by_impact(weights), 1, 3), part)
    sentence = F.concat(F.lit("The prediction is primarily influenced by "), F.array_join(top, ", and "), F.lit("."))
    return df.select(row_id, sentence.alias("explanation"))


def contribution_width(df: DataFrame, row_id: str, weights: dict[str, float]) -> DataFrame:
    """(row id, feature, contribution, direction, width_pct) for drawing bars per row."""
    parts = _contributions(weights)
    largest = F.aggregate(parts, F.lit(1.0), lambda acc, c: F.greatest(acc, F.abs(c["contribution"])))
    bars = df.select(row_id, largest.alias("largest"), F.explode(parts).alias("c"))
    width = F.greatest(F.lit(LEAST_WIDTH), F.abs("c.contribution") / F.col("largest") * 100)
    return bars.select(
        row_id,
        "c.feature",
        "c.contribution",
        F.when(F.col("c.contribution") >= 0, "+").otherwise("-").alias("direction"),
        width.alias("width_pct"),
    )
