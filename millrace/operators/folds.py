"""Cross-validation of the linear model from sufficient statistics.

Sums of products of all features are taken once per fold. What a model sees that
leaves a fold out is the total less that fold's sums, so all folds are fitted from
one aggregate, however many there are. Medians enter later: a filled feature is
the feature where it is known plus the median times the flag of being null, and
sums of products with that flag are taken as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.quantiles import quantile_row
from millrace.operators.preprocess import CORRELATION_LIMIT, TablePreprocessor
from millrace.operators.rows import batches

#: Sums of one aggregate; wider tables take more passes.
SUMS_PER_PASS = 600


@dataclass
class FoldSums:
    """Per fold: sums of products of (1, label, features less their shift, null flags), and the range of each feature."""

    features: list[str]
    flagged: list[str]
    continuous: set[str]
    shift: dict[str, float]
    products: np.ndarray
    low: np.ndarray
    high: np.ndarray
    medians: np.ndarray

    def fit(self, fold: int, intercept: bool) -> tuple[dict[str, float], float]:
        """Weights of the unscaled features and the constant of the model that leaves a fold out.

        Features are filled, scaled and selected as the preprocessor does it.
        """
        sums = self.products.sum(0) - self.products[fold]
        n, width = sums[0, 0], len(sums)
        rest = [k for k in range(len(self.products)) if k != fold]
        maps: dict[str, np.ndarray] = {}
        for i, c in enumerate(self.features):
            column = np.zeros(width)
            column[2 + i] = 1.0
            if c in self.continuous:
                known = n
                if c in self.flagged:
                    at = 2 + len(self.features) + self.flagged.index(c)
                    column[at] = self.medians[fold, i] - self.shift[c]
                    known = n - sums[0, at]
                mean = sums[0, 2 + i] / known if known else 0.0
                spread = max(sums[2 + i, 2 + i] / known - mean**2, 0.0) if known else 0.0
                column[0] -= mean
                column /= np.sqrt(spread) if spread > 0 else 1.0
            maps[c] = column
        low, high = np.nanmin(self.low[rest], 0), np.nanmax(self.high[rest], 0)
        kept = [c for i, c in enumerate(self.features) if low[i] < high[i]] or self.features
        kept = self._uncorrelated(sums, maps, kept)
        design = np.stack([maps[c] for c in kept] + ([np.eye(width)[0]] if intercept else []), 1)
        normal, right = design.T @ sums @ design, design.T @ sums[:, 1]
        scale = np.sqrt(np.maximum(np.diag(normal), 1e-300))
        solved = np.linalg.lstsq(normal / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale
        told = design @ solved
        weights = {c: float(told[2 + self.features.index(c)]) for c in kept}
        return weights, float(told[0]) - sum(w * self.shift[c] for c, w in weights.items())

    @staticmethod
    def _uncorrelated(sums: np.ndarray, maps: dict[str, np.ndarray], kept: list[str]) -> list[str]:
        design = np.stack([maps[c] for c in kept], 1)
        mean = design.T @ sums[:, 0] / sums[0, 0]
        covariance = design.T @ sums @ design / sums[0, 0] - np.outer(mean, mean)
        sigma = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.abs(covariance / np.outer(sigma, sigma))
        return [c for j, c in enumerate(kept) if not (r[:j, j] > CORRELATION_LIMIT).any()]


def feature_frame(df: DataFrame, label: str, fold: str, ignored: list[str]) -> tuple[DataFrame, list[str], set[str]] | None:
    """(fold, y, features…) with the features unfilled and unscaled; None where a column needs ordinal codes.

    Which columns are timestamps and which categories there are is taken from all
    rows; a category that a fold's training rows lack does not vary there.
    """
    plain = TablePreprocessor(labelCol=label, ignoredCols=[*ignored, fold]).unfitted(df)
    if plain.state_value["ordinal"]:
        return None
    expressions = plain.expressions({f.name: f.dataType for f in df.schema.fields})
    frame = df.where(F.col(label).isNotNull()).select(
        F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(expressions.values())]
    )
    return frame, list(expressions), plain.continuous()


def fold_sums(frame: DataFrame, names: list[str], continuous: set[str], folds: int) -> FoldSums:
    """All that the models of all folds need, in two aggregates, and two more where nulls are to be filled."""
    columns = [f"x{i}" for i in range(len(names))]
    first = frame.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns]
    ).first()
    shift = {n: (first[f"m_{c}"] or 0.0) if n in continuous else 0.0 for n, c in zip(names, columns)}
    flagged = [n for n, c in zip(names, columns) if n in continuous and first[f"n_{c}"]]
    at = dict(zip(names, columns))
    parts = [F.lit(1.0), F.col("y"), *[F.coalesce(F.col(at[n]) - F.lit(shift[n]), F.lit(0.0)) for n in names]]
    parts += [F.col(at[n]).isNull().cast("double") for n in flagged]
    wide = frame.select("fold", *columns, *[p.alias(f"z{i}") for i, p in enumerate(parts)])
    width = len(parts)
    sums = [(f"p_{i}_{j}", f"sum(z{i} * z{j})") for i, j in combinations_with_replacement(range(width), 2)]
    ranges = [(f"{f}_{c}", f"{f}({c})") for c in columns for f in ("min", "max")]
    products = np.zeros((folds, width, width))
    low, high = np.full((folds, len(names)), np.nan), np.full((folds, len(names)), np.nan)
    for group in batches([*ranges, *sums], SUMS_PER_PASS):
        for row in wide.groupBy("fold").agg(*[F.expr(e).alias(n) for n, e in group]).collect():  # a row per fold
            for n, _ in group:
                kind, *place = n.split("_")
                if kind == "p":
                    i, j = map(int, place)
                    products[row["fold"], i, j] = products[row["fold"], j, i] = row[n]
                elif row[n] is not None:
                    (low if kind == "min" else high)[row["fold"], int(place[0][1:])] = row[n]
    medians = np.zeros((folds, len(names)))
    if flagged:
        others = [(k, n) for k in range(folds) for n in flagged]
        apart = frame.select(*[F.when(F.col("fold") != k, F.col(at[n])).alias(f"q{i}") for i, (k, n) in enumerate(others)])
        found = quantile_row(apart, {f"q{i}": (f"q{i}", 0.5) for i in range(len(others))}).first()
        for i, (k, n) in enumerate(others):
            medians[k, names.index(n)] = found[f"q{i}"] if found[f"q{i}"] is not None else 0.0
    return FoldSums(names, flagged, continuous, shift, products, low, high, medians)


def predicted(sums: FoldSums, folds: int, intercept: bool) -> Column:
    """The prediction of each row by the model that has not seen its fold."""
    out = F.lit(None).cast("double")
    for k in range(folds):
        if not (sums.products.sum(0) - sums.products[k])[0, 0]:
            continue
        weights, constant = sums.fit(k, intercept)
        total = F.lit(constant)
        for c, w in weights.items():
            i = sums.features.index(c)
            fill = float(sums.medians[k, i]) if c in sums.continuous else 0.0
            total = total + F.lit(w) * F.coalesce(F.col(f"x{i}"), F.lit(fill))
        out = F.when(F.col("fold") == k, total).otherwise(out)
    return out
