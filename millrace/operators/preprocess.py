"""A pipeline stage that turns raw columns into a feature vector.

Order: timestamps to parts, encoding, scaling, median filling, pruning. The
fitted model compiles all of it to one projection over the raw columns; only
ordinal codes, which may be many, are joined in from a table.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.functions.quantiles import quantile_row
from millrace.functions.ranking import is_small
from millrace.operators import encode as E
from millrace.operators.correlate import filled_matrix
from millrace.operators.rows import rows_of, union_all

CODES_SCHEMA = "feature string, category string, code bigint"
CORRELATION_LIMIT = 0.95


class _PreprocessorParams(Params):
    outputCol = Param(Params._dummy(), "outputCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label used to rank features", TypeConverters.toString)
    ignoredCols = Param(Params._dummy(), "ignoredCols", "columns that are no features", TypeConverters.toListString)
    importanceTrees = Param(
        Params._dummy(), "importanceTrees", "trees that rank the features; 0 keeps their order", TypeConverters.toInt
    )
    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(outputCol="features", labelCol="label", ignoredCols=[], importanceTrees=0, state="{}")


class TablePreprocessor(Estimator, _PreprocessorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits encoders, scaler, medians and the feature selection on a training table."""

    def __init__(self, outputCol="features", labelCol="label", ignoredCols=None, importanceTrees=0):
        super().__init__()
        self._set(
            outputCol=outputCol, labelCol=labelCol, ignoredCols=ignoredCols or [], importanceTrees=importanceTrees
        )

    def unfitted(self, dataset: DataFrame) -> TablePreprocessorModel:
        """The model with its columns, categories and codes, before anything is scaled, filled or selected."""
        skip = {self.getOrDefault("labelCol"), *self.getOrDefault("ignoredCols")}
        raw = dataset.select(*[c for c in dataset.columns if c not in skip])
        numeric = [f.name for f in raw.schema.fields if ty.is_numeric(f.dataType)]
        dates = E.datetime_columns(raw)
        flags = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.BooleanType)]
        categories = E.few_categories(raw, [c for c in raw.columns if c not in {*numeric, *flags, *dates}])
        ordinal = [c for c, values in categories.items() if values is None]
        state = {
            "input": raw.columns,
            "types": {f.name: f.dataType.simpleString() for f in raw.schema.fields},
            "numeric": numeric,
            "dates": dates,
            "one_hot": {c: values for c, values in categories.items() if values is not None},
            "ordinal": ordinal,
            "scale": {},
            "medians": {},
        }
        model = TablePreprocessorModel(state, _codes(raw, ordinal))
        self._copyValues(model)
        return model

    def _fit(self, dataset: DataFrame) -> TablePreprocessorModel:
        label = self.getOrDefault("labelCol")
        model = self.unfitted(dataset)
        state, chosen = model.state_value, model.continuous()
        encoded = model.feature_frame(dataset, label if label in dataset.columns else None)
        continuous = [c for c in model.all_features() if c in chosen]
        # One pass gives the scaler and tells which features vary.
        features = model.all_features()
        stats = {r["column"]: r for r in feature_spread(encoded, features).collect()}
        varying = [c for c in features if stats[c]["low"] is not None and stats[c]["low"] < stats[c]["high"]]
        if continuous:
            state["scale"] = {c: [stats[c]["mean"] or 0.0, stats[c]["std"] or 0.0] for c in continuous}
            # The median of a column is the value filled in, in scaled terms.
            row = quantile_row(encoded, {f"m{i}": (c, 0.5) for i, c in enumerate(continuous)}).first()
            for i, c in enumerate(continuous):
                mean, std = state["scale"][c]
                value = row[f"m{i}"]
                state["medians"][c] = 0.0 if value is None else (value - mean) / (std if std > 0 else 1.0)
        model.state_value = state
        state["selected"] = self._select(model, dataset, label, varying or features)
        model.state_value = state
        return model

    def _select(self, model: TablePreprocessorModel, dataset: DataFrame, label: str, kept: list[str]) -> list[str]:
        frame = model.feature_frame(dataset, label if label in dataset.columns else None)
        if len(kept) > 1:
            r = filled_matrix(frame, kept)
            close = {j for j in range(len(kept)) for i in range(j) if abs(r[i][j]) > CORRELATION_LIMIT}
            kept = [c for j, c in enumerate(kept) if j not in close]
        trees = self.getOrDefault("importanceTrees")
        if trees and label in dataset.columns:
            kept = [r["feature"] for r in importance_rank(frame, kept, label, trees).collect()]
        return kept


def feature_spread(df: DataFrame, features: list[str]) -> DataFrame:
    """(column, mean, std, low, high) of every feature in one scan."""
    measures = {"mean": F.avg, "std": F.stddev_pop, "low": F.min, "high": F.max}
    aggregates, structs = [], []
    for i, name in enumerate(features):
        aggregates += [fn(F.col(ty.quoted(name))).alias(f"{what}{i}") for what, fn in measures.items()]
        structs.append(F.struct(F.lit(name).alias("column"), *[F.col(f"{w}{i}").alias(w) for w in measures]))
    return rows_of(df.agg(*aggregates), structs)


def _codes(raw: DataFrame, ordinal: list[str]) -> DataFrame:
    spark = raw.sparkSession
    parts = [spark.createDataFrame([], CODES_SCHEMA)]
    for name in ordinal:
        codes, _ = E.ordinal_fit(raw, name)
        parts.append(codes.select(F.lit(name).alias("feature"), "category", "code"))
    return union_all(parts)


class TablePreprocessorModel(Model, _PreprocessorParams, MLReadable, MLWritable):
    """Applies the fitted steps; input columns must be those of training."""

    def __init__(self, state: dict | None = None, codes: DataFrame | None = None):
        super().__init__()
        self.codes = codes
        self.state_value = state or {}

    @property
    def state_value(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    @state_value.setter
    def state_value(self, value: dict) -> None:
        self._set(state=json.dumps(value))

    @property
    def feature_names(self) -> list[str]:
        return self.state_value["selected"]

    def all_features(self) -> list[str]:
        return list(self.expressions({}))

    def continuous(self) -> set[str]:
        """Features that are scaled and filled by medians: all but flags of categories, codes and booleans."""
        s = self.state_value
        flags = {f"{c}_{v}" for c, values in s["one_hot"].items() for v in values}
        booleans = {c for c, kind in s["types"].items() if kind == "boolean"}
        return {c for c in self.all_features() if c not in flags and c not in s["ordinal"] and c not in booleans}

    def expressions(self, types: dict[str, T.DataType]) -> dict[str, Column]:
        """Final expression of every feature over the raw columns, in table order."""
        s = self.state_value
        found: dict[str, Column] = {}
        parts: dict[str, Column] = {}
        for name in s["input"]:
            c, dtype = F.col(name), types.get(name)
            if name in s["dates"]:
                ts = V.parse_timestamp(c, dtype)
                day = F.weekday(ts)
                parts[f"{name}_epoch"] = F.coalesce(F.unix_timestamp(ts), F.lit(0)).cast("double")
                parts[f"{name}_hour"] = F.coalesce(F.hour(ts), F.lit(-1)).cast("double")
                parts[f"{name}_minute"] = F.coalesce(F.minute(ts), F.lit(-1)).cast("double")
                parts[f"{name}_dayofweek"] = F.coalesce(day, F.lit(-1)).cast("double")
                parts[f"{name}_is_weekend"] = F.coalesce((day >= 5).cast("double"), F.lit(0.0))
            elif name in s["one_hot"]:
                for v in s["one_hot"][name]:
                    found[f"{name}_{v}"] = F.when(E.category(c) == v, 1.0).otherwise(0.0)
            elif name in s["ordinal"]:
                found[name] = F.coalesce(F.col(_code_column(s["ordinal"].index(name))), F.lit(-1)).cast("double")
            else:
                found[name] = V.to_number(c, dtype)
        for name, c in {**found, **parts}.items():
            if name in s["scale"]:
                mean, std = s["scale"][name]
                c = (c - mean) / (std if std > 0 else 1.0)
            if name in s["medians"]:
                c = F.coalesce(c, F.lit(s["medians"][name]))
            elif s["medians"]:
                c = F.coalesce(c, F.lit(0.0))
            found[name] = c
        return found

    def _with_codes(self, df: DataFrame) -> DataFrame:
        s = self.state_value
        for i, name in enumerate(s["ordinal"]):
            table = self.codes.where(F.col("feature") == name).select(
                F.col("category").alias(f"known_{i}"), F.col("code").alias(_code_column(i))
            )
            table = F.broadcast(table) if is_small(table) else table
            df = df.join(table, E.category(F.col(name)) == F.col(f"known_{i}"), "left").drop(f"known_{i}")
        return df

    def feature_frame(self, df: DataFrame, label: str | None = None) -> DataFrame:
        """All features as plain columns, before selection."""
        types = {f.name: f.dataType for f in df.schema.fields}
        columns = [c.alias(n) for n, c in self.expressions(types).items()]
        keep = [F.col(label)] if label else []
        return self._with_codes(df).select(*keep, *columns)

    def _check(self, df: DataFrame) -> None:
        wanted = self.state_value["input"]
        known = {*wanted, self.getOrDefault("labelCol"), *self.getOrDefault("ignoredCols")}
        missing = [c for c in wanted if c not in df.columns]
        extra = [c for c in df.columns if c not in known]
        if missing or extra:
            raise ValueError(f"input schema differs from training: missing {missing}, extra {extra}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._check(dataset)
        types = {f.name: f.dataType for f in dataset.schema.fields}
        expressions = self.expressions(types)
        vector = array_to_vector(F.array(*[expressions[n] for n in self.feature_names]))
        coded = [_code_column(i) for i in range(len(self.state_value["ordinal"]))]
        return self._with_codes(dataset).withColumn(self.getOrDefault("outputCol"), vector).drop(*coded)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


def _code_column(index: int) -> str:
    return f"code_{index}"


class _ModelWriter(MLWriter):
    def __init__(self, instance: TablePreprocessorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.codes.write.mode("overwrite").parquet(f"{path}/codes")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TablePreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(codes=self.sparkSession.read.parquet(f"{path}/codes"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def importance_rank(df: DataFrame, features: list[str], label: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance, importance_rank) of a random forest, largest first; a null feature counts as 0."""
    from millrace.operators.explain import importance_table

    whole = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    assembled = VectorAssembler(inputCols=features, outputCol="__features").transform(whole)
    forest = RandomForestRegressor(
        featuresCol="__features", labelCol=label, numTrees=trees, seed=seed, predictionCol="__prediction"
    )
    weights = forest.fit(assembled).featureImportances.toArray()
    table = importance_table(df.sparkSession, dict(zip(features, weights)), "feature_importance")
    return table.select("feature", "importance", "importance_rank").orderBy("importance_rank")
