"""Training, evaluation, selection and persistence of regression models."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import types as ty
from millrace.operators import experiments, explain
from millrace.operators import folds as fold_sums
from millrace.operators.features import split_bucket
from millrace.operators.preprocess import TablePreprocessor, TablePreprocessorModel
from millrace.operators.rows import union_all
from millrace.sources import sinks

# Model names, their estimators and their search grids.
BASELINE_MODEL = "LinearRegression"
ESTIMATORS = {
    "LinearRegression": lambda **p: LinearRegression(**p),
    "RandomForestRegressor": lambda **p: RandomForestRegressor(**{"numTrees": 100, "seed": 42, **p}),
    "GradientBoostingRegressor": lambda **p: GBTRegressor(
        **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 42, **p}
    ),
    "XGBRegressor": lambda **p: GBTRegressor(
        **{"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "seed": 42, **p}
    ),
}
GRIDS = {
    "LinearRegression": {"fitIntercept": [True, False]},
    "RandomForestRegressor": {"numTrees": [10, 20]},
    "GradientBoostingRegressor": {"maxIter": [10, 20]},
    "XGBRegressor": {
        "maxIter": [50, 100],
        "maxDepth": [3, 5],
        "stepSize": [0.01, 0.1],
        "subsamplingRate": [0.8, 1.0],
    },
}
MAPE_FLOOR = 1e-8
METRICS = ["mae", "rmse", "r2", "mape"]

#: Partitions that training rows are dealt to, at least.
FIT_PARTITIONS = 16
#: Cells (rows times columns) of such a partition at most; a larger table is dealt to more of them.
FIT_CELLS = 2_000_000


def make_estimator(name: str, label: str, **overrides):
    if name not in ESTIMATORS:
        raise ValueError(f"unknown model: {name}; known: {', '.join(ESTIMATORS)}")
    return ESTIMATORS[name](featuresCol="features", labelCol=label, predictionCol="prediction", **overrides)


def make_pipeline(name: str, label: str, ignored: list[str] = (), importance_trees: int = 0, **overrides) -> Pipeline:
    preprocessor = TablePreprocessor(labelCol=label, ignoredCols=list(ignored), importanceTrees=importance_trees)
    return Pipeline(stages=[preprocessor, make_estimator(name, label, **overrides)])


def train_regressor(
    name: str, train: DataFrame, label: str, ignored: list[str] = (), importance_trees: int = 0, **overrides
) -> PipelineModel:
    """Fit preprocessing and one regressor on the rows that have a label."""
    pipeline = make_pipeline(name, label, ignored, importance_trees, **overrides)
    with kept_in_memory(train.where(F.col(label).isNotNull()), drawn=name != BASELINE_MODEL) as rows:
        return pipeline.fit(rows)


@dataclass
class Prepared:
    """Training rows held in memory and the preprocessing fitted to them, for any number of regressors."""

    table: DataFrame
    rows: DataFrame
    label: str
    key: str
    preprocessor: TablePreprocessorModel
    seconds: float

    def fit(self, name: str, **overrides) -> PipelineModel:
        """As ``train_regressor`` on the table: its preprocessing, then one regressor."""
        regressor = make_estimator(name, self.label, **overrides)
        return PipelineModel([self.preprocessor, regressor.fit(self.preprocessor.transform(self.rows))])


@contextmanager
def prepared(train: DataFrame, label: str, key: str, drawn: bool = True):
    """Hold the rows that have a label and fit the preprocessing once for several regressors or runs."""
    begun = time.perf_counter()
    with kept_in_memory(train.where(F.col(label).isNotNull()), drawn=drawn) as rows:
        fitted = TablePreprocessor(labelCol=label, ignoredCols=[key]).fit(rows)
        yield Prepared(train, rows, label, key, fitted, time.perf_counter() - begun)


def fit_partitions(rows: int, columns: int) -> int:
    """Partitions of a training table; its size alone decides, not the machine or the files."""
    return max(FIT_PARTITIONS, -(-rows * columns // FIT_CELLS))


@contextmanager
def kept_in_memory(df: DataFrame, partitions: int | None = None, drawn: bool = True):
    """Hold a training table across the many passes of a fit; it spills to disk when large.

    Bagging and subsampling draw per partition and row. Where rows are ``drawn``
    they are dealt to ``partitions``, by default as many as their number asks for,
    by a hash of their cells and put in its order: the same rows give the same
    trees on any machine and file layout. A fit that draws none takes the rows as
    they lie, without a shuffle unless they lie in fewer partitions than there are
    cores.
    """
    if not drawn:
        cores = df.sparkSession.sparkContext.defaultParallelism
        held = (df.repartition(cores) if df.rdd.getNumPartitions() < cores else df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield held
        finally:
            held.unpersist()
        return
    partitions = partitions or fit_partitions(df.count(), len(df.columns))
    digest = ty.row_digest(df)
    placed = df.withColumns({"__1": digest[0], "__2": digest[1]}).repartition(partitions, "__1")
    held = placed.sortWithinPartitions("__1", "__2").drop("__1", "__2").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


# ------------------------------------------------------------------ evaluation


def regression_metrics(predictions: DataFrame, label: str, prediction: str = "prediction", by: list[str] = ()):
    """(by…, rows, mae, rmse, r2, mape) from one aggregate.

    A constant label gives r2 = 1 for exact predictions and 0 otherwise.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = y - p
    squared, spread = F.sum(error * error), F.var_pop(y) * F.count(y)
    pct = F.abs(error) / F.greatest(F.abs(y), F.lit(MAPE_FLOOR)) * 100
    r2 = F.when(spread > 0, 1 - F.try_divide(squared, spread)).when(squared == 0, 1.0).otherwise(0.0)
    return (
        predictions.where(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            r2.alias("r2"),
            F.avg(pct).alias("mape"),
        )
    )


def _metric_order(metric: str) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return F.desc(metric) if metric == "r2" else F.asc(metric)


def leaderboard(results: DataFrame, metric: str = "mae") -> DataFrame:
    """Models ranked by a metric; one row per model, so one sort ranks them."""
    order = Window.orderBy(_metric_order(metric), "model_name")
    return results.withColumn("model_rank", F.row_number().over(order))


def best_model(board: DataFrame, metric: str = "mae") -> DataFrame:
    return board.where("model_rank = 1").select(
        "model_name", F.lit(metric).alias("ranking_metric"), F.col(metric).alias("metric_value")
    )


# ------------------------------------------------------------ cross-validation


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """Fold number from a hash of the key: stable and shuffle-free."""
    return F.pmod(split_bucket(key, seed), F.lit(folds))


def cross_validate(
    name: str, df: DataFrame, label: str, key: str, folds: int = 5, ignored: list[str] = (), **overrides
) -> DataFrame:
    """(model_name, fold, rows, mae, rmse, r2, mape); preprocessing is refitted in every fold.

    The linear model is fitted for all folds from sums per fold, other models and
    columns with ordinal codes by a refit per fold.
    """
    numbered = df.withColumn("__fold", fold_of(F.col(key), folds))
    if name == BASELINE_MODEL and set(overrides) <= {"fitIntercept"}:
        scored = _linear_scores(numbered, label, folds, [key, *ignored], [overrides.get("fitIntercept", True)])
        if scored is not None:
            metrics = regression_metrics(scored[0].withColumnRenamed("p0", "prediction"), "y", by=["fold"])
            return metrics.select(F.lit(name).alias("model_name"), "fold", "rows", *METRICS)
    return refitted_folds(name, numbered, label, key, folds, ignored, **overrides)


def refitted_folds(
    name: str, numbered: DataFrame, label: str, key: str, folds: int, ignored: list[str] = (), **overrides
) -> DataFrame:
    """As ``cross_validate``, by one fit per fold on rows with a number in ``__fold``."""
    skip = [key, "__fold", *ignored]
    parts = []
    for k in range(folds):
        model = train_regressor(name, numbered.where(F.col("__fold") != k), label, skip, **overrides)
        scored = model.transform(numbered.where(F.col("__fold") == k))
        parts.append(regression_metrics(scored, label).withColumn("fold", F.lit(k)))
    return union_all(parts).select(F.lit(name).alias("model_name"), "fold", "rows", *METRICS)


def _linear_scores(
    numbered: DataFrame, label: str, folds: int, ignored: list[str], intercepts: list[bool]
) -> tuple[DataFrame, list[str]] | None:
    """(fold, y, p0, p1, …): predictions of held-out rows by linear models with and without intercept."""
    found = fold_sums.feature_frame(numbered, label, "__fold", ignored)
    if found is None:
        return None
    frame, names, continuous = found
    with kept_in_memory(frame, drawn=False) as rows:
        sums = fold_sums.fold_sums(rows, names, continuous, folds)
    columns = [f"p{i}" for i in range(len(intercepts))]
    predictions = [fold_sums.predicted(sums, folds, b).alias(c) for c, b in zip(columns, intercepts)]
    return frame.select("fold", "y", *predictions), columns


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population sigma of every metric over the folds."""
    measures = []
    for m in METRICS:
        measures += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return folds.groupBy("model_name").agg(F.count(F.lit(1)).alias("folds"), *measures)


@dataclass
class SearchResult:
    """All configurations ranked, and the best one refitted on all rows."""

    ranked: DataFrame
    model: PipelineModel


def grid_search(
    name: str,
    df: DataFrame,
    label: str,
    key: str,
    grid: dict[str, list] | None = None,
    folds: int = 5,
    ignored: list[str] = (),
    parallelism: int = 4,
    **overrides,
) -> SearchResult:
    """Exhaustive search; configurations of a fold are fitted in parallel, those of the linear model from sums per fold."""
    grid = GRIDS[name] if grid is None else grid
    if name == BASELINE_MODEL and list(grid) == ["fitIntercept"] and not overrides:
        numbered = df.withColumn("__fold", fold_of(F.col(key), folds))
        scored = _linear_scores(numbered, label, folds, [key, *ignored], grid["fitIntercept"])
        if scored is not None:
            frame, columns = scored
            errors = frame.groupBy("fold").agg(*[F.avg(F.abs(F.col("y") - F.col(c))).alias(c) for c in columns])
            means = errors.agg(*[F.avg(c).alias(c) for c in columns]).first()
            scores = [(json.dumps({"fitIntercept": b}), means[c]) for c, b in zip(columns, grid["fitIntercept"])]
            best = json.loads(min(scores, key=lambda r: r[1])[0])
            return SearchResult(_ranked(df.sparkSession, name, scores), train_regressor(name, df, label, [key, *ignored], **best))
    pipeline = make_pipeline(name, label, [key, "__fold", *ignored], **overrides)
    estimator = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(estimator.getParam(param), values)
    maps = builder.build()
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mae"),
        foldCol="__fold",
        numFolds=folds,
        parallelism=parallelism,
    )
    numbered = df.where(F.col(label).isNotNull()).withColumn("__fold", fold_of(F.col(key), folds))
    with kept_in_memory(numbered) as rows:
        fitted = search.fit(rows)
    scores = [
        (json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(score))
        for m, score in zip(maps, fitted.avgMetrics)
    ]
    return SearchResult(_ranked(df.sparkSession, name, scores), fitted.bestModel)


def _ranked(spark: SparkSession, name: str, scores: list[tuple[str, float]]) -> DataFrame:
    """Configurations by their mean error; one row each."""
    return spark.createDataFrame(
        [(name, i + 1, params, score) for i, (params, score) in enumerate(sorted(scores, key=lambda r: r[1]))],
        "model_name string, config_rank int, parameters string, mean_mae double",
    )


# ----------------------------------------------------------------- persistence


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def next_version(spark: SparkSession, folder: str, name: str) -> int:
    version = 1
    while _exists(spark, f"{folder}/{name}_v{version}"):
        version += 1
    return version


def save_model(
    model: PipelineModel, spark: SparkSession, folder: str, name: str, version: int | None = None
) -> tuple[str, int]:
    """Write under the next free version, or replace the one given; returns (path, version)."""
    writer = model.write() if version is None else model.write().overwrite()
    version = next_version(spark, folder, name) if version is None else version
    path = f"{folder}/{name}_v{version}"
    writer.save(path)
    return path, version


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def batch_score(df: DataFrame, path: str, name: str, version: int) -> DataFrame:
    """Raw rows plus prediction, model name and version."""
    scored = load_model(path).transform(df).drop("features")
    return scored.withColumns({"model_name": F.lit(name), "model_version": F.lit(version)})


# --------------------------------------------------------------------- full run

# Tables of a training folder. The events are written last: a run that has them is complete.
LEDGER = {
    "leaderboards": "run_id string, model_name string, rows bigint, mae double, rmse double, r2 double, mape double, "
    "training_seconds double, model_rank int",
    "importances": "run_id string, model_name string, version bigint, feature string, importance double, "
    "importance_rank int, method string",
    "folds": "run_id string, model_name string, fold int, rows bigint, mae double, rmse double, r2 double, mape double",
    "searches": "run_id string, model_name string, config_rank int, parameters string, mean_mae double",
    "experiments": experiments.SCHEMA,
    "events": "run_id string, seq bigint, model_name string, version bigint, event string, status string, "
    "created_at timestamp, mae double",
}
LEDGER_KEYS = {
    "leaderboards": ["run_id", "model_name"],
    "importances": ["run_id", "feature"],
    "folds": ["run_id", "model_name", "fold"],
    "searches": ["run_id", "model_name", "parameters"],
    "experiments": ["experiment_id"],
    "events": ["run_id", "event"],
}
DEFAULT_DATASET = "default"


@dataclass
class Ledger:
    """What training runs recorded in a folder; every table is appended to by run and never rewritten."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return sinks.read_if_any(self.spark, f"{self.folder}/{name}", LEDGER[name])

    def add(self, name: str, rows: DataFrame) -> int:
        fields = T.StructType.fromDDL(LEDGER[name]).fields
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        return sinks.append_once(typed, f"{self.folder}/{name}", LEDGER_KEYS[name])

    def finished(self, run_id: str) -> Row | None:
        """The registration of a run that is complete; its other event follows from the status."""
        events = self.table("events").where(F.col("run_id") == run_id).orderBy("seq").collect()  # two rows
        return events[0] if len(events) == 2 else None

    def next_version(self, name: str) -> int:
        last = self.table("events").where(F.col("model_name") == name).agg(F.max("version")).first()[0]
        return (last or 0) + 1

    def next_seq(self) -> int:
        last = self.table("events").agg(F.max("seq")).first()[0]
        return (last or 0) + 1


@dataclass
class TrainingRun:
    """Everything a full run produces."""

    board: DataFrame
    best: str
    path: str
    version: int
    status: str
    folds: DataFrame | None
    searches: dict[str, DataFrame] = field(default_factory=dict)
    seconds: float = 0.0
    run_id: str = ""
    repeated: bool = False

    def registry_events(self, spark: SparkSession, seq: int, created_at: str) -> DataFrame:
        """Registration and promotion (or archiving, for the baseline) as registry events."""
        mae = float(self.board.where(F.col("model_name") == self.best).first()["mae"])
        follow = "archive" if self.status == "Archived" else "promote"
        rows = [
            (seq, self.best, self.version, "register", "Staging", created_at, mae),
            (seq + 1, self.best, self.version, follow, None, created_at, mae),
        ]
        schema = (
            "seq bigint, model_name string, version bigint, event string, status string, created_at string, mae double"
        )
        events = spark.createDataFrame(rows, schema)
        return events.withColumn("created_at", F.col("created_at").try_cast("timestamp"))


def _status(best: str) -> str:
    return "Archived" if best == BASELINE_MODEL else "Production"


def recorded_run(ledger: Ledger, run_id: str) -> TrainingRun | None:
    """A complete run as the tables of its folder tell it."""
    registered = ledger.finished(run_id)
    if registered is None:
        return None
    own = {n: ledger.table(n).where(F.col("run_id") == run_id).drop("run_id") for n in ("leaderboards", "folds", "searches")}
    best, version = registered["model_name"], registered["version"]
    board = own["leaderboards"].orderBy("model_rank")
    names = [r["model_name"] for r in own["searches"].select("model_name").distinct().collect()]  # one row per model
    return TrainingRun(
        board=board,
        best=best,
        path=f"{ledger.folder}/{best}_v{version}",
        version=version,
        status=_status(best),
        folds=None if own["folds"].isEmpty() else own["folds"],
        searches={n: own["searches"].where(F.col("model_name") == n) for n in sorted(names)},
        run_id=run_id,
        repeated=True,
    )


def training_run(
    train: DataFrame | Prepared,
    test: DataFrame,
    label: str,
    key: str,
    folder: str,
    models: dict[str, dict] | None = None,
    folds: int = 0,
    grids: dict[str, dict] | None = None,
    run_id: str | None = None,
    dataset_version: str = DEFAULT_DATASET,
    created_at: str | None = None,
) -> TrainingRun:
    """Train and evaluate every model, save the best, log the experiment and register it with its importances.

    The best model is promoted; a winning linear baseline is archived instead.
    ``folds`` and ``grids`` add cross-validation and search. All of it is recorded
    in the tables of a ``Ledger`` in ``folder`` under ``run_id``. A second call
    with the id of a complete run trains nothing, adds nothing and returns what
    was recorded; after an interrupted call it writes what is missing. One run
    writes to a folder at a time.

    All models share the rows held in memory and the preprocessing fitted to them,
    and so do several runs that are given the same ``Prepared`` rows; its time
    counts for each model.
    """
    started = time.perf_counter()
    if isinstance(train, Prepared) and (train.label, train.key) != (label, key):
        raise ValueError(f"rows were prepared for label {train.label} and key {train.key}")
    spark = test.sparkSession
    ledger = Ledger(spark, folder)
    run_id = run_id or uuid.uuid4().hex
    before = recorded_run(ledger, run_id)
    if before is not None:
        return before
    created_at = created_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    models = models or {n: {} for n in ESTIMATORS}
    fitted, parts, fold_parts, searches = {}, [], [], {}
    table = train.table if isinstance(train, Prepared) else train
    drawn = any(n != BASELINE_MODEL for n in models)
    with nullcontext(train) if isinstance(train, Prepared) else prepared(train, label, key, drawn) as ready:
        for name, overrides in models.items():
            begun = time.perf_counter()
            if overrides.get("importance_trees"):  # preprocessing of its own
                fitted[name], shared = train_regressor(name, table, label, [key], **overrides), 0.0
            else:
                own = {k: v for k, v in overrides.items() if k != "importance_trees"}
                fitted[name], shared = ready.fit(name, **own), ready.seconds
            seconds = shared + time.perf_counter() - begun
            metrics = regression_metrics(fitted[name].transform(test), label)
            parts.append(
                metrics.select(
                    F.lit(name).alias("model_name"), "rows", *METRICS, F.lit(seconds).alias("training_seconds")
                )
            )
    for name, overrides in models.items():
        if folds > 1:
            fold_parts.append(cross_validate(name, table, label, key, folds, **overrides))
        if grids and name in grids:
            found = grid_search(name, table, label, key, grids[name], max(folds, 2), **overrides)
            searches[name] = found.ranked
    # One row per model.
    rows = union_all(parts).collect()
    board = leaderboard(spark.createDataFrame(rows, union_all(parts).schema))
    best = board.where("model_rank = 1").first()["model_name"]
    path, version = save_model(fitted[best], spark, folder, best, ledger.next_version(best))
    run = TrainingRun(
        board=board,
        best=best,
        path=path,
        version=version,
        status=_status(best),
        folds=union_all(fold_parts) if fold_parts else None,
        searches=searches,
        run_id=run_id,
    )
    _record(ledger, run, fitted[best], dataset_version, created_at)
    run.seconds = time.perf_counter() - started
    return run


def _record(ledger: Ledger, run: TrainingRun, model: PipelineModel, dataset_version: str, created_at: str) -> None:
    """Append a run to its tables, the registry events last."""
    spark, own = ledger.spark, F.lit(run.run_id).alias("run_id")
    ledger.add("leaderboards", run.board.select(own, "*"))
    if run.folds is not None:
        ledger.add("folds", run.folds.select(own, "*"))
    for ranked in run.searches.values():
        ledger.add("searches", ranked.select(own, "*"))
    named = explain.global_importance(spark, model.stages[-1], model.stages[0].feature_names)
    ledger.add("importances", named.select(own, F.lit(run.best).alias("model_name"), F.lit(run.version).alias("version"), "*"))
    best = run.board.where(F.col("model_name") == run.best).crossJoin(  # one row each
        F.broadcast(run.board.agg(F.sum("training_seconds").alias("all_seconds")))
    )
    measured = F.map_from_arrays(F.array(*[F.lit(m) for m in METRICS]), F.array(*METRICS))
    ledger.add(
        "experiments",
        best.select(
            F.lit(run.run_id).alias("experiment_id"),
            F.lit(created_at).alias("timestamp"),
            "model_name",
            F.lit(dataset_version).alias("dataset_version"),
            F.create_map(F.lit("selected_model"), "model_name").alias("hyperparameters"),
            measured.alias("metrics"),
            F.col("all_seconds").alias("training_time_seconds"),
            F.lit(run.version).alias("model_version"),
        ),
    )
    ledger.add("events", run.registry_events(spark, ledger.next_seq(), created_at).coalesce(1).select(own, "*"))
