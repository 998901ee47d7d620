"""Queries on the model registry, evaluation and training."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.operators import experiments as L
from millrace.operators import explain as Z
from millrace.operators import features as G
from millrace.operators import registry as R
from millrace.operators import train as M
from millrace.operators.preprocess import TablePreprocessor, importance_rank
from millrace.plans.catalog import query, rounded, union_sql
from millrace.plans.quality_queries import scratch
from millrace.plans.tables import with_views

EVENTS = with_views("registry_events")

STATE = """firsts AS (SELECT model_name, version, min(seq) AS seq FROM registry_events WHERE event = 'register' AND version >= 1 GROUP BY 1, 2),
regs AS (SELECT e.model_name, e.version, e.seq, e.status, e.created_at, e.mae FROM registry_events e JOIN firsts f USING (model_name, version, seq)),
own AS (SELECT r.*, (SELECT max(seq) FROM registry_events e WHERE e.model_name = r.model_name AND e.version = r.version
        AND e.event = 'promote' AND e.seq > r.seq) AS promoted,
    (SELECT max(seq) FROM registry_events e WHERE e.model_name = r.model_name AND e.version = r.version
        AND e.event = 'archive' AND e.seq > r.seq) AS archived FROM regs r),
last AS (SELECT *, greatest(seq, coalesce(promoted, 0), coalesce(archived, 0)) AS latest,
    max(promoted) OVER (PARTITION BY model_name) AS family_promoted FROM own),
kind AS (SELECT *, CASE WHEN latest = promoted THEN 'Production' WHEN latest = archived THEN 'Archived' ELSE status END AS own_status FROM last),
state AS (SELECT model_name, version, CASE WHEN own_status = 'Production' AND coalesce(family_promoted > latest, false) THEN 'Archived'
    ELSE own_status END AS status, created_at, mae FROM kind)"""
WITH_STATE = EVENTS + f",\n{STATE}\n"
SHOWN = "model_name, version, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, round(mae, 6) AS mae"


def state(t):
    return R.registry_state(t("registry_events"))


def shown(df, *names):
    out = df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return rounded(out.select(*names) if names else out)


# ------------------------------------------------------------------- registry


@query("registry_state", WITH_STATE + f"SELECT {SHOWN} FROM state")
def _(t):
    return shown(state(t))


@query(
    "production_model",
    WITH_STATE
    + f"SELECT {SHOWN} FROM (SELECT * FROM state WHERE status = 'Production' ORDER BY version DESC, created_at DESC, model_name LIMIT 1)",
)
def _(t):
    return shown(R.production_model(state(t)))


@query(
    "production_model_family",
    WITH_STATE
    + f"SELECT {SHOWN} FROM (SELECT * FROM state WHERE status = 'Production' AND lower(model_name) = 'model7' ORDER BY version DESC, created_at DESC LIMIT 1)",
)
def _(t):
    return shown(R.production_model(state(t), " MODEL7 "))


@query(
    "production_per_family",
    WITH_STATE
    + f"""SELECT {SHOWN.replace("status, ", "")} FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC, created_at DESC) AS rn
       FROM state WHERE status = 'Production') WHERE rn = 1""",
)
def _(t):
    return shown(R.production_per_family(state(t)))


@query(
    "registry_summary",
    WITH_STATE
    + """SELECT model_name AS production_model, version, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, round(mae, 6) AS mae,
       (SELECT count(*) FROM state WHERE status = 'Archived') AS archived_models FROM state WHERE status = 'Production'
       ORDER BY state.created_at DESC, version DESC LIMIT 1""",
)
def _(t):
    return shown(R.registry_summary(state(t)))


@query(
    "latest_runs",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, round(value, 6) AS mae FROM
       (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 3)""",
)
def _(t):
    runs = t("events").select("event_id", F.col("ts").alias("created_at"), F.col("value").alias("mae"))
    return shown(R.latest_runs(runs, "created_at", "event_id"))


# Families of six events each with up to three versions.
FAMILIES = """SELECT event_id AS seq, concat('F', CAST(event_id - event_id % 6 AS STRING)) AS model_name, CAST(event_id % 4 AS BIGINT) AS version,
    CASE WHEN event_id % 5 < 3 THEN 'register' WHEN event_id % 5 = 3 THEN 'promote' ELSE 'archive' END AS event,
    CASE WHEN event_id % 5 < 3 THEN 'Staging' END AS status, ts AS created_at, value AS mae FROM {events}"""


@query(
    "latest_per_family",
    f"""WITH registry_events AS ({FAMILIES.replace("{events}", "events")}), {STATE}
SELECT {SHOWN}, versions FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS rn,
    count(*) OVER (PARTITION BY model_name) AS versions FROM state) WHERE rn = 1 AND versions <= 2""",
)
def _(t):
    events = t.spark.sql(FAMILIES, events=t("events"))
    return shown(R.latest_per_family(R.registry_state(events)))


@query(
    "training_history",
    WITH_STATE + f"SELECT {SHOWN.replace('round(mae, 6)', 'round(coalesce(mae, 0), 6)')} FROM state WHERE created_at IS NOT NULL",
)
def _(t):
    return shown(R.training_history(state(t)))


# The event rows themselves as versions of many families: a feed over the whole table.
FEED = """feed AS (SELECT model_name, seq AS version, created_at,
    CASE WHEN seq % 7 < 5 THEN 'Archived' WHEN seq % 7 = 5 THEN 'Production' ELSE 'Staging' END AS status FROM registry_events),
ordered AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, CASE WHEN status = 'Production' THEN 0 ELSE 1 END, model_name, version DESC) AS pos
    FROM feed),
breaks AS (SELECT *, CASE WHEN status = 'Archived' AND lag(status) OVER (ORDER BY pos) = 'Archived'
    AND lag(model_name) OVER (ORDER BY pos) = model_name THEN 0 ELSE 1 END AS fresh FROM ordered),
runs AS (SELECT *, sum(fresh) OVER (ORDER BY pos) AS run FROM breaks),
first_live AS (SELECT model_name, min(pos) AS pos FROM runs WHERE status = 'Production' GROUP BY 1),
happened AS (
    SELECT min(created_at) AS happened_at, 1 AS quiet, CASE WHEN count(*) > 1 THEN count(*) || ' ' || min(model_name) || ' models archived'
        ELSE min(model_name) || ' v' || min(version) || ' archived' END AS label FROM runs WHERE status = 'Archived' GROUP BY run
    UNION ALL SELECT r.created_at, 0, r.model_name || ' v' || version || ' promoted to Production' FROM runs r JOIN first_live USING (model_name, pos)
    UNION ALL SELECT created_at, 1, model_name || ' v' || version || ' staging' FROM runs WHERE status = 'Staging')"""


@query(
    "activity_feed",
    EVENTS
    + f""",\n{FEED}
SELECT row_number() OVER (ORDER BY happened_at DESC, quiet, label) AS position, label, strftime(happened_at, '%Y-%m-%d %H:%M:%S') AS event_time
FROM happened ORDER BY position LIMIT 5""",
)
def _(t):
    status = F.expr("CASE WHEN seq % 7 < 5 THEN 'Archived' WHEN seq % 7 = 5 THEN 'Production' ELSE 'Staging' END")
    rows = t("registry_events").select("model_name", F.col("seq").alias("version"), "created_at", status.alias("status"))
    feed = R.activity_feed(rows)
    return feed.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))


# Two families that take turns in Production: two events, however long the table.
TURNS = "SELECT CASE WHEN seq % 2 = 0 THEN 'Even' ELSE 'Odd' END AS model_name, seq AS version, created_at, 'Production' AS status FROM registry_events"


@query(
    "activity_feed_alternating",
    EVENTS
    + f""", turns AS ({TURNS}),
last_one AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, version DESC) AS rn FROM turns)
SELECT row_number() OVER (ORDER BY created_at DESC, model_name || ' v' || version) AS position,
    model_name || ' v' || version || ' promoted to Production' AS label, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS event_time
FROM last_one WHERE rn = 1""",
)
def _(t):
    family = F.when(F.col("seq") % 2 == 0, "Even").otherwise("Odd")
    rows = t("registry_events").select(
        family.alias("model_name"), F.col("seq").alias("version"), "created_at", F.lit("Production").alias("status")
    )
    return R.activity_feed(rows).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))


@query(
    "dataset_summary",
    with_views("dirty_orders")
    + "\n"
    + union_sql(
        [
            f"SELECT 'dirty_orders' AS dataset, count(*) AS rows, 12 AS columns, '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM dirty_orders"
            for c in ("order_value", "promo_code", "order_time", "drop_lat", "delivery_minutes")
        ]
    ),
)
def _(t):
    return R.dataset_summary(t("dirty_orders"), "dirty_orders")


def logged(t):
    """One experiment record per model and version of the events, written and read back."""
    path = f"{scratch(t)}/experiments"
    runs = (
        t("registry_events")
        .groupBy("model_name", "version")
        .agg(F.max("created_at").alias("ts"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("runs"))
    )
    records = runs.select(
        F.concat_ws("-", "model_name", "version").alias("experiment_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "model_name",
        F.lit("default").alias("dataset_version"),
        F.create_map(F.lit("runs"), F.col("runs").cast("string")).alias("hyperparameters"),
        F.create_map(F.lit("mae"), F.col("mae")).alias("metrics"),
        F.col("runs").cast("double").alias("training_time_seconds"),
        F.col("version").alias("model_version"),
    )
    L.experiment_append(records, path)
    return path


@query(
    "experiment_list",
    EVENTS
    + """\nSELECT model_name || '-' || version AS experiment_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS timestamp, model_name,
       'default' AS dataset_version, '{"runs":"' || count(*) || '"}' AS hyperparameters, round(avg(mae), 6) AS mae,
       CAST(count(*) AS DOUBLE) AS training_time_seconds, version AS model_version FROM registry_events GROUP BY model_name, version""",
)
def _(t):
    return rounded(L.experiment_flat(L.experiment_list(t.spark, logged(t)), ["mae"]))


@query(
    "experiment_log",
    EVENTS
    + """\nSELECT model_name || '-' || version AS experiment_id, round(avg(mae), 4) AS mae FROM registry_events
       WHERE model_name = 'Model7' AND version = 7 GROUP BY model_name, version""",
)
def _(t):
    found = L.experiment_get(t.spark, logged(t), "Model7-7")
    return rounded(L.experiment_flat(found, ["mae"]).select("experiment_id", "mae"), 4)


# ----------------------------------------------------------------- evaluation

SCORED = with_views("scored") + "\n"
METRICS_SQL = """SELECT model_name, count(*) AS rows, avg(abs(y - prediction)) AS mae, sqrt(avg((y - prediction) * (y - prediction))) AS rmse,
    1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2,
    avg(abs(y - prediction) / greatest(abs(y), 1e-8) * 100) AS mape FROM scored GROUP BY model_name"""
ROUND_METRICS = "model_name, rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(mape, 6) AS mape"


def metrics(t):
    return M.regression_metrics(t("scored"), "y", "prediction", ["model_name"])


@query("regression_metrics", SCORED + f"SELECT {ROUND_METRICS} FROM ({METRICS_SQL})")
def _(t):
    return rounded(metrics(t))


@query(
    "leaderboard",
    SCORED + f"SELECT {ROUND_METRICS}, row_number() OVER (ORDER BY r2 DESC, model_name) AS model_rank FROM ({METRICS_SQL})",
)
def _(t):
    return rounded(M.leaderboard(metrics(t), "r2"))


@query(
    "best_model",
    SCORED
    + f"SELECT model_name, 'mae' AS ranking_metric, round(mae, 6) AS metric_value FROM ({METRICS_SQL}) ORDER BY mae, model_name LIMIT 1",
)
def _(t):
    return rounded(M.best_model(M.leaderboard(metrics(t), "mae"), "mae"))


FOLD_SQL = "CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '-42'), 1, 4) AS INTEGER) % 5"


@query(
    "fold_summary",
    SCORED
    + f"""SELECT model_name, count(*) AS folds, {", ".join(f"round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS std_{m}" for m in M.METRICS)}
       FROM ({METRICS_SQL.replace("SELECT model_name,", f"SELECT model_name, {FOLD_SQL} AS fold,").replace("GROUP BY model_name", "GROUP BY 1, 2")}) GROUP BY model_name""",
)
def _(t):
    folded = t("scored").withColumn("fold", M.fold_of(F.col("id"), 5))
    return rounded(M.fold_summary(M.regression_metrics(folded, "y", "prediction", ["model_name", "fold"])))


# ------------------------------------------------------------------- training

INPUTS = ["id", "prep_capacity", "current_load", "order_size", "order_value", "avg_rating", "return_flag", "charge"]


def training_table(t):
    return t("deliveries").select(*INPUTS)


def split_tables(t):
    df = training_table(t)
    is_test = G.split_bucket(F.col("id")) < int(65536 * 0.2)
    return df.where(~is_test), df.where(is_test)


# What the preprocessor must find on the training rows: no two of these features are close, and all vary.
FITTED = ["prep_capacity", "current_load", "order_size", "order_value", "avg_rating"]
FLAGS = ["A", "N", "R"]
FIT_SQL = (
    with_views("deliveries")
    + """, parts AS (SELECT *, CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '-42'), 1, 4) AS INTEGER) < 13107 AS held FROM deliveries),
"""
)


def fitted(t):
    train, test = split_tables(t)
    return TablePreprocessor(labelCol="charge", ignoredCols=["id"]).fit(train), test


@query(
    "preprocess_fit",
    FIT_SQL.rstrip().rstrip(",")
    + union_sql(
        [
            f"\nSELECT {i} AS position, '{c}' AS feature, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS sigma, "
            f"round((median({c}) - avg({c})) / stddev_pop({c}), 5) AS median FROM parts WHERE NOT held"
            for i, c in enumerate(FITTED)
        ]
        + [
            f"\nSELECT {len(FITTED) + i} AS position, 'return_flag_{v}' AS feature, NULL::DOUBLE AS mean, NULL::DOUBLE AS sigma, NULL::DOUBLE AS median"
            for i, v in enumerate(FLAGS)
        ]
    ),
)
def _(t):
    model, _ = fitted(t)
    s = model.state_value
    rows = [(i, n, *(s["scale"].get(n) or (None, None)), s["medians"].get(n)) for i, n in enumerate(model.feature_names)]
    return rounded(t.spark.createDataFrame(rows, "position int, feature string, mean double, sigma double, median double"), 5)


@query(
    "preprocess_transform",
    FIT_SQL
    + "stats AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, median({c}) AS d_{c}" for c in FITTED)
    + " FROM parts WHERE NOT held)\nSELECT id, "
    + ", ".join(f"round((coalesce({c}, d_{c}) - m_{c}) / s_{c}, 5) AS {c}" for c in FITTED)
    + ", "
    + ", ".join(f"CASE WHEN return_flag = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS return_flag_{v}" for v in FLAGS)
    + " FROM parts, stats WHERE held",
)
def _(t):
    model, test = fitted(t)
    cells = vector_to_array("features")
    out = model.transform(test).select("id", *[cells[i].alias(f"f{i}") for i in range(len(model.feature_names))])
    return rounded(out.toDF("id", *model.feature_names), 5)


@query("train_regressor")
def _(t):
    train, test = split_tables(t)
    model = M.train_regressor("LinearRegression", train, "charge", ["id"])
    return rounded(M.regression_metrics(model.transform(test), "charge"))


@query("train_regressor_forest")
def _(t):
    train, test = split_tables(t)
    model = M.train_regressor("RandomForestRegressor", train, "charge", ["id"], numTrees=10)
    return rounded(M.regression_metrics(model.transform(test), "charge"))


@query("train_regressor_boosted")
def _(t):
    train, test = split_tables(t)
    model = M.train_regressor("XGBRegressor", train, "charge", ["id"], maxIter=5, maxDepth=3, subsamplingRate=0.8)
    return rounded(M.regression_metrics(model.transform(test), "charge"))


@query("global_importance")
def _(t):
    train, _ = split_tables(t)
    model = M.train_regressor("LinearRegression", train, "charge", ["id"])
    return Z.global_importance(t.spark, model.stages[-1], model.stages[0].feature_names)


@query("save_load_model")
def _(t):
    train, test = split_tables(t)
    model = M.train_regressor("LinearRegression", train, "charge", ["id"])
    path, _ = M.save_model(model, t.spark, scratch(t), "LinearRegression")
    again = M.load_model(path).transform(test).select("id", F.round("prediction", 6).alias("prediction"))
    return again


# A label that is an exact linear function, so that what a linear fit must predict is known.
EXACT_VIEW = (
    with_views("deliveries")
    + """, exact AS (SELECT id, coalesce(order_size, 0) AS a, coalesce(prep_capacity, 0) AS b,
    7 + 3 * coalesce(order_size, 0) - 0.5 * coalesce(prep_capacity, 0) AS charge,
    CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '-42'), 1, 4) AS INTEGER) < 13107 AS held FROM deliveries)
"""
)


def exact_tables(t):
    a, b = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("order_size", "prep_capacity"))
    df = t("deliveries").select("id", a.alias("a"), b.alias("b"), (7 + 3 * a - 0.5 * b).alias("charge"))
    held = G.split_bucket(F.col("id")) < int(65536 * 0.2)
    return df.where(~held), df.where(held)


def _exact_metrics(t, name, **params):
    train, test = exact_tables(t)
    return M.regression_metrics(M.train_regressor(name, train, "charge", ["id"], **params).transform(test), "charge")


@query(
    "train_regressor_exact",
    EXACT_VIEW + "SELECT count(*) AS rows, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS mape FROM exact WHERE held",
)
def _(t):
    return rounded(_exact_metrics(t, "LinearRegression"), 4)


RUN_TIMES = ("2026-03-01 10:00:00", "2026-03-02 10:00:00", "2026-03-03 10:00:00")


def recorded_runs(t):
    """Three runs in one folder: the linear model wins the first and the last, boosted trees are alone in the second.

    Every call is made twice; the second adds nothing. The runs share their tables in
    memory and the preprocessing.
    """
    train, test = exact_tables(t)
    folder = scratch(t)
    boosted = {"GradientBoostingRegressor": {"maxIter": 5}}
    with M.prepared(train, "charge", "id") as ready, M.kept_in_memory(test, drawn=False) as held:
        for run_id, models, at in zip("abc", ({"LinearRegression": {}, **boosted}, boosted, {"LinearRegression": {}}), RUN_TIMES):
            for _ in range(2):
                M.training_run(ready, held, "charge", "id", folder, models, run_id=run_id, created_at=at)
    return M.Ledger(t.spark, folder)


@query(
    "training_run",
    EXACT_VIEW
    + """, told(run_id, model_name, model_rank, version, status, created_at, linear) AS (VALUES
    ('a', 'LinearRegression', 1, 1, 'Archived', '2026-03-01 10:00:00', true), ('a', 'GradientBoostingRegressor', 2, NULL, NULL, NULL, false),
    ('b', 'GradientBoostingRegressor', 1, 1, 'Production', '2026-03-02 10:00:00', false),
    ('c', 'LinearRegression', 1, 2, 'Archived', '2026-03-03 10:00:00', true))
SELECT run_id, model_name, model_rank, version::BIGINT AS version, status, created_at, linear AS exact_fit,
    (SELECT count(*) FROM exact WHERE held) AS rows FROM told""",
)
def _(t):
    ledger = recorded_runs(t)
    events = ledger.table("events")
    state = R.registry_state(events.drop("run_id")).select("model_name", "version", "status", "created_at")
    made = events.where("event = 'register'").select("run_id", "model_name", "version").join(state, ["model_name", "version"])
    out = ledger.table("leaderboards").join(made, ["run_id", "model_name"], "left")
    return shown(out.withColumn("exact_fit", F.col("mae") < 1e-6), "run_id", "model_name", "model_rank", "version", "status", "created_at", "exact_fit", "rows")


@query(
    "training_run_experiments",
    EXACT_VIEW
    + """, weights(feature, importance, importance_rank) AS (
    SELECT 'a', 3 * stddev_pop(a), 1 FROM exact WHERE NOT held UNION ALL SELECT 'b', 0.5 * stddev_pop(b), 2 FROM exact WHERE NOT held)
SELECT id AS experiment_id, '2026-03-0' || day || ' 10:00:00' AS timestamp, 'LinearRegression' AS model_name, 'default' AS dataset_version,
    '{"selected_model":"LinearRegression"}' AS hyperparameters, 0.0::DOUBLE AS mae, 1.0::DOUBLE AS r2, version AS model_version,
    feature, round(importance, 3)::DOUBLE AS importance, importance_rank
FROM (VALUES ('a', 1, 1), ('c', 3, 2)) AS runs(id, day, version), weights""",
)
def _(t):
    ledger = recorded_runs(t)
    flat = L.experiment_flat(L.experiment_list(t.spark, f"{ledger.folder}/experiments"), ["mae", "r2"])
    linear = flat.where(F.col("model_name") == M.BASELINE_MODEL).drop("training_time_seconds")
    weights = ledger.table("importances").select(F.col("run_id").alias("experiment_id"), "feature", "importance", "importance_rank")
    return rounded(linear.join(weights, "experiment_id"), 3)


@query(
    "cross_validate",
    EXACT_VIEW
    + f"""SELECT 'LinearRegression' AS model_name, {FOLD_SQL} AS fold, count(*) AS rows, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 1.0::DOUBLE AS r2,
    0.0::DOUBLE AS mape FROM exact GROUP BY fold""",
)
def _(t):
    train, test = exact_tables(t)
    return rounded(M.cross_validate("LinearRegression", train.unionByName(test), "charge", "id", folds=5), 4)


# Without a constant, a model of centred features predicts the label less its mean among the rows it was fitted to.
@query(
    "grid_search",
    EXACT_VIEW
    + f""", parts AS (SELECT charge, {FOLD_SQL.replace("% 5", "% 2")} AS fold FROM exact),
sizes AS (SELECT fold, avg(charge) AS mean FROM parts GROUP BY fold),
errors AS (SELECT p.fold, avg(abs(s.mean)) AS mae FROM parts p JOIN sizes s ON s.fold <> p.fold GROUP BY p.fold)
SELECT 'LinearRegression' AS model_name, 1 AS config_rank, '{{"fitIntercept": true}}' AS parameters, 0.0::DOUBLE AS mean_mae
UNION ALL SELECT 'LinearRegression', 2, '{{"fitIntercept": false}}', round(avg(mae), 4) FROM errors""",
)
def _(t):
    train, test = exact_tables(t)
    return rounded(M.grid_search("LinearRegression", train.unionByName(test), "charge", "id", folds=2).ranked, 4)


@query(
    "batch_score",
    EXACT_VIEW
    + """SELECT id, a, b, charge, round(charge, 4)::DOUBLE AS prediction, 'LinearRegression' AS model_name, 1 AS model_version
FROM exact WHERE held""",
)
def _(t):
    train, test = exact_tables(t)
    model = M.train_regressor("LinearRegression", train, "charge", ["id"])
    path, version = M.save_model(model, t.spark, scratch(t), "LinearRegression")
    return M.batch_score(test, path, "LinearRegression", version).withColumn("prediction", F.round("prediction", 4))


# Twelve features of falling weight: the label is linear in them, and each has its own spread.
WEIGHED = 12


def weighed_table(t):
    parts = [F.pmod(F.floor(F.col("id") * (i + 3) / F.lit(7)), F.lit(11)).cast("double").alias(f"f{i:02d}") for i in range(WEIGHED)]
    label = sum((F.col(f"f{i:02d}") * (2.0 ** (WEIGHED - i)) for i in range(WEIGHED)), F.lit(0.0))
    return t("deliveries").select("id", *parts).withColumn("charge", label)


WEIGHED_SQL = (
    with_views("deliveries")
    + ", weighed AS (SELECT "
    + ", ".join(f"floor(id * {i + 3} / 7)::BIGINT % 11 AS f{i:02d}" for i in range(WEIGHED))
    + " FROM deliveries), weights AS ("
    + union_sql([f"SELECT 'f{i:02d}' AS feature, {2 ** (WEIGHED - i)} * stddev_pop(f{i:02d}) AS importance FROM weighed" for i in range(WEIGHED)])
    + ")\n"
)


@query(
    "importance_top10",
    WEIGHED_SQL
    + """SELECT feature, round(importance, 1)::DOUBLE AS importance, row_number() OVER (ORDER BY importance DESC) AS importance_rank,
    'coefficients' AS method FROM weights QUALIFY importance_rank <= 10""",
)
def _(t):
    model = M.train_regressor("LinearRegression", weighed_table(t), "charge", ["id"])
    table = Z.global_importance(t.spark, model.stages[-1], model.stages[0].feature_names)
    return rounded(Z.importance_top(table, 10), 1)


@query(
    "importance_rank",
    WEIGHED_SQL + f"SELECT feature, 1 AS importance_rank, {WEIGHED} AS features, true AS adds_up FROM weights ORDER BY importance DESC LIMIT 1",
)
def _(t):
    df = weighed_table(t)
    table = importance_rank(df, [f"f{i:02d}" for i in range(WEIGHED)], "charge", trees=10)
    total = table.agg(F.count(F.lit(1)).cast("int").alias("features"), (F.round(F.sum("importance"), 6) == 1).alias("adds_up"))
    return table.where("importance_rank = 1").select("feature", "importance_rank").crossJoin(F.broadcast(total))  # one row each


BETTER = EXACT_VIEW + "SELECT count(*) AS rows, true AS better_than_mean, true AS finite FROM exact WHERE held"


def _invariants(metrics):
    return metrics.select("rows", (F.col("r2") > 0.5).alias("better_than_mean"), (~F.isnan("rmse")).alias("finite"))


@query("forest_invariants", BETTER)
def _(t):
    return _invariants(_exact_metrics(t, "RandomForestRegressor", numTrees=10))


@query("boosted_invariants", BETTER)
def _(t):
    return _invariants(_exact_metrics(t, "XGBRegressor", maxIter=8, maxDepth=3))


@query("importance_invariants", "SELECT 'a' AS feature, 1 AS importance_rank, true AS adds_up")
def _(t):
    train, _ = exact_tables(t)
    table = importance_rank(train.withColumn("c", F.pmod("id", F.lit(7)).cast("double")), ["a", "b", "c"], "charge", trees=10)
    total = table.agg(F.round(F.sum("importance"), 6).alias("total"))
    return table.where("importance_rank = 1").crossJoin(F.broadcast(total)).select(  # one row each
        "feature", "importance_rank", (F.col("total") == 1).alias("adds_up")
    )


@query("save_load_exact", EXACT_VIEW + "SELECT id, round(charge, 4)::DOUBLE AS prediction FROM exact WHERE held")
def _(t):
    train, test = exact_tables(t)
    path, _ = M.save_model(M.train_regressor("LinearRegression", train, "charge", ["id"]), t.spark, scratch(t), "LinearRegression")
    return M.load_model(path).transform(test).select("id", F.round("prediction", 4).alias("prediction"))


@query(
    "monitor_stream",
    with_views("deliveries")
    + """
SELECT 0 AS batch_id, count(charge) AS prediction_count, round(avg(charge), 4) AS mean_prediction,
    round(stddev_pop(charge), 4) AS std_prediction, round(min(charge), 4) AS min_prediction, round(max(charge), 4) AS max_prediction,
    2 * count(*) - count(order_size) - count(discount) AS missing_inputs,
    count(*) FILTER (WHERE order_size < 1 OR order_size > 45) AS out_of_range_inputs FROM deliveries""",
)
def _(t):
    from millrace.operators.monitor import drift_baseline
    from millrace.streaming.monitoring import monitor_stream

    folder = scratch(t)
    source = t("deliveries").select("id", "order_size", "discount", F.col("charge").alias("prediction"))
    source.write.mode("overwrite").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    baseline = drift_baseline(source, ["order_size", "discount"])
    monitor_stream(
        stream, "prediction", f"{folder}/out", f"{folder}/state", ["order_size", "discount"], {"order_size": (1, 45)}, baseline
    ).awaitTermination()
    return rounded(t.spark.read.parquet(f"{folder}/out/monitoring").drop("batch"), 4)


