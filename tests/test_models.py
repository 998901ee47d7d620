import hashlib
import random

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from millrace.functions import ranking
from millrace.operators import experiments as L
from millrace.operators import explain as Z
from millrace.operators import monitor as W
from millrace.operators import registry as R
from millrace.operators import train as M
from millrace.operators.preprocess import TablePreprocessor, TablePreprocessorModel
from millrace.sources import checksums, files, sinks
from millrace.streaming.monitoring import monitor_stream

EVENTS = "seq long, model_name string, version long, event string, status string, created_at timestamp, mae double"


def events(spark, entries):
    data = [(i, m, v, e, s, None, 1.0 * i) for i, (m, v, e, s) in enumerate(entries)]
    return spark.createDataFrame(data, EVENTS)


def test_promotion_archives_the_previous_version(spark):
    state = R.registry_state(
        events(spark, [("A", 1, "register", "Staging"), ("A", 1, "promote", None), ("A", 2, "register", "Staging"),
                       ("A", 2, "promote", None), ("B", 1, "register", "Production")])
    )
    got = rows(state.select("model_name", "version", "status"), "model_name", "version")
    assert got == [("A", 1, "Archived"), ("A", 2, "Production"), ("B", 1, "Production")]
    assert R.production_model(state, " a ").first()["version"] == 2


def test_invalid_events_are_rejected(spark):
    state = R.registry_state(
        events(spark, [("A", 1, "promote", None), ("A", 1, "register", "Staging"), ("A", 1, "register", "Production"),
                       ("A", 0, "register", "Staging"), ("C", 3, "archive", None)])
    )
    assert rows(state.select("model_name", "version", "status")) == [("A", 1, "Staging")]


def brute_state(entries):
    known = {}
    for model, version, event, status in entries:
        key = (model, version)
        if event == "register":
            if version >= 1 and key not in known:
                known[key] = status
        elif key in known and event == "archive":
            known[key] = "Archived"
        elif key in known:
            for other in known:
                if other[0] == model and other != key and known[other] == "Production":
                    known[other] = "Archived"
            known[key] = "Production"
    return sorted((m, v, s) for (m, v), s in known.items())


@pytest.mark.parametrize("seed, small_rows", [(0, 100_000), (1, 100_000), (2, -1)])
def test_state_equals_replay(spark, monkeypatch, seed, small_rows):
    """With a bound below zero every table counts as large, and the rows are salted."""
    monkeypatch.setattr(R, "lookup", lambda *a: ranking.lookup(*a, limit=small_rows))
    rng = random.Random(seed)
    entries = [
        (rng.choice("AAAB"), rng.randint(0, 5), rng.choice(["register", "promote", "archive"]), rng.choice(["Staging", "Production"]))
        for _ in range(60)
    ]
    state = R.registry_state(events(spark, entries))
    assert rows(state.select("model_name", "version", "status"), "model_name", "version") == brute_state(entries)


def brute_feed(entries, k=5):
    order = sorted(entries, key=lambda e: (-e[2], e[3] != "Production", e[0], -e[1]))
    out, run, live = [], None, set()

    def close():
        if run:
            label = f"{run[1]} {run[0]} models archived" if run[1] > 1 else f"{run[0]} v{run[3]} archived"
            out.append((-run[2], 1, label))

    for model, version, at, status in order:
        if status == "Archived":
            if run and run[0] == model:
                run = (model, run[1] + 1, at, version)
            else:
                close()
                run = (model, 1, at, version)
            continue
        close()
        run = None
        if status == "Production":
            if model not in live:
                live.add(model)
                out.append((-at, 0, f"{model} v{version} promoted to Production"))
        else:
            out.append((-at, 1, f"{model} v{version} {status.lower()}"))
    close()
    return [e[2] for e in sorted(out)[:k]]


@pytest.mark.parametrize("chunk, archived_share", [(1000, 0.5), (3, 0.5), (3, 0.95), (7, 0.9), (2, 1.0)])
def test_feed_equals_walk(spark, chunk, archived_share):
    rng = random.Random(chunk)
    entries = [
        (rng.choice("AAAAAB"), i, rng.randint(0, 60), "Archived" if rng.random() < archived_share else rng.choice(["Production", "Staging"]))
        for i in range(80)
    ]
    df = spark.createDataFrame(entries, "model_name string, version long, at long, status string")
    df = df.select("model_name", "version", F.timestamp_seconds("at").alias("created_at"), "status")
    got = [r["label"] for r in R.activity_feed(df).orderBy("position").collect()]
    assert got == brute_feed(entries)


def test_metrics(spark):
    exact = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "y double, prediction double")
    assert tuple(M.regression_metrics(exact, "y").first()) == (3, 0.0, 0.0, 1.0, 0.0)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, prediction double")
    assert M.regression_metrics(flat, "y").first()["r2"] == 0.0


def test_leaderboard(spark):
    results = spark.createDataFrame(
        [("A", 2.0, 3.0, 0.7, 8.0), ("B", 1.0, 2.0, 0.8, 5.0), ("C", 3.0, 4.0, 0.6, 10.0)],
        "model_name string, mae double, rmse double, r2 double, mape double",
    )
    for metric in ("mae", "r2"):
        board = M.leaderboard(results, metric)
        assert [r["model_name"] for r in board.orderBy("model_rank").collect()] == ["B", "A", "C"]
        assert M.best_model(board, metric).first()["model_name"] == "B"
    with pytest.raises(ValueError):
        M.leaderboard(results, "speed")


def lifecycle(spark):
    train = spark.createDataFrame(
        [(i, "ABAC"[i % 4], float(i % 50), f"2026-01-{1 + i % 28:02d}T0{i % 10}:00:00", f"w{i % 15}", 2.0 * (i % 50) + 1) for i in range(200)],
        "id int, category string, value double, ts string, word string, label double",
    )
    test = spark.createDataFrame(
        [(1, "D", 4.0, "2026-02-01T00:00:00", "w1", 9.0), (2, "E", None, None, "new", 1.0)], train.schema
    )
    return train, test


def test_preprocessor(spark, tmp_path):
    train, test = lifecycle(spark)
    model = TablePreprocessor(labelCol="label", ignoredCols=["id"]).fit(train)
    assert {"value", "category_A", "word", "ts_hour"} <= set(model.feature_names)
    vectors = [r["features"].toArray() for r in model.transform(test).orderBy("id").collect()]
    at = model.feature_names.index
    assert all(v[at("category_A")] == 0 for v in vectors)
    assert vectors[1][at("word")] == -1
    # The null is filled by the median, in scaled terms.
    stats = train.agg(F.avg("value"), F.stddev_pop("value"), F.median("value")).first()
    assert vectors[1][at("value")] == pytest.approx((stats[2] - stats[0]) / stats[1])
    model.write().save(f"{tmp_path}/pre")
    again = TablePreprocessorModel.read().load(f"{tmp_path}/pre")
    assert [r["features"] for r in again.transform(test).orderBy("id").collect()] == [
        r["features"] for r in model.transform(test).orderBy("id").collect()
    ]
    with pytest.raises(ValueError, match="missing \\['value'\\]"):
        model.transform(test.drop("value"))
    with pytest.raises(ValueError, match="extra \\['more'\\]"):
        model.transform(test.withColumn("more", F.lit(1)))


def test_training_run(spark, tmp_path):
    train, test = lifecycle(spark)
    models = {"LinearRegression": {}, "RandomForestRegressor": {"numTrees": 3}}
    run = M.training_run(train, train, "label", "id", str(tmp_path), models)
    assert run.best == "LinearRegression" and run.status == "Archived" and run.version == 1
    scored = M.batch_score(test, run.path, run.best, run.version)
    assert scored.where("prediction IS NULL").count() == 0 and "model_version" in scored.columns
    state = R.registry_state(run.registry_events(spark, 1, "2026-01-01 00:00:00"))
    assert state.first()["status"] == "Archived"
    assert M.next_version(spark, str(tmp_path), "LinearRegression") == 2


def test_folds_and_search(spark):
    train, _ = lifecycle(spark)
    slim = train.select("id", "value", "label")
    folds = M.cross_validate("LinearRegression", slim, "label", "id", folds=3)
    summary = M.fold_summary(folds).first()
    assert folds.agg(F.sum("rows")).first()[0] == 200 and summary["folds"] == 3 and summary["mean_r2"] > 0.99
    search = M.grid_search("LinearRegression", slim, "label", "id", {"fitIntercept": [True, False]}, folds=2)
    assert search.ranked.count() == 2 and search.model.transform(slim).count() == 200
    with pytest.raises(ValueError, match="unknown model"):
        M.make_estimator("Nope", "label")


def test_drift(spark):
    base = W.drift_baseline(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "f double"))
    near = spark.createDataFrame([(x + 0.1,) for x in (1, 2, 3, 4)], "f double")
    far = spark.createDataFrame([(float(x),) for x in (10, 11, 12, 13)], "f double")
    assert not W.drift_any(W.drift_scan(base, near)).first()["drift_detected"]
    assert W.drift_any(W.drift_scan(base, far)).first()["drifted_features"] == 1


def test_monitoring(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (3.0, 50.0)], "prediction double, x double")
    row = W.monitor_batch(df, "prediction", ["x"], {"x": (0, 10)}).first()
    assert (row["prediction_count"], row["mean_prediction"], row["missing_inputs"], row["out_of_range_inputs"]) == (3, 2.0, 1, 1)
    assert row["std_prediction"] == pytest.approx((2 / 3) ** 0.5)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    baseline = W.drift_baseline(df, ["x"])
    for _ in range(2):  # a restart adds nothing
        monitor_stream(stream, "prediction", f"{tmp_path}/out", f"{tmp_path}/cp", ["x"], {"x": (0, 10)}, baseline).awaitTermination()
    records = spark.read.parquet(f"{tmp_path}/out/monitoring")
    assert records.agg(F.sum("prediction_count")).first()[0] == 3
    assert spark.read.parquet(f"{tmp_path}/out/drift").count() == 1


def test_explanations(spark):
    df = spark.createDataFrame([(1, 2.0, -3.0, None)], "id int, a_b double, c double, d double")
    weights = {"a_b": 0.5, "c": 0.4, "d": 0.1}
    ranked = rows(Z.rank_impacts(df, "id", weights).select("feature", "impact_rank"), "impact_rank")
    assert ranked == [("c", 1), ("a_b", 2), ("d", 3)]
    text = Z.explain_text(df, "id", weights).first()["explanation"]
    assert text == "The prediction is primarily influenced by c (decreasing), and a b (increasing), and d (decreasing)."
    confidence = Z.explain_confidence(df, "id", weights).first()
    assert confidence["confidence"] == round((1.2 + 1.0) / 3, 4)
    assert confidence["uncertainty"] == round(1 - (1.2 + 1.0) / 3, 4)
    widths = {r["feature"]: (r["direction"], r["width_pct"]) for r in Z.contribution_width(df, "id", weights).collect()}
    assert widths["c"] == ("-", 100.0) and widths["d"][1] == 8.0
    table = Z.importance_table(spark, weights, "coefficients")
    assert rows(Z.importance_top(table, 1).select("feature")) == [("a_b",)]
    assert Z.model_weights(object(), ["x", "y"]) == ({"x": 0.5, "y": 0.5}, "fallback")


def test_experiments(spark, tmp_path):
    record = ("e1", "2026-01-01", "A", "default", {"depth": "3"}, {"mae": 1.5}, 0.5, 1)
    L.experiment_log(spark, f"{tmp_path}/log", [record])
    L.experiment_log(spark, f"{tmp_path}/log", [("e2", "2026-01-02", "B", "default", {}, {}, 0.1, 1)])
    assert [r["experiment_id"] for r in L.experiment_list(spark, f"{tmp_path}/log").collect()] == ["e1", "e2"]
    flat = L.experiment_flat(L.experiment_get(spark, f"{tmp_path}/log", "e1"), ["mae"]).first()
    assert flat["mae"] == 1.5 and flat["hyperparameters"] == '{"depth":"3"}'


def test_sources(spark, tmp_path):
    (tmp_path / "Raw Data").mkdir()
    (tmp_path / "Raw Data" / "My Orders.csv").write_text("id,v\n1,a\n2,b\n")
    df = files.scan_csv(spark, f"{tmp_path}/Raw Data/My Orders.csv")
    assert df.count() == 2 and dict(df.dtypes)["id"] == "int"
    slug = spark.createDataFrame([("Raw Data/My Orders.csv",), ("x.CSV",)], "p string")
    assert [r[0] for r in slug.select(files.dataset_slug(F.col("p"))).collect()] == ["raw_data_my_orders", "x"]
    found = files.scan_discover(spark, str(tmp_path))
    assert found.count() == 1
    with pytest.raises(FileNotFoundError, match="nope"):
        files.scan_required_tables(spark, str(tmp_path), ["nope"])
    assert files.manifest_read(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "manifest.json").write_text(
        '{"manifest": [{"decision_id": "DEC-001", "dataset_id": "orders", "column": "v", "action": "IMPUTE",'
        ' "priority": "HIGH", "confidence": 0.9, "rationale": "r", "status": "APPROVED", "details": {"a": "b"}}]}'
    )
    entry = files.manifest_read(spark, f"{tmp_path}/manifest.json").first()
    assert (entry["dataset"], entry["action"], entry["details"]) == ("orders", "IMPUTE", {"a": "b"})
    checks = sinks.file_checksums(spark, f"{tmp_path}/manifest.json").first()
    assert len(checks["sha256"]) == 64


def test_large_files_are_hashed_in_ranges(spark, tmp_path, monkeypatch):
    """Files over several ranges and splits, with or without a newline or a byte order mark at their ends."""
    rng = random.Random(5)
    monkeypatch.setattr(checksums, "RANGE_BYTES", 60_000)
    noise = rng.randbytes(200_000)
    contents = {
        "a b%20c.bin": noise, "ends.bin": noise + b"\n", "blank.bin": b"\n" * 70_001, "mark.bin": b"\xef\xbb\xbf" + noise,
        "both.bin": b"\xef\xbb\xbf\n" + noise[:70_000] + b"\r\n", "zero.bin": b"\0" * 90_000, "packed.gz": noise,
        "sub/[x] {y}.bin": noise[7:], "sub/ends.bin": b"\n" + noise[:60_000], "border.bin": noise[:120_000],
        "whole.bin": noise[:60_000], "small.bin": b"x",
    }
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    want = sorted((n.rsplit("/")[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items())
    # Spark refuses to read a file above this limit whole.
    for pattern, split, limit in (("*", "128m", 2**31 - 1), ("*.bin", "19001b", checksums.RANGE_BYTES)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit)
        try:
            got = rows(sinks.file_checksums(spark, str(tmp_path / "in"), pattern), "file", "bytes")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        assert got == [w for w in want if pattern == "*" or w[0].endswith(".bin")]


def test_sampling(spark):
    df = spark.range(1000)
    one, two = files.sample_rows(df, "id", 50), files.sample_rows(df.repartition(7), "id", 50)
    assert one.count() == 50 and one.exceptAll(two).count() == 0


def test_folds_from_sums_equal_refits(spark):
    """Nulls, a constant, a feature close to another, timestamps and categories; with and without intercept."""
    rng = random.Random(4)
    rows_ = []
    for i in range(400):
        a, b = rng.gauss(50, 9), rng.random() * 1e6
        ts = f"2026-01-{1 + i % 28:02d}T{i % 24:02d}:00:00"
        label = 3 * a - b / 1e5 + rng.gauss(0, 4) + (i % 3)
        rows_.append((i, None if i % 7 == 0 else a, b, 2 * b + 1, 5.0, "xyz"[i % 3], ts, i % 5 == 0, None if i % 50 == 3 else label))
    df = spark.createDataFrame(rows_, "id long, a double, b double, near double, flat double, kind string, ts string, flag boolean, label double")
    numbered = df.withColumn("__fold", M.fold_of(F.col("id"), 3))
    for fit in (True, False):
        got = rows(M.cross_validate("LinearRegression", df, "label", "id", folds=3, fitIntercept=fit).drop("model_name"), "fold")
        want = rows(M.refitted_folds("LinearRegression", numbered, "label", "id", 3, fitIntercept=fit).drop("model_name"), "fold")
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for g, w in zip(got, want):
            assert g[2:] == pytest.approx(w[2:], rel=1e-4)
    search = M.grid_search("LinearRegression", df, "label", "id", {"fitIntercept": [False, True]}, folds=3)
    assert [r["parameters"] for r in search.ranked.orderBy("config_rank").collect()][0] == '{"fitIntercept": true}'


def test_runs_are_recorded_once(spark, tmp_path, monkeypatch):
    train, test = lifecycle(spark)
    train, test = (d.select("id", "category", "value", "label") for d in (train, test.where("value is not null")))
    folder = str(tmp_path / "runs")
    call = lambda run_id, **k: M.training_run(train, test, "label", "id", folder, {"LinearRegression": {}}, run_id=run_id, **k)
    ledger = M.Ledger(spark, folder)
    assert ledger.table("events").count() == 0

    # An interrupted run leaves no events; the next call with its id finishes it without a second experiment.
    add = M.Ledger.add
    monkeypatch.setattr(M.Ledger, "add", lambda self, name, df: 1 / 0 if name == "events" else add(self, name, df))
    with pytest.raises(ZeroDivisionError):
        call("one", folds=2)
    monkeypatch.setattr(M.Ledger, "add", add)
    assert ledger.table("experiments").count() == 1 and ledger.finished("one") is None
    first = call("one", folds=2)
    held = {name: rows(ledger.table(name), *M.LEDGER_KEYS[name]) for name in M.LEDGER}
    assert len(held["experiments"]) == 1 and len(held["events"]) == 2 and len(held["folds"]) == 2 and len(held["leaderboards"]) == 1

    monkeypatch.setattr(M, "train_regressor", lambda *a, **k: pytest.fail("a complete run is not trained again"))
    again = call("one", folds=2)
    monkeypatch.undo()
    assert again.repeated and not first.repeated
    assert (again.best, again.version, again.status, again.path) == (first.best, first.version, first.status, first.path)
    assert {name: rows(ledger.table(name), *M.LEDGER_KEYS[name]) for name in M.LEDGER} == held
    assert call("two").version == 2
    state = R.registry_state(ledger.table("events").drop("run_id"))
    assert rows(state.select("model_name", "version", "status"), "version") == [("LinearRegression", 1, "Archived"), ("LinearRegression", 2, "Archived")]
    assert rows(L.experiment_list(spark, f"{folder}/experiments").select("experiment_id", "model_version"), "model_version") == [("one", 1), ("two", 2)]
    assert sinks.append_once(ledger.table("events").limit(1), f"{folder}/events", ["run_id", "event"]) == 0
    M.load_model(again.path).transform(test).count()


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    """A partition holds no more cells in a larger table, whatever partitions the table comes in."""
    monkeypatch.setattr(M, "FIT_CELLS", 1_000)
    table = lambda n, parts: spark.range(0, n, 1, parts).select("id", (F.col("id") * 2).alias("y"))
    for n, parts, dealt in ((2_000, 3, 16), (20_000, 3, 40), (20_000, 50, 40), (40_000, 3, 80)):
        with M.kept_in_memory(table(n, parts)) as held:
            assert held.rdd.getNumPartitions() == dealt
            assert held.count() == n and held.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2 * 1_000
    with M.kept_in_memory(table(0, 1)) as held:
        assert held.rdd.getNumPartitions() == M.FIT_PARTITIONS


def test_models_of_a_run_share_their_preprocessing(spark, tmp_path, monkeypatch):
    """One fit of the preprocessing serves all models and, where the caller holds the rows, all runs."""
    train, test = lifecycle(spark)
    slim, held = (d.select("id", "category", "value", "label") for d in (train, test))
    fits, fit = [], TablePreprocessor._fit
    monkeypatch.setattr(TablePreprocessor, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    models = {"LinearRegression": {}, "GradientBoostingRegressor": {"maxIter": 2}}
    run = M.training_run(slim, held, "label", "id", str(tmp_path / "one"), models)
    assert len(fits) == 1 and run.board.count() == 2
    with M.prepared(slim, "label", "id") as ready:
        again = [M.training_run(ready, held, "label", "id", str(tmp_path / "two"), models) for _ in range(2)]
        with pytest.raises(ValueError, match="prepared for label"):
            M.training_run(ready, held, "value", "id", str(tmp_path / "two"), models)
    assert len(fits) == 2
    shown = lambda r: [(x["model_name"], round(x["mae"], 9)) for x in r.board.orderBy("model_rank").collect()]
    alone = M.train_regressor("GradientBoostingRegressor", slim, "label", ["id"], maxIter=2).transform(held)
    want = round(M.regression_metrics(alone, "label").first()["mae"], 9)
    assert shown(again[0]) == shown(again[1]) == shown(run) and dict(shown(run))["GradientBoostingRegressor"] == want
