from tests.conftest import rows
from pyspark.sql import functions as F

from millrace.operators import advise as A
from millrace.operators import decide as D
from millrace.operators import profile as P
from millrace.operators import relate as R
from millrace.operators.rows import union_all


def delivery_tables(spark):
    restaurants = spark.createDataFrame(
        [(f"R00{i}", f"Place {i}", 12.9 + i, 77.5 + i, "Bengaluru", i % 2 == 0) for i in (1, 2, 3)],
        "restaurant_id string, restaurant_name string, latitude double, longitude double, city string, is_active boolean",
    )
    riders = spark.createDataFrame(
        [(f"D00{i}", f"Rider {i}", 12.8 + i, 77.4 + i, "bike", "on") for i in (1, 2, 3)],
        "rider_id string, rider_name string, latitude double, longitude double, vehicle_type string, status string",
    )
    orders = spark.createDataFrame(
        [
            ("O1", "R001", "D001", "2026-01-01T10:00:00", "2026-01-01T10:35:00", 35.0, 34.5),
            ("O2", "R002", "D002", "2026-01-01T11:00:00", "2026-01-01T11:30:00", 30.0, 29.8),
            ("O3", "R001", "D003", "2026-01-01T12:00:00", "2026-01-01T12:40:00", 40.0, 39.7),
        ],
        "order_id string, restaurant_id string, rider_id string, order_timestamp string, delivery_timestamp string, "
        "delivery_time_minutes double, delivery_time_estimate double",
    )
    return {"restaurants": restaurants, "riders": riders, "orders": orders}


def test_key_relations(spark):
    tables = delivery_tables(spark)
    roles = P.column_roles(P.profile_tables(tables))
    found = R.detect_relationships(tables, roles)
    pairs = {(r["source_dataset"], r["source_column"], r["target_dataset"]): r for r in found.collect()}
    assert pairs[("orders", "restaurant_id", "restaurants")]["tier"] == "Confirmed"
    assert ("orders", "rider_id", "riders") in pairs
    columns = {r["source_column"] for r in pairs.values()} | {r["target_column"] for r in pairs.values()}
    assert columns <= {"restaurant_id", "rider_id", "order_id"}
    one = pairs[("orders", "restaurant_id", "restaurants")]
    parts = [one[f"{p}_part"] for p in ("name", "integrity", "cardinality", "dtype", "overlap")]
    assert abs(sum(parts) - one["join_confidence"]) < 1e-3
    plan = R.merge_plan(found)
    assert plan.count() == found.count() and plan.where("rank = 1").count() == 1


def test_descriptive_columns_are_no_keys(spark):
    pair = spark.createDataFrame(
        [("a", "completed_orders", "b", "id"), ("orders", "customer_id", "customers", "id"), ("a", "id", "b", "id"),
         ("orders", "rider_id", "customers", "id"), ("a", "rider_id", "b", "restaurant_id")],
        R.PAIR,
    )
    got = [r[0] for r in pair.select(R.join_plausible(*[F.col(c) for c in R.PAIR])).collect()]
    assert got == [False, True, False, False, False]


def test_name_similarity(spark):
    pair = spark.createDataFrame(
        [("a", "id", "b", "id"), ("a", "x_id", "b", "x_id"), ("orders", "customer_id", "customers", "id"),
         ("orders", "cust_id", "customers", "id"), ("a", "rider_id", "b", "id_riders"), ("a", "p_id", "b", "q_id")],
        R.PAIR,
    )
    got = [r[0] for r in pair.select(R.name_similarity(*[F.col(c) for c in R.PAIR])).collect()]
    assert got == [0.1, 1.0, 1.0, 0.8, 1.0, 0.0]


def test_leakage_and_targets(spark):
    tables = {"orders": delivery_tables(spark)["orders"]}
    roles = P.column_roles(P.profile_tables(tables))
    targets = A.target_candidates(roles)
    best = targets.where("rank = 1").first()
    assert best["column"] == "delivery_time_minutes" and best["tier"] in ("strong", "possible")
    leaks = {r["column"]: r for r in A.leakage_scan(tables, roles, targets).collect() if r["target"] == "delivery_time_minutes"}
    assert leaks["delivery_timestamp"]["rule"] == "post_event_timestamp"
    assert leaks["delivery_time_estimate"]["severity"] == "HIGH"
    marked = P.add_role(roles, A.leakage_scan(tables, roles, targets), "potential_leakage")
    advice = {r["column"]: r["classification"] for r in A.feature_advice(marked).collect()}
    assert advice["order_id"] == "identifier"


def test_profile_of_edge_columns(spark):
    df = spark.createDataFrame(
        [(None, 1.0, "yes", "2026-01-01"), (None, float("nan"), "no", "2026-01-02"), (None, 3.0, "yes", None)],
        "empty string, n double, flag string, day string",
    )
    got = {r["column"]: r for r in P.profile_columns(df, "t").collect()}
    assert (got["empty"]["null_pct"], got["empty"]["unique_count"], got["empty"]["duplicate_rows"]) == (100.0, 0, 2)
    assert (got["n"]["null_count"], got["n"]["max"], got["n"]["unique_count"]) == (1, 3.0, 2)
    assert got["flag"]["is_boolean"] and not got["empty"]["is_boolean"]
    assert got["day"]["logical_dtype"] == "datetime"


def test_wide_tables_are_profiled_in_batches(spark):
    df = spark.range(3).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(230)])
    profile = P.profile_columns(df, "wide")
    assert profile.count() == 230 and profile.where("position = 229 AND max = 458").count() == 1


def test_roles(spark):
    df = spark.createDataFrame(
        [(i, f"u{i}@x", "v" if i % 2 else "w", 1) for i in range(50)], "user_id int, email string, kind string, same int"
    )
    got = {r["column"]: r["roles"] for r in P.column_roles(P.profile_columns(df, "t")).collect()}
    assert got["user_id"] == ["identifier"]
    assert got["email"] == ["identifier", "pii", "categorical_feature"] or "pii" in got["email"]
    assert got["kind"] == ["categorical_feature"]
    assert "distractor" in got["same"]


def test_recommendations_follow_issues(spark):
    issues = spark.createDataFrame(
        [
            ("null_violation", "t", "a", "HIGH", 85.0, 85), ("high_null_rate", "t", "b", "MEDIUM", 10.0, 10),
            ("duplicate_rows", "t", None, "HIGH", None, 3), ("schema_extra_columns", "t", None, "LOW", None, 1),
            ("pii_column", "t", "c", "HIGH", None, None), ("target_leakage", "t", "d", "LOW", None, None),
            ("outlier_detected", "t", "y", "MEDIUM", None, None), ("categorical_needs_encoding", "t", "e", "INFO", None, None),
        ],
        "issue_type string, dataset string, column string, severity string, null_pct double, count long",
    )
    recommended = D.recommend_actions(issues)
    got = {r["column"]: (r["action"], r["confidence"]) for r in recommended.collect()}
    assert got == {
        "a": ("DROP", 0.95), "b": ("IMPUTE", 0.85), None: ("REMOVE_DUPLICATES", 1.0), "c": ("DROP", 1.0),
        "d": ("DROP", 0.98), "y": ("REMOVE_OUTLIERS", 0.80),
    }
    registry = spark.createDataFrame([("t", c) for c in "abcdyz"] + [("u", "k")], "dataset string, column string")
    defaults = rows(D.default_actions(recommended, registry).select("action", "dataset", "column"), "dataset", "column")
    assert defaults == [("KEEP", "t", "z"), ("LEAVE_UNCHANGED", "u", None), ("KEEP", "u", "k")]
    targets = spark.createDataFrame([("t", "y", "strong")], "dataset string, column string, tier string")
    calibrated = D.calibrate_priority(recommended, targets)
    assert calibrated.where("column = 'y'").first()["priority"] == "CRITICAL"
    manifest = rows(D.approval_manifest(calibrated).select("decision_id", "column", "status"), "decision_id")
    assert manifest[0] == ("DEC-001", "y", "PENDING_APPROVAL") and len(manifest) == 6
    # HIGH: confidence 1.0 before 0.95, the table-level entry first.
    assert [m[1] for m in manifest[1:4]] == [None, "c", "a"]


def test_schema_diff_reports_real_changes_only(spark):
    schema = "dataset string, column string, logical_dtype string, row_count long"
    old = spark.createDataFrame([("t", "a", "integer", 5), ("gone", "x", "string", 1)], schema)
    assert P.schema_diff(old, old).count() == 0
    new = spark.createDataFrame([("t", "a", "float", 5), ("t", "b", "string", 5)], schema)
    got = rows(P.schema_diff(old, new).select("dataset", "column", "change"), "dataset", "column")
    assert got == [("gone", None, "removed_dataset"), ("t", "a", "datatype_change"), ("t", "b", "added_column")]


def test_intelligence_score_defaults(spark):
    tables = {"t": spark.createDataFrame([(1, "a")], "id int, name string")}
    roles = P.column_roles(P.profile_tables(tables))
    advice, targets = A.feature_advice(roles), A.target_candidates(roles)
    none = spark.createDataFrame([], "join_confidence double")
    row = A.intelligence_score(roles, none, advice, targets).first()
    assert (row["relationship_confidence"], row["feature_confidence"], row["target_confidence"]) == (50.0, 50.0, 0.0)
    assert row["overall_score"] == 60.0


def test_key_overlap_counts_distinct_keys(spark):
    tables = {
        "a": spark.createDataFrame([("1.0",), ("2",), ("2",), ("9",), (None,)], "b_id string"),
        "b": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
    }
    pairs = R.pair_table(spark, R.plausible_pairs(tables))
    got = {r["source_dataset"]: (r["matched"], r["distinct_keys"]) for r in R.key_overlap(R.key_values(tables), pairs).collect()}
    assert got == {"a": (2, 3), "b": (2, 3)}
    assert union_all([pairs]).count() == 2


def test_keys_are_read_once(spark):
    """One pass over the key columns gives the ratios of both sides and the overlap."""
    seen = spark.sparkContext.accumulator(0)

    def touched(value):
        seen.add(1)
        return value

    key = F.udf(touched, "long")
    tables = {
        "items": spark.range(0, 10, 1, 2).select(key(F.col("id") % 5).alias("order_id")),
        "orders": spark.range(0, 8, 1, 2).select(key("id").alias("id")),
    }
    roles = P.column_roles(P.profile_tables(tables))
    before = seen.value
    found = R.detect_relationships(tables, roles).where("source_dataset = 'items'").collect()
    assert [(r["source_column"], r["target_column"], r["overlap_ratio"], r["cardinality"]) for r in found] == [
        ("order_id", "id", 1.0, "many_to_one")
    ]
    assert seen.value - before == 18


def test_ratios_and_overlaps_by_sets_of_columns(spark):
    keys = spark.createDataFrame(
        [("a", "id", "1", 1), ("a", "id", "2", 1), ("b", "a_id", "1", 3), ("b", "a_id", "9", 2), ("b", "c_id", "1", 5)],
        "dataset string, column string, key string, copies long",
    )
    sets = R.key_sets(keys)
    assert rows(sets.groupBy("dataset", "column").agg(F.sum("keys"), F.sum("copies")), "dataset", "column") == [
        ("a", "id", 2, 2), ("b", "a_id", 2, 5), ("b", "c_id", 1, 5)
    ]
    assert rows(R._set_ratios(sets), "dataset", "column") == rows(R.key_ratios(keys), "dataset", "column")


def test_intelligence_score_profiles_once(spark, monkeypatch):
    from millrace.plans import catalog, profile_queries

    kinds = {d: ", ".join(f"{c} {k}" for c, k, _ in columns) for d, columns in profile_queries.STAR.items()}

    class Small:
        def __init__(self, session, folder):
            self.spark = session

        def __call__(self, name):
            return spark.createDataFrame([tuple(None for _ in profile_queries.STAR[name])] * 2, kinds[name])

    profiles, profiled = [], P.profile_tables
    monkeypatch.setattr(catalog, "Tables", Small)
    monkeypatch.setattr(P, "profile_tables", lambda *a: profiles.append(1) or profiled(*a))
    assert catalog.QUERIES["intelligence_score"](spark, "").count() == 1
    assert len(profiles) == 1
