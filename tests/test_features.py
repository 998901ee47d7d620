import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from millrace import ForeignKey
from millrace.operators import encode as E
from millrace.operators import enrich as J
from millrace.operators import explore as X
from millrace.operators import features as G
from millrace.operators import messages as M
from millrace.operators.correlate import correlated_columns

ROLES = G.OperationRoles(
    "prep_capacity", "current_load", "completed_orders", "shift_hours", "order_size", "order_value", "avg_rating"
)


def test_enrich_join_keeps_rows_and_adds_suffixes(delivery):
    fks = [ForeignKey("restaurant_id", "restaurants", "id"), ForeignKey("rider_id", "riders", "id")]
    parents = [(fks[0], delivery["restaurants"], "restaurant"), (fks[1], delivery["riders"], "rider")]
    wide = J.enrich_join(delivery["orders"], parents, mark=True)
    assert {"id_restaurant", "id_rider", "lat", "lat_rider", "prep_capacity", "shift_hours"} <= set(wide.columns)
    facts = J.verify_join(
        delivery["orders"], wide, "id", {"restaurant_id": "restaurant_matched", "rider_id": "rider_matched"}
    ).first()
    assert facts["passed"] and facts["rows_after"] == 2


def test_assertions(spark, delivery):
    J.assert_required_columns(delivery, {"orders": ["id", "restaurant_id"]})
    with pytest.raises(ValueError, match="lacks columns: zip"):
        J.assert_required_columns(delivery, {"orders": ["zip"]})
    with pytest.raises(ValueError, match="empty"):
        J.assert_required_columns({"orders": delivery["orders"].limit(0)}, {"orders": ["id"]})
    J.assert_unique_keys(delivery, {"orders": "id"})
    with pytest.raises(ValueError, match="orders"):
        J.assert_unique_keys({"orders": delivery["orders"].union(delivery["orders"])}, {"orders": "id"})
    fk = ForeignKey("restaurant_id", "restaurants", "id")
    J.assert_references(delivery["orders"], fk, delivery["restaurants"])
    with pytest.raises(ValueError, match="missing rows"):
        J.assert_references(delivery["orders"], fk, delivery["restaurants"].where("id = 1"))
    with pytest.raises(ValueError, match="parent key is"):
        J.assert_references(delivery["orders"].withColumn("restaurant_id", F.lit("1")), fk, delivery["restaurants"])


def test_temporal_edges(spark):
    df = spark.createDataFrame(
        [("2026-01-03 04:59:00",), ("2026-01-03 05:00:00",), ("2026-01-05 11:00:00",), ("2026-01-05 20:59:00",), (None,)], "ts string"
    )
    got = [(r["weekday"], r["is_weekend"], r["meal_period"], r["peak_hour"]) for r in G.temporal_features(df, "ts").collect()]
    assert got == [
        ("Saturday", True, "Night", False), ("Saturday", True, "Breakfast", False), ("Monday", False, "Lunch", False),
        ("Monday", False, "Evening", True), (None, False, "Night", False),
    ]


def test_tier_edges(spark):
    ratings = spark.createDataFrame([(x,) for x in (3.49, 3.5, 4.2, 4.7, 4.71, None)], "r double")
    assert [r[0] for r in ratings.select(G.tier(F.col("r"), G.QUALITY)).collect()] == [
        "Low", "Standard", "Standard", "Good", "Premium", "Low",
    ]
    done = spark.createDataFrame([(x,) for x in (499.0, 499.5, 500.0, 1499.0, 1499.5, 1500.0, 3000.0)], "c double")
    assert [r[0] for r in done.select(G.tier(F.col("c"), G.EXPERIENCE)).collect()] == [
        "Beginner", "Beginner", "Intermediate", "Intermediate", "Beginner", "Experienced", "Expert",
    ]


def test_operational_and_business(spark):
    df = spark.createDataFrame(
        [(10, 8, 600, 6.0, 2, 30.0, 4.6), (0, 1, 10, 0.0, 0, 10.0, 3.0), (None, 1, 3000, 5.0, 1, 20.0, None), (5, 1, 1, 1.0, 4, 100.0, 4.5)],
        "prep_capacity int, current_load int, completed_orders int, shift_hours double, order_size int, order_value double, avg_rating double",
    )
    made = G.business_features(G.operational_features(df, ROLES), ROLES).orderBy("order_value").collect()
    zero, empty, busy, big = made
    assert zero["load_ratio"] == 0 and zero["average_order_value_per_item"] == 0 and not zero["high_workload"]
    assert empty["load_ratio"] == 0 and empty["remaining_capacity"] is None and not empty["premium_restaurant"]
    assert busy["high_workload"] and busy["busy_restaurant"] and busy["orders_per_shift_hour"] == 100
    # 75th percentile of 10, 20, 30, 100 is 47.5; of 0, 1, 2, 4 it is 2.5.
    assert big["high_value_order"] and not busy["high_value_order"]
    assert big["large_order"] and not busy["large_order"]


def test_feature_types(spark):
    df = spark.createDataFrame([], "id int, a_id int, lat double, order_timestamp string, ok boolean, n int, t string, y double, arr array<int>")
    got = {r["column"]: r["feature_type"] for r in G.feature_types(df, "y").collect()}
    assert got == {
        "id": "Identifier", "a_id": "Identifier", "lat": "GPS", "order_timestamp": "Datetime", "ok": "Boolean",
        "n": "Numerical", "t": "Categorical", "y": "Target", "arr": "Unknown",
    }


def test_split_is_stable_and_complete(spark):
    df = spark.range(5000).withColumn("y", F.col("id") * 2.0)
    split = G.train_test_split(df, "id", "y", drop=[])
    share = split.where("split = 'test'").count() / 5000
    assert 0.17 < share < 0.23
    again = G.train_test_split(df.repartition(9), "id", "y", drop=[])
    assert split.exceptAll(again).count() == 0
    assert G.train_test_split(df, "id", "y").columns == ["y", "split"]


def test_encoding_plan_cardinality(spark):
    many = spark.createDataFrame([(f"v{i}", "A" if i % 2 else "B") for i in range(150)], "u string, c string")
    got = {r["column"]: r["strategy"] for r in E.encoding_plan(many).collect()}
    assert got == {"u": E.SKIPPED, "c": E.ONE_HOT}
    auto = {r["column"]: r["strategy"] for r in E.encoding_plan_auto(many).collect()}
    assert auto == {"u": E.ORDINAL, "c": E.ONE_HOT}
    with pytest.raises(ValueError, match="more than"):
        E.categories_of(many, "u", 100)


def test_encoders_and_unseen_values(spark):
    train = spark.createDataFrame([("A",), ("B",), (None,)], "c string")
    test = spark.createDataFrame([("A",), ("Z",), (None,)], "c string")
    hot = E.one_hot(test, {"c": E.categories_of(train, "c")})
    assert hot.columns == ["c_A", "c_B", "c_nan"]
    assert [tuple(r) for r in hot.collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 1)]
    codes, small = E.ordinal_fit(train, "c")
    assert sorted(r[0] for r in E.ordinal_encode(test, "c", codes, small).collect()) == [-1, 0, 2]
    assert sorted(r[0] for r in E.ordinal_encode(test, "c", codes, False).collect()) == [-1, 0, 2]


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "c")], "n double, t string")
    assert [r[0] for r in E.standard_scale(df, ["n"]).collect()] == [-1.0, 1.0, None]
    assert [r[0] for r in E.impute_median_matrix(df.select("n")).collect()] == [1.0, 3.0, 2.0]


def test_pruning(spark):
    df = spark.createDataFrame(
        [(1, 5, 10.0, None), (2, 5, 20.0, 1.0), (3, 5, 31.0, None), (4, 5, 39.0, 1.0)], "a int, k int, b double, half double"
    )
    assert E.drop_constant(df).columns == ["a", "b", "half"]
    assert [r["column"] for r in correlated_columns(df).collect()] == ["b"]
    assert E.drop_correlated(df).columns == ["a", "k", "half"]


def test_align(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, extra double")
    assert tuple(E.align_features(df, ["a", "b"], {"a": 7.0}).first()) == (7.0, 1.0)
    with pytest.raises(ValueError, match="differs"):
        E.align_features(df, ["a", "b"], strict=True)
    width = df.select(E.align_width(F.array("b", "extra"), 3), E.align_width(F.array("b", "extra"), 1)).first()
    assert width[0] == [1.0, 2.0, 0.0] and width[1] == [1.0]


def test_datetime_expand(spark):
    df = spark.createDataFrame(
        [("2021-01-02T03:04:00", "x", 1), ("bad", "y", 2), ("2021-01-04T00:00:00", "z", 3)], "ts string, t string, n int"
    )
    assert E.datetime_columns(df) == ["ts"]
    got = [tuple(r) for r in E.datetime_expand(df, ["ts"]).drop("t", "n").collect()]
    assert got == [(1609556640, 3, 4, 5, 1), (0, -1, -1, -1, 0), (1609718400, 0, 0, 0, 0)]


def test_exploration_edges(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    bins = X.histogram(df, ["v"])
    assert bins.count() == 30 and bins.agg(F.sum("rows")).first()[0] == 2
    assert bins.agg(F.min("low"), F.max("high")).first() == (4.5, 5.5)
    row = X.describe_stats(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")).first()
    assert (row["q1"], row["median"], row["q3"]) == (1.75, 2.5, 4.75)
    table = rows(X.frequency_table(spark.createDataFrame([("a",), ("a",), (None,)], "c string"), ["c"]), "value")
    assert table == [("c", "Missing", 1, 33.33), ("c", "a", 2, 66.67)]


@pytest.mark.parametrize(
    "message, tags, first",
    [
        ("What model is in production?", ["registry"], "model_info"),
        ("help", ["health"], "help"),
        ("predict eta", ["prediction"], "predict"),
        ("prediction", ["prediction"], "general_chat"),
        ("explain why", ["explainability"], "explain_prediction"),
        ("show shap", ["health"], "feature_importance"),
        ("tell me about the data", ["dataset"], "dataset_info"),
        ("random question", ["health"], "general_chat"),
        ("which model", ["registry"], "model_info"),
        ("never mind", ["health"], "cancel"),
        ("Hi there", ["health"], "greeting"),
        ("show me the models", ["registry"], "model_info"),
        ("list all datasets", ["dataset"], "dataset_info"),
        ("his shipment", ["health"], "general_chat"),
    ],
)
def test_messages(spark, message, tags, first):
    df = spark.createDataFrame([(message,)], "m string")
    got = M.intent_first(M.intent_tags(df, "m"), "m").first()
    assert (got["tags"], got["intent"]) == (tags, first)


def test_plain_contains_reads_which_as_greeting(spark):
    df = spark.createDataFrame([("which model",)], "m string")
    assert M.intent_first(df, "m", whole_words=False).first()["intent"] == "greeting"


def test_last_turns(spark):
    df = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 0)], "c int, t int")
    got = M.last_n_turns(df, "c", "t")
    assert got.count() == 21 and got.where("c = 1").agg(F.min("t")).first()[0] == 10
