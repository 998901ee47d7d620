from tests.conftest import rows
from tests.delivery_specs import ORDERS, RESTAURANTS, SPECS
from pyspark.sql import functions as F

from millrace import ColumnSpec, TableSpec
from millrace.operators import checks as C
from millrace.operators import scoring as S


def test_clean_tables_score_100(delivery):
    results = C.validation_suite(delivery, SPECS)
    assert results.where("NOT passed").count() == 0
    assert tuple(S.quality_score(results).first()) == (100.0, "excellent")
    # 4 checks per parent, 7 for the child (schema, nulls, duplicates, gps, timestamp, target, foreign key).
    assert results.count() == 4 + 4 + 7


def test_one_orphan_fails(delivery):
    orders = delivery["orders"].withColumn(
        "restaurant_id", F.when(F.col("id") == 1, 999).otherwise(F.col("restaurant_id"))
    )
    row = C.fk_orphans(orders, ORDERS.foreign_keys[0], delivery).first()
    assert (row["checked"], row["orphans"], row["parent_missing"]) == (2, 1, False)
    assert not C.single_check(orders, ORDERS, "foreign_key", delivery).first()["passed"]
    sample = C.fk_orphan_samples(orders, ORDERS.foreign_keys[0], delivery["restaurants"])
    assert rows(sample) == [(999, 1)]


def test_missing_parent_makes_all_rows_orphans(delivery):
    row = C.fk_orphans(delivery["orders"], ORDERS.foreign_keys[0], {}).first()
    assert (row["orphans"], row["parent_missing"]) == (2, True)


def test_mixed_key_types_are_comparable(spark, delivery):
    orders = spark.createDataFrame([("1.0",), (" 2 ",), ("x",), (None,)], "restaurant_id string")
    row = C.fk_orphans(orders, ORDERS.foreign_keys[0], delivery).first()
    assert (row["checked"], row["orphans"]) == (3, 1)


def test_null_violation(delivery):
    broken = delivery["restaurants"].withColumn("name", F.when(F.col("id") == 1, F.col("name")))
    result = C.single_check(broken, RESTAURANTS, "nulls").first()
    assert not result["passed"] and result["score"] == 100 * (1 - 1 / 8)
    assert rows(C.null_counts(broken, RESTAURANTS).where("violation")) == [("name", 1, 50.0, True)]


def test_schema_penalties(spark):
    spec = TableSpec("t", columns=(ColumnSpec("a", "integer"), ColumnSpec("b", "float"), ColumnSpec("c", "boolean"),
                                   ColumnSpec("d", "datetime"), ColumnSpec("gone"), ColumnSpec("extra_ok", required=False)))
    df = spark.createDataFrame([("1", "x", "true", "2026-01-01", 1), ("2.5", "2", "maybe", "bad", 1)], "a string, b string, c string, d string, e int")
    assert C.schema_gaps(df, spec) == (["gone"], ["e"])
    got = {r["column"]: r["violations"] for r in C.dtype_violations(df, spec).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 1}
    result = C.single_check(df, spec, "schema").first()
    assert (result["score"], result["passed"]) == (100 - 20 - 5 - 40, False)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (2, "c"), (None, None), (None, None)], "id int, v string")
    assert tuple(C.duplicate_rows(df).first()) == (6, 2, 4)
    assert rows(C.duplicate_keys(df, "id")) == [("2", 3)]
    result = C.single_check(df, TableSpec("t", "id"), "duplicates").first()
    assert abs(result["score"] - 100 * (1 - 5 / 6)) < 1e-9


def test_gps_target_and_timestamp(spark):
    df = spark.createDataFrame(
        [(12.9, 77.5, "2026-01-01", 15.0), (999.0, -200.0, "bad", -1.0), (None, None, None, 2000.0)],
        "lat double, lon double, ts string, y double",
    )
    spec = TableSpec("t", latitude=("lat",), longitude=("lon",), timestamps=("ts",), targets=("y",))
    assert rows(C.bounds_violations(df, spec), "column") == [("lat", 2, 1), ("lon", 2, 1)]
    assert rows(C.timestamp_violations(df, spec)) == [("ts", 2, 1, 50.0)]
    assert rows(C.target_violations(df, spec)) == [("y", 3, 1, 1, 0)]


def test_weights_cover_present_categories_only(spark):
    results = spark.createDataFrame(
        [("schema", "t", True, 100.0), ("timestamp", "t", True, 50.0), ("nulls", "t", True, 80.0), ("other", "t", True, 0.0)],
        "validator string, dataset string, passed boolean, score double",
    )
    score = S.quality_score(results).first()["overall_score"]
    assert score == round((75 * 0.30 + 80 * 0.20) / 0.50, 2)


def test_bands(spark):
    df = spark.createDataFrame([(float(x),) for x in (90, 89.9, 80, 60, 40, 39.9)], "s double")
    got = [r[0] for r in df.select(S.quality_band(F.col("s"))).collect()]
    assert got == ["excellent", "good", "good", "fair", "poor", "critical"]


def test_empty_table(spark, delivery):
    empty = delivery["orders"].limit(0)
    results = C.validation_suite({**delivery, "orders": empty}, SPECS)
    assert results.where("dataset = 'orders' AND score != 100").count() == 0


def test_findings_name_what_a_check_found(spark, delivery):
    orders = delivery["orders"].withColumn("restaurant_id", F.lit(999).cast("long")).withColumn("surplus", F.lit(1))
    orders = orders.drop("promo_code_used").union(orders.drop("promo_code_used").where("id = 1"))
    tables = {**delivery, "orders": orders}
    found = C.validation_findings(tables, SPECS)
    got = {(r.validator, r.kind, r.subject): r.violations for r in found.where("dataset = 'orders'").collect()}
    assert got[("schema", "missing", "promo_code_used")] == got[("schema", "extra", "surplus")] == 1
    assert got[("duplicates", "copies", None)] == 1 and got[("duplicates", "repeated id", "1")] == 2
    assert got[("foreign_key", "orphans", "restaurant_id")] == got[("foreign_key", "orphan key", "999")] == 3
    results = C.validation_suite(tables, SPECS)
    detailed = C.with_details(results, found)
    assert detailed.columns == [*results.columns, "details"] and detailed.count() == results.count()
    fk = detailed.where("dataset = 'orders' AND validator = 'foreign_key'").first().details
    assert [tuple(x) for x in fk] == [("orphan key", "999", 3), ("orphans", "restaurant_id", 3)]
    assert detailed.where("dataset = 'riders' AND size(details) > 0").count() == 0
    assert found.where("dataset <> 'orders'").count() == 0


def test_no_findings_in_clean_and_empty_tables(delivery):
    assert C.validation_findings(delivery, SPECS).count() == 0
    empty = {name: df.limit(0) for name, df in delivery.items()}
    assert C.validation_findings(empty, SPECS).count() == 0
