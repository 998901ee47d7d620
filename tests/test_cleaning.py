import pytest
from tests.conftest import rows
from tests.delivery_specs import SPECS
from pyspark.sql import functions as F

from millrace.operators import clean as K
from millrace.operators import diff as X
from millrace.plans.cleaning import action_order, clean_tables
from millrace.sources import sinks

MANIFEST = "decision_id string, dataset string, column string, action string, status string, details map<string,string>"


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, val string")
    assert rows(K.drop_duplicates(df), "id") == [(1, "a"), (2, "b")]


def test_keyed_duplicates_keep_the_first_in_order(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (2, 5, None)], "id int, seq int, v string")
    assert rows(K.drop_duplicates(df, ["id"], ["seq"]), "id") == [(1, 1, "y"), (2, 5, None)]


def test_impute(spark):
    df = spark.createDataFrame(
        [(10.0, "apple", True, 1), (20.0, "apple", None, 2), (None, None, True, None)],
        "n double, t string, b boolean, i int",
    )
    got = K.impute(df, ["n", "t", "b", "i"]).where("n = 15.0").first()
    assert tuple(got) == (15.0, "apple", True, 1.5)


def test_impute_keeps_whole_numbers(spark):
    """Keys beyond 2**53 without nulls, a whole median, a fractional one and a column of nulls."""
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1, 1, None), (big + 2, 3, 2, None), (big + 4, None, None, None)], "k long, w int, f long, n int")
    got = K.impute(df, ["k", "w", "f", "n"])
    assert [d for _, d in got.dtypes] == ["bigint", "int", "double", "int"]
    assert rows(got, "k") == [(big, 1, 1.0, 0), (big + 2, 3, 2.0, 0), (big + 4, 2, 1.5, 0)]


def test_impute_ties_and_empty(spark):
    tied = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    assert {r[0] for r in K.impute(tied, ["t"]).collect()} == {"a", "b"}
    assert [r[0] for r in K.impute(tied, ["t"]).collect()].count("a") == 2
    empty = spark.createDataFrame([(None, None, None)], "n double, t string, b boolean")
    assert tuple(K.impute(empty, ["n", "t", "b"]).first()) == (0.0, "Unknown", False)


def test_remove_outliers_drops_negatives(spark):
    df = spark.createDataFrame([(20.0,), (30.0,), (-10.0,)], "delivery_time_minutes double")
    assert rows(K.remove_outliers(df, "delivery_time_minutes"), "delivery_time_minutes") == [(20.0,), (30.0,)]


def test_remove_outliers_rules(spark):
    ids = spark.createDataFrame([(1,), (-5,)], "customer_id int")
    assert K.remove_outliers(ids, "customer_id").count() == 2
    flat = spark.createDataFrame([(5.0,), (5.0,), (None,)], "speed double")
    assert K.remove_outliers(flat, "speed").count() == 3
    scaled = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "order_value double")
    assert K.remove_outliers(scaled, "order_value").count() == 3
    with_null = spark.createDataFrame([(1.0,), (2.0,), (None,)], "speed double")
    assert K.remove_outliers(with_null, "speed").count() == 2


def test_fix_datatype(spark):
    df = spark.createDataFrame([("1.0", "2.5", "x"), ("0.0", "3.5", "7")], "b string, i string, f string")
    assert [r[0] for r in K.fix_datatype(df, "b", "boolean").select("b").collect()] == [True, False]
    assert [r[0] for r in K.fix_datatype(df, "i", "Int64").select("i").collect()] == [2, 4]
    assert [r[0] for r in K.fix_datatype(df, "f", "float").select("f").collect()] == [None, 7.0]


def test_gps(spark):
    df = spark.createDataFrame([(12.97,), (999.0,), (None,)], "latitude double")
    assert [r[0] for r in K.gps_nullify(df, "latitude").collect()] == [12.97, None, None]
    assert [r[0] for r in K.gps_drop(df, "latitude").collect()] == [12.97, None]


@pytest.mark.parametrize("broadcast_keys", [1_000_000, 0])
def test_foreign_keys(spark, monkeypatch, broadcast_keys):
    monkeypatch.setattr(K, "BROADCAST_KEYS", broadcast_keys)
    child = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "k double")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(K.fk_flag(child, "k", parent, "id"), "k") == [(None, False), ("1", False), ("2", False), ("3", True)]
    assert rows(K.fk_repair(child, "k", parent, "id"), "k") == [(None,), ("1",), ("2",)]


def test_hot_keys_are_salted(spark, monkeypatch):
    """A third of the rows on one key and a third without key, against a parent with repeats."""
    monkeypatch.setattr(K, "BROADCAST_KEYS", 0)
    child = spark.range(0, 3000, 1, 9).select(F.expr("CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN id END").alias("k"))
    parent = spark.range(0, 1500).union(spark.range(0, 1500))
    kept = K.fk_repair(child, "k", parent, "id")
    assert kept.count() == 1000 + 1000 + 500
    assert K.fk_flag(child, "k", parent, "id").where("k_is_orphan").count() == 500


def test_text_and_scaling(spark):
    df = spark.createDataFrame([(" a\t", 1.0), (None, 3.0)], "t string, n double")
    assert [r[0] for r in K.trim_whitespace(df, "t").select("t").collect()] == ["a", None]
    assert [r[0] for r in K.format_string(df, "n").select("n").collect()] == ["1.0", "3.0"]
    assert [r[0] for r in K.minmax_column(df, "n").select("n").collect()] == [0.0, 1.0]
    z = [r[0] for r in K.standardize_column(df, "n").select("n").collect()]
    assert z == pytest.approx([-0.7071067811865475, 0.7071067811865475])


def test_label_encode(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert sorted(r[0] for r in K.label_encode(df, "v").collect()) == [-1, 0, 1, 1]


def broken(spark, delivery):
    first = delivery["restaurants"].where("id = 1")
    orders = delivery["orders"]
    bad_fk = orders.where("id = 1").withColumns({"id": F.lit(3), "restaurant_id": F.lit(999)})
    bad_target = orders.where("id = 1").withColumns({"id": F.lit(4), "actual_delivery_time_min": F.lit(-99.0)})
    riders = delivery["riders"].withColumn("lat", F.when(F.col("id") == 2, 999.0).otherwise(F.col("lat")))
    tables = {
        "restaurants": delivery["restaurants"].union(first),
        "riders": riders,
        "orders": orders.union(bad_fk.select(orders.columns)).union(bad_target.select(orders.columns)),
    }
    manifest = spark.createDataFrame(
        [
            ("DEC-001", "restaurants", None, "REMOVE_DUPLICATES", "APPROVED", None),
            ("DEC-002", "riders", "lat", "FIX_GPS", "PENDING_APPROVAL", None),
            ("DEC-003", "orders", "restaurant_id", "DROP", "APPROVED", None),
            ("DEC-004", "orders", "actual_delivery_time_min", "REMOVE_OUTLIERS", "APPROVED", None),
        ],
        MANIFEST,
    )
    return tables, manifest


def test_end_to_end(spark, delivery):
    tables, manifest = broken(spark, delivery)
    result = clean_tables(tables, SPECS, manifest)
    assert result.tables["restaurants"].count() == 2
    # The outlier is gone; the approved DROP is unsupported and keeps the orphan.
    assert [r["id"] for r in result.tables["orders"].orderBy("id").collect()] == [1, 2, 3]
    assert result.tables["riders"].where("lat = 999").count() == 1
    forced = clean_tables(tables, SPECS, manifest, force_approve_all=True)
    assert forced.tables["riders"].where("lat IS NULL").count() == 1
    repaired = clean_tables(tables, SPECS, manifest, drop_disables_repair=False)
    assert [r["id"] for r in repaired.tables["orders"].orderBy("id").collect()] == [1, 2]


def test_rows_reconcile_and_cleaning_is_idempotent(spark, delivery):
    tables, manifest = broken(spark, delivery)
    result = clean_tables(tables, SPECS, manifest, drop_disables_repair=False)
    audit = result.audit_trail(spark)
    removed = audit.groupBy("dataset").agg(F.sum(F.col("records_before") - F.col("records_after")).alias("n"))
    for name, n in rows(removed):
        assert tables[name].count() - n == result.tables[name].count()
    again = clean_tables(result.tables, SPECS, manifest, drop_disables_repair=False)
    for name, df in result.tables.items():
        assert again.tables[name].count() == df.count()
        assert again.tables[name].columns == tables[name].columns


def test_unknown_column_is_audited_as_failed(spark, delivery):
    manifest = spark.createDataFrame([("DEC-001", "orders", "nope", "IMPUTE", "APPROVED", None)], MANIFEST)
    audit = clean_tables(delivery, SPECS, manifest).audit
    assert [(a[3], a[4]) for a in audit if a[2] == "nope"] == [("IMPUTE", "FAILED")]


def test_nothing_approved_copies_tables(spark, delivery):
    manifest = spark.createDataFrame([("DEC-001", "orders", "order_value", "IMPUTE", "PENDING_APPROVAL", None)], MANIFEST)
    result = clean_tables(delivery, SPECS, manifest)
    assert list(result.tables) == ["orders"] and result.audit == []


def test_action_order(spark):
    actions = [("DEC-001", "REMOVE_OUTLIERS", "v"), ("DEC-002", "FLAG", "drop_lat"), ("DEC-003", "IMPUTE", "v"),
               ("DEC-004", "REMOVE_DUPLICATES", None), ("DEC-005", "NORMALIZE", "v"), ("DEC-006", "FLAG", "order_date"),
               ("DEC-007", "FLAG", "rider_id")]
    manifest = spark.createDataFrame([(d, "t", c, a, "APPROVED", None) for d, a, c in actions], MANIFEST)
    got = [(r["decision_id"], r["verb"]) for r in action_order(manifest).orderBy("step").collect()]
    assert got == [
        ("DEC-004", "REMOVE_DUPLICATES"), ("DEC-003", "IMPUTE"), ("DEC-006", "STANDARDIZE_TIMESTAMP"),
        ("DEC-002", "FIX_GPS"), ("DEC-007", "FLAG_FOREIGN_KEY"), ("DEC-001", "REMOVE_OUTLIERS"),
    ]


def test_cell_diff(spark):
    raw = spark.createDataFrame(
        [(1, None, "18/05/2026 22:56", "5.0"), (2, 9.0, "x", "6"), (3, 1.0, "y", "z")],
        "id int, n double, t string, k string",
    )
    new = spark.createDataFrame(
        [("1", 15.0, "2026-05-18 22:56:00", "5"), ("2", None, "x", "6")], "id string, n double, t string, k string"
    )
    got = rows(X.cell_diff(raw, new, "id").select("record_id", "column", "change_type"), "record_id", "column")
    assert got == [("1", "n", "imputed"), ("1", "t", "timestamp_format"), ("2", "n", "nullified")]
    assert tuple(X.diff_summary(raw, new, "id").first()) == (3, 2, 1, 3 + 4, 1, 1)


def test_rollback(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    sinks.sink_table(raw, f"{tmp_path}/raw")
    sinks.sink_table(raw.dropDuplicates(), f"{tmp_path}/processed")
    entry = sinks.rollback_entry(spark, "t", f"{tmp_path}/raw", f"{tmp_path}/processed")
    assert (entry.first()["raw_rows"], entry.first()["processed_rows"]) == (3, 2)
    sinks.sink_table(entry, f"{tmp_path}/manifest")
    outcome = sinks.rollback_table(spark, spark.read.parquet(f"{tmp_path}/manifest"))
    assert rows(outcome) == [("t", 3, True)]
    assert spark.read.parquet(f"{tmp_path}/processed").count() == 3


def test_rollback_notices_a_changed_raw_table(spark, tmp_path):
    sinks.sink_table(spark.range(3), f"{tmp_path}/raw")
    sinks.sink_table(spark.range(3), f"{tmp_path}/processed")
    entry = sinks.rollback_entry(spark, "t", f"{tmp_path}/raw", f"{tmp_path}/processed")
    sinks.sink_table(entry, f"{tmp_path}/manifest")
    sinks.sink_table(spark.range(4), f"{tmp_path}/raw")
    assert rows(sinks.rollback_table(spark, spark.read.parquet(f"{tmp_path}/manifest"))) == [("t", 4, False)]


def test_fingerprint_counts_repeats(spark):
    once, twice = spark.range(3), spark.range(3).union(spark.range(3))
    assert sinks.table_fingerprint(once).first()["checksum"] != sinks.table_fingerprint(twice).first()["checksum"]
    shuffled = spark.range(3).orderBy(F.desc("id"))
    assert sinks.table_fingerprint(once).first() == sinks.table_fingerprint(shuffled).first()


def test_failed_actions_are_named_and_the_rest_goes_on(spark):
    from millrace import TableSpec
    from millrace.plans.cleaning import clean_tables

    rows = spark.createDataFrame([(1, [1], None, " a "), (2, [2], 4.0, "b"), (3, [2], 6.0, "b")], "id long, n array<int>, v double, t string")
    manifest = spark.createDataFrame(
        [
            ("d1", "x", "n", "IMPUTE", "APPROVED"),
            ("d2", "x", "v", "IMPUTE", "APPROVED"),
            ("d3", "x", "t", "TRIM_WHITESPACE", "APPROVED"),
            ("d4", "x", "gone", "FORMAT_STRING", "APPROVED"),
            ("d5", "x", "id", "REPAIR_FOREIGN_KEY", "APPROVED"),
        ],
        "decision_id string, dataset string, column string, action string, status string",
    )
    result = clean_tables({"x": rows}, [TableSpec("x", id_column="id")], manifest)
    status = {r["column"]: r["status"] for r in result.audit_trail(spark).collect()}
    assert (status["v"], status["t"], status["gone"], status["id"]) == ("SUCCESS", "SUCCESS", "FAILED", "FAILED")
    assert [r["v"] for r in result.tables["x"].orderBy("id").collect()] == [5.0, 4.0, 6.0]
    assert [r["t"] for r in result.tables["x"].orderBy("id").collect()][0] == "a"
