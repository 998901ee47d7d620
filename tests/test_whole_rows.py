"""Row-level operators see every cell: nested values, nulls and null keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import clean
from millrace.operators.checks import duplicate_rows
from millrace.operators.diff import cell_diff
from millrace.sources.sinks import table_fingerprint

NESTED = "id long, a array<double>, m map<string,int>, s struct<x:int,y:array<int>>"
ROWS = [
    (1, [1.0], {"a": 1, "b": 2}, (1, [1])),
    (1, [2.0], {"a": 1, "b": 2}, (1, [1])),
    (1, [1.0], {"b": 2, "a": 1}, (1, [1])),
    (1, [1.0], {"a": 1}, (1, [1])),
    (1, [1.0], {"a": 1, "b": 2}, (1, [None, 1])),
    (1, [1.0], {"a": 1, "b": 2}, (1, [1, None])),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame(ROWS, NESTED)


def test_drop_duplicates_nested(nested):
    out = clean.drop_duplicates(nested)
    assert out.columns == nested.columns and out.count() == 6
    report = duplicate_rows(nested).first()
    assert (report["row_count"], report["duplicate_rows"], report["rows_in_groups"]) == (7, 1, 2)


def test_keyed_duplicates_prefer_full_rows(spark, nested):
    rows = spark.createDataFrame([(1, None, None), (1, "b", 5.0), (2, "x", None), (2, None, 1.0)], "k int, t string, v double")
    assert sorted(map(tuple, clean.drop_duplicates(rows, ["k"]).collect())) == [(1, "b", 5.0), (2, "x", None)]
    assert sorted(map(tuple, clean.drop_duplicates(rows, ["k"], ["v"]).collect())) == [(1, "b", 5.0), (2, None, 1.0)]
    assert clean.drop_duplicates(nested, ["id"]).count() == 2
    assert clean.drop_duplicates(rows.select("k"), ["k"]).count() == 2


def test_fingerprint_sees_nested_and_swapped_nulls(spark, nested):
    base = tuple(table_fingerprint(nested).first())
    assert base == tuple(table_fingerprint(nested.repartition(3)).first())
    assert base != tuple(table_fingerprint(nested.withColumn("a", F.array(F.lit(9.0)))).first())
    two = [tuple(table_fingerprint(spark.createDataFrame([r], "a string, b string")).first()) for r in (("x", None), (None, "x"))]
    assert two[0] != two[1]


def test_diff_of_null_ids_and_nested_cells(spark):
    old = spark.createDataFrame([(None, "a", [1]), (1, "b", [2])], "id long, t string, n array<int>")
    new = spark.createDataFrame([(None, "z", [1]), (1, "b", [3])], "id long, t string, n array<int>")
    got = sorted((r.record_id or "", r.column, r.before, r.after) for r in cell_diff(old, new, "id").collect())
    assert got == [("", "t", "a", "z"), ("1", "n", "[2]", "[3]")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("18-05-2026", dt.datetime(2026, 5, 18)),
        ("8-5-2026 22:56", dt.datetime(2026, 5, 8, 22, 56)),
        ("18-05-2026 22:56:07", dt.datetime(2026, 5, 18, 22, 56, 7)),
        ("20260518", dt.datetime(2026, 5, 18)),
        ("May 18, 2026", dt.datetime(2026, 5, 18)),
        ("september 8 2026 07:05", dt.datetime(2026, 9, 8, 7, 5)),
        ("18 Sept. 2026", dt.datetime(2026, 9, 18)),
        ("18/05/2026 22:56", dt.datetime(2026, 5, 18, 22, 56)),
        ("2026-05-19 23:00:00", dt.datetime(2026, 5, 19, 23)),
        ("31-02-2026", None),
        ("not a date", None),
    ],
)
def test_timestamp_layouts(spark, text, want):
    df = spark.range(1).select(V.parse_timestamp(F.lit(text)).cast("timestamp_ntz").alias("t"))
    assert df.first()["t"] == want


def test_long_keys_stay_apart(spark):
    a, b = "1" * 40, "1" * 39 + "2"
    df = spark.createDataFrame([(a,), (b,), ("00" + a + ".0",), (" 007.0 ",)], "k string")
    got = [r["n"] for r in df.select(V.normalize_key(F.col("k")).alias("n")).collect()]
    assert got == [a, b, a, "7"]
