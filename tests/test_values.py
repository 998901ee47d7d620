import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

import millrace.functions.quantiles as Q
from millrace.functions import numeric as N
from millrace.functions import ranking
from millrace.functions import values as V
from millrace.operators import checks, correlate


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_normalize_key_text(spark):
    given = [" 12 ", "12.0", "12.5", "1e3", "007", "A1 ", "", "  ", None, "12345678901234567890", "12d"]
    got = [r[0] for r in column(spark, given).select(V.normalize_key(F.col("v"))).collect()]
    assert got == ["12", "12", "12.5", "1000", "7", "A1", None, None, None, "12345678901234567890", "12d"]


def test_normalize_key_numbers(spark):
    df = column(spark, [5764.0, 3377.0, None], "double")
    assert [r[0] for r in df.select(V.normalize_key(F.col("v"))).collect()] == ["5764", "3377", None]


def test_standard_timestamp(spark):
    given = ["18/05/2026 22:56", "2026-05-19 23:00:00", "18/05/2026", "18/05/2026 22:56:07", "1767261600",
             "1767261600000", "bad", "", None, "2026-01-01T10:00:00Z", "2026-01-01 10:00:00+0530", "99999999999999999"]
    want = ["2026-05-18 22:56:00", "2026-05-19 23:00:00", "2026-05-18 00:00:00", "2026-05-18 22:56:07",
            "2026-01-01 10:00:00", "2026-01-01 10:00:00", None, None, None, "2026-01-01 10:00:00+00:00",
            "2026-01-01 10:00:00+05:30", None]
    got = [r[0] for r in column(spark, given).select(V.format_timestamp(F.col("v"))).collect()]
    assert got == want


def test_numeric_epochs(spark):
    df = column(spark, [1767261600, 1767261600000, None], "long")
    got = [r[0] for r in df.select(V.format_timestamp(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == ["2026-01-01 10:00:00", "2026-01-01 10:00:00", None]


def test_safe_divide_edges(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (nan, 1.0), (inf, 1.0)], "a double, b double"
    )
    got = [r[0] for r in df.select(N.safe_divide(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0, 0, 0, 0, 0, 0]


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (12.97, 77.59, 12.97, 77.59)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(N.haversine_km(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == pytest.approx(math.pi * 6371.0)
    assert got[1] == 0


def test_moments_match_pandas(spark):
    series = pd.Series([1.0, 2.0, 3.0, 10.0])
    df = column(spark, series.tolist(), "double")
    skew, kurt = df.agg(N.skew_corrected(F.col("v")), N.kurtosis_corrected(F.col("v"))).first()
    assert skew == pytest.approx(series.skew()) and kurt == pytest.approx(series.kurt())


def test_moments_of_constant_and_short_columns(spark):
    for values in ([5.0, 5.0, 5.0, 5.0, 5.0], [1.0, 2.0], []):
        df = column(spark, values, "double")
        assert tuple(df.agg(N.skew_corrected(F.col("v")), N.kurtosis_corrected(F.col("v"))).first()) == (None, None)


def test_few_filled_columns_take_one_aggregate(spark, monkeypatch):
    """As products of whole rows give it, without a pass over vectors."""
    rng = random.Random(3)
    table = [(a := rng.gauss(0, 1), a + rng.gauss(0, 0.2), rng.random() * 1e6, float(i % 2), 4.0) for i in range(500)]
    df, columns = spark.createDataFrame(table, "a double, near double, `b.c` double, flag double, flat double").repartition(3), ["a", "near", "b.c", "flag", "flat"]
    with monkeypatch.context() as few:
        few.setattr(correlate, "FEW_COLUMNS", 0)
        want = correlate.filled_matrix(df, columns)
    monkeypatch.setattr(correlate.Correlation, "corr", None)
    got = correlate.filled_matrix(df, columns)
    assert np.allclose(got, want, rtol=0, atol=1e-9, equal_nan=True)
    assert math.isnan(got[0][4]) and got[4][4] == 1.0 and got[0][1] > 0.95
    with pytest.raises(ValueError, match="two rows"):
        correlate.filled_matrix(df.limit(1), columns)


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 6.0)], "a double, b double")
    assert df.agg(N.guarded_corr(F.col("a"), F.col("b"))).first()[0] is None


def test_nan_is_null(spark):
    df = column(spark, [1.0, float("nan"), None], "double")
    assert df.agg(F.count_if(checks.is_null(df, "v"))).first()[0] == 2


@pytest.mark.parametrize("size", [1, 2, 5, 1000, 1601, 50_000])
def test_quantiles_are_exact(spark, size):
    rng = random.Random(size)
    values = [rng.choice([rng.gauss(0, 1), 7.0, rng.randint(0, 5) * 1.0, 1e12 * rng.random()]) for _ in range(size)]
    df = column(spark, values, "double").repartition(7)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["p"]: r["quantile"] for r in Q.exact_quantiles(df, ["v"], ps).collect()}
    for p in ps:
        assert got[p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_quantiles_narrowed_many_times(spark, monkeypatch):
    """Brackets of repeated, infinite and close values are narrowed to the end."""
    monkeypatch.setattr(Q, "LAST_VALUES", 2)
    rng = random.Random(11)
    values = [rng.choice([1.0, 1.0, 2.0, 2.0, float("-inf"), rng.random()]) for _ in range(4000)]
    df = column(spark, values, "double").repartition(3)
    ps = [0.0, 0.3, 0.5, 0.6, 0.9, 1.0]
    got = {r["p"]: r["quantile"] for r in Q.exact_quantiles(df, ["v"], ps).collect()}
    ordered = sorted(values)
    for p in ps:
        at = p * (len(values) - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
        assert got[p] == pytest.approx(low if low == high else low + (at - int(at)) * (high - low), rel=1e-12)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_grouped_quantiles_with_a_hot_group(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 30)}", rng.random()) for _ in range(20_000)]
    df = spark.createDataFrame(data, "g string, v double")
    want = pd.DataFrame(data, columns=["g", "v"]).groupby("g")["v"].median().to_dict()
    got = {r["g"]: r["quantile"] for r in Q.exact_quantiles(df, ["v"], [0.5], ["g"]).collect()}
    assert got == pytest.approx(want)


def test_median_of_nothing_is_null(spark):
    assert Q.quantile_row(column(spark, [None], "double"), {"m": ("v", 0.5)}).first()["m"] is None


def test_distributed_codes_equal_sorted_positions(spark):
    names = sorted({f"n{random.Random(i).randint(0, 5000)}" for i in range(3000)})
    df = column(spark, names).repartition(5)
    got = {r["v"]: r["code"] for r in ranking.distributed_codes(df, "v", 6).collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_median_matches_statistics(spark):
    values = [10.0, 20.0, None]
    got = Q.quantile_row(column(spark, values, "double"), {"m": ("v", 0.5)}).first()["m"]
    assert got == statistics.median([10.0, 20.0])
    assert rows(column(spark, values, "double"), "v")[0] == (None,)
