"""Arithmetic shared by features, profiling and exploration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient with null, NaN and infinity replaced by 0."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    finite = ~F.isnan(ratio) & (F.abs(ratio) < float("inf"))
    return F.when(finite, ratio).otherwise(F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    phi1, phi2 = F.radians(lat1.cast("double")), F.radians(lat2.cast("double"))
    half_lat = (phi2 - phi1) / 2
    half_lon = (F.radians(lon2.cast("double")) - F.radians(lon1.cast("double"))) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs, null when either side is constant.

    ``corr`` raises on a constant input under ANSI rules; a zero spread gives
    null here.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def skew_corrected(c: Column) -> Column:
    """Bias-corrected skewness (needs three values and a spread)."""
    n = F.count(c).cast("double")
    usable = (n >= 3) & (F.min(c) < F.max(c))
    return F.when(usable, F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2))


def kurtosis_corrected(c: Column) -> Column:
    """Bias-corrected excess kurtosis (needs four values and a spread)."""
    n = F.count(c).cast("double")
    usable = (n >= 4) & (F.min(c) < F.max(c))
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(usable, value)
