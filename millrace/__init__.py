"""Millrace: data quality, profiling, feature and scoring operators on Spark DataFrames.

Every public operator takes DataFrames plus parameters and returns a DataFrame
(or, for model fitting, a ``pyspark.ml`` object).
"""

from millrace.spec import ColumnSpec, ForeignKey, TableSpec

__all__ = ["ColumnSpec", "ForeignKey", "TableSpec"]
