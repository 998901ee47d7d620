"""Type tests on a DataFrame's schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
MOMENT = (T.TimestampType, T.TimestampNTZType, T.DateType)
SCALAR = INTEGRAL + FRACTIONAL + MOMENT + (T.StringType, T.BooleanType)


def quoted(name: str) -> str:
    """Name that Spark reads literally, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL + FRACTIONAL)


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, MOMENT)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that can be profiled: everything but arrays, maps and structs."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, SCALAR)]


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """The value in a form that can be grouped and ordered: maps become their entries in order of key."""
    if not holds_map(dtype):
        return c
    if isinstance(dtype, T.MapType):
        value = lambda e: comparable(e["value"], dtype.valueType)
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: comparable(x, dtype.elementType))
    return F.when(c.isNotNull(), F.struct(*[comparable(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]))


def _marked(c: Column, dtype: T.DataType) -> Column:
    """The value with a null mark at every level, because hashes pass over nulls."""
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        return _marked(F.array_sort(F.map_entries(c)) if not holds_map(dtype.valueType) else comparable(c, dtype), T.ArrayType(entry))
    if isinstance(dtype, T.ArrayType):
        return F.struct(F.size(c).alias("n"), F.transform(c, lambda x: _marked(x, dtype.elementType)).alias("v"))
    if isinstance(dtype, T.StructType):
        return F.struct(c.isNull().alias("n"), *[_marked(c[f.name], f.dataType).alias(f"v{i}") for i, f in enumerate(dtype.fields)])
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(dtype)  # one zero
    return F.struct(c.isNull().alias("n"), c.alias("v"))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two independent 64-bit hashes of the row's cells, nulls and nested cells included."""
    names = sorted(columns or df.columns)
    cells = [_marked(F.col(quoted(c)), dtype_of(df, c)) for c in names]
    return [F.xxhash64(*cells).alias("digest_1"), F.xxhash64(F.lit("second"), *reversed(cells)).alias("digest_2")]


def logical_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, INTEGRAL):
        return "integer"
    if isinstance(dtype, FRACTIONAL):
        return "float"
    if isinstance(dtype, MOMENT):
        return "datetime"
    return "string"
