"""Reading messy cells: numbers, keys, booleans, text and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types as ty

WHITESPACE = " \t\n\r\f\v"
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE_TEXT = r"^[+-]?\d+(\.0*)?$"
OFFSET_TEXT = r"(Z|[+-]\d{2}:?\d{2})$"
OUTPUT_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Words read as booleans, and slash date layouts.
TRUE_WORDS = ["true", "1", "1.0", "yes"]
FALSE_WORDS = ["false", "0", "0.0", "no"]
SLASH_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]

# Years 1 to 9999, in seconds; values of 1e12 and more are milliseconds.
EPOCH_RANGE = (-62135596800, 253402300799)
MILLIS_FROM = 1_000_000_000_000


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    text = strip(c)
    return F.when(text != "", text)


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Value as double; anything unreadable, NaN included, becomes null."""
    if dtype is not None and ty.is_integral(dtype):
        return c.cast("double")
    if dtype is not None and ty.is_numeric(dtype):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    text = strip(c)
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def normalize_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """Key text: ``' 12 '``, ``12.0`` and ``'12.0'`` all become ``'12'``; blank is null."""
    if dtype is not None and ty.is_integral(dtype):
        return c.cast("string")
    text = blank_to_null(c)
    whole = F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("decimal(38,0)").cast("string")
    number = F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))
    return (
        F.when(text.rlike(WHOLE_TEXT) & whole.isNotNull(), whole)
        # Too long for a decimal: the digits themselves, so that different keys stay different.
        .when(text.rlike(WHOLE_TEXT), F.regexp_replace(F.regexp_extract(text, r"^([+-]?\d+)", 1), r"^\+?(-?)0*(?=\d)", "$1"))
        .when((F.abs(number) < 9e15) & (number % 1 == 0), number.cast("bigint").cast("string"))
        .when(number.isNotNull() & ~F.isnan(number), number.cast("string"))
        .otherwise(text)
    )


def to_boolean(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


#: A day as eight digits; as seconds it would lie in the first year of the epoch.
COMPACT_DATE = r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"


def _from_epoch(number: Column) -> Column:
    millis = F.abs(number) >= MILLIS_FROM
    seconds = F.when(millis, number / F.lit(1000.0)).otherwise(number.cast("double"))
    return F.when(seconds.between(*EPOCH_RANGE), F.timestamp_seconds(seconds))


def parse_timestamp(c: Column, dtype: T.DataType | None = None) -> Column:
    """Epoch numbers, compact days, ISO text, day-first dates with slashes or dashes and month names to a timestamp."""
    if dtype is not None and ty.is_moment(dtype):
        return c.cast("timestamp")
    if dtype is not None and ty.is_numeric(dtype):
        return _from_epoch(c)
    text = blank_to_null(c)
    digits = text.rlike(r"^[+-]?\d{1,18}$")
    # The shape picks the layout, so that a failing parse stays rare.
    slashed = F
    for shape, layout in SLASH_FORMATS:
        slashed = slashed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}"), text.try_cast("timestamp"))
    named = F.initcap(F.regexp_replace(F.regexp_replace(text, r"([A-Za-z]{3})[A-Za-z]*\.?", "$1"), r"\s*,?\s+", " "))
    return (
        F.when(text.rlike(COMPACT_DATE), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(digits, _from_epoch(F.when(digits, text).try_cast("bigint")))
        .when(text.contains("/"), slashed)
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}"), F.try_to_timestamp(text, F.lit("d-M-yyyy[ H:mm[:ss]]")))
        .when(text.rlike(r"^[A-Za-z]{3,9}\.? +\d{1,2},? "), F.try_to_timestamp(named, F.lit("MMM d yyyy[ H:mm[:ss]]")))
        .when(text.rlike(r"^\d{1,2} +[A-Za-z]{3,9}\.?,? "), F.try_to_timestamp(named, F.lit("d MMM yyyy[ H:mm[:ss]]")))
        .otherwise(iso)
    )


def format_timestamp(c: Column, dtype: T.DataType | None = None) -> Column:
    """Standard text of a messy timestamp; an offset in the input is kept."""
    plain = F.date_format(parse_timestamp(c, dtype), OUTPUT_FORMAT)
    if dtype is not None and not isinstance(dtype, T.StringType):
        return plain
    text = blank_to_null(c)
    offset = F.regexp_extract(text, OFFSET_TEXT, 1)
    local = F.regexp_replace(text, OFFSET_TEXT, "").try_cast("timestamp_ntz")
    shown = F.when(offset == "Z", "+00:00").when(
        F.length(offset) == 5, F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
    ).otherwise(offset)
    has_offset = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:.*" + OFFSET_TEXT)
    return F.when(has_offset, F.concat(F.date_format(local, OUTPUT_FORMAT), shown)).otherwise(plain)
