"""Exact quantiles that never gather a column in one task.

``percentile`` and ``median`` keep every distinct value of a group in one
buffer. Here a bounded sketch brackets the wanted rank, a second sketch inside
the bracket narrows it again, and only the few values left are sorted and
counted. Each round is a scan with partial aggregation, so nothing but the
last bracket is shuffled by value, and the interpolated result is exact.

Without groups the brackets are a few numbers, so each round is one aggregate
of one row for all columns and probabilities, with the brackets as literals.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.ranking import all_salts, is_small, task_salt
from millrace.functions.types import quoted
from millrace.session import durable_checkpoint

GRID = 400
ACCURACY = 4000
DIRECT_BELOW = 4 * GRID
BROADCAST_ROWS = 100_000
#: Distinct values of a bracket that are read to settle an ungrouped quantile.
LAST_VALUES = 20_000


def melt_numbers(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Long form (by…, column, value) of numeric columns, nulls and NaN dropped."""
    numbers = [F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    slim = df.select(*by, *numbers)
    if len(columns) == 1:
        long = slim.select(*by, F.lit(columns[0]).alias("column"), F.col(quoted(columns[0])).alias("value"))
    else:
        long = slim.unpivot(list(by), [quoted(c) for c in columns], "column", "value")
    return long.where("value IS NOT NULL")


def _grid(value: Column) -> Column:
    return F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _bracket(grid: Column, rank: Column, size: Column) -> tuple[Column, Column]:
    """Grid values that surely enclose positions ``rank`` and ``rank + 1`` of ``size``."""
    direct = size < DIRECT_BELOW
    low = F.floor(F.try_divide(rank * GRID, size)) - 2
    high = F.ceil(F.try_divide((rank + 2) * GRID, size)) + 2
    at = lambda index: F.get(grid, index.cast("int"))
    return (
        F.when(direct, at(F.lit(0))).otherwise(at(F.greatest(low, F.lit(0)))),
        F.when(direct, at(F.lit(GRID))).otherwise(at(F.least(high, F.lit(GRID)))),
    )


def attach(long: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Join (keys…, value) rows to a table with a few rows per group.

    Without groups there is one bracket per column and probability, so it is
    broadcast; with groups only after their number was checked. Otherwise a
    group is spread over salts, so one large group fills many tasks.
    """
    if small:
        return long.join(F.broadcast(table), keys)
    salted = long.withColumn("salt", task_salt())
    copies = table.withColumn("salt", all_salts())
    return salted.join(copies, [*keys, "salt"]).drop("salt")


@dataclass
class _Search:
    """A quantile that is being narrowed down: the values at ``rank`` and ``rank + 1`` lie in ``low``…``high``."""

    column: str
    position: float
    size: int
    low: float
    high: float
    first: float | None = None
    second: float | None = None
    below: int | None = None

    @property
    def rank(self) -> int:
        return math.floor(self.position)

    @property
    def found(self) -> bool:
        return self.first is not None

    @property
    def middle(self) -> float:
        top = sys.float_info.max
        half = max(self.low, -top) / 2 + min(self.high, top) / 2
        return half if self.low <= half < self.high else math.nextafter(self.high, -math.inf)

    def settle(self, first: float, second: float) -> None:
        self.first, self.second = first, second

    def value(self) -> float:
        if self.first == self.second:  # also where both are infinite
            return self.first
        return self.first + (self.position - self.rank) * (self.second - self.first)


def _grid_cut(grid: list[float], rank: int, size: int) -> tuple[float, float]:
    """As ``_bracket``, on numbers."""
    if size < DIRECT_BELOW:
        return grid[0], grid[GRID]
    low = max(math.floor(rank * GRID / size) - 2, 0)
    high = min(math.ceil((rank + 2) * GRID / size) + 2, GRID)
    return grid[low], grid[high]


def _narrow(numbers: DataFrame, searches: list[_Search]) -> None:
    """One scan for all open searches: counts below and inside, a grid inside, and both sides of the middle."""
    aggregates = []
    for i, s in enumerate(searches):
        x = F.col(s.column)
        inside = x.between(F.lit(s.low), F.lit(s.high))
        left = inside & (x <= F.lit(s.middle))
        aggregates += [
            F.count_if(x < F.lit(s.low)).alias(f"b{i}"),
            F.count_if(inside).alias(f"n{i}"),
            _grid(F.when(inside, x)).alias(f"g{i}"),
            F.count_if(left).alias(f"l{i}"),
            F.max(F.when(left, x)).alias(f"p{i}"),
            F.min(F.when(inside & ~left, x)).alias(f"q{i}"),
        ]
    row = numbers.agg(*aggregates).first()
    for i, s in enumerate(searches):
        s.below, inside, left = row[f"b{i}"], row[f"n{i}"], row[f"l{i}"]
        at, old = s.rank - s.below, (s.low, s.high)
        if inside <= LAST_VALUES:
            s.size = inside
            continue
        s.low, s.high = _grid_cut(row[f"g{i}"], at, inside)
        s.size = LAST_VALUES + 1
        if (s.low, s.high) == old:  # few values, often repeated: halve the range instead
            if at + 1 == left:
                s.settle(row[f"p{i}"], row[f"q{i}"])
            elif at + 1 < left:
                s.high = row[f"p{i}"]
            else:
                s.low = row[f"q{i}"]


def _bracket_share(size: int) -> float:
    """Share of ``size`` values that a first bracket holds at most, ties apart: six steps of the grid and the sketch's error."""
    return 1.0 if size < DIRECT_BELOW else 6 / GRID + 4 / ACCURACY


def _settle(numbers: DataFrame, searches: list[_Search]) -> None:
    """One scan for all searches: the counts of all values inside, and of those below where they are not counted yet."""
    slots: dict[tuple, int] = {}
    for s in searches:
        slots.setdefault((s.column, s.low, s.high, s.below), len(slots))
    cells = []
    for (column, low, high, below), i in slots.items():
        x, tagged = F.col(column), lambda v: F.struct(F.lit(i).alias("i"), v.alias("v"))  # noqa: B023
        cell = F.when(x.between(F.lit(low), F.lit(high)), tagged(x))
        cells.append(cell.when(x < F.lit(low), tagged(F.lit(None).cast("double"))) if below is None else cell)
    values = numbers.select(F.explode(F.array_compact(F.array(*cells))).alias("e"))
    counts: dict[int, list] = {}
    for r in values.groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n")).collect():  # LAST_VALUES a search
        counts.setdefault(r["i"], []).append((r["v"], r["n"]))
    for told in counts.values():
        told.sort(key=lambda e: (e[0] is not None, e[0]))
    for s in searches:
        at, run, found = s.rank - (s.below or 0), 0, []
        for v, n in counts[slots[s.column, s.low, s.high, s.below]]:
            run += n
            while v is not None and len(found) < 2 and run > at + len(found):
                found.append(v)
        s.settle(found[0], found[-1])


def _searched(df: DataFrame, wanted: list[tuple[str, float]]) -> dict[tuple[str, float], tuple[int, float | None]]:
    """(column, p) -> (count, quantile), exact. One scan for counts and sketches, one for the values around each rank;
    between them rounds that narrow the brackets of long columns."""
    names = {c: f"x{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in wanted))}
    null = F.lit(None).cast("double")
    numbers = df.select(*[F.nanvl(F.col(quoted(c)).cast("double"), null).alias(x) for c, x in names.items()])
    row = numbers.agg(*[f(F.col(x)).alias(k + x) for x in names.values() for k, f in (("n", F.count), ("g", _grid))]).first()
    searches: dict[tuple[str, float], _Search] = {}
    for c, p in wanted:
        n = row["n" + names[c]]
        if n:
            position = p * (n - 1)
            low, high = _grid_cut(row["g" + names[c]], math.floor(position), n)
            searches[c, p] = _Search(names[c], position, math.ceil(n * _bracket_share(n)), low, high)
    while True:
        for s in searches.values():
            if not s.found and s.low == s.high:
                s.settle(s.low, s.low)
        wide = [s for s in searches.values() if not s.found and s.size > LAST_VALUES]
        if not wide:
            break
        _narrow(numbers, wide)
    last = [s for s in searches.values() if not s.found]
    if last:
        _settle(numbers, last)
    return {(c, p): (row["n" + names[c]], searches[c, p].value() if (c, p) in searches else None) for c, p in wanted}


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] = ()
) -> DataFrame:
    """(by…, column, p, n, quantile) with linear interpolation between ranks."""
    by = list(by)
    if not by:
        found = _searched(df, [(c, float(p)) for c in columns for p in probabilities])
        rows = [(c, p, n, q) for (c, p), (n, q) in found.items() if n]
        return literal_rows(df, rows, "column string, p double, n bigint, quantile double")
    keys = [*by, "column"]
    long = melt_numbers(df, columns, by)
    position = F.col("p") * (F.col("n") - 1)
    first = (
        long.groupBy(*keys)
        .agg(F.count("value").alias("n"), _grid(F.col("value")).alias("grid"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("position", position)
        .withColumn("rank", F.floor("position").cast("bigint"))
    )
    low, high = _bracket(F.col("grid"), F.col("rank"), F.col("n"))
    first = first.select(*keys, "p", "n", "position", "rank", low.alias("low"), high.alias("high"))

    first = durable_checkpoint(first)
    small = is_small(first, BROADCAST_ROWS)

    value, inside = F.col("value"), (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    goal = ["p", "n", "position", "rank"]
    second = (
        attach(long, first, keys, small)
        .where(value <= F.col("high"))
        .groupBy(*keys, *goal)
        .agg(
            F.count_if(value < F.col("low")).alias("below"),
            F.count_if(inside).alias("size"),
            _grid(F.when(inside, value)).alias("grid"),
            F.min("low").alias("outer_low"),
        )
    )
    low, high = _bracket(F.col("grid"), F.col("rank") - F.col("below"), F.col("size"))
    second = second.select(*keys, *goal, "below", "outer_low", low.alias("low"), high.alias("high"))

    # One row per distinct value of the last bracket; everything under it is a single row.
    slot = F.when(value >= F.col("low"), value)
    counts = (
        attach(long, second, keys, small)
        .where((value >= F.col("outer_low")) & (value <= F.col("high")))
        .groupBy(*keys, *goal, "below", slot.alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    running = Window.partitionBy(*keys, "p").orderBy(F.col("value").asc_nulls_first())
    upto = F.col("below") + F.sum("copies").over(running)
    ranked = counts.withColumn("upto", upto).where("value IS NOT NULL")
    at_rank = F.min(F.when(F.col("upto") > F.col("rank"), F.col("value")))
    after_rank = F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("value")))
    fraction = F.col("position") - F.col("rank")
    return (
        ranked.groupBy(*keys, *goal)
        .agg(at_rank.alias("low"), after_rank.alias("high"))
        .select(
            *keys,
            "p",
            "n",
            (F.col("low") + fraction * (F.coalesce("high", "low") - F.col("low"))).alias("quantile"),
        )
    )


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column per ``alias -> (column, probability)``; null where no value exists."""
    found = _searched(df, [(c, float(p)) for c, p in dict.fromkeys(wanted.values())])
    cells = [(found[c, float(p)][1], alias) for alias, (c, p) in wanted.items()]
    return df.sparkSession.range(0, 1, 1, 1).select(*[F.lit(q).cast("double").alias(alias) for q, alias in cells])


def literal_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held in the plan."""
    fields = [part.split() for part in schema.split(", ")]
    cell = lambda v, kind, name: F.lit(v).cast(kind).alias(name)
    structs = [F.struct(*[cell(v, kind, name) for v, (name, kind) in zip(row, fields, strict=True)]) for row in rows]
    empty = F.array().cast(f"array<struct<{', '.join(f'{n}:{k}' for n, k in fields)}>>")
    return df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*structs) if structs else empty))
