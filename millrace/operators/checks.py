"""Data-quality checks.

All cell checks of a table (nulls, types, coordinates, timestamps, targets)
share one scan and one aggregate. Duplicate and foreign-key checks aggregate by
value before anything is joined, so a repeated value costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.operators.rows import rows_of, union_all
from millrace.spec import ColumnSpec, ForeignKey, TableSpec

PASS_SCORE = 80.0
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
BOOLEAN_CELLS = ["true", "false", "True", "False", "1", "0"]


def is_null(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    if isinstance(ty.dtype_of(df, column), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _bad_type(df: DataFrame, spec: ColumnSpec) -> Column | None:
    """Condition under which a non-null cell breaks its declared type."""
    dtype, c = ty.dtype_of(df, spec.name), F.col(spec.name)
    number = V.to_number(c, dtype)
    if spec.dtype == "integer":
        return None if ty.is_integral(dtype) else number.isNull() | (number % 1 != 0)
    if spec.dtype == "float":
        return None if ty.is_numeric(dtype) else number.isNull()
    if spec.dtype == "boolean":
        return None if isinstance(dtype, T.BooleanType) else ~c.cast("string").isin(BOOLEAN_CELLS)
    if spec.dtype == "datetime":
        return None if ty.is_moment(dtype) else V.parse_timestamp(c, dtype).isNull()
    return None


def _cell_plan(df: DataFrame, spec: TableSpec) -> list[tuple[str, str, Column, Column, bool]]:
    """(check, column, checked, violations, counts toward the score) as aggregates."""
    plan = []
    for name in df.columns:
        required = name in spec.non_nullable
        plan.append(("nulls", name, F.count(F.lit(1)), F.count_if(is_null(df, name)), required))
    for column in spec.columns:
        if column.name in df.columns:
            present, bad = ~is_null(df, column.name), _bad_type(df, column)
            count = F.lit(0) if bad is None else F.count_if(present & bad)
            plan.append(("schema", column.name, F.count_if(present), count, True))
    bounds = [(c, LATITUDE_RANGE) for c in spec.latitude] + [(c, LONGITUDE_RANGE) for c in spec.longitude]
    for name, (low, high) in bounds:
        if name in df.columns:
            number = V.to_number(F.col(name), ty.dtype_of(df, name))
            plan.append(("gps", name, F.count(number), F.count_if(~number.between(low, high)), True))
    for name in spec.timestamps:
        if name in df.columns:
            c = F.col(name)
            bad = c.isNotNull() & V.parse_timestamp(c, ty.dtype_of(df, name)).isNull()
            plan.append(("timestamp", name, F.count(c), F.count_if(bad), True))
    low, high = spec.target_range
    for name in spec.targets:
        if name in df.columns:
            number = V.to_number(F.col(name), ty.dtype_of(df, name))
            bad = ~number.between(low, high) | (number.isNull() & ~is_null(df, name))
            plan.append(("target", name, F.count(number), F.count_if(bad), True))
    return plan


def cell_checks(df: DataFrame, spec: TableSpec, checks: list[str] | None = None) -> DataFrame:
    """(check, column, checked, violations, scored) for every cell check, in one scan."""
    plan = [p for p in _cell_plan(df, spec) if checks is None or p[0] in checks]
    aggregates = []
    for i, (_, _, checked, bad, _) in enumerate(plan):
        aggregates += [checked.cast("bigint").alias(f"n{i}"), bad.cast("bigint").alias(f"b{i}")]
    if not aggregates:
        return df.sparkSession.createDataFrame(
            [], "check string, column string, checked bigint, violations bigint, scored boolean"
        )
    structs = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            F.col(f"n{i}").alias("checked"),
            F.col(f"b{i}").alias("violations"),
            F.lit(scored).alias("scored"),
        )
        for i, (check, column, _, _, scored) in enumerate(plan)
    ]
    return rows_of(df.agg(*aggregates), structs)


def null_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, null_count, null_pct, violation) for every column."""
    cells = cell_checks(df, spec, ["nulls"])
    pct = F.round(F.coalesce(F.try_divide(F.col("violations"), F.col("checked")), F.lit(0.0)) * 100, 2)
    return cells.select(
        "column",
        F.col("violations").alias("null_count"),
        pct.alias("null_pct"),
        ((F.col("violations") > 0) & ~F.col("column").isin(spec.nullable)).alias("violation"),
    )


def dtype_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, expected, non_null, violations) against the declared logical types."""
    expected = {c.name: c.dtype for c in spec.columns}
    label = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    return cell_checks(df, spec, ["schema"]).select(
        "column",
        label[F.col("column")].alias("expected"),
        F.col("checked").alias("non_null"),
        "violations",
    )


def bounds_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, checked, invalid) for coordinates outside their range."""
    return cell_checks(df, spec, ["gps"]).select("column", "checked", F.col("violations").alias("invalid"))


def timestamp_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, non_null, invalid, invalid_pct) for timestamps that do not parse."""
    pct = F.round(F.coalesce(F.try_divide("violations", "checked"), F.lit(0.0)) * 100, 2)
    return cell_checks(df, spec, ["timestamp"]).select(
        "column", F.col("checked").alias("non_null"), F.col("violations").alias("invalid"), pct.alias("invalid_pct")
    )


def target_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, checked, negative, too_high, non_numeric) for target values."""
    low, high = spec.target_range
    aggregates, structs = [], []
    for i, name in enumerate(c for c in spec.targets if c in df.columns):
        number = V.to_number(F.col(name), ty.dtype_of(df, name))
        aggregates += [
            F.count(number).alias(f"n{i}"),
            F.count_if(number < low).alias(f"l{i}"),
            F.count_if(number > high).alias(f"h{i}"),
            F.count_if(number.isNull() & ~is_null(df, name)).alias(f"x{i}"),
        ]
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"n{i}").alias("checked"),
                F.col(f"l{i}").alias("negative"),
                F.col(f"h{i}").alias("too_high"),
                F.col(f"x{i}").alias("non_numeric"),
            )
        )
    return rows_of(df.agg(*aggregates), structs)


# ---------------------------------------------------------------- duplicates


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (row_count, duplicate_rows, rows_in_groups): copies beyond the first, and all copies."""
    groups = df.groupBy(*ty.row_digest(df, columns)).agg(F.count(F.lit(1)).alias("copies"))
    n = F.col("copies")
    return groups.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_groups"),
    )


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def duplicate_keys(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The most repeated keys: (key, copies)."""
    return key_counts(df, key).where("copies > 1").orderBy(F.desc("copies"), "key").limit(top)


def _duplicate_numbers(df: DataFrame, spec: TableSpec) -> DataFrame:
    exact = duplicate_rows(df)
    if spec.id_column is None or spec.id_column not in df.columns:
        return exact.withColumn("duplicate_ids", F.lit(0).cast("bigint"))
    repeated = key_counts(df, spec.id_column).agg(
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("duplicate_ids")
    )
    return exact.crossJoin(F.broadcast(repeated))  # one row each


# --------------------------------------------------------------- foreign keys


def paired_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> tuple[Column, Column]:
    """Comparable key expressions; whole-number keys stay numbers."""
    left, right = ty.dtype_of(child, column), ty.dtype_of(parent, parent_column)
    if ty.is_integral(left) and ty.is_integral(right):
        return F.col(column).cast("bigint"), F.col(parent_column).cast("bigint")
    return V.normalize_key(F.col(column), left), V.normalize_key(F.col(parent_column), right)


def parent_keys(parent: DataFrame, key: Column) -> DataFrame:
    return parent.select(key.alias("parent_key")).where("parent_key IS NOT NULL").distinct()


def _child_key_counts(child: DataFrame, key: Column) -> DataFrame:
    return child.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("key").alias("copies"))


def fk_orphans(child: DataFrame, fk: ForeignKey, parents: dict[str, DataFrame]) -> DataFrame:
    """One row (column, parent, checked, orphans, parent_missing) for a foreign key.

    Child rows are counted per key first: the join then sees every key once,
    whatever its share of the rows.
    """
    parent = parents.get(fk.parent)
    missing = parent is None
    if missing:
        key = V.normalize_key(F.col(fk.column), ty.dtype_of(child, fk.column))
        matched = _child_key_counts(child, key).withColumn("orphan", F.lit(True))
    else:
        key, parent_key = paired_keys(child, fk.column, parent, fk.parent_column)
        keys = parent_keys(parent, parent_key)
        counted = _child_key_counts(child, key)
        matched = counted.join(keys, counted["key"] == keys["parent_key"], "left").withColumn(
            "orphan", F.col("parent_key").isNull()
        )
    return matched.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("orphan"), F.col("copies"))), F.lit(0)).alias("orphans"),
    ).select(
        F.lit(fk.column).alias("column"),
        F.lit(fk.parent).alias("parent"),
        "checked",
        "orphans",
        F.lit(missing).alias("parent_missing"),
    )


def fk_orphan_samples(child: DataFrame, fk: ForeignKey, parent: DataFrame, top: int = 10) -> DataFrame:
    """Orphan keys with their row counts, most frequent first."""
    key, parent_key = paired_keys(child, fk.column, parent, fk.parent_column)
    counted, keys = _child_key_counts(child, key), parent_keys(parent, parent_key)
    orphans = counted.join(keys, counted["key"] == keys["parent_key"], "left_anti")
    return orphans.orderBy(F.desc("copies"), "key").limit(top)


# ---------------------------------------------------------------------- suite


def schema_gaps(df: DataFrame, spec: TableSpec) -> tuple[list[str], list[str]]:
    """Missing and extra column names; known without reading data."""
    declared = {c.name for c in spec.columns}
    missing = sorted(set(spec.required_columns) - set(df.columns))
    extra = sorted(set(df.columns) - declared) if declared else []
    return missing, extra


def _result(validator: str | Column, spec: TableSpec, score: Column, clean: Column, checked: Column, bad: Column):
    name = F.lit(validator) if isinstance(validator, str) else validator
    score = F.greatest(F.lit(0.0), score)
    return [
        name.alias("validator"),
        F.lit(spec.name).alias("dataset"),
        ((score >= PASS_SCORE) & clean).alias("passed"),
        score.alias("score"),
        checked.cast("bigint").alias("checked"),
        bad.cast("bigint").alias("violations"),
    ]


def _share_score(bad: Column, total: Column) -> Column:
    return F.lit(100.0) * (1 - F.coalesce(F.try_divide(bad, total), F.lit(0.0)))


def _cell_results(df: DataFrame, spec: TableSpec, checks: list[str] | None = None) -> DataFrame:
    missing, extra = schema_gaps(df, spec)
    scored = F.col("scored")
    per_check = (
        cell_checks(df, spec, checks)
        .groupBy("check")
        .agg(
            F.coalesce(F.sum(F.when(scored, F.col("checked"))), F.lit(0)).alias("checked"),
            F.coalesce(F.sum(F.when(scored, F.col("violations"))), F.lit(0)).alias("violations"),
            F.count_if(scored & (F.col("violations") > 0)).alias("bad_columns"),
            F.count_if(~F.col("column").isin(spec.nullable) & (F.col("violations") > 0)).alias("null_columns"),
        )
    )
    is_schema, is_nulls = F.col("check") == "schema", F.col("check") == "nulls"
    schema_score = F.lit(100.0 - 20.0 * len(missing) - 5.0 * len(extra)) - 10.0 * F.col("bad_columns")
    share = _share_score(F.col("violations"), F.col("checked"))
    clean = (
        F.when(is_schema, F.lit(not missing))
        .when(is_nulls, F.col("null_columns") == 0)
        .otherwise(F.col("violations") == 0)
    )
    return per_check.select(
        *_result(
            F.col("check"),
            spec,
            F.when(is_schema, schema_score).otherwise(share),
            clean,
            F.col("checked"),
            F.col("violations"),
        )
    )


def duplicate_check(df: DataFrame, spec: TableSpec) -> DataFrame:
    rows, ids = F.col("duplicate_rows"), F.col("duplicate_ids")
    bad = F.least(rows + ids, F.col("row_count"))
    return _duplicate_numbers(df, spec).select(
        *_result("duplicates", spec, _share_score(bad, F.col("row_count")), ids == 0, F.col("row_count"), rows + ids)
    )


def fk_check(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]) -> DataFrame:
    parts = union_all([fk_orphans(df, fk, parents) for fk in spec.foreign_keys if fk.column in df.columns])
    total = parts.agg(F.sum("checked").alias("checked"), F.sum("orphans").alias("orphans"))
    bad = F.col("orphans")
    return total.select(
        *_result("foreign_key", spec, _share_score(bad, F.col("checked")), bad == 0, F.col("checked"), bad)
    )


def single_check(df: DataFrame, spec: TableSpec, validator: str, parents: dict | None = None) -> DataFrame:
    """One check of one table as a result row."""
    if validator == "duplicates":
        return duplicate_check(df, spec)
    if validator == "foreign_key":
        return fk_check(df, spec, parents or {})
    return _cell_results(df, spec, [validator])


def validation_suite(tables: dict[str, DataFrame], specs: list[TableSpec]) -> DataFrame:
    """(validator, dataset, passed, score, checked, violations) for every table and applicable check.

    Coordinate, timestamp and target checks appear where such columns are
    declared; the foreign-key check only on tables with foreign keys.
    """
    results = []
    for spec in specs:
        df = tables.get(spec.name)
        if df is None:
            continue
        results += [_cell_results(df, spec), duplicate_check(df, spec)]
        if any(fk.column in df.columns for fk in spec.foreign_keys):
            results.append(fk_check(df, spec, tables))
    return union_all(results)


# ------------------------------------------------------------------- evidence

FINDING = "validator string, dataset string, kind string, subject string, violations bigint"


def _findings(df: DataFrame, validator: Column, spec: TableSpec, kind: str, subject: Column, count: Column) -> DataFrame:
    return df.select(
        validator.alias("validator"),
        F.lit(spec.name).alias("dataset"),
        F.lit(kind).alias("kind"),
        subject.cast("string").alias("subject"),
        count.cast("bigint").alias("violations"),
    ).where("violations > 0")


def validation_findings(tables: dict[str, DataFrame], specs: list[TableSpec], top: int = 10) -> DataFrame:
    """(validator, dataset, kind, subject, violations): what stands behind the suite's results.

    Kinds are ``column`` (cells that break a check, nulls of optional columns
    included), ``missing`` and ``extra`` (columns, without rows), ``copies``
    (rows beyond the first of each group of equal rows), ``repeated id`` and
    ``orphan key`` (the ``top`` most frequent keys, equal counts by key), and
    ``orphans`` (rows by foreign key). A check that found nothing has no row.
    """
    found = []
    for spec in specs:
        df = tables.get(spec.name)
        if df is None:
            continue
        spark = df.sparkSession
        for kind, names in zip(("missing", "extra"), schema_gaps(df, spec), strict=True):
            rows = [("schema", spec.name, kind, name, 1) for name in names]
            found.append(spark.createDataFrame(rows, FINDING))
        found.append(_findings(cell_checks(df, spec), F.col("check"), spec, "column", F.col("column"), F.col("violations")))
        copies = duplicate_rows(df)
        found.append(_findings(copies, F.lit("duplicates"), spec, "copies", F.lit(None), F.col("duplicate_rows")))
        if spec.id_column in df.columns:
            keys = duplicate_keys(df, spec.id_column, top)
            found.append(_findings(keys, F.lit("duplicates"), spec, "repeated id", F.col("key"), F.col("copies")))
        for fk in spec.foreign_keys:
            if fk.column not in df.columns:
                continue
            orphans = fk_orphans(df, fk, tables)
            found.append(_findings(orphans, F.lit("foreign_key"), spec, "orphans", F.col("column"), F.col("orphans")))
            if fk.parent in tables:
                keys = fk_orphan_samples(df, fk, tables[fk.parent], top)
                found.append(_findings(keys, F.lit("foreign_key"), spec, "orphan key", F.col("key"), F.col("copies")))
    return union_all(found)


def with_details(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Suite results with ``details``: (kind, subject, violations) of every finding, most violations first.

    Both tables have a few rows per check. A check without findings has an empty array.
    """
    item = F.struct((-F.col("violations")).alias("less"), "kind", "subject")
    held = findings.groupBy("validator", "dataset").agg(F.array_sort(F.collect_list(item)).alias("items"))
    told = F.transform("items", lambda x: F.struct(x.kind.alias("kind"), x.subject.alias("subject"), (-x.less).alias("violations")))
    empty = F.array().cast("array<struct<kind:string,subject:string,violations:bigint>>")
    joined = results.join(F.broadcast(held), ["validator", "dataset"], "left")
    return joined.select(*results.columns, F.coalesce(told, empty).alias("details"))
