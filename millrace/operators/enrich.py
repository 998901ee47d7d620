"""Checks around, and the join into, the wide feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as ty
from millrace.operators.checks import key_counts, paired_keys, parent_keys
from millrace.operators.rows import union_all
from millrace.spec import ForeignKey


def assert_required_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> None:
    """Raise when a table lacks a required column or has no rows."""
    for name, columns in required.items():
        if name not in tables:
            raise ValueError(f"missing table: {name}")
        missing = [c for c in columns if c not in tables[name].columns]
        if missing:
            raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
        if tables[name].isEmpty():
            raise ValueError(f"{name} is empty")


def key_uniqueness(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """One row (dataset, key_column, distinct_keys, repeated_keys, is_unique)."""
    repeated = F.count_if(F.col("copies") > 1)
    return key_counts(df, key).agg(
        F.count(F.lit(1)).alias("distinct_keys"), repeated.alias("repeated_keys")
    ).select(
        F.lit(dataset).alias("dataset"),
        F.lit(key).alias("key_column"),
        "distinct_keys",
        "repeated_keys",
        (F.col("repeated_keys") == 0).alias("is_unique"),
    )


def assert_unique_keys(tables: dict[str, DataFrame], keys: dict[str, str]) -> None:
    report = union_all([key_uniqueness(tables[n], n, k) for n, k in keys.items()])
    bad = [r["dataset"] for r in report.where("NOT is_unique").collect()]  # one row per table
    if bad:
        raise ValueError(f"keys repeat in: {', '.join(bad)}")


def missing_references(child: DataFrame, fk: ForeignKey, parent: DataFrame, top: int = 10) -> DataFrame:
    """The first ``top`` child keys without a parent."""
    key, parent_key = paired_keys(child, fk.column, parent, fk.parent_column)
    found = child.select(key.alias("key")).where("key IS NOT NULL").distinct()
    keys = parent_keys(parent, parent_key)
    return found.join(keys, found["key"] == keys["parent_key"], "left_anti").orderBy("key").limit(top)


def assert_references(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> None:
    left, right = ty.dtype_of(child, fk.column), ty.dtype_of(parent, fk.parent_column)
    if left != right:
        raise ValueError(f"{fk.column} is {left.simpleString()} but its parent key is {right.simpleString()}")
    offenders = [r["key"] for r in missing_references(child, fk, parent).collect()]
    if offenders:
        raise ValueError(f"{fk.column} refers to missing rows of {fk.parent}: {offenders}")


def enrich_join(child: DataFrame, parents: list[tuple[ForeignKey, DataFrame, str]], mark: bool = False) -> DataFrame:
    """Left-join every parent; names that collide get the parent's suffix.

    No hint is given: Spark broadcasts a parent whose size it knows to be
    small, and splits skewed keys of a sort-merge join otherwise. With ``mark``
    a ``<suffix>_matched`` flag tells which rows found a parent.
    """
    wide = child
    for fk, parent, suffix in parents:
        taken = set(wide.columns)
        renamed = {c: f"{c}_{suffix}" if c in taken else c for c in parent.columns}
        right = parent.select(*[F.col(c).alias(n) for c, n in renamed.items()])
        if mark:
            right = right.withColumn(f"{suffix}_matched", F.lit(True))
        wide = wide.join(right, wide[fk.column] == right[renamed[fk.parent_column]], "left")
        if mark:
            wide = wide.withColumn(f"{suffix}_matched", F.coalesce(f"{suffix}_matched", F.lit(False)))
    return wide


def verify_join(child: DataFrame, wide: DataFrame, key: str, fks: dict[str, str]) -> DataFrame:
    """One row of facts about a marked join: rows, repeats, matches and null keys.

    ``fks`` maps a foreign-key column to its match flag.
    """
    before = child.agg(F.count(F.lit(1)).alias("rows_before"))
    facts = [F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in fks]
    facts += [F.count_if(F.col(c).isNotNull() & ~F.col(m)).alias(f"{c}_unmatched") for c, m in fks.items()]
    after = wide.agg(F.count(F.lit(1)).alias("rows_after"), *facts)
    repeats = key_counts(wide, key).agg(F.count_if(F.col("copies") > 1).alias("repeated_keys"))
    one = before.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(repeats))  # one row each
    problems = [F.col(f"{c}_{kind}") for c in fks for kind in ("null", "unmatched")]
    clean = (F.col("rows_before") == F.col("rows_after")) & (F.col("repeated_keys") == 0)
    for problem in problems:
        clean = clean & (problem == 0)
    return one.withColumn("passed", clean)
