"""Join inference between tables.

Pairs of columns are pruned on the profile table and by name before any data is
read; the surviving columns are compared through one table of distinct keys,
grouped by key, so no pair of tables is joined on its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import names
from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.operators.rows import literal_table, union_all
from millrace.session import durable_checkpoint

# Evidence weights, tiers and thresholds.
WEIGHTS = {"name": 0.40, "integrity": 0.30, "cardinality": 0.15, "dtype": 0.10, "overlap": 0.05}
CONFIRMED, LIKELY = 0.80, 0.65
TARGET_UNIQUE_PCT, TARGET_NULL_PCT = 85.0, 10.0
KEY_UNIQUE_PCT = 90.0
DISTINCT_RATIO = 0.95
REQUIRED_OVERLAP = 0.95
PAIR = ["source_dataset", "source_column", "target_dataset", "target_column"]
DESCRIPTIVE = ["avg_rating", "completed_orders", "prep_capacity", "shift_hours", "order_size"]


def key_like(name: Column) -> Column:
    low = F.lower(name)
    return (
        (low == "id")
        | low.endswith("_id")
        | low.startswith("id_")
        | low.isin(names.KEY_WORDS)
        | F.array_contains(F.split(low, "_"), "id")
    )


def _key_like_name(name: str) -> bool:
    low = name.lower()
    return low in names.KEY_WORDS or "id" in low.split("_")


def _singular(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "s$", "")


def _entity(name: Column) -> Column:
    """``customer_id`` and ``id_customer`` give ``customer``; other names give null."""
    low = F.lower(name)
    return F.when(low.endswith("_id"), F.regexp_replace(low, "_id$", "")).when(
        low.startswith("id_"), F.regexp_replace(low, "^id_", "")
    )


def detect_primary_keys(roles: DataFrame) -> DataFrame:
    """(dataset, column) of likely primary keys."""
    return roles.where(
        F.array_contains("roles", "identifier")
        & ((F.col("unique_pct") >= KEY_UNIQUE_PCT) | (F.lower("column") == "id"))
    ).select("dataset", "column")


def _type_class(dtype: Column) -> Column:
    return F.when(dtype.isin("integer", "float"), "numeric").otherwise(dtype)


def join_candidates(profile: DataFrame) -> DataFrame:
    """Column pairs worth comparing, from the profile table alone."""
    columns = profile.withColumn("type_class", _type_class(F.col("logical_dtype")))
    source = columns.select(
        F.col("dataset").alias("source_dataset"),
        F.col("column").alias("source_column"),
        F.col("logical_dtype").alias("source_dtype"),
        F.col("null_count").alias("source_nulls"),
        "type_class",
    )
    target = columns.where(
        (F.col("unique_pct") >= TARGET_UNIQUE_PCT) & (F.col("null_pct") <= TARGET_NULL_PCT)
    ).select(
        F.col("dataset").alias("target_dataset"),
        F.col("column").alias("target_column"),
        F.col("logical_dtype").alias("target_dtype"),
        "type_class",
    )
    named = key_like(F.col("source_column")) | key_like(F.col("target_column"))
    return (
        source.join(target, "type_class")
        .where((F.col("source_dataset") != F.col("target_dataset")) & named)
        .drop("type_class")
    )


def name_similarity(source_ds: Column, source: Column, target_ds: Column, target: Column) -> Column:
    low_s, low_t = F.lower(source), F.lower(target)
    ent_s, ent_t = F.coalesce(_entity(source), low_s), F.coalesce(_entity(target), low_t)
    other = _singular(F.when(low_s == "id", ent_t).otherwise(ent_s))
    table = _singular(F.when(low_s == "id", source_ds).otherwise(target_ds))
    near = other.contains(table) | table.contains(other)
    return (
        F.when((low_s == low_t) & (low_s == "id"), 0.1)
        .when(low_s == low_t, 1.0)
        .when((low_s == "id") | (low_t == "id"), F.when(other == table, 1.0).when(near, 0.8).otherwise(0.0))
        .when(_singular(ent_s) == _singular(ent_t), 1.0)
        .otherwise(0.0)
    )


def join_plausible(
    source_ds: Column, source: Column, target_ds: Column, target: Column, descriptive: list[str] = DESCRIPTIVE
) -> Column:
    """Both columns are keys, their entities agree, and neither is a descriptive attribute."""
    low_s, low_t = F.lower(source), F.lower(target)
    ent_s, ent_t = _singular(_entity(source)), _singular(_entity(target))
    agree = lambda a, b: a.contains(b) | b.contains(a)
    aligned = (
        F.when((low_s == "id") & ent_t.isNotNull(), agree(_singular(source_ds), ent_t))
        .when((low_t == "id") & ent_s.isNotNull(), agree(_singular(target_ds), ent_s))
        .when(ent_s.isNotNull() & ent_t.isNotNull(), ent_s == ent_t)
        .otherwise(True)
    )
    return (
        ~low_s.isin(descriptive)
        & ~low_t.isin(descriptive)
        & key_like(source)
        & key_like(target)
        & ~((low_s == "id") & (low_t == "id"))
        & aligned
    )


def cardinality(source_ratio: Column, target_ratio: Column, target_is_key: Column) -> Column:
    r = DISTINCT_RATIO
    return (
        F.when(target_is_key & (source_ratio < r), "many_to_one")
        .when((source_ratio > r) & (target_ratio > r), "one_to_one")
        .when((source_ratio > r) & (target_ratio < r), "one_to_many")
        .when((source_ratio < r) & (target_ratio < r), "many_to_many")
        .otherwise("many_to_one")
    )


def key_values(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(dataset, column, key, copies) of the normalised keys of key-like columns."""
    parts = []
    for name, df in tables.items():
        chosen = (columns or {}).get(name) or [c for c in ty.scalar_columns(df) if _key_like_name(c)]
        if not chosen:
            continue
        keys = [V.normalize_key(F.col(c), ty.dtype_of(df, c)).alias(c) for c in chosen]
        long = df.select(*keys).unpivot([], chosen, "column", "key").where("key IS NOT NULL")
        parts.append(long.groupBy("column", "key").agg(F.count("key").alias("copies")).withColumn("dataset", F.lit(name)))
    return union_all(parts)


def key_ratios(keys: DataFrame) -> DataFrame:
    """(dataset, column, distinct_keys, distinct_ratio)."""
    return keys.groupBy("dataset", "column").agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.count(F.lit(1)) / F.sum("copies")).alias("distinct_ratio"),
    )


def key_sets(keys: DataFrame) -> DataFrame:
    """(holders, dataset, column, keys, copies): a row for each set of columns that hold the same keys and each of its columns.

    ``keys`` are those of ``key_values``, grouped once whatever the number of pairs;
    equal sets are counted together, so the result is small.
    """
    held = keys.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dataset", "column", "copies"))).alias("held"))
    holders = F.transform("held", lambda h: F.struct(h["dataset"].alias("dataset"), h["column"].alias("column")))
    each = held.select(holders.alias("holders"), F.explode("held").alias("own"))
    return each.groupBy("holders", "own.dataset", "own.column").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("own.copies").alias("copies")
    )


def _set_ratios(sets: DataFrame) -> DataFrame:
    """As ``key_ratios``."""
    return sets.groupBy("dataset", "column").agg(
        F.sum("keys").alias("distinct_keys"), (F.sum("keys") / F.sum("copies")).alias("distinct_ratio")
    )


def _set_overlap(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """As ``key_overlap``."""
    small = F.broadcast(pairs.select(*PAIR).distinct())
    on = (F.col("dataset") == F.col("source_dataset")) & (F.col("column") == F.col("source_column"))
    in_target = F.exists(
        "holders", lambda h: (h["dataset"] == F.col("target_dataset")) & (h["column"] == F.col("target_column"))
    )
    found = sets.join(small, on).groupBy(*PAIR).agg(
        F.sum(F.when(in_target, F.col("keys")).otherwise(0)).alias("matched"), F.sum("keys").alias("distinct_keys")
    )
    return found.withColumn("overlap", F.col("matched") / F.col("distinct_keys"))


def key_overlap(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair columns…, matched, distinct_keys, overlap): share of source keys found in the target.

    Only the counts of ``key_sets`` meet ``pairs``, which has at most one row per
    pair of key-like columns and is broadcast.
    """
    return _set_overlap(key_sets(keys), pairs)


def plausible_pairs(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """Key-like column pairs of different tables, by name alone."""
    named = [(t, c) for t, df in tables.items() for c in ty.scalar_columns(df) if _key_like_name(c)]
    return [(a, b, c, d) for a, b in named for c, d in named if a != c]


def pair_table(spark, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    schema = "source_dataset string,source_column string,target_dataset string,target_column string"
    return literal_table(spark, pairs, schema)


def detect_relationships(tables: dict[str, DataFrame], roles: DataFrame) -> DataFrame:
    """Likely joins with their evidence, most confident first by ``join_confidence``."""
    spark = roles.sparkSession
    s_ds, s, t_ds, t = (F.col(c) for c in ("source_dataset", "source_column", "target_dataset", "target_column"))
    named = pair_table(spark, plausible_pairs(tables)).where(join_plausible(s_ds, s, t_ds, t))
    pair = named.columns

    # All keys are read and grouped once, for the ratios of both sides and the overlaps.
    sets = durable_checkpoint(key_sets(key_values(tables)))
    ratios = _set_ratios(sets)
    overlap = _set_overlap(sets, named)
    primary = detect_primary_keys(roles).select(
        F.col("dataset").alias("target_dataset"), F.col("column").alias("target_column"), F.lit(True).alias("is_key")
    )

    def ratio(prefix: str) -> DataFrame:
        return ratios.select(
            F.col("dataset").alias(f"{prefix}_dataset"),
            F.col("column").alias(f"{prefix}_column"),
            F.col("distinct_ratio").alias(f"{prefix}_ratio"),
        )

    # All of these tables hold one row per column or pair of columns.
    evidence = (
        join_candidates(roles)
        .join(F.broadcast(overlap), pair)
        .join(F.broadcast(ratio("source")), ["source_dataset", "source_column"])
        .join(F.broadcast(ratio("target")), ["target_dataset", "target_column"])
        .join(F.broadcast(primary), ["target_dataset", "target_column"], "left")
    )
    same = F.col("source_dtype") == F.col("target_dtype")
    kind = F.col("cardinality")
    scored = evidence.withColumn(
        "cardinality",
        cardinality(F.col("source_ratio"), F.col("target_ratio"), F.coalesce("is_key", F.lit(False))),
    ).withColumns(
        {
            "name_score": name_similarity(s_ds, s, t_ds, t),
            "cardinality_score": F.when(kind.isin("many_to_one", "one_to_one"), 1.0)
            .when(kind == "one_to_many", 0.8)
            .otherwise(0.1),
            "dtype_score": F.when(same, 1.0).otherwise(0.8),
        }
    )
    confidence = (
        F.col("name_score") * WEIGHTS["name"]
        + F.col("overlap") * WEIGHTS["integrity"]
        + F.col("cardinality_score") * WEIGHTS["cardinality"]
        + F.col("dtype_score") * WEIGHTS["dtype"]
        + F.col("overlap") * WEIGHTS["overlap"]
    )
    tier = F.when(F.col("confidence") >= CONFIRMED, "Confirmed").when(F.col("confidence") >= LIKELY, "Likely")
    no_nulls = F.col("source_nulls") == 0
    return (
        scored.withColumn("confidence", confidence)
        .withColumn("tier", tier)
        .where("tier IS NOT NULL")
        .select(
            *pair,
            "tier",
            "cardinality",
            F.round("confidence", 4).alias("join_confidence"),
            F.round("overlap", 4).alias("overlap_ratio"),
            F.round(F.col("name_score") * WEIGHTS["name"], 4).alias("name_part"),
            F.round(F.col("overlap") * WEIGHTS["integrity"], 4).alias("integrity_part"),
            F.round(F.col("cardinality_score") * WEIGHTS["cardinality"], 4).alias("cardinality_part"),
            F.round(F.col("dtype_score") * WEIGHTS["dtype"], 4).alias("dtype_part"),
            F.round(F.col("overlap") * WEIGHTS["overlap"], 4).alias("overlap_part"),
            (~no_nulls).alias("optional"),
            ((F.col("overlap") >= REQUIRED_OVERLAP) & no_nulls).alias("required"),
            F.when(F.col("overlap") >= REQUIRED_OVERLAP, "inner").otherwise("left").alias("join_type"),
        )
    )


def foreign_key_columns(relationships: DataFrame) -> DataFrame:
    """(dataset, column) of the source side of every kept relationship."""
    return relationships.select(
        F.col("source_dataset").alias("dataset"), F.col("source_column").alias("column")
    ).distinct()


def merge_plan(relationships: DataFrame) -> DataFrame:
    """One recommended join per column pair, ranked by confidence."""
    pair = PAIR
    kind = F.col("cardinality")
    strategy = (
        F.when(kind == "many_to_one", "enrich_source_with_target")
        .when(kind == "one_to_many", "aggregate_target_to_source")
        .when(kind == "many_to_many", "bridge_or_aggregate_before_join")
        .otherwise("direct_join")
    )
    # A result table: one row per pair of key columns.
    order = Window.orderBy(F.desc("confidence"), "left_dataset", "left_on", "right_dataset", "right_on")
    return (
        relationships.dropDuplicates(pair)
        .select(
            F.col("source_dataset").alias("left_dataset"),
            F.col("target_dataset").alias("right_dataset"),
            F.col("source_column").alias("left_on"),
            F.col("target_column").alias("right_on"),
            F.when(F.col("required"), "inner").otherwise("left").alias("join_type"),
            "optional",
            "required",
            F.col("join_confidence").alias("confidence"),
            "cardinality",
            strategy.alias("strategy"),
        )
        .withColumn("rank", F.row_number().over(order))
    )


def graph_nodes(relationships: DataFrame, datasets: list[str]) -> DataFrame:
    """(id, degree) of every table; tables without a relationship have degree 0."""
    ends = relationships.select(F.explode(F.array("source_dataset", "target_dataset")).alias("id"))
    all_ids = literal_table(relationships.sparkSession, [(d,) for d in datasets], "id string")
    degree = ends.groupBy("id").agg(F.count("id").alias("degree"))
    return all_ids.join(F.broadcast(degree), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_edges(relationships: DataFrame) -> DataFrame:
    label = F.concat("source_column", F.lit(" -> "), "target_column")
    return relationships.select(
        F.col("source_dataset").alias("source"),
        F.col("target_dataset").alias("target"),
        label.alias("label"),
        "cardinality",
        F.col("join_confidence").alias("confidence"),
    )
