"""Model registry, experiments and run history as queries over event tables.

Registry events are append-only: (seq, model_name, version, event, status,
created_at, mae). Current state is an aggregate over them, so a family with a
large share of the events costs one row per task and version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.ranking import lookup
from millrace.session import durable_checkpoint

PRODUCTION, ARCHIVED = "Production", "Archived"


def registry_state(events: DataFrame) -> DataFrame:
    """(model_name, version, status, created_at, mae) after all events.

    The first registration of a version counts; repeats, versions below 1 and
    events on versions not yet registered are rejected. A promotion archives
    the family's other Production versions.
    """
    seq = F.col("seq")
    when = lambda kind: F.when(F.col("event") == kind, seq)
    registered = F.min(F.when(F.col("event") == "register", F.struct(seq, "status", "created_at", "mae")))
    versions = (
        events.where(F.col("version") >= 1)
        .groupBy("model_name", "version")
        .agg(
            registered.alias("first"),
            F.max(when("promote")).alias("promoted"),
            F.max(when("archive")).alias("archived"),
        )
        .where("first IS NOT NULL")
    )
    after = lambda c: F.when(F.col(c) > F.col("first.seq"), F.col(c))
    versions = versions.withColumns({"promoted": after("promoted"), "archived": after("archived")})
    latest = F.greatest(F.col("first.seq"), "promoted", "archived")
    own = (
        F.when(latest == F.col("promoted"), PRODUCTION)
        .when(latest == F.col("archived"), ARCHIVED)
        .otherwise(F.col("first.status"))
    )
    families = versions.groupBy("model_name").agg(F.max("promoted").alias("family_promoted"))
    demoted = (F.col("own") == PRODUCTION) & (F.col("family_promoted") > F.col("latest"))
    dated = lookup(versions.withColumns({"latest": latest, "own": own}), families, "model_name")
    return dated.select(
        "model_name",
        "version",
        F.when(F.coalesce(demoted, F.lit(False)), ARCHIVED).otherwise(F.col("own")).alias("status"),
        F.col("first.created_at").alias("created_at"),
        F.col("first.mae").alias("mae"),
    )


def production_model(state: DataFrame, family: str | None = None) -> DataFrame:
    """The latest Production version, overall or of a family (case-insensitive)."""
    chosen = state.where(F.col("status") == PRODUCTION)
    if family is not None:
        chosen = chosen.where(F.lower("model_name") == family.strip().lower())
    return chosen.orderBy(F.desc("version"), F.desc("created_at"), "model_name").limit(1)


def production_per_family(state: DataFrame) -> DataFrame:
    """The latest Production version of every family."""
    best = F.max(F.struct("version", "created_at", "mae"))
    return (
        state.where(F.col("status") == PRODUCTION)
        .groupBy("model_name")
        .agg(best.alias("b"))
        .select("model_name", "b.version", "b.created_at", "b.mae")
    )


def registry_summary(state: DataFrame) -> DataFrame:
    """One row: the newest Production model, its metric, and how many versions are archived."""
    live = F.lower("status") == PRODUCTION.lower()
    newest = F.max(F.when(live, F.struct("created_at", "version", "model_name", "mae")))
    archived = F.count_if(F.lower("status") == ARCHIVED.lower())
    return state.agg(newest.alias("n"), archived.alias("archived_models")).select(
        F.col("n.model_name").alias("production_model"),
        F.col("n.version").alias("version"),
        F.col("n.created_at").alias("created_at"),
        F.col("n.mae").alias("mae"),
        "archived_models",
    )


def latest_runs(runs: DataFrame, timestamp: str, key: str, k: int = 3) -> DataFrame:
    return runs.orderBy(F.desc(timestamp), F.desc(key)).limit(k)


def latest_per_family(state: DataFrame, most: int = 2) -> DataFrame:
    """The highest version of each family that has at most ``most`` versions."""
    best = F.max(F.struct("version", "status", "created_at", "mae"))
    return (
        state.groupBy("model_name")
        .agg(best.alias("b"), F.count(F.lit(1)).alias("versions"))
        .where(F.col("versions") <= most)
        .select("model_name", "b.*", "versions")
    )


def training_history(state: DataFrame) -> DataFrame:
    """Registered versions with a time, oldest first, and an error of 0 where none is stored."""
    return (
        state.where("created_at IS NOT NULL")
        .select("created_at", "model_name", "version", "status", F.coalesce("mae", F.lit(0.0)).alias("mae"))
        .orderBy("created_at", "model_name", "version")
    )


# -------------------------------------------------------------- activity feed

_ORDER = ["neg_time", "not_live", "model_name", "neg_version"]


def _feed_rows(state: DataFrame) -> DataFrame:
    status = F.lower("status")
    kind = F.when(status == "production", "live").when(status == "archived", "archived").otherwise("other")
    return state.where("created_at IS NOT NULL").select(
        (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("neg_time"),
        (status != "production").cast("bigint").alias("not_live"),
        "model_name",
        (-F.col("version")).cast("bigint").alias("neg_version"),
        kind.alias("kind"),
        status.alias("status"),
    )


def _numbered_runs(rows: DataFrame) -> DataFrame:
    """``rows`` with ``run``: neighbours of the newest-first order share it if they agree in kind and family.

    Rows are range-partitioned by the order and written to the checkpoint
    folder. Each partition compares neighbours on its own; its first row is
    compared with the last row before it, of which there is one per partition.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable_checkpoint(rows.repartitionByRange(partitions, *_ORDER).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*_ORDER)
    mark = F.struct("kind", "model_name")
    beside = placed.withColumn("before", F.lag(mark).over(inside)).withColumn("place", F.row_number().over(inside))
    starts = (F.col("kind") == "other") | ~mark.eqNullSafe(F.col("before"))
    beside = beside.withColumn("starts", starts.cast("bigint"))
    order = F.struct(*_ORDER)
    borders = beside.groupBy("part").agg(
        F.sum("starts").alias("runs"),
        F.min_by(F.struct("kind", "model_name"), order).alias("head"),
        F.max_by(F.struct("kind", "model_name"), order).alias("tail"),
    )
    by_part = Window.orderBy("part")  # one row per partition
    previous = F.lag("tail").over(by_part)
    joined = (F.col("head.kind") != "other") & F.col("head").eqNullSafe(previous) & previous.isNotNull()
    borders = borders.withColumn("joins", joined.cast("bigint"))
    total = F.sum(F.col("runs") - F.col("joins")).over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    borders = borders.select("part", (total - F.col("runs") + F.col("joins")).alias("offset"), "joins")
    numbered = beside.join(F.broadcast(borders), "part")
    own = F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("run", F.col("offset") + own - F.col("joins")).drop("before", "place", "starts", "offset", "joins")


def activity_feed(state: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` latest registry events: (label, event_time), newest first.

    Neighbouring archived versions of a family form one event dated at its
    oldest; only the first Production entry of a family is an event. Runs are
    numbered in the cluster, so the number of jobs does not depend on the data.
    """
    rows = _numbered_runs(_feed_rows(state))
    order = F.struct(*_ORDER)
    name, version = F.col("model_name"), (-F.col("neg_version")).cast("string")
    archived = (
        rows.where("kind = 'archived'")
        .groupBy("run", "model_name")
        .agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
        .select(
            F.col("last.neg_time").alias("at"),
            F.lit(1).alias("rank"),
            F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" "), name, F.lit(" models archived")))
            .otherwise(F.concat(name, F.lit(" v"), (-F.col("last.neg_version")).cast("string"), F.lit(" archived")))
            .alias("label"),
        )
    )
    live = (
        rows.where("kind = 'live'")
        .groupBy("model_name")
        .agg(F.min(order).alias("first"))
        .select(
            F.col("first.neg_time").alias("at"),
            F.lit(0).alias("rank"),
            F.concat(name, F.lit(" v"), (-F.col("first.neg_version")).cast("string"), F.lit(" promoted to Production")).alias("label"),
        )
    )
    other = rows.where("kind = 'other'").select(
        F.col("neg_time").alias("at"), F.lit(1).alias("rank"), F.concat(name, F.lit(" v"), version, F.lit(" "), "status").alias("label")
    )
    best = archived.unionByName(live).unionByName(other).orderBy("at", "rank", "label").limit(k)
    position = F.row_number().over(Window.orderBy("at", "rank", "label"))  # k rows
    return best.select(position.alias("position"), "label", F.timestamp_micros(-F.col("at")).alias("event_time"))


def dataset_summary(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, rows, columns, column, nulls) for columns that contain nulls."""
    from millrace.operators.checks import cell_checks
    from millrace.spec import TableSpec

    cells = cell_checks(df, TableSpec(dataset), ["nulls"]).where("violations > 0")
    return cells.select(
        F.lit(dataset).alias("dataset"),
        F.col("checked").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "column",
        F.col("violations").alias("nulls"),
    )
