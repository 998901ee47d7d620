"""Queries on scans, schema, checks and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import checks as C
from millrace.operators import scoring as S
from millrace.functions import values as V
from millrace.functions.names import DATETIME_VALUES
from millrace.operators.rows import union_all
from millrace.plans.catalog import query, rounded, union_sql
from millrace.plans.tables import BASE, with_views
from millrace.sources import files, sinks
from millrace.spec import ColumnSpec, ForeignKey, TableSpec

ORDERS = TableSpec(
    name="dirty_orders",
    id_column="id",
    columns=(
        ColumnSpec("id", "integer", nullable=False),
        ColumnSpec("customer_id", "integer", nullable=False),
        ColumnSpec("order_value", "float"),
        ColumnSpec("order_status"),
        ColumnSpec("promo_code", nullable=False),
        ColumnSpec("order_time", "datetime"),
        ColumnSpec("drop_lat", "float"),
        ColumnSpec("drop_lon", "float"),
        ColumnSpec("order_size", "integer", nullable=False),
        ColumnSpec("delivery_minutes", "integer"),
        ColumnSpec("is_gift", "boolean"),
        ColumnSpec("courier_note"),
    ),
    foreign_keys=(ForeignKey("customer_id", "customers", "id"),),
    latitude=("drop_lat",),
    longitude=("drop_lon",),
    timestamps=("order_time",),
    targets=("delivery_minutes",),
)
CUSTOMERS = TableSpec(
    name="customers",
    id_column="id",
    columns=(
        ColumnSpec("id", "integer", nullable=False),
        ColumnSpec("name", nullable=False),
        ColumnSpec("lat", "float", nullable=False),
        ColumnSpec("lon", "float", nullable=False),
        ColumnSpec("segment"),
        ColumnSpec("balance", "float"),
        ColumnSpec("prep_capacity", "integer"),
        ColumnSpec("avg_rating", "float"),
    ),
    latitude=("lat",),
    longitude=("lon",),
)
SPECS = [CUSTOMERS, ORDERS]
ORDER_COLUMNS = [
    "id", "customer_id", "order_value", "order_status", "promo_code", "order_time", "drop_lat", "drop_lon",
    "order_size", "delivery_minutes", "is_gift", "weight",
]
CUSTOMER_COLUMNS = ["id", "name", "lat", "lon", "segment", "balance", "prep_capacity", "avg_rating"]

DIRTY = with_views("dirty_orders")
BOTH = with_views("dirty_orders", "customers")

# SQL form of timestamp parsing for the checking engine.
PARSED_SQL = """CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN to_timestamp(CAST(trim({c}) AS BIGINT))::TIMESTAMP
    WHEN contains({c}, '/') THEN try_strptime(trim({c}), ['%d/%m/%Y %H:%M', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y'])
    ELSE try_cast(trim({c}) AS TIMESTAMP) END"""


def parsed_sql(column: str) -> str:
    return PARSED_SQL.format(c=column)


# ---------------------------------------------------------------------- scans


def scratch(t) -> str:
    """A new folder for round trips: below the shared checkpoint folder where one is named."""
    import tempfile
    import uuid

    base = t.spark.sparkContext.getCheckpointDir() or t.spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base}/millrace-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="millrace-scratch-")


@query(
    "scan_csv",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def _(t):
    path = f"{scratch(t)}/orders_csv"
    slim = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    sinks.sink_table(slim, path, "csv")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return files.scan_csv(t.spark, path, schema)


@query(
    "scan_required_tables",
    union_sql([f"SELECT '{n}' AS dataset, count(*) AS row_count FROM {n}" for n in BASE]),
)
def _(t):
    found = files.scan_required_tables(t.spark, t.folder, BASE)
    return C.union_all([files.row_count(df, name) for name, df in found.items()])


@query(
    "scan_discover",
    union_sql([f"SELECT '{name}' AS dataset, '{name}.parquet' AS relative_path" for name in sorted(BASE)]),
)
def _(t):
    return files.scan_discover(t.spark, t.folder, "*.parquet").drop("bytes")


# Columns of every given file.
WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5,
    "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query(
    "scan_inventory",
    union_sql(
        [f"SELECT '{n}.parquet' AS file, count(*) AS rows, {w} AS columns, count(*) > 10000 AS larger_than_sample FROM {n}" for n, w in WIDTHS.items()]
    ),
)
def _(t):
    return union_all([files.scan_inventory(t.spark.read.parquet(f"{t.folder}/{n}.parquet")) for n in WIDTHS]).drop("bytes")


@query("row_count", "SELECT 'lineitem' AS dataset, count(*) AS row_count FROM lineitem")
def _(t):
    return files.row_count(t("lineitem"), "lineitem")


@query(
    "head_sample",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000",
)
def _(t):
    return files.head_sample(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 1000)


@query(
    "sample_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 2000",
)
def _(t):
    return files.sample_rows(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 2000)


@query(
    "key_set_read",
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders",
)
def _(t):
    return files.key_set_read(t("orders"), ["customer_id", "o_custkey"])


@query(
    "sink_table",
    "SELECT c_mktsegment, count(*) AS rows, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment",
)
def _(t):
    path = f"{scratch(t)}/customers"
    sinks.sink_table(t("customer"), path, "parquet", ["c_mktsegment"])
    back = t.spark.read.parquet(path)
    return back.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query(
    "sink_report",
    "SELECT l_returnflag AS flag, count(*) AS rows FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    path = f"{scratch(t)}/report"
    found = t("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("rows"))
    sinks.sink_report(found, path)
    return t.spark.read.schema("flag string, rows bigint").json(path)


@query(
    "sink_append",
    "SELECT c_nationkey, count(*) * 2 AS rows FROM customer GROUP BY c_nationkey",
)
def _(t):
    path = f"{scratch(t)}/metrics"
    per_nation = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows"))
    sinks.sink_append(per_nation, path)
    sinks.sink_append(per_nation, path)
    return t.spark.read.parquet(path).groupBy("c_nationkey").agg(F.sum("rows").alias("rows"))


@query("file_checksums")
def _(t):
    return sinks.file_checksums(t.spark, t.folder, "*.parquet")


@query("rollback_table", "SELECT 'customer' AS dataset, count(*) AS restored_rows, true AS raw_unchanged FROM customer")
def _(t):
    path = scratch(t)
    sinks.sink_table(t("customer"), f"{path}/raw")
    sinks.sink_table(t("customer").where("c_acctbal > 0"), f"{path}/processed")
    entry = sinks.rollback_entry(t.spark, "customer", f"{path}/raw", f"{path}/processed")
    return sinks.rollback_table(t.spark, entry)


# --------------------------------------------------------------------- schema


DTYPE_SQL = {
    "integer": "try_cast({c} AS DOUBLE) IS NULL OR try_cast({c} AS DOUBLE) % 1 <> 0",
    "float": "try_cast({c} AS DOUBLE) IS NULL",
    "boolean": "CAST({c} AS VARCHAR) NOT IN ('true', 'false', 'True', 'False', '1', '0')",
    "datetime": f"({PARSED_SQL}) IS NULL",
    "string": "false",
}


def _dtype_sql(column: ColumnSpec, table: str) -> str:
    bad = DTYPE_SQL[column.dtype].format(c=column.name)
    return (
        f"SELECT '{column.name}' AS \"column\", '{column.dtype}' AS expected, count({column.name}) AS non_null, "
        f"count(*) FILTER (WHERE {column.name} IS NOT NULL AND ({bad})) AS violations FROM {table}"
    )


DTYPE_PARTS = [_dtype_sql(c, "dirty_orders") for c in ORDERS.columns if c.name in ORDER_COLUMNS]


@query("dtype_violations", DIRTY + "\n" + union_sql(DTYPE_PARTS))
def _(t):
    return C.dtype_violations(t("dirty_orders"), ORDERS)


SCHEMA_RESULT = """SELECT 'schema' AS validator, '{ds}' AS dataset,
    greatest(0, 100 - 20 * {missing} - 5 * {extra} - 10 * count(*) FILTER (WHERE violations > 0)) >= 80 AND {missing} = 0 AS passed,
    CAST(greatest(0, 100 - 20 * {missing} - 5 * {extra} - 10 * count(*) FILTER (WHERE violations > 0)) AS DOUBLE) AS score,
    CAST(sum(non_null) AS BIGINT) AS checked, CAST(sum(violations) AS BIGINT) AS violations
    FROM ({parts})"""
SCHEMA_ORDERS = SCHEMA_RESULT.format(ds="dirty_orders", missing=1, extra=1, parts=union_sql(DTYPE_PARTS))
SCHEMA_CUSTOMERS = SCHEMA_RESULT.format(
    ds="customers", missing=0, extra=0, parts=union_sql([_dtype_sql(c, "customers") for c in CUSTOMERS.columns])
)


@query("schema_conformance", DIRTY + "\n" + SCHEMA_ORDERS)
def _(t):
    return C.single_check(t("dirty_orders"), ORDERS, "schema")


DIRTY_TEXTS = ["order_status", "promo_code", "order_time", "is_gift", "weight"]


def _datetime_sql(c: str) -> str:
    shaped = " OR ".join(f"regexp_matches(trim({c}), '{p}')" for p in DATETIME_VALUES)
    parsed, named = parsed_sql(c), c == "order_time"
    enough = "true" if named else f"count(*) FILTER (WHERE {shaped}) / count({c}) >= 0.8"
    return f"""
SELECT '{c}' AS "column", {str(named).lower()} AS named, round(count(*) FILTER (WHERE {shaped}) / count({c}), 6) AS shaped_share,
       round(count({parsed}) / count({c}), 6) AS parsed_share, {enough} AND count({parsed}) / count({c}) >= 0.8 AS is_datetime
FROM dirty_orders"""


@query("detect_datetime_column", DIRTY + union_sql([_datetime_sql(c) for c in DIRTY_TEXTS]))
def _(t):
    from millrace.operators.profile import detect_datetime_columns

    return rounded(detect_datetime_columns(t("dirty_orders"), DIRTY_TEXTS))


# --------------------------------------------------------------------- checks


def _null_sql(columns: list[str], spec: TableSpec, table: str) -> list[str]:
    return [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, "
        f"(count(*) - count({c})) > 0 AND {str(c not in spec.nullable).lower()} AS violation FROM {table}"
        for c in columns
    ]


@query("null_counts", DIRTY + "\n" + union_sql(_null_sql(ORDER_COLUMNS, ORDERS, "dirty_orders")))
def _(t):
    return C.null_counts(t("dirty_orders"), ORDERS)


def _null_result(columns: list[str], spec: TableSpec, table: str) -> str:
    strict = [c for c in columns if c in spec.non_nullable]
    cells = " + ".join(f"(count(*) - count({c}))" for c in strict)
    outside = " AND ".join(f"count({c}) = count(*)" for c in columns if c not in spec.nullable)
    score = f"100.0 * (1 - ({cells}) / (count(*) * {len(strict)}))"
    return (
        f"SELECT 'nulls' AS validator, '{spec.name}' AS dataset, {score} >= 80 AND {outside} AS passed, "
        f"round({score}, 6) AS score, count(*) * {len(strict)} AS checked, {cells} AS violations FROM {table}"
    )


NULLS_ORDERS = _null_result(ORDER_COLUMNS, ORDERS, "dirty_orders")
NULLS_CUSTOMERS = _null_result(CUSTOMER_COLUMNS, CUSTOMERS, "customers")


@query("null_check", DIRTY + "\n" + NULLS_ORDERS)
def _(t):
    return rounded(C.single_check(t("dirty_orders"), ORDERS, "nulls"))


def _group_sql(columns: list[str], table: str) -> str:
    return f"SELECT count(*) AS n FROM {table} GROUP BY {', '.join(columns)}"


@query(
    "duplicate_rows_check",
    DIRTY
    + f"""
SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_groups
FROM ({_group_sql(ORDER_COLUMNS, "dirty_orders")})""",
)
def _(t):
    return C.duplicate_rows(t("dirty_orders"))


@query(
    "duplicate_keys_top",
    """SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1
       ORDER BY copies DESC, key LIMIT 10""",
)
def _(t):
    return C.duplicate_keys(t("orders"), "o_custkey")


def _duplicate_result(columns: list[str], spec: TableSpec) -> str:
    return f"""SELECT 'duplicates' AS validator, '{spec.name}' AS dataset,
       100.0 * (1 - least(1.0, (d + i) / r)) >= 80 AND i = 0 AS passed,
       round(100.0 * (1 - least(1.0, (d + i) / r)), 6) AS score,
       CAST(r AS BIGINT) AS checked, CAST(d + i AS BIGINT) AS violations
    FROM (SELECT sum(n) AS r, sum(n - 1) AS d FROM ({_group_sql(columns, spec.name)})),
         (SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) AS i FROM ({_group_sql([spec.id_column], spec.name)}))"""


DUPLICATES_ORDERS = _duplicate_result(ORDER_COLUMNS, ORDERS)
DUPLICATES_CUSTOMERS = _duplicate_result(CUSTOMER_COLUMNS, CUSTOMERS)


@query("duplicate_key_check", DIRTY + "\n" + DUPLICATES_ORDERS)
def _(t):
    return rounded(C.single_check(t("dirty_orders"), ORDERS, "duplicates"))


def _range_sql(column: str, low: float, high: float) -> str:
    return f"count(*) FILTER (WHERE {column} < {low} OR {column} > {high})"


@query(
    "gps_check",
    DIRTY
    + "\n"
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS checked, {_range_sql(c, -b, b)} AS invalid FROM dirty_orders"
            for c, b in (("drop_lat", 90), ("drop_lon", 180))
        ]
    ),
)
def _(t):
    return C.bounds_violations(t("dirty_orders"), ORDERS)


def _share_result(check: str, spec: TableSpec, checked: str, bad: str, source: str) -> str:
    score = f"100.0 * (1 - coalesce(({bad}) / nullif({checked}, 0), 0))"
    return (
        f"SELECT '{check}' AS validator, '{spec.name}' AS dataset, {score} >= 80 AND ({bad}) = 0 AS passed, "
        f"round({score}, 6) AS score, CAST({checked} AS BIGINT) AS checked, CAST({bad} AS BIGINT) AS violations FROM {source}"
    )


GPS_ORDERS = _share_result(
    "gps",
    ORDERS,
    "(count(drop_lat) + count(drop_lon))",
    f"{_range_sql('drop_lat', -90, 90)} + {_range_sql('drop_lon', -180, 180)}",
    "dirty_orders",
)
GPS_CUSTOMERS = _share_result(
    "gps",
    CUSTOMERS,
    "(count(lat) + count(lon))",
    f"{_range_sql('lat', -90, 90)} + {_range_sql('lon', -180, 180)}",
    "customers",
)
FK_ORDERS = _share_result(
    "foreign_key",
    ORDERS,
    "count(o.customer_id)",
    "count(*) FILTER (WHERE o.customer_id IS NOT NULL AND c.id IS NULL)",
    "dirty_orders o LEFT JOIN customers c ON o.customer_id = c.id",
)
BAD_TIME = f"count(*) FILTER (WHERE order_time IS NOT NULL AND ({parsed_sql('order_time')}) IS NULL)"
TIME_ORDERS = _share_result("timestamp", ORDERS, "count(order_time)", BAD_TIME, "dirty_orders")
TARGET_ORDERS = _share_result(
    "target", ORDERS, "count(delivery_minutes)", _range_sql("delivery_minutes", 0, 1440), "dirty_orders"
)


@query(
    "fk_orphan_check",
    BOTH
    + """
SELECT 'customer_id' AS "column", 'customers' AS parent, count(o.customer_id) AS checked,
       count(*) FILTER (WHERE c.id IS NULL) AS orphans, false AS parent_missing
FROM dirty_orders o LEFT JOIN customers c ON o.customer_id = c.id""",
)
def _(t):
    return C.fk_orphans(t("dirty_orders"), ORDERS.foreign_keys[0], {"customers": t("customers")})


@query(
    "fk_orphan_samples",
    BOTH
    + """
SELECT customer_id AS key, count(*) AS copies FROM dirty_orders WHERE customer_id NOT IN (SELECT id FROM customers)
GROUP BY 1 ORDER BY copies DESC, key LIMIT 10""",
)
def _(t):
    return C.fk_orphan_samples(t("dirty_orders"), ORDERS.foreign_keys[0], t("customers"))


@query(
    "normalize_key",
    DIRTY
    + """
SELECT id, CASE WHEN regexp_full_match(weight, '[0-9]+\\.0') THEN split_part(weight, '.', 1) ELSE weight END AS weight_key,
       trim(order_status) AS status_key FROM dirty_orders""",
)
def _(t):
    return t("dirty_orders").select(
        "id",
        V.normalize_key(F.col("weight")).alias("weight_key"),
        V.normalize_key(F.col("order_status")).alias("status_key"),
    )


@query(
    "timestamp_check",
    DIRTY
    + f"""
SELECT 'order_time' AS "column", count(order_time) AS non_null, {BAD_TIME} AS invalid,
       round({BAD_TIME} / count(order_time) * 100, 2) AS invalid_pct FROM dirty_orders""",
)
def _(t):
    return C.timestamp_violations(t("dirty_orders"), ORDERS)


@query(
    "target_range_check",
    DIRTY
    + """
SELECT 'delivery_minutes' AS "column", count(delivery_minutes) AS checked,
       count(*) FILTER (WHERE delivery_minutes < 0) AS negative, count(*) FILTER (WHERE delivery_minutes > 1440) AS too_high,
       0 AS non_numeric FROM dirty_orders""",
)
def _(t):
    return C.target_violations(t("dirty_orders"), ORDERS)


SUITE_SQL = union_sql(
    [
        SCHEMA_ORDERS, SCHEMA_CUSTOMERS, NULLS_ORDERS, NULLS_CUSTOMERS, DUPLICATES_ORDERS, DUPLICATES_CUSTOMERS,
        GPS_ORDERS, GPS_CUSTOMERS, FK_ORDERS, TIME_ORDERS, TARGET_ORDERS,
    ]
)


def suite(t):
    return C.validation_suite({"dirty_orders": t("dirty_orders"), "customers": t("customers")}, SPECS)


@query("validation_suite", BOTH + "\n" + SUITE_SQL)
def _(t):
    return rounded(suite(t))


CATEGORY_SQL = f"""SELECT category, avg(score) AS average,
    CASE category WHEN 'schema' THEN 0.30 WHEN 'nulls' THEN 0.20 WHEN 'duplicates' THEN 0.15 WHEN 'foreign_key' THEN 0.15
         ELSE 0.10 END AS weight
    FROM (SELECT CASE validator WHEN 'timestamp' THEN 'schema' ELSE validator END AS category, score FROM ({SUITE_SQL}))
    GROUP BY category"""
BAND_SQL = """CASE WHEN {s} >= 90 THEN 'excellent' WHEN {s} >= 80 THEN 'good' WHEN {s} >= 60 THEN 'fair'
    WHEN {s} >= 40 THEN 'poor' ELSE 'critical' END"""


@query(
    "category_scores",
    BOTH + f"\nSELECT category, round(average, 4) AS average, CAST(weight AS DOUBLE) AS weight FROM ({CATEGORY_SQL})",
)
def _(t):
    return rounded(S.category_scores(suite(t)), 4)


@query(
    "quality_score",
    BOTH
    + f"""
SELECT score AS overall_score, {BAND_SQL.format(s="score")} AS interpretation
FROM (SELECT round(sum(average * weight) / sum(weight), 2) AS score FROM ({CATEGORY_SQL}))""",
)
def _(t):
    return S.quality_score(suite(t))


@query(
    "quality_band",
    f"""SELECT c_custkey, abs(c_acctbal) / 100 AS score, {BAND_SQL.format(s="(abs(c_acctbal) / 100)")} AS band FROM customer""",
)
def _(t):
    score = F.abs("c_acctbal") / 100
    return t("customer").select("c_custkey", score.alias("score"), S.quality_band(score).alias("band"))


def _finding_sql(validator: str, dataset: str, kind: str, subject: str, count: str, source: str) -> str:
    return (
        f"SELECT '{validator}' AS validator, '{dataset}' AS dataset, '{kind}' AS kind, {subject} AS subject, "
        f"CAST({count} AS BIGINT) AS violations FROM {source}"
    )


def _table_findings_sql(spec: TableSpec, columns: list[str]) -> list[str]:
    table = spec.name
    parts = [_finding_sql("nulls", table, "column", f"'{c}'", f"count(*) - count({c})", table) for c in columns]
    for c in spec.columns:
        if c.name in columns:
            parts.append(_finding_sql("schema", table, "column", '"column"', "violations", f"({_dtype_sql(c, table)})"))
    for names, bound in ((spec.latitude, 90), (spec.longitude, 180)):
        parts += [_finding_sql("gps", table, "column", f"'{c}'", _range_sql(c, -bound, bound), table) for c in names]
    copies = f"({_group_sql(columns, table)})"
    parts.append(_finding_sql("duplicates", table, "copies", "CAST(NULL AS VARCHAR)", "sum(n - 1)", copies))
    repeated = f"(SELECT CAST(id AS VARCHAR) AS key, count(*) AS n FROM {table} WHERE id IS NOT NULL GROUP BY 1 HAVING n > 1 ORDER BY n DESC, key LIMIT 10)"
    parts.append(_finding_sql("duplicates", table, "repeated id", "key", "n", repeated))
    return parts


ORPHAN_KEYS = """(SELECT o.customer_id AS key, count(*) AS n FROM dirty_orders o LEFT JOIN customers c ON o.customer_id = c.id
    WHERE o.customer_id IS NOT NULL AND c.id IS NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 10)"""
FINDINGS_SQL = "SELECT * FROM ({}) WHERE violations > 0".format(
    union_sql(
        [
            *_table_findings_sql(ORDERS, ORDER_COLUMNS),
            *_table_findings_sql(CUSTOMERS, CUSTOMER_COLUMNS),
            "SELECT 'schema', 'dirty_orders', 'missing', 'courier_note', 1",
            "SELECT 'schema', 'dirty_orders', 'extra', 'weight', 1",
            _finding_sql("timestamp", "dirty_orders", "column", "'order_time'", BAD_TIME, "dirty_orders"),
            _finding_sql("target", "dirty_orders", "column", "'delivery_minutes'", _range_sql("delivery_minutes", 0, 1440), "dirty_orders"),
            _finding_sql("foreign_key", "dirty_orders", "orphans", "'customer_id'", "sum(violations)", f"({FK_ORDERS})"),
            _finding_sql("foreign_key", "dirty_orders", "orphan key", "CAST(key AS VARCHAR)", "n", ORPHAN_KEYS),
        ]
    )
)


def findings(t):
    return C.validation_findings({"dirty_orders": t("dirty_orders"), "customers": t("customers")}, SPECS)


@query("validation_findings", BOTH + "\n" + FINDINGS_SQL)
def _(t):
    return findings(t)


@query(
    "validation_suite_details",
    BOTH
    + f"""
SELECT s.*, coalesce(f.details, '') AS details FROM ({SUITE_SQL}) s LEFT JOIN (
    SELECT validator, dataset, string_agg(kind || ' ' || coalesce(subject, '-') || ' ' || violations, '; '
           ORDER BY violations DESC, kind, subject) AS details
    FROM ({FINDINGS_SQL}) GROUP BY validator, dataset) f ON s.validator = f.validator AND s.dataset = f.dataset""",
)
def _(t):
    line = lambda x: F.concat_ws(" ", x.kind, F.coalesce(x.subject, F.lit("-")), x.violations)
    told = C.with_details(rounded(suite(t)), findings(t))
    return told.withColumn("details", F.array_join(F.transform("details", line), "; "))
