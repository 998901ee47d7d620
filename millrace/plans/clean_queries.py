"""Queries on cleaning operators, the cleaning plan and before/after comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import checks as C
from millrace.operators import clean as K
from millrace.operators import diff as X
from millrace.operators.rows import literal_table, union_all
from millrace.plans.catalog import query, rounded, union_sql
from millrace.plans.cleaning import clean_tables
from millrace.plans.quality_queries import CUSTOMER_COLUMNS, ORDER_COLUMNS, SPECS, parsed_sql
from millrace.plans.tables import with_views

DIRTY = with_views("dirty_orders") + "\n"
BOTH = with_views("dirty_orders", "customers")
COLUMN_LIST = ", ".join(ORDER_COLUMNS)


@query("drop_duplicates", DIRTY + f"SELECT DISTINCT {COLUMN_LIST} FROM dirty_orders")
def _(t):
    return K.drop_duplicates(t("dirty_orders"))


@query(
    "drop_duplicates_keyed",
    """SELECT o_custkey, o_orderdate::VARCHAR AS first_date, o_orderkey FROM (SELECT *, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(t):
    slim = t("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    first = K.drop_duplicates(slim, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", F.col("o_orderdate").cast("string").alias("first_date"), "o_orderkey")


MODE_SQL = "(SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute",
    DIRTY
    + f"""SELECT id, round(coalesce(order_value, (SELECT median(order_value) FROM dirty_orders)), 4) AS order_value,
       round(coalesce(delivery_minutes, (SELECT median(delivery_minutes) FROM dirty_orders)), 4) AS delivery_minutes,
       coalesce(promo_code, {MODE_SQL.format(c="promo_code")}) AS promo_code FROM dirty_orders""",
)
def _(t):
    slim = t("dirty_orders").select("id", "order_value", "delivery_minutes", "promo_code")
    return rounded(K.impute(slim, ["order_value", "delivery_minutes", "promo_code"]), 4)


# Keys beyond 2**53 that differ in the last digit, a column to fill by a whole median, and a full one.
IMPUTED_KEYS = "id + 9007199254740993 AS key, CASE WHEN id % 17 = 0 THEN NULL ELSE order_size END AS size, order_size"


@query(
    "impute_keys",
    DIRTY
    + f""", keyed AS (SELECT {IMPUTED_KEYS} FROM dirty_orders)
SELECT key, coalesce(size, (SELECT median(size) FROM keyed))::BIGINT AS size, order_size, 'bigint,bigint,bigint' AS kinds FROM keyed""",
)
def _(t):
    filled = K.impute(t("dirty_orders").selectExpr(*IMPUTED_KEYS.split(", ")), ["key", "size", "order_size"])
    return filled.withColumn("kinds", F.lit(",".join(kind for _, kind in filled.dtypes)))


@query(
    "fix_datatype",
    DIRTY
    + f"""SELECT id, CASE WHEN lower(trim(is_gift)) IN ('true', '1', '1.0', 'yes') THEN 'true'
            WHEN lower(trim(is_gift)) IN ('false', '0', '0.0', 'no') THEN 'false' END AS is_gift,
       CAST(round_even(try_cast(weight AS DOUBLE), 0) AS BIGINT) AS weight,
       strftime({parsed_sql("order_time")}, '%Y-%m-%d %H:%M:%S') AS order_time FROM dirty_orders""",
)
def _(t):
    slim = t("dirty_orders").select("id", "is_gift", "weight", "order_time")
    fixed = K.fix_datatype(K.fix_datatype(slim, "is_gift", "boolean"), "weight", "integer")
    fixed = K.fix_datatype(fixed, "order_time", "datetime")
    shown = F.date_format("order_time", "yyyy-MM-dd HH:mm:ss")
    return fixed.withColumns({"order_time": shown, "is_gift": F.col("is_gift").cast("string")})


@query(
    "standardize_timestamp",
    DIRTY + f"SELECT id, strftime({parsed_sql('order_time')}, '%Y-%m-%d %H:%M:%S') AS order_time FROM dirty_orders",
)
def _(t):
    return K.standardize_timestamp(t("dirty_orders").select("id", "order_time"), "order_time")


@query(
    "timestamp_parse_report",
    DIRTY
    + f"""SELECT 'order_time' AS "column", count(*) AS rows, count({parsed_sql('order_time')}) AS parsed,
       count(order_time) - count({parsed_sql('order_time')}) AS failed FROM dirty_orders""",
)
def _(t):
    return K.timestamp_parse_report(t("dirty_orders"), ["order_time"])


@query(
    "gps_nullify",
    DIRTY
    + """SELECT id, CASE WHEN drop_lat BETWEEN -90 AND 90 THEN drop_lat END AS drop_lat,
       CASE WHEN drop_lon BETWEEN -180 AND 180 THEN drop_lon END AS drop_lon FROM dirty_orders""",
)
def _(t):
    slim = t("dirty_orders").select("id", "drop_lat", "drop_lon")
    return K.gps_nullify(K.gps_nullify(slim, "drop_lat", "latitude"), "drop_lon", "longitude")


@query(
    "gps_drop",
    DIRTY
    + """SELECT id, drop_lat, drop_lon FROM dirty_orders WHERE (drop_lat IS NULL OR drop_lat BETWEEN -90 AND 90)
       AND (drop_lon IS NULL OR drop_lon BETWEEN -180 AND 180)""",
)
def _(t):
    slim = t("dirty_orders").select("id", "drop_lat", "drop_lon")
    return K.gps_drop(K.gps_drop(slim, "drop_lat", "latitude"), "drop_lon", "longitude")


@query(
    "fk_repair",
    BOTH
    + """\nSELECT id, customer_id, order_size FROM dirty_orders
       WHERE customer_id IS NULL OR customer_id IN (SELECT id FROM customers)""",
)
def _(t):
    slim = t("dirty_orders").select("id", "customer_id", "order_size")
    return K.fk_repair(slim, "customer_id", t("customers"), "id")


@query(
    "fk_flag",
    BOTH
    + """\nSELECT id, customer_id, customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM customers)
       AS customer_id_is_orphan FROM dirty_orders""",
)
def _(t):
    return K.fk_flag(t("dirty_orders").select("id", "customer_id"), "customer_id", t("customers"), "id")


AUTO_SQL = BOTH + """\nSELECT id, customer_id FROM dirty_orders WHERE customer_id IN (SELECT id FROM customers)"""


@query("fk_auto_repair", AUTO_SQL)
def _(t):
    manifest = literal_table(
        t.spark,
        [("DEC-001", "dirty_orders", "order_size", "KEEP", "APPROVED")],
        "decision_id string,dataset string,column string,action string,status string",
    )
    slim = {"customers": t("customers"), "dirty_orders": t("dirty_orders").select("id", "customer_id", "order_size")}
    return clean_tables(slim, SPECS, manifest).tables["dirty_orders"].select("id", "customer_id")


@query("trim_whitespace", DIRTY + "SELECT id, trim(order_status) AS order_status FROM dirty_orders")
def _(t):
    return K.trim_whitespace(t("dirty_orders").select("id", "order_status"), "order_status")


@query("format_string", DIRTY + "SELECT id, CAST(order_size AS VARCHAR) AS order_size FROM dirty_orders")
def _(t):
    return K.format_string(t("dirty_orders").select("id", "order_size"), "order_size")


OUTLIER_WHERE = """{c} BETWEEN m - 3 * s AND m + 3 * s AND {c} >= 0"""


@query(
    "remove_outliers",
    DIRTY
    + f"""SELECT id, round(order_value, 2) AS order_value FROM dirty_orders,
       (SELECT avg(order_value) AS m, stddev_samp(order_value) AS s FROM dirty_orders)
       WHERE {OUTLIER_WHERE.format(c="order_value")}""",
)
def _(t):
    return rounded(K.remove_outliers(t("dirty_orders").select("id", "order_value"), "order_value"), 2)


@query(
    "standardize_column",
    DIRTY
    + """SELECT id, round((delivery_minutes - m) / s, 6) AS delivery_minutes FROM dirty_orders,
       (SELECT avg(delivery_minutes) AS m, stddev_samp(delivery_minutes) AS s FROM dirty_orders)""",
)
def _(t):
    return rounded(K.standardize_column(t("dirty_orders").select("id", "delivery_minutes"), "delivery_minutes"))


@query(
    "minmax_column",
    """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal FROM customer,
       (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
)
def _(t):
    return rounded(K.minmax_column(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal"))


@query(
    "label_encode",
    DIRTY
    + """SELECT id, coalesce(code, -1) AS promo_code FROM dirty_orders d LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
       FROM (SELECT DISTINCT promo_code AS v FROM dirty_orders WHERE promo_code IS NOT NULL)) k ON d.promo_code = k.v""",
)
def _(t):
    return K.label_encode(t("dirty_orders").select("id", "promo_code"), "promo_code")


# ------------------------------------------------------------- cleaning plan

MANIFEST = [
    ("DEC-001", "dirty_orders", None, "REMOVE_DUPLICATES", "APPROVED"),
    ("DEC-002", "dirty_orders", "order_value", "REMOVE_OUTLIERS", "APPROVED"),
    ("DEC-003", "dirty_orders", "delivery_minutes", "IMPUTE", "APPROVED"),
    ("DEC-004", "dirty_orders", "drop_lat", "FLAG", "APPROVED"),
    ("DEC-005", "dirty_orders", "drop_lon", "FIX_GPS", "APPROVED"),
    ("DEC-006", "dirty_orders", "order_status", "TRIM_WHITESPACE", "APPROVED"),
    ("DEC-007", "dirty_orders", "promo_code", "DROP", "APPROVED"),
    ("DEC-008", "dirty_orders", "promo_code", "IMPUTE", "PENDING_APPROVAL"),
    ("DEC-009", "dirty_orders", "customer_id", "REPAIR_FOREIGN_KEY", "APPROVED"),
    ("DEC-010", "customers", "lat", "FIX_GPS", "APPROVED"),
    ("DEC-011", "customers", "prep_capacity", "IMPUTE", "APPROVED"),
    ("DEC-012", "dirty_orders", "order_size", "NORMALIZE", "APPROVED"),
    ("DEC-013", "dirty_orders", "order_time", "FLAG", "APPROVED"),
]
MANIFEST_SCHEMA = "decision_id string,dataset string,column string,action string,status string"


def manifest(t):
    return literal_table(t.spark, MANIFEST, MANIFEST_SCHEMA)


def cleaned(t):
    tables = {"customers": t("customers"), "dirty_orders": t("dirty_orders")}
    return clean_tables(tables, SPECS, manifest(t))


CLEAN_STEPS = f"""uniq AS (SELECT DISTINCT {COLUMN_LIST} FROM dirty_orders),
filled AS (SELECT * REPLACE (coalesce(delivery_minutes, (SELECT median(delivery_minutes) FROM uniq)) AS delivery_minutes,
    strftime({parsed_sql("order_time")}, '%Y-%m-%d %H:%M:%S') AS order_time,
    CASE WHEN drop_lat BETWEEN -90 AND 90 THEN drop_lat END AS drop_lat,
    CASE WHEN drop_lon BETWEEN -180 AND 180 THEN drop_lon END AS drop_lon, trim(order_status) AS order_status) FROM uniq
    WHERE customer_id IN (SELECT id FROM customers)),
clean_orders AS (SELECT f.* FROM filled f, (SELECT avg(order_value) AS m, stddev_samp(order_value) AS s FROM filled)
    WHERE {OUTLIER_WHERE.format(c="order_value")}),
clean_customers AS (SELECT * REPLACE (CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat,
    coalesce(CAST(prep_capacity AS DOUBLE), (SELECT median(prep_capacity) FROM customers)) AS prep_capacity) FROM customers)"""


@query("clean_tables", BOTH + f",\n{CLEAN_STEPS}\nSELECT {COLUMN_LIST} FROM clean_orders")
def _(t):
    return cleaned(t).tables["dirty_orders"]


@query(
    "clean_parents",
    BOTH + f",\n{CLEAN_STEPS}\nSELECT {', '.join(CUSTOMER_COLUMNS)} FROM clean_customers",
)
def _(t):
    return cleaned(t).tables["customers"]


AUDIT = [
    ("customers", "prep_capacity", "IMPUTE", "(SELECT count(*) FROM customers)", "(SELECT count(*) FROM customers)"),
    ("customers", "lat", "FIX_GPS", "(SELECT count(*) FROM customers)", "(SELECT count(*) FROM customers)"),
    ("dirty_orders", None, "REMOVE_DUPLICATES", "(SELECT count(*) FROM dirty_orders)", "(SELECT count(*) FROM uniq)"),
    ("dirty_orders", "delivery_minutes", "IMPUTE", "(SELECT count(*) FROM uniq)", "(SELECT count(*) FROM uniq)"),
    ("dirty_orders", "order_time", "STANDARDIZE_TIMESTAMP", "(SELECT count(*) FROM uniq)", "(SELECT count(*) FROM uniq)"),
    ("dirty_orders", "drop_lat", "FIX_GPS", "(SELECT count(*) FROM uniq)", "(SELECT count(*) FROM uniq)"),
    ("dirty_orders", "drop_lon", "FIX_GPS", "(SELECT count(*) FROM uniq)", "(SELECT count(*) FROM uniq)"),
    ("dirty_orders", "customer_id", "REPAIR_FOREIGN_KEY", "(SELECT count(*) FROM uniq)", "(SELECT count(*) FROM filled)"),
    ("dirty_orders", "order_status", "TRIM_WHITESPACE", "(SELECT count(*) FROM filled)", "(SELECT count(*) FROM filled)"),
    ("dirty_orders", "order_value", "REMOVE_OUTLIERS", "(SELECT count(*) FROM filled)", "(SELECT count(*) FROM clean_orders)"),
]


@query(
    "audit_trail",
    BOTH
    + f",\n{CLEAN_STEPS}\n"
    + union_sql(
        [
            f"SELECT {i + 1} AS step, '{d}' AS dataset, {repr(c) if c else 'NULL'} AS \"column\", '{a}' AS action, "
            f"'SUCCESS' AS status, {b} AS records_before, {f} AS records_after, NULL AS error"
            for i, (d, c, a, b, f) in enumerate(AUDIT)
        ]
    ),
)
def _(t):
    return cleaned(t).audit_trail(t.spark)


@query(
    "quality_before_after",
    BOTH
    + f""",\n{CLEAN_STEPS},
before AS (SELECT count(*) AS r, count(promo_code) AS p, count(DISTINCT id) AS ids FROM dirty_orders),
after AS (SELECT count(*) AS r, count(promo_code) AS p FROM clean_orders)
SELECT 'dirty_orders' AS dataset, 'nulls' AS validator, round(100 * (1 - (b.r - b.p) / (b.r * 4)), 6) AS score_before,
    round(100 * (1 - (a.r - a.p) / (a.r * 4)), 6) AS score_after FROM before b, after a""",
)
def _(t):
    tables = {"customers": t("customers"), "dirty_orders": t("dirty_orders")}
    result = cleaned(t).tables
    compared = X.quality_before_after(
        C.validation_suite(tables, SPECS), C.validation_suite({**tables, **result}, SPECS)
    )
    nulls = compared.where("dataset = 'dirty_orders' AND validator = 'nulls'")
    return rounded(nulls.select("dataset", "validator", "score_before", "score_after"))


@query("quality_suites_before_after")
def _(t):
    tables = {"customers": t("customers"), "dirty_orders": t("dirty_orders")}
    result = cleaned(t).tables
    return rounded(
        X.quality_before_after(C.validation_suite(tables, SPECS), C.validation_suite({**tables, **result}, SPECS))
    )


def _health_sql(table: str, columns: list[str], suffix: str) -> str:
    nulls = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return (
        f"SELECT (SELECT count(*) FROM {table}) AS row_count{suffix}, (SELECT {nulls} FROM {table}) AS null_cells{suffix}, "
        f"(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(columns)})) "
        f"AS duplicate_rows{suffix}"
    )


@query(
    "tables_before_after",
    BOTH
    + f",\n{CLEAN_STEPS}\n"
    + union_sql(
        [
            f"SELECT '{n}' AS dataset, * FROM ({_health_sql(n, cols, '_before')}), ({_health_sql(c, cols, '_after')})"
            for n, c, cols in (
                ("customers", "clean_customers", CUSTOMER_COLUMNS),
                ("dirty_orders", "clean_orders", ORDER_COLUMNS),
            )
        ]
    ),
)
def _(t):
    return X.tables_before_after({"customers": t("customers"), "dirty_orders": t("dirty_orders")}, cleaned(t).tables)


DIFF_COLUMNS = ["delivery_minutes", "order_status", "order_time", "drop_lat"]


def diff_sides(t):
    raw = t("order_rows").select("id", *DIFF_COLUMNS)
    new = K.impute(raw, ["delivery_minutes"])
    new = K.gps_nullify(K.standardize_timestamp(K.trim_whitespace(new, "order_status"), "order_time"), "drop_lat")
    return raw, K.gps_drop(new.where("id % 10 != 0"), "drop_lat")


NEW_SQL = f"""new AS (SELECT id, coalesce(delivery_minutes, (SELECT median(delivery_minutes) FROM order_rows)) AS delivery_minutes,
    trim(order_status) AS order_status, strftime({parsed_sql("order_time")}, '%Y-%m-%d %H:%M:%S') AS order_time,
    CASE WHEN drop_lat BETWEEN -90 AND 90 THEN drop_lat END AS drop_lat FROM order_rows WHERE id % 10 <> 0)"""
CELLS_SQL = union_sql(
    [
        f"SELECT CAST(o.id AS VARCHAR) AS record_id, '{c}' AS \"column\", CAST(o.{c} AS VARCHAR) AS before, "
        f"CAST(n.{c} AS VARCHAR) AS after FROM order_rows o JOIN new n USING (id)"
        for c in DIFF_COLUMNS
    ]
)
CHANGED = "regexp_replace(trim(before), '\\.0$', '') IS DISTINCT FROM regexp_replace(trim(after), '\\.0$', '')"
CHANGES = f"""cells AS ({CELLS_SQL}), changes AS (SELECT *, CASE WHEN before IS NULL THEN 'imputed' WHEN after IS NULL THEN 'nullified'
    WHEN before LIKE '%.0' AND NOT contains(after, '.') THEN 'id_float_to_int'
    WHEN contains(before, '/') AND contains(after, '-') THEN 'timestamp_format' ELSE 'changed' END AS change_type
    FROM cells WHERE {CHANGED})"""


@query("cell_diff", with_views("order_rows") + f",\n{NEW_SQL},\n{CHANGES}\nSELECT * FROM changes")
def _(t):
    return X.cell_diff(*diff_sides(t), "id")


@query(
    "diff_summary",
    with_views("order_rows")
    + f""",\n{NEW_SQL},\n{CHANGES}
SELECT b AS rows_before, a AS rows_after, b - a AS rows_removed, c + (b - a) * 5 AS cells_changed, r AS rows_repaired, f AS rows_nullified
FROM (SELECT (SELECT count(*) FROM order_rows) AS b, (SELECT count(*) FROM new) AS a, (SELECT count(*) FROM changes) AS c,
    (SELECT count(DISTINCT record_id) FROM changes WHERE after IS NOT NULL) AS r,
    (SELECT count(DISTINCT record_id) FROM changes WHERE after IS NULL) AS f)""",
)
def _(t):
    return X.diff_summary(*diff_sides(t), "id")


@query(
    "table_fingerprint",
    """SELECT 'copy' AS case, count(*) AS rows, true AS same FROM embeddings UNION ALL SELECT 'nested cell', count(*), false FROM embeddings
       UNION ALL SELECT 'repeated row', count(*) + 1, false FROM embeddings UNION ALL SELECT 'null label', count(*), false FROM embeddings""",
)
def _(t):
    from millrace.sources.sinks import table_fingerprint

    table = t("embeddings")
    one = F.col("vec_id") == table.agg(F.min("vec_id")).first()[0]
    cases = {
        "copy": table.repartition(3),
        "nested cell": table.withColumn("embedding", F.when(one, F.reverse("embedding")).otherwise(F.col("embedding"))),
        "repeated row": table.unionByName(table.where(one)),
        "null label": table.withColumn("label", F.when(~one, F.col("label"))),
    }
    base = table_fingerprint(table).select(F.col("checksum").alias("before"))
    rows = [
        table_fingerprint(df).crossJoin(F.broadcast(base)).select(  # one row each
            F.lit(case).alias("case"), "rows", (F.col("checksum") == F.col("before")).alias("same")
        )
        for case, df in cases.items()
    ]
    return union_all(rows)


@query(
    "drop_duplicates_nested",
    """SELECT vec_id, CAST(round(list_sum(list_transform(embedding, lambda x: x * 1000)), 2) AS DOUBLE) AS total, label FROM embeddings
       UNION ALL SELECT vec_id, 0.0, label FROM embeddings WHERE vec_id % 3 = 0""",
)
def _(t):
    table = t("embeddings")
    third = table.where("vec_id % 3 = 0")
    zeros = third.withColumn("embedding", F.array(F.lit(0.0).cast("float")))
    rows = K.drop_duplicates(table.unionByName(third).unionByName(zeros).unionByName(zeros))
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * 1000), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(total, 2).alias("total"), "label")
