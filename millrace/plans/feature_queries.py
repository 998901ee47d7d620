"""Queries on the feature join, feature groups, encoders, scaler and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.operators import encode as E
from millrace.operators import enrich as J
from millrace.operators import features as G
from millrace.operators.checks import null_counts
from millrace.operators.correlate import correlated_columns
from millrace.operators.rows import union_all
from millrace.plans.catalog import query, rounded, union_sql
from millrace.plans.tables import with_views
from millrace.spec import ForeignKey, TableSpec

DELIVERIES = with_views("deliveries") + "\n"
ROLES = G.OperationRoles(
    capacity="prep_capacity",
    load="current_load",
    completed="completed_orders",
    shift_hours="shift_hours",
    size="order_size",
    value="order_value",
    rating="avg_rating",
)
ORDER_FK = ForeignKey("o_custkey", "customer", "c_custkey")
NATION_FK = ForeignKey("c_nationkey", "nation", "n_nationkey")

# ----------------------------------------------------------------------- join


@query(
    "assert_required_columns",
    "SELECT 'orders' AS dataset, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer",
)
def _(t):
    tables = {"orders": t("orders"), "customer": t("customer")}
    J.assert_required_columns(tables, {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey"]})
    return union_all(
        [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("dataset", F.lit(n)) for n, df in tables.items()]
    )


def _unique_sql(table: str, key: str) -> str:
    return (
        f"SELECT '{table}' AS dataset, '{key}' AS key_column, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS "
        f"repeated_keys, count(*) FILTER (WHERE n > 1) = 0 AS is_unique FROM (SELECT {key}, count(*) AS n FROM {table} "
        f"WHERE {key} IS NOT NULL GROUP BY 1)"
    )


UNIQUE = [("orders", "o_orderkey"), ("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_suppkey")]


@query("assert_unique_keys", union_sql([_unique_sql(*u) for u in UNIQUE]))
def _(t):
    return union_all([J.key_uniqueness(t(n), n, k) for n, k in UNIQUE])


@query(
    "assert_references",
    with_views("order_rows")
    + """\nSELECT DISTINCT customer_id AS key FROM order_rows WHERE customer_id NOT IN (SELECT c_custkey FROM customer)
    ORDER BY key LIMIT 10""",
)
def _(t):
    return J.missing_references(t("order_rows"), ForeignKey("customer_id", "customer", "c_custkey"), t("customer"))


def wide(t, mark: bool = False):
    return J.enrich_join(
        t("orders"), [(ORDER_FK, t("customer"), "customer"), (NATION_FK, t("nation"), "nation")], mark=mark
    )


@query(
    "enrich_join",
    """SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name
       FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def _(t):
    return wide(t).select(
        "o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name"
    )


@query(
    "enrich_join_suffix",
    with_views("customers", "order_rows")
    + """\nSELECT o.id, o.customer_id, c.id AS id_shop, c.name, c.avg_rating FROM order_rows o LEFT JOIN customers c ON o.customer_id = c.id""",
)
def _(t):
    joined = J.enrich_join(t("order_rows"), [(ForeignKey("customer_id", "customers", "id"), t("customers"), "shop")])
    return joined.select("id", "customer_id", "id_shop", "name", "avg_rating")


@query(
    "verify_join",
    """SELECT count(*) AS rows_before, count(*) AS rows_after, 0 AS o_custkey_null, 0 AS c_nationkey_null,
       count(*) FILTER (WHERE c.c_custkey IS NULL) AS o_custkey_unmatched, 0 AS c_nationkey_unmatched, 0 AS repeated_keys,
       count(*) FILTER (WHERE c.c_custkey IS NULL) = 0 AS passed
       FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def _(t):
    matched = {"o_custkey": "customer_matched", "c_nationkey": "nation_matched"}
    return J.verify_join(t("orders"), wide(t, mark=True), "o_orderkey", matched)


# --------------------------------------------------------------------- groups


@query(
    "temporal_features",
    """SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, day(ts) AS day, month(ts) AS month, dayname(ts) AS weekday,
       dayname(ts) IN ('Saturday', 'Sunday') AS is_weekend,
       CASE WHEN hour(ts) BETWEEN 5 AND 10 THEN 'Breakfast' WHEN hour(ts) BETWEEN 11 AND 15 THEN 'Lunch'
            WHEN hour(ts) BETWEEN 16 AND 20 THEN 'Evening' ELSE 'Night' END AS meal_period,
       hour(ts) BETWEEN 7 AND 10 OR hour(ts) BETWEEN 17 AND 20 AS peak_hour FROM events""",
)
def _(t):
    return G.temporal_features(t("events").select("event_id", "ts"), "ts").drop("ts")


HAVERSINE_SQL = """2 * 6371.0 * asin(sqrt(pow(sin((radians(drop_lat) - radians(shop_lat)) / 2), 2)
    + cos(radians(shop_lat)) * cos(radians(drop_lat)) * pow(sin((radians(drop_lon) - radians(shop_lon)) / 2), 2)))"""


@query("haversine_km", DELIVERIES + f"SELECT id, round({HAVERSINE_SQL}, 6) AS distance_km FROM deliveries")
def _(t):
    km = N.haversine_km(F.col("shop_lat"), F.col("shop_lon"), F.col("drop_lat"), F.col("drop_lon"))
    return rounded(t("deliveries").select("id", km.alias("distance_km")))


@query(
    "geo_features",
    DELIVERIES
    + f"""SELECT id, round(d, 6) AS distance_km, round(abs(shop_lat - drop_lat), 6) AS latitude_difference,
       round(abs(shop_lon - drop_lon), 6) AS longitude_difference, d < 0.05 AS same_location
       FROM (SELECT *, {HAVERSINE_SQL} AS d FROM deliveries)""",
)
def _(t):
    geo = G.geo_features(t("deliveries"), ("shop_lat", "shop_lon"), ("drop_lat", "drop_lon"))
    return rounded(geo.select("id", "distance_km", "latitude_difference", "longitude_difference", "same_location"))


RATIO = "coalesce(CAST(current_load AS DOUBLE) / nullif(prep_capacity, 0), 0)"


@query(
    "safe_divide",
    DELIVERIES + f"SELECT id, round({RATIO}, 6) AS ratio FROM deliveries",
)
def _(t):
    ratio = N.safe_divide(F.col("current_load"), F.col("prep_capacity"))
    return rounded(t("deliveries").select("id", ratio.alias("ratio")))


OPERATIONAL_SQL = f"""SELECT *, {RATIO} AS load_ratio, CAST(prep_capacity - current_load AS DOUBLE) AS remaining_capacity,
    {RATIO} * 100 AS capacity_utilization_percent, coalesce(completed_orders / nullif(shift_hours, 0), 0) AS orders_per_shift_hour,
    coalesce(order_value / nullif(order_size, 0), 0) AS average_order_value_per_item, {RATIO} >= 0.80 AS high_workload FROM deliveries"""
OPERATIONAL = [
    "load_ratio", "remaining_capacity", "capacity_utilization_percent", "orders_per_shift_hour",
    "average_order_value_per_item",
]


@query(
    "operational_features",
    DELIVERIES
    + f"SELECT id, {', '.join(OPERATIONAL)}, high_workload FROM ({OPERATIONAL_SQL})",
)
def _(t):
    made = G.operational_features(t("deliveries"), ROLES)
    return made.select("id", *OPERATIONAL, "high_workload")


BUSINESS = [
    "rider_experience_level", "restaurant_quality_tier", "high_value_order", "large_order", "premium_restaurant",
    "busy_restaurant",
]
BUSINESS_SQL = f"""SELECT *, CASE WHEN completed_orders < 500 THEN 'Beginner' WHEN completed_orders BETWEEN 500 AND 1499 THEN 'Intermediate'
    WHEN completed_orders BETWEEN 1500 AND 2999 THEN 'Experienced' WHEN completed_orders >= 3000 THEN 'Expert' ELSE 'Beginner' END
    AS rider_experience_level,
    CASE WHEN avg_rating < 3.5 THEN 'Low' WHEN avg_rating BETWEEN 3.5 AND 4.2 THEN 'Standard' WHEN avg_rating BETWEEN 4.2 AND 4.7
    THEN 'Good' WHEN avg_rating >= 4.7 THEN 'Premium' ELSE 'Low' END AS restaurant_quality_tier,
    order_value >= (SELECT quantile_cont(order_value, 0.75) FROM deliveries) AS high_value_order,
    order_size >= (SELECT quantile_cont(CAST(order_size AS DOUBLE), 0.75) FROM deliveries) AS large_order,
    avg_rating >= 4.5 AS premium_restaurant,
    coalesce(load_ratio >= 0.80 AND prep_capacity > (SELECT median(prep_capacity) FROM deliveries), false) AS busy_restaurant
    FROM ({OPERATIONAL_SQL})"""


@query("business_features", DELIVERIES + f"SELECT id, {', '.join(BUSINESS)} FROM ({BUSINESS_SQL})")
def _(t):
    made = G.business_features(G.operational_features(t("deliveries"), ROLES), ROLES)
    return made.select("id", *BUSINESS)


# --------------------------------------------------------------- column types

KINDS = {
    "id": "Identifier", "order_id": "Identifier", "part_id": "Identifier", "rider_id": "Identifier",
    "ship_timestamp": "Datetime", "drop_lat": "GPS", "drop_lon": "GPS", "shop_lat": "GPS", "shop_lon": "GPS",
    "prep_capacity": "Numerical", "current_load": "Numerical", "completed_orders": "Numerical",
    "shift_hours": "Numerical", "order_size": "Numerical", "order_value": "Numerical", "avg_rating": "Numerical",
    "return_flag": "Categorical", "line_status": "Categorical", "discount": "Numerical", "tax": "Numerical",
    "charge": "Target",
}


@query(
    "feature_types",
    DELIVERIES
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", '{k}' AS feature_type, '{G.FEATURE_ACTIONS[k]}' AS action, "
            f"count(*) - count({c}) AS null_count FROM deliveries"
            for c, k in KINDS.items()
        ]
    ),
)
def _(t):
    df = t("deliveries")
    nulls = null_counts(df, TableSpec("deliveries")).select("column", "null_count")
    # One row per column on both sides.
    return G.feature_types(df, "charge").join(F.broadcast(nulls), "column")


BUCKET_SQL = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR) || '-42'), 1, 4) AS INTEGER)"
SPLIT_SQL = f"CASE WHEN {BUCKET_SQL.format(k='id')} < {int(65536 * 0.2)} THEN 'test' ELSE 'train' END"


@query(
    "train_test_split",
    DELIVERIES
    + f"""SELECT prep_capacity, current_load, order_size, order_value, discount, charge, {SPLIT_SQL} AS split
       FROM deliveries""",
)
def _(t):
    split = G.train_test_split(t("deliveries"), "id", "charge")
    return split.select("prep_capacity", "current_load", "order_size", "order_value", "discount", "charge", "split")


@query(
    "datetime_expand",
    """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate_epoch, hour(o_orderdate) AS o_orderdate_hour,
       minute(o_orderdate) AS o_orderdate_minute, isodow(o_orderdate) - 1 AS o_orderdate_dayofweek,
       CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS o_orderdate_is_weekend FROM orders""",
)
def _(t):
    slim = t("orders").select("o_orderkey", "o_orderdate")
    return E.datetime_expand(slim, E.datetime_columns(slim))


# ------------------------------------------------------------------- encoding


@query(
    "encoding_plan",
    DELIVERIES
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", '{k}' AS feature_type, "
            + (
                f"CASE WHEN count(DISTINCT {c}) > 100 OR count(DISTINCT {c}) / count(*) > 0.10 THEN '{E.SKIPPED}' "
                f"ELSE '{E.ONE_HOT}' END"
                if k == "Categorical"
                else f"'{E.NO_ENCODING}'"
            )
            + (" AS strategy FROM deliveries" if k == "Categorical" else " AS strategy")
            for c, k in KINDS.items()
        ]
    ),
)
def _(t):
    return E.encoding_plan(t("deliveries"), "charge")


AUTO = ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"]


@query(
    "encoding_plan_auto",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", 'Categorical' AS feature_type, CASE WHEN count(DISTINCT {c}) <= 10 THEN '{E.ONE_HOT}' "
            f"ELSE '{E.ORDINAL}' END AS strategy FROM {tb}"
            for c, tb in (("o_orderstatus", "orders"), ("o_orderpriority", "orders"), ("o_clerk", "(SELECT 'c' || (o_custkey % 97) AS o_clerk FROM orders)"))
        ]
        + [f"SELECT '{c}', 'Numerical', '{E.NO_ENCODING}'" for c in ("o_totalprice", "o_custkey")]
    ),
)
def _(t):
    clerk = F.concat(F.lit("c"), F.col("o_custkey") % 97)
    return E.encoding_plan_auto(t("orders").select(*AUTO, clerk.alias("o_clerk")))


@query(
    "one_hot",
    with_views("dirty_orders")
    + """\nSELECT id, CAST(coalesce(promo_code, 'nan') = '1-URGENT' AS INTEGER) AS "promo_code_1-URGENT",
       CAST(coalesce(promo_code, 'nan') = '2-HIGH' AS INTEGER) AS "promo_code_2-HIGH",
       CAST(coalesce(promo_code, 'nan') = '3-MEDIUM' AS INTEGER) AS "promo_code_3-MEDIUM",
       CAST(coalesce(promo_code, 'nan') = '4-NOT SPECIFIED' AS INTEGER) AS "promo_code_4-NOT SPECIFIED",
       CAST(coalesce(promo_code, 'nan') = '5-LOW' AS INTEGER) AS "promo_code_5-LOW",
       CAST(coalesce(promo_code, 'nan') = 'nan' AS INTEGER) AS promo_code_nan FROM dirty_orders""",
)
def _(t):
    slim = t("dirty_orders").select("id", "promo_code")
    return E.one_hot(slim, {"promo_code": E.categories_of(slim, "promo_code")})


@query(
    "ordinal_encode",
    """SELECT c_custkey, coalesce(code, -1) AS c_name FROM customer LEFT JOIN (SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1
       AS code FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey % 3 <> 0)) ON c_name = v""",
)
def _(t):
    slim = t("customer").select("c_custkey", "c_name")
    codes, small = E.ordinal_fit(slim.where("c_custkey % 3 != 0"), "c_name")
    return E.ordinal_encode(slim, "c_name", codes, small)


# -------------------------------------------------------------------- scaling


@query(
    "standard_scale",
    DELIVERIES
    + """SELECT id, round((order_value - vm) / vs, 6) AS order_value, round((current_load - lm) / ls, 6) AS current_load FROM deliveries,
       (SELECT avg(order_value) AS vm, stddev_pop(order_value) AS vs, avg(current_load) AS lm, stddev_pop(current_load) AS ls FROM deliveries)""",
)
def _(t):
    slim = t("deliveries").select("id", "order_value", "current_load")
    return rounded(E.standard_scale(slim, ["order_value", "current_load"]))


@query(
    "impute_median_matrix",
    DELIVERIES
    + """SELECT CAST(id AS DOUBLE) AS id, coalesce(CAST(prep_capacity AS DOUBLE), (SELECT median(prep_capacity) FROM deliveries)) AS prep_capacity
       FROM deliveries""",
)
def _(t):
    return E.impute_median_matrix(t("deliveries").select("id", "prep_capacity"))


PRUNED = ["prep_capacity", "current_load", "fixed_fee", "order_value", "value_cents", "discount"]
PRUNE_SQL = "(SELECT *, 5 AS fixed_fee, order_value * 100 AS value_cents FROM deliveries)"


def pruned(t):
    return t("deliveries").withColumns({"fixed_fee": F.lit(5), "value_cents": F.col("order_value") * 100}).select(*PRUNED)


@query(
    "constant_columns",
    DELIVERIES
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + (CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END) <= 1 AS is_constant "
            f"FROM {PRUNE_SQL}"
            for c in PRUNED
        ]
    ),
)
def _(t):
    return E.constant_columns(pruned(t))


@query(
    "drop_constant",
    DELIVERIES + f"SELECT {', '.join(f'round({c}, 4) AS {c}' if 'val' in c else c for c in PRUNED if c != 'fixed_fee')} FROM {PRUNE_SQL}",
)
def _(t):
    return rounded(E.drop_constant(pruned(t)), 4)


PAIRS = [(a, b) for i, a in enumerate(PRUNED) for b in PRUNED[i + 1 :] if "fixed_fee" not in (a, b)]


@query(
    "correlated_columns",
    DELIVERIES
    + "SELECT \"column\", round(max(abs(r)), 6) AS strongest FROM ("
    + union_sql([f"SELECT '{b}' AS \"column\", corr({a}, {b}) AS r FROM {PRUNE_SQL}" for a, b in PAIRS])
    + ") WHERE abs(r) > 0.95 GROUP BY 1",
)
def _(t):
    return rounded(correlated_columns(pruned(t)))


@query(
    "drop_correlated",
    DELIVERIES + "SELECT prep_capacity, current_load, fixed_fee, round(order_value, 4) AS order_value, discount FROM " + PRUNE_SQL,
)
def _(t):
    return rounded(E.drop_correlated(pruned(t)), 4)


@query(
    "align_features",
    DELIVERIES + "SELECT order_value, 0.0::DOUBLE AS surge, 2.5::DOUBLE AS rain, discount FROM deliveries",
)
def _(t):
    return E.align_features(t("deliveries"), ["order_value", "surge", "rain", "discount"], {"rain": 2.5})


@query(
    "align_width",
    "SELECT vec_id, list_sum(list_transform(embedding[1:10], lambda x: 1)) AS kept, CAST(50 AS INTEGER) AS padded FROM embeddings",
)
def _(t):
    vector = F.col("embedding").cast("array<double>")
    longer = F.size(E.align_width(F.slice(vector, 1, 3), 50))
    return t("embeddings").select(
        "vec_id", F.size(E.align_width(vector, 10)).alias("kept"), longer.alias("padded")
    )
