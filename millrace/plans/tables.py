"""Input tables of the registered queries.

The test tables are clean and have no coordinates, so the views below derive
dirt and delivery-like columns from whole tables, by rules on the keys. Each
view is one SQL text that Spark and the checking engine both run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "customers": """
        SELECT c_custkey AS id, c_name AS name,
               CASE WHEN c_custkey % 29 = 0 THEN 999e0 ELSE 12.9e0 + (c_custkey % 200) / 1000e0 END AS lat,
               CASE WHEN c_custkey % 31 = 0 THEN -999e0 ELSE 77.5e0 + (c_custkey % 300) / 1000e0 END AS lon,
               c_mktsegment AS segment, c_acctbal AS balance,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS prep_capacity,
               3e0 + (c_custkey % 21) / 10e0 AS avg_rating
        FROM {customer}""",
    "suppliers": """
        SELECT s_suppkey AS id, s_name AS rider_name, s_acctbal AS balance, s_nationkey AS current_load,
               CAST(s_suppkey * 37 % 4000 AS BIGINT) AS completed_orders, 4e0 + (s_suppkey % 9) AS shift_hours
        FROM {supplier}""",
    "order_rows": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 19 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS customer_id,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN -o_totalprice
                    WHEN o_orderkey % 103 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS order_value,
               concat(' ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE '' END) AS order_status,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS promo_code,
               CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS STRING)
                    WHEN o_orderkey % 4 = 1 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
                         lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING), ' 08:30')
                    WHEN o_orderkey % 4 = 2 THEN CAST(EPOCH_SECONDS(o_orderdate) AS STRING)
                    WHEN o_orderkey % 8 = 3 THEN 'bad' ELSE NULL END AS order_time,
               CASE WHEN o_orderkey % 29 = 0 THEN 999e0 WHEN o_orderkey % 47 = 0 THEN NULL
                    ELSE 12.8e0 + (o_orderkey % 250) / 1000e0 END AS drop_lat,
               CASE WHEN o_orderkey % 31 = 0 THEN -999e0 ELSE 77.4e0 + (o_orderkey % 350) / 1000e0 END AS drop_lon,
               CAST(o_orderkey % 7 AS BIGINT) + 1 AS order_size,
               CASE WHEN o_orderkey % 37 = 0 THEN -5e0 WHEN o_orderkey % 41 = 0 THEN 2000e0
                    WHEN o_orderkey % 43 = 0 THEN NULL ELSE 15e0 + (o_orderkey % 60) END AS delivery_minutes,
               CASE WHEN o_orderkey % 5 = 0 THEN 'yes' WHEN o_orderkey % 5 = 1 THEN ' False'
                    WHEN o_orderkey % 5 = 2 THEN '1.0' WHEN o_orderkey % 5 = 3 THEN '0' ELSE 'maybe' END AS is_gift,
               CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_orderkey % 40 AS STRING), '.5')
                    WHEN o_orderkey % 3 = 1 THEN concat(CAST(o_orderkey % 40 AS STRING), '.0') ELSE 'n/a' END AS weight
        FROM {orders}""",
    # Copies of the rows whose key is a multiple of 23.
    "dirty_orders": """
        SELECT * FROM {order_rows} UNION ALL SELECT * FROM {order_rows} WHERE id % 23 = 0""",
    # Deliveries: an order line with its coordinates, load and value; no dirt.
    "deliveries": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS part_id,
               l_suppkey AS rider_id, l_shipdate AS ship_timestamp,
               12.8e0 + (l_orderkey % 250) / 1000e0 AS drop_lat, 77.4e0 + (l_orderkey % 350) / 1000e0 AS drop_lon,
               12.9e0 + (l_partkey % 200) / 1000e0 AS shop_lat, 77.5e0 + (l_partkey % 300) / 1000e0 AS shop_lon,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 25 AS BIGINT) END AS prep_capacity,
               CAST(l_partkey % 20 AS BIGINT) AS current_load,
               CAST(l_suppkey * 37 % 4000 AS BIGINT) AS completed_orders,
               CAST(l_partkey % 9 AS DOUBLE) AS shift_hours,
               CAST(l_quantity AS BIGINT) AS order_size, l_extendedprice AS order_value,
               3e0 + (l_partkey % 21) / 10e0 AS avg_rating,
               l_returnflag AS return_flag, l_linestatus AS line_status, l_discount AS discount, l_tax AS tax,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS charge
        FROM {lineitem}""",
    # One row per order with model inputs; the id is unique.
    "order_inputs": """
        SELECT o_orderkey AS id, o_totalprice AS order_value, CAST(o_custkey % 20 AS BIGINT) AS current_load,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 11) / 100e0 END AS discount,
               3e0 + (o_custkey % 21) / 10e0 AS avg_rating
        FROM {orders}""",
    # Renamed star schema, for join inference and column roles.
    "orders_star": """
        SELECT o_orderkey AS id, o_custkey AS customer_id, o_totalprice AS total_amount, o_orderstatus AS order_status,
               o_orderpriority AS priority, CAST(o_orderdate AS STRING) AS created_date,
               o_totalprice * 1.1 AS total_amount_estimate, CAST(o_orderkey % 60 AS BIGINT) AS delivery_minutes,
               CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS is_rush
        FROM {orders}""",
    "customers_star": """
        SELECT c_custkey AS id, c_name AS customer_name, c_acctbal AS balance, c_mktsegment AS segment,
               CAST(c_nationkey AS BIGINT) AS nation_id
        FROM {customer}""",
    "nations_star": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, CAST(n_regionkey AS BIGINT) AS region_id
        FROM {nation}""",
    "items_star": """
        SELECT l_orderkey AS order_id, CASE WHEN l_partkey % 50 = 0 THEN l_partkey + 90000000 ELSE l_partkey END AS part_id,
               l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS return_flag
        FROM {lineitem}""",
    "parts_star": """
        SELECT p_partkey AS id, p_brand AS brand, p_size AS size, p_retailprice AS retail_value
        FROM {part}""",
    # Registry events: many versions per family, registrations, promotions, archives, rejects.
    "registry_events": """
        SELECT event_id AS seq, concat('Model', CAST(user_id % 40 AS STRING)) AS model_name,
               CAST(event_id % 12 AS BIGINT) AS version,
               CASE WHEN event_id % 5 < 3 THEN 'register' WHEN event_id % 5 = 3 THEN 'promote' ELSE 'archive' END AS event,
               CASE WHEN event_id % 5 < 3 THEN CASE WHEN event_id % 35 = 0 THEN 'Production' ELSE 'Staging' END END AS status,
               ts AS created_at, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS mae
        FROM {events}""",
    # Runs of several models scored on the same lines.
    "scored": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 1000 AS y,
               concat('model_', CAST(m AS STRING)) AS model_name,
               l_extendedprice / 1000 + (l_partkey % 11 - 5) * (m + 1) / 10e0 AS prediction,
               l_quantity AS quantity, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS discount
        FROM (SELECT *, EACH_OF(0, 1, 2, 3, 4) AS m FROM {lineitem})""",
}


def _expand(name: str, seen: dict[str, str]) -> None:
    """Collect the view and the views it reads, dependencies first."""
    for other in re.findall(r"\{(\w+)\}", VIEWS[name]):
        if other in VIEWS and other not in seen:
            _expand(other, seen)
    seen[name] = VIEWS[name]


class Tables:
    """Given tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}
        # Results must not depend on the time zone of the machine.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self._base(name)
        return self._made[name]

    def _base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoned = [
            F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields
        ]
        return df.select(*zoned)

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name].replace("EPOCH_SECONDS(", "unix_timestamp(")
        sql = re.sub(r"EACH_OF\(([^)]*)\)", r"explode(array(\1))", sql)
        needed = {other: self(other) for other in set(re.findall(r"\{(\w+)\}", sql))}
        return self.spark.sql(sql, **needed)


def with_views(*names: str) -> str:
    """The views as a WITH clause for the checking engine (ends without a comma)."""
    seen: dict[str, str] = {}
    for name in names:
        _expand(name, seen)
    parts = []
    for name, sql in seen.items():
        text = re.sub(r"\{(\w+)\}", r"\1", sql).replace("EPOCH_SECONDS(", "epoch(").strip()
        text = re.sub(r"EACH_OF\(([^)]*)\)", r"unnest([\1])", text)
        text = text.replace("CAST(epoch(o_orderdate) AS STRING)", "CAST(CAST(epoch(o_orderdate) AS BIGINT) AS STRING)")
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts)
