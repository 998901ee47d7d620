"""Queries on exploration, messages, monitoring, drift and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import explain as Z
from millrace.operators import explore as X
from millrace.operators import messages as M
from millrace.operators import monitor as W
from millrace.operators.correlate import correlation_matrix
from millrace.plans.catalog import query, rounded, union_sql
from millrace.plans.tables import with_views

DELIVERIES = with_views("deliveries") + "\n"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]

# -------------------------------------------------------------------- explore


@query(
    "eda_columns",
    union_sql(
        [
            f"SELECT 'orders' AS dataset, '{c}' AS \"column\", '{d}' AS dtype, count(DISTINCT {c}) AS unique_values, "
            f"count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM orders"
            for c, d in (
                ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string"),
            )
        ]
    ),
)
def _(t):
    return X.eda_columns(t("orders"), "orders")


DIRTY_COLUMNS = [
    "id", "customer_id", "order_value", "order_status", "promo_code", "order_time", "drop_lat", "drop_lon",
    "order_size", "delivery_minutes", "is_gift", "weight",
]
NULL_CELLS = " + ".join(f"(count(*) - count({c}))" for c in DIRTY_COLUMNS)


@query(
    "eda_quality",
    with_views("dirty_orders")
    + f"""\nSELECT 'dirty_orders' AS dataset, count(*) AS row_count, 12 AS column_count, {NULL_CELLS} AS missing,
       (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {", ".join(DIRTY_COLUMNS)})) AS duplicate_rows,
       round((count(*) * 12 - ({NULL_CELLS})) / (count(*) * 12) * 100, 2) AS completeness_pct FROM dirty_orders""",
)
def _(t):
    return X.eda_quality(t("dirty_orders"), "dirty_orders")


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, var_samp({c}) AS variance,
        min({c}) AS min, max({c}) AS max, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, quantile_cont({c}, 0.25) AS q1,
        median({c}) AS median, quantile_cont({c}, 0.75) AS q3 FROM lineitem"""


@query(
    "describe_stats",
    "SELECT \"column\", count, "
    + ", ".join(f"round({c}, 3) AS {c}" for c in ("mean", "std", "variance", "min", "max", "skewness", "kurtosis", "q1", "median", "q3"))
    + " FROM ("
    + union_sql([_describe_sql(c) for c in NUMBERS])
    + ")",
)
def _(t):
    return rounded(X.describe_stats(t("lineitem"), NUMBERS), 3)


@query(
    "univariate_numeric",
    "SELECT \"column\", "
    + ", ".join(f"round({c}, 3) AS {c}" for c in ("min", "max", "mean", "median", "std", "skewness", "kurtosis"))
    + ", CASE WHEN abs(skewness) < 0.5 THEN 'symmetric' WHEN skewness > 0.5 THEN 'positive' ELSE 'negative' END AS skew_direction,"
    + " CASE \"column\" WHEN 'l_quantity' THEN (SELECT count(DISTINCT l_quantity) FROM lineitem)"
    + " WHEN 'l_extendedprice' THEN (SELECT count(DISTINCT l_extendedprice) FROM lineitem)"
    + " ELSE (SELECT count(DISTINCT l_discount) FROM lineitem) END < 15 AS is_discrete FROM ("
    + union_sql([_describe_sql(c) for c in NUMBERS])
    + ")",
)
def _(t):
    return rounded(X.univariate_numeric(t("lineitem"), NUMBERS), 3)


@query(
    "histogram",
    """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
f AS (SELECT least(CAST(floor((l_quantity - lo) * 30 / (hi - lo)) AS INTEGER), 29) AS bin, count(*) AS rows FROM lineitem, s GROUP BY 1)
SELECT 'l_quantity' AS "column", b.bin, round(lo + b.bin * ((hi - lo) / 30), 6) AS low, round(lo + (b.bin + 1) * ((hi - lo) / 30), 6) AS high,
       coalesce(rows, 0) AS rows FROM s, (SELECT unnest(range(30)) AS bin) b LEFT JOIN f ON f.bin = b.bin""",
)
def _(t):
    return rounded(X.histogram(t("lineitem"), ["l_quantity"]))


BOX_SQL = """WITH q AS (SELECT {g} AS g, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median,
    quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
j AS (SELECT o.o_totalprice AS v, q.*, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
    FROM orders o JOIN q ON {on})
SELECT {out} round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(v) FILTER (WHERE inside), 4) AS whisker_low,
    round(max(v) FILTER (WHERE inside), 4) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers, count(*) AS rows
FROM j GROUP BY ALL"""


@query("box_summary", BOX_SQL.format(g="1", on="true", out=""))
def _(t):
    return rounded(X.box_summary(t("orders"), "o_totalprice"), 4)


@query(
    "box_summary_by",
    BOX_SQL.format(g="o_orderpriority", on="o.o_orderpriority = q.g", out="g AS o_orderpriority,"),
)
def _(t):
    return rounded(X.box_summary(t("orders"), "o_totalprice", "o_orderpriority"), 4)


def _frequency_sql(c: str) -> str:
    return f"""(SELECT '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), 'Missing') AS value, count(*) AS rows,
        round(count(*) / (SELECT count(*) FROM dirty_orders) * 100, 2) AS pct FROM dirty_orders GROUP BY 2 ORDER BY rows DESC, value LIMIT 10)"""


@query(
    "frequency_table",
    with_views("dirty_orders") + "\n" + union_sql([_frequency_sql(c) for c in ("promo_code", "order_size", "customer_id")]),
)
def _(t):
    return X.frequency_table(t("dirty_orders"), ["promo_code", "order_size", "customer_id"])


@query(
    "calendar_columns",
    "SELECT event_id, hour(ts) AS hour, dayname(ts) AS day_of_week, monthname(ts) AS month_name FROM events",
)
def _(t):
    return X.calendar_columns(t("events").select("event_id", "ts"), "ts").drop("ts")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    union_sql(
        [
            f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS pairs, round(corr({a}, {b}), 6) AS r FROM lineitem"
            for a in CORR
            for b in CORR
            if a != b
        ]
    ),
)
def _(t):
    return rounded(correlation_matrix(t("lineitem"), CORR))


BAND = "CASE WHEN r >= 0.8 THEN 'Very Strong' WHEN r >= 0.6 THEN 'Strong' WHEN r >= 0.4 THEN 'Moderate' WHEN r >= 0.2 THEN 'Weak' ELSE 'Very Weak' END"
STRENGTH_SQL = union_sql(
    [f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS r FROM lineitem" for c in CORR if c != "l_extendedprice"]
)


@query(
    "correlation_strength",
    f"SELECT feature, round(r, 6) AS correlation, {BAND} AS relationship FROM ({STRENGTH_SQL})",
)
def _(t):
    return rounded(X.correlation_strength(t("lineitem"), "l_extendedprice", CORR))


@query(
    "strongest_predictor",
    f"SELECT feature, round(r, 6) AS correlation FROM ({STRENGTH_SQL}) ORDER BY r DESC, feature LIMIT 1",
)
def _(t):
    return rounded(X.strongest_predictor(t("lineitem"), "l_extendedprice", CORR))


GROUPS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
MEANS_SQL = union_sql(
    [
        f"SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS member, count(l_extendedprice) AS rows, avg(l_extendedprice) AS mean "
        f"FROM lineitem GROUP BY 2"
        for k in GROUPS
    ]
)


@query("group_mean", f"SELECT dimension, member, rows, round(mean, 4) AS mean FROM ({MEANS_SQL})")
def _(t):
    return rounded(X.group_mean(t("lineitem"), "l_extendedprice", GROUPS), 4)


DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query(
    "pivot_mean",
    "SELECT hour(ts) AS hour, "
    + ", ".join(f"round(avg(value) FILTER (WHERE dayname(ts) = '{d}'), 4) AS {d}" for d in DAYS)
    + " FROM events GROUP BY 1",
)
def _(t):
    return rounded(X.pivot_mean(X.calendar_columns(t("events"), "ts"), "value", "hour", "day_of_week", DAYS), 4)


@query(
    "top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(t):
    return X.top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


PEAK_SQL = f"""SELECT dimension, arg_max(member, (mean, neg)) AS highest, max(mean) AS highest_mean, arg_min(member, (mean, -neg)) AS lowest,
    min(mean) AS lowest_mean FROM (SELECT *, -row_number() OVER (PARTITION BY dimension ORDER BY member) AS neg FROM ({MEANS_SQL})) GROUP BY 1"""


@query(
    "peak_groups",
    f"SELECT * REPLACE (round(highest_mean, 4) AS highest_mean, round(lowest_mean, 4) AS lowest_mean) FROM ({PEAK_SQL})",
)
def _(t):
    return rounded(X.peak_groups(t("lineitem"), "l_extendedprice", GROUPS), 4)


@query(
    "insight_table",
    f"""SELECT 'mean l_extendedprice' AS question, printf('%.2f', avg(l_extendedprice)) AS answer FROM lineitem
UNION ALL SELECT 'min l_extendedprice', printf('%.2f', min(l_extendedprice)) FROM lineitem
UNION ALL SELECT 'max l_extendedprice', printf('%.2f', max(l_extendedprice)) FROM lineitem
UNION ALL SELECT 'median l_extendedprice', printf('%.2f', median(l_extendedprice)) FROM lineitem
UNION ALL SELECT 'highest ' || dimension, highest FROM ({PEAK_SQL})
UNION ALL SELECT 'lowest ' || dimension, lowest FROM ({PEAK_SQL})
UNION ALL SELECT * FROM (SELECT 'strongest predictor', feature FROM ({STRENGTH_SQL}) ORDER BY r DESC, feature LIMIT 1)""",
)
def _(t):
    predictors = [c for c in CORR if c != "l_extendedprice"]
    return X.insight_table(t("lineitem"), "l_extendedprice", GROUPS, predictors)


# ------------------------------------------------------------------- messages


def _contains(words: list[str], column: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


TAG_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_contains(w)} THEN '{g}' END" for g, w in M.TAGS.items()) + "], lambda x: x IS NOT NULL)"


@query(
    "intent_tags",
    f"SELECT conv_id, turn, CASE WHEN len({TAG_LIST}) > 0 THEN array_to_string({TAG_LIST}, ',') ELSE 'health' END AS tags FROM conversations",
)
def _(t):
    tagged = M.intent_tags(t("conversations"), "text")
    return tagged.select("conv_id", "turn", F.array_join("tags", ",").alias("tags"))


@query(
    "intent_tags_documents",
    f"SELECT doc_id, CASE WHEN len({TAG_LIST}) > 0 THEN array_to_string({TAG_LIST}, ',') ELSE 'health' END AS tags FROM documents",
)
def _(t):
    return M.intent_tags(t("documents"), "text").select("doc_id", F.array_join("tags", ",").alias("tags"))


def _intent_sql(whole: bool) -> str:
    cases = []
    for intent, phrases in M.INTENTS.items():
        single = [p for p in phrases if (" " not in p if whole else p in M.WHOLE_WORDS)]
        rest = [p for p in phrases if p not in single]
        plural = [p + ("s?" if whole and len(p) > 3 and p != "predict" else "") for p in single]
        tests = [f"regexp_matches(lower(text), '\\b({'|'.join(plural)})\\b')"] if single else []
        tests += [_contains(rest)] if rest else []
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{intent}'")
    return f"CASE {' '.join(cases)} ELSE 'general_chat' END"


@query("intent_first", f"SELECT conv_id, turn, {_intent_sql(True)} AS intent FROM conversations")
def _(t):
    return M.intent_first(t("conversations"), "text").select("conv_id", "turn", "intent")


# Messages with the intent and the tags that a reader gives them; each row of the conversations says one of them.
SAID = [
    ("Please stop", "cancel", "health"),
    ("Good morning to you", "greeting", "health"),
    ("Hello, which model is live?", "greeting", "registry"),
    ("What can you do?", "help", "health"),
    ("List the commands", "help", "health"),
    ("Explain the last one", "explain_prediction", "explainability"),
    ("What drove it?", "explain_prediction", "health"),
    ("Predict for me", "predict", "prediction"),
    ("Estimate ETA now", "predict", "health"),
    ("Two predictions of mine", "general_chat", "prediction"),
    ("Which features count?", "feature_importance", "dataset"),
    ("Show shap", "feature_importance", "health"),
    ("Show me the models", "model_info", "registry"),
    ("Compare both", "model_info", "registry"),
    ("What about performance", "model_info", "health"),
    ("List all datasets", "dataset_info", "dataset"),
    ("How many records are there", "dataset_info", "dataset"),
    ("Any drift lately?", "general_chat", "drift"),
    ("His shipments were late", "general_chat", "health"),
    ("Latency today", "general_chat", "monitoring"),
    ("Who trained it", "general_chat", "training"),
    ("System health", "general_chat", "health"),
    ("Why is the confidence low", "explain_prediction", "explainability"),
    ("The weather is fine", "general_chat", "health"),
]


@query(
    "intent_first_said",
    "WITH said(k, message, intent, tags) AS (VALUES "
    + ", ".join(f"({k}, '{m}', '{i}', '{g}')" for k, (m, i, g) in enumerate(SAID))
    + f") SELECT conv_id, turn, message, intent, tags FROM conversations JOIN said ON (conv_id * 31 + turn) % {len(SAID)} = k",
)
def _(t):
    message = F.element_at(F.array(*[F.lit(m) for m, _, _ in SAID]), (F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(len(SAID))) + 1).cast("int"))
    rows = t("conversations").select("conv_id", "turn", message.alias("message"))
    tagged = M.intent_first(M.intent_tags(rows, "message"), "message")
    return tagged.withColumn("tags", F.array_join("tags", ","))


@query("intent_first_anywhere", f"SELECT conv_id, turn, {_intent_sql(False)} AS intent FROM conversations")
def _(t):
    return M.intent_first(t("conversations"), "text", False).select("conv_id", "turn", "intent")


@query(
    "last_n_turns",
    """SELECT conv_id, turn, role, recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency
       FROM conversations) WHERE recency <= 3""",
)
def _(t):
    return M.last_n_turns(t("conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", "recency")


# ------------------------------------------------------- monitoring and drift

MONITOR_FIELDS = """count(prediction) AS prediction_count, round(avg(prediction), 4) AS mean_prediction,
    round(stddev_pop(prediction), 4) AS std_prediction, round(min(prediction), 4) AS min_prediction,
    round(max(prediction), 4) AS max_prediction, count(*) - count(discount) AS missing_inputs,
    count(*) FILTER (WHERE quantity < 1 OR quantity > 45) AS out_of_range_inputs"""
SCORED = with_views("scored") + "\n"


def monitored(t, by=()):
    return W.monitor_batch(t("scored"), "prediction", ["quantity", "discount"], {"quantity": (1, 45)}, by)


@query("monitor_batch", SCORED + f"SELECT {MONITOR_FIELDS} FROM scored")
def _(t):
    return rounded(monitored(t), 4)


RECORDS_SQL = f"SELECT model_name, CAST(id % 24 AS BIGINT) AS hour, {MONITOR_FIELDS} FROM scored GROUP BY 1, 2"


def records(t):
    hourly = t("scored").withColumn("hour", F.col("id") % 24)
    bounds = {"quantity": (1, 45)}
    return rounded(W.monitor_batch(hourly, "prediction", ["quantity", "discount"], bounds, ["model_name", "hour"]), 4)


@query("monitor_list", SCORED + RECORDS_SQL)
def _(t):
    return W.monitor_list(records(t), "hour")


@query(
    "monitor_latest",
    SCORED + f"SELECT * FROM ({RECORDS_SQL}) r WHERE hour = (SELECT max(hour) FROM ({RECORDS_SQL}) x WHERE x.model_name = r.model_name)",
)
def _(t):
    return W.monitor_latest(records(t), "hour", ["model_name"])


@query(
    "mean_latency",
    "SELECT round(avg(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END)), 4) AS mean_latency_ms,"
    " count(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END)) AS samples FROM events",
)
def _(t):
    timed = t("events").select(
        F.expr("CASE WHEN event_id % 3 = 0 THEN value END").alias("latency_ms"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN value * 2 END").alias("latency"),
    )
    return rounded(W.mean_latency(timed, ["latency_ms", "prediction_latency_ms", "latency"]), 4)


DRIFT = ["order_value", "current_load", "avg_rating"]


@query(
    "drift_baseline",
    DELIVERIES
    + union_sql(
        [f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM deliveries" for c in DRIFT]
    ),
)
def _(t):
    return rounded(W.drift_baseline(t("deliveries"), DRIFT))


def drift(t):
    df = t("deliveries").select("id", *DRIFT)
    current = df.where("id % 2 = 1").withColumn("order_value", F.col("order_value") * 1.5)
    return W.drift_scan(W.drift_baseline(df.where("id % 2 = 0"), DRIFT), current)


def _drift_sql(c: str) -> str:
    scale = " * 1.5" if c == "order_value" else ""
    return f"""SELECT '{c}' AS feature, avg({c}) FILTER (WHERE id % 2 = 0) AS baseline_mean, avg({c}{scale}) FILTER (WHERE id % 2 = 1) AS
        current_mean, greatest(stddev_pop({c}) FILTER (WHERE id % 2 = 0), 1e-8) AS s FROM deliveries"""


DRIFT_SQL = (
    "SELECT feature, baseline_mean, current_mean, abs(current_mean - baseline_mean) / s AS shift, "
    "abs(current_mean - baseline_mean) / s > 0.5 AS drifted FROM (" + union_sql([_drift_sql(c) for c in DRIFT]) + ")"
)


@query(
    "drift_scan",
    DELIVERIES
    + "SELECT * REPLACE (round(baseline_mean, 6) AS baseline_mean, round(current_mean, 6) AS current_mean, round(shift, 6) AS shift) FROM ("
    + DRIFT_SQL
    + ")",
)
def _(t):
    return rounded(drift(t))


@query(
    "drift_any",
    DELIVERIES
    + f"SELECT bool_or(drifted) AS drift_detected, count(*) FILTER (WHERE drifted) AS drifted_features, count(*) AS features FROM ({DRIFT_SQL})",
)
def _(t):
    return W.drift_any(drift(t))


# ---------------------------------------------------------------- explanation

INPUTS = with_views("order_inputs") + "\n"
WEIGHTS = {"order_value": 0.0004, "current_load": 0.25, "discount": -6.0, "avg_rating": 0.5}
TOTAL = sum(abs(w) for w in WEIGHTS.values())
CONTRIBUTIONS_SQL = union_sql(
    [
        f"SELECT id, {i} AS position, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {w}::DOUBLE AS importance, "
        f"coalesce(CAST({f} AS DOUBLE), 0) * {w}::DOUBLE AS contribution FROM order_inputs"
        for i, (f, w) in enumerate(WEIGHTS.items())
    ]
)


@query(
    "local_contributions",
    INPUTS
    + f"SELECT id, feature, round(value, 6) AS value, importance, round(contribution, 6) + 0 AS contribution FROM ({CONTRIBUTIONS_SQL})",
)
def _(t):
    return rounded(Z.local_contributions(t("order_inputs"), "id", WEIGHTS))


RANKED_SQL = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, position) AS impact_rank FROM ({CONTRIBUTIONS_SQL})"


@query(
    "rank_impacts",
    INPUTS + f"SELECT id, feature, round(contribution, 6) + 0 AS contribution, impact_rank FROM ({RANKED_SQL})",
)
def _(t):
    return rounded(Z.rank_impacts(t("order_inputs"), "id", WEIGHTS))


BASE_CONFIDENCE = min(1.0, max(0.05, max(abs(w) for w in WEIGHTS.values()) / TOTAL))
SMALL_WEIGHTS = {"order_value": 0.0000213, "current_load": 0.0217, "discount": 0.513, "avg_rating": 0.4519}
SMALL_TOTAL = sum(abs(w) for w in SMALL_WEIGHTS.values())
SMALL_BASE = min(1.0, max(0.05, max(abs(w) for w in SMALL_WEIGHTS.values()) / SMALL_TOTAL))
SMALL_SUM = " + ".join(f"abs(coalesce(CAST({f} AS DOUBLE), 0) * {w}::DOUBLE)" for f, w in SMALL_WEIGHTS.items())


@query(
    "explain_confidence",
    INPUTS
    + f"""SELECT id, round(c, 4) AS confidence, round(greatest(0, 1 - c), 4) AS uncertainty FROM (SELECT id,
       least(1.0::DOUBLE, greatest({SMALL_BASE!r}::DOUBLE, least(1.0::DOUBLE, (0::DOUBLE + {SMALL_SUM}) / 4 / {max(SMALL_TOTAL, 1.0)!r}::DOUBLE))) AS c
       FROM order_inputs)""",
)
def _(t):
    return Z.explain_confidence(t("order_inputs"), "id", SMALL_WEIGHTS)


@query(
    "explain_text",
    INPUTS
    + f"""SELECT id, 'The prediction is primarily influenced by ' || string_agg(replace(feature, '_', ' ') ||
       CASE WHEN contribution > 0 THEN ' (increasing)' ELSE ' (decreasing)' END, ', and ' ORDER BY impact_rank) || '.' AS explanation
       FROM ({RANKED_SQL}) WHERE impact_rank <= 3 GROUP BY id""",
)
def _(t):
    return Z.explain_text(t("order_inputs"), "id", WEIGHTS)


@query(
    "contribution_width",
    INPUTS
    + f"""SELECT id, feature, round(contribution, 6) + 0 AS contribution, CASE WHEN contribution >= 0 THEN '+' ELSE '-' END AS direction,
       round(greatest(8, abs(contribution) / greatest(1, max(abs(contribution)) OVER (PARTITION BY id)) * 100), 4) AS width_pct
       FROM ({CONTRIBUTIONS_SQL})""",
)
def _(t):
    made = Z.contribution_width(t("order_inputs"), "id", WEIGHTS)
    return made.withColumns({"contribution": F.round("contribution", 6), "width_pct": F.round("width_pct", 4)})


