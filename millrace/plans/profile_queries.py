"""Queries on profiles, relations, advice and decisions over a renamed star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import names
from millrace.operators import advise as A
from millrace.operators import decide as D
from millrace.operators import profile as P
from millrace.operators import relate as R
from millrace.operators import scoring as S
from millrace.operators.rows import union_all
from millrace.plans.catalog import query, rounded, union_sql
from millrace.plans.cleaning import action_order
from millrace.plans.quality_queries import BOTH as DIRTY_BOTH
from millrace.plans.quality_queries import scratch
from millrace.plans.quality_queries import CATEGORY_SQL, ORDER_COLUMNS, SPECS, suite
from millrace.plans.tables import with_views
from millrace.sources.files import manifest_read
from millrace.sources.sinks import sink_report

# Columns of each star table with their physical and logical types.
STAR = {
    "orders_star": [
        ("id", "bigint", "integer"), ("customer_id", "bigint", "integer"), ("total_amount", "double", "float"),
        ("order_status", "string", "string"), ("priority", "string", "string"), ("created_date", "string", "datetime"),
        ("total_amount_estimate", "double", "float"), ("delivery_minutes", "bigint", "integer"),
        ("is_rush", "string", "string"),
    ],
    "customers_star": [
        ("id", "bigint", "integer"), ("customer_name", "string", "string"), ("balance", "double", "float"),
        ("segment", "string", "string"), ("nation_id", "bigint", "integer"),
    ],
    "nations_star": [
        ("id", "bigint", "integer"), ("title", "string", "string"), ("region_id", "bigint", "integer"),
    ],
    "items_star": [
        ("order_id", "bigint", "integer"), ("part_id", "bigint", "integer"), ("quantity", "double", "float"),
        ("price", "double", "float"), ("return_flag", "string", "string"),
    ],
    "parts_star": [
        ("id", "bigint", "integer"), ("brand", "string", "string"), ("size", "int", "integer"),
        ("retail_value", "double", "float"),
    ],
}
WITH = with_views(*STAR)
BOOLEAN_WORDS = ", ".join(f"'{w}'" for w in names.BOOLEAN_WORDS)


def _profile_sql(dataset: str, position: int, column: str, physical: str, logical: str) -> str:
    numeric = logical in ("integer", "float")
    value = f"CAST({column} AS DOUBLE)"
    stats = [f"min({value})", f"max({value})", f"avg({value})", f"stddev_samp({value})"] if numeric else ["NULL"] * 4
    columns = ", ".join(f"CAST({s} AS DOUBLE) AS {n}" for s, n in zip(stats, ("min", "max", "mean", "std")))
    text = f"CAST({column} AS VARCHAR)"
    return f"""SELECT '{dataset}' AS dataset, '{column}' AS "column", {position} AS position,
        '{logical}' AS logical_dtype, '{physical}' AS physical_dtype, count(*) AS row_count,
        count(*) - count({column}) AS null_count, round((count(*) - count({column})) / count(*) * 100, 2) AS null_pct,
        count(DISTINCT {column}) AS unique_count, round(count(DISTINCT {column}) / count(*) * 100, 2) AS unique_pct,
        count(*) - count(DISTINCT {column}) - least(count(*) - count({column}), 1) AS duplicate_rows, {columns},
        {str(numeric).lower()} AS is_numeric,
        count(DISTINCT {column}) BETWEEN 1 AND 2 AND count(*) FILTER (WHERE lower({text}) NOT IN ({BOOLEAN_WORDS})) = 0 AS is_boolean,
        {str(logical == "datetime").lower()} AS is_datetime,
        {str(logical == "string").lower()} AND avg(length({text})) >= 40 AS is_text
        FROM {dataset}"""


RAW_PROFILE = union_sql(
    [_profile_sql(ds, i, *c) for ds, columns in STAR.items() for i, c in enumerate(columns)]
)
PROFILE = f"""profile AS (SELECT *,
    logical_dtype = 'string' AND NOT is_text AND unique_count <= greatest(50, row_count * 0.2) AS is_categorical,
    unique_pct >= 50 AS is_high_cardinality FROM ({RAW_PROFILE}))"""


def _m(pattern: str, column: str = '"column"') -> str:
    return f"regexp_matches({column}, '{pattern}', 'i')"


IDENT = f"({_m(names.IDENTIFIER)} OR unique_pct / 100 >= 0.95)"
ROLE_RULES = [
    ("identifier", IDENT),
    ("timestamp", f"(({_m(names.TIME)} OR is_datetime) AND NOT is_numeric)"),
    ("pii", _m(names.PII)),
    ("metadata", _m(names.METADATA)),
    ("boolean_feature", "is_boolean"),
    ("numeric_feature", f"is_numeric AND NOT {IDENT}"),
    ("categorical_feature", "is_categorical"),
    ("text", "is_text"),
    ("high_cardinality", f"is_high_cardinality AND NOT {IDENT}"),
    ("potential_target", f"{_m(names.TARGET)} AND is_numeric"),
    ("distractor", "null_pct >= 99 OR (unique_count <= 1 AND row_count > 1)"),
]
FOUND = "list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in ROLE_RULES) + "], lambda x: x IS NOT NULL)"
ROLES = PROFILE + f""",
plain_roles AS (SELECT *, CASE WHEN len({FOUND}) > 0 THEN {FOUND} ELSE ['unknown'] END AS roles FROM profile)"""

FK_COLUMNS = [
    ("orders_star", "customer_id"), ("customers_star", "nation_id"), ("items_star", "order_id"), ("items_star", "part_id"),
]
FK_LIST = ", ".join(f"('{d}', '{c}')" for d, c in FK_COLUMNS)
FK_ROLES = ROLES + f""",
roles AS (SELECT * REPLACE (CASE WHEN (dataset, "column") IN ({FK_LIST})
    THEN list_append(list_filter(roles, lambda x: x <> 'unknown'), 'foreign_key') ELSE roles END AS roles) FROM plain_roles)"""


def star(t):
    return {name: t(name) for name in STAR}


def profile_of(t):
    return P.profile_tables(star(t))


def foreign_keys(t):
    return P.literal_fk(t.spark, FK_COLUMNS)


def roles_of(t, plain=None):
    return P.mark_foreign_keys(P.column_roles(profile_of(t)) if plain is None else plain, foreign_keys(t))


# -------------------------------------------------------------------- profile

STAT_ROUND = "* REPLACE (round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max)"


@query("profile_column", WITH + f",\n{PROFILE}\nSELECT {STAT_ROUND} FROM profile")
def _(t):
    return rounded(profile_of(t), 4)


def _sample_sql(dataset: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", rank, value FROM (SELECT row_number() OVER (ORDER BY value) AS rank, value "
        f"FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS value FROM {dataset} WHERE {column} IS NOT NULL)) WHERE rank <= 5"
    )


@query(
    "sample_values",
    union_sql([_sample_sql("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]),
)
def _(t):
    return P.sample_values(t("orders"))


@query(
    "infer_logical_dtype",
    WITH + f",\n{PROFILE}\nSELECT dataset, \"column\", logical_dtype FROM profile",
)
def _(t):
    return profile_of(t).select("dataset", "column", "logical_dtype")


def _dataset_sql(name: str, columns: list[str]) -> str:
    keys = ", ".join(columns)
    return (
        f"SELECT '{name}' AS dataset, CAST(sum(n) AS BIGINT) AS row_count, {len(columns)} AS column_count, "
        f"CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count FROM (SELECT count(*) AS n FROM {name} GROUP BY {keys})"
    )


@query(
    "profile_dataset",
    with_views("dirty_orders", *STAR)
    + "\n"
    + union_sql(
        [_dataset_sql(n, [c for c, *_ in cols]) for n, cols in STAR.items()] + [_dataset_sql("dirty_orders", ORDER_COLUMNS)]
    ),
)
def _(t):
    tables = {**star(t), "dirty_orders": t("dirty_orders")}
    return union_all([P.profile_dataset(df, name) for name, df in tables.items()])


@query(
    "is_boolean_like",
    WITH + f",\n{PROFILE}\nSELECT dataset, \"column\" FROM profile WHERE is_boolean",
)
def _(t):
    return profile_of(t).where("is_boolean").select("dataset", "column")


# Every text column of the given tables.
TEXT_COLUMNS = [
    ("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("supplier", "s_name"),
    ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"),
    ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("events", "event_type"), ("events", "props"),
    ("documents", "text"), ("documents", "lang"), ("documents", "source"), ("pages", "url"), ("pages", "html"),
    ("benchmark", "text"), ("conversations", "role"), ("conversations", "text"),
]


@query(
    "is_text_like",
    union_sql(
        [
            f"SELECT '{d}' AS dataset, '{c}' AS \"column\", avg(length({c})) >= 40 AS is_text, "
            f"count(DISTINCT {c}) <= greatest(50, count(*) * 0.2) AND NOT avg(length({c})) >= 40 AS is_categorical FROM {d}"
            for d, c in TEXT_COLUMNS
        ]
    ),
)
def _(t):
    return P.profile_tables({d: t(d) for d, _ in TEXT_COLUMNS}, TEXT_COLUMNS).select("dataset", "column", "is_text", "is_categorical")


@query(
    "categorical_flags",
    WITH + f",\n{PROFILE}\nSELECT dataset, \"column\", is_categorical, is_high_cardinality FROM profile",
)
def _(t):
    return profile_of(t).select("dataset", "column", "is_categorical", "is_high_cardinality")


@query(
    "column_groups",
    WITH
    + f""",\n{PROFILE}
SELECT dataset, bucket, string_agg("column", ',' ORDER BY position) AS columns FROM (
    {union_sql([f"SELECT dataset, position, \"column\", '{b}' AS bucket FROM profile WHERE is_{b}" for b in P.BUCKETS])})
GROUP BY dataset, bucket""",
)
def _(t):
    return P.column_groups(profile_of(t)).withColumn("columns", F.array_join("columns", ","))


@query(
    "column_roles",
    WITH + f",\n{ROLES}\nSELECT dataset, \"column\", array_to_string(roles, ',') AS roles FROM plain_roles",
)
def _(t):
    return P.column_roles(profile_of(t)).select("dataset", "column", F.array_join("roles", ",").alias("roles"))


@query(
    "mark_foreign_keys",
    WITH + f",\n{FK_ROLES}\nSELECT dataset, \"column\", array_to_string(roles, ',') AS roles FROM roles",
)
def _(t):
    return roles_of(t).select("dataset", "column", F.array_join("roles", ",").alias("roles"))


REGISTRY_SQL = """SELECT dataset, "column", logical_dtype, physical_dtype, null_count > 0 AS nullable, unique_count, row_count
    FROM profile"""


@query("schema_registry", WITH + f",\n{PROFILE}\n{REGISTRY_SQL}")
def _(t):
    return P.schema_registry(profile_of(t))


@query(
    "schema_diff",
    WITH
    + f""",\n{PROFILE},
new AS ({REGISTRY_SQL}),
old AS (SELECT dataset, CASE WHEN "column" = 'price' THEN 'cost' ELSE "column" END AS "column",
        CASE WHEN "column" = 'balance' THEN 'string' ELSE logical_dtype END AS logical_dtype,
        row_count - CASE WHEN dataset = 'parts_star' THEN 10 ELSE 0 END AS row_count FROM new WHERE dataset <> 'nations_star'),
cols AS (SELECT coalesce(o.dataset, n.dataset) AS dataset, coalesce(o."column", n."column") AS "column",
        o.logical_dtype AS previous, n.logical_dtype AS current, o.dataset IS NULL AS added, n.dataset IS NULL AS removed
        FROM old o FULL JOIN new n ON o.dataset = n.dataset AND o."column" = n."column")
SELECT dataset, "column", CASE WHEN added THEN 'added_column' WHEN removed THEN 'removed_column' ELSE 'datatype_change' END AS change,
       previous, current FROM cols WHERE dataset <> 'nations_star' AND (added OR removed OR previous IS DISTINCT FROM current)
UNION ALL SELECT 'nations_star', NULL, 'added_dataset', NULL, CAST(max(row_count) AS VARCHAR) FROM new WHERE dataset = 'nations_star'
UNION ALL SELECT 'parts_star', NULL, 'row_count_change', CAST(max(row_count) - 10 AS VARCHAR), CAST(max(row_count) AS VARCHAR)
    FROM new WHERE dataset = 'parts_star'""",
)
def _(t):
    new = P.schema_registry(profile_of(t))
    old = new.where("dataset != 'nations_star'").select(
        "dataset",
        F.when(F.col("column") == "price", "cost").otherwise(F.col("column")).alias("column"),
        F.when(F.col("column") == "balance", "string").otherwise(F.col("logical_dtype")).alias("logical_dtype"),
        (F.col("row_count") - F.when(F.col("dataset") == "parts_star", 10).otherwise(0)).alias("row_count"),
    )
    return P.schema_diff(old, new)


# ------------------------------------------------------------------ relations

KEY_COLUMNS = [(d, c, ty) for d, columns in STAR.items() for c, _, ty in columns if c == "id" or c.endswith("_id")]
CONSIDERED = [(a, b, c, d) for a, b, _ in KEY_COLUMNS for c, d, _ in KEY_COLUMNS if a != c]


def _overlap_sql(a: str, b: str, c: str, d: str) -> str:
    return f"""SELECT '{a}' AS source_dataset, '{b}' AS source_column, '{c}' AS target_dataset, '{d}' AS target_column,
        (SELECT count(*) FROM (SELECT DISTINCT {b} AS k FROM {a}) WHERE k IN (SELECT {d} FROM {c})) AS matched,
        (SELECT count(DISTINCT {b}) FROM {a}) AS distinct_keys"""


OVERLAP_SQL = "SELECT *, matched / distinct_keys AS overlap FROM (" + union_sql([_overlap_sql(*p) for p in CONSIDERED]) + ")"
RATIO_SQL = union_sql(
    [
        f"SELECT '{d}' AS dataset, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_keys, "
        f"count(DISTINCT {c}) / count({c}) AS distinct_ratio FROM {d}"
        for d, c, _ in KEY_COLUMNS
    ]
)


@query(
    "detect_primary_keys",
    WITH
    + f""",\n{ROLES}
SELECT dataset, "column" FROM plain_roles WHERE list_contains(roles, 'identifier') AND (unique_pct >= 90 OR lower("column") = 'id')""",
)
def _(t):
    return R.detect_primary_keys(P.column_roles(profile_of(t)))


KEYISH = """({c} = 'id' OR {c} LIKE '%\\_id' ESCAPE '\\' OR {c} LIKE 'id\\_%' ESCAPE '\\' OR {c} IN ('uuid', 'guid', 'key', 'code')
    OR list_contains(string_split({c}, '_'), 'id'))"""
CANDIDATES = f"""candidates AS (SELECT s.dataset AS source_dataset, s."column" AS source_column, s.logical_dtype AS source_dtype,
    s.null_count AS source_nulls, t.dataset AS target_dataset, t."column" AS target_column, t.logical_dtype AS target_dtype
    FROM profile s JOIN profile t ON s.dataset <> t.dataset
     AND CASE WHEN s.is_numeric THEN 'n' ELSE s.logical_dtype END = CASE WHEN t.is_numeric THEN 'n' ELSE t.logical_dtype END
    WHERE t.unique_pct >= 85 AND t.null_pct <= 10
      AND ({KEYISH.format(c='s."column"')} OR {KEYISH.format(c='t."column"')}))"""


@query("join_candidates", WITH + f",\n{PROFILE},\n{CANDIDATES}\nSELECT * FROM candidates")
def _(t):
    return R.join_candidates(profile_of(t))


@query(
    "key_overlap",
    WITH + "\nSELECT * REPLACE (round(overlap, 6) AS overlap) FROM (" + OVERLAP_SQL + ")",
)
def _(t):
    tables = star(t)
    pairs = R.pair_table(t.spark, R.plausible_pairs(tables))
    return rounded(R.key_overlap(R.key_values(tables), pairs))


@query("key_ratios", WITH + f"\nSELECT * REPLACE (round(distinct_ratio, 6) AS distinct_ratio) FROM ({RATIO_SQL})")
def _(t):
    return rounded(R.key_ratios(R.key_values(star(t))))


CARDINALITY_SQL = """CASE WHEN {k} AND {s} < 0.95 THEN 'many_to_one' WHEN {s} > 0.95 AND {t} > 0.95 THEN 'one_to_one'
    WHEN {s} > 0.95 AND {t} < 0.95 THEN 'one_to_many' WHEN {s} < 0.95 AND {t} < 0.95 THEN 'many_to_many' ELSE 'many_to_one' END"""


@query(
    "infer_cardinality",
    WITH
    + f"""\nSELECT s.dataset AS source_dataset, s."column" AS source_column, t.dataset AS target_dataset, t."column" AS target_column,
       {CARDINALITY_SQL.format(k="t.\"column\" = 'id'", s="s.distinct_ratio", t="t.distinct_ratio")} AS cardinality
FROM ({RATIO_SQL}) s JOIN ({RATIO_SQL}) t ON s.dataset <> t.dataset""",
)
def _(t):
    tables = star(t)
    ratios = R.key_ratios(R.key_values(tables))
    pairs = R.pair_table(t.spark, R.plausible_pairs(tables))
    side = lambda p: ratios.select(
        F.col("dataset").alias(f"{p}_dataset"), F.col("column").alias(f"{p}_column"), F.col("distinct_ratio").alias(p)
    )
    # One row per key column.
    joined = pairs.join(F.broadcast(side("source")), ["source_dataset", "source_column"]).join(
        F.broadcast(side("target")), ["target_dataset", "target_column"]
    )
    kind = R.cardinality(F.col("source"), F.col("target"), F.col("target_column") == "id")
    return joined.select(*pairs.columns, kind.alias("cardinality"))


def _entity(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%\\_id' ESCAPE '\\' THEN {c}[:-4] ELSE {c} END"


def _single(c: str) -> str:
    return f"regexp_replace({c}, 's$', '')"


OTHER = _single(f"CASE WHEN sc = 'id' THEN {_entity('tc')} ELSE {_entity('sc')} END")
TABLE = _single("CASE WHEN sc = 'id' THEN sd ELSE td END")
SIMILARITY_SQL = f"""CASE WHEN sc = tc AND sc = 'id' THEN 0.1 WHEN sc = tc THEN 1.0
    WHEN sc = 'id' OR tc = 'id' THEN CASE WHEN {OTHER} = {TABLE} THEN 1.0
         WHEN contains({OTHER}, {TABLE}) OR contains({TABLE}, {OTHER}) THEN 0.8 ELSE 0.0 END
    WHEN {_single(_entity('sc'))} = {_single(_entity('tc'))} THEN 1.0 ELSE 0.0 END"""
NEAR = lambda a, b: f"(contains({a}, {b}) OR contains({b}, {a}))"
PLAUSIBLE_SQL = f"""NOT (sc = 'id' AND tc = 'id') AND CASE
    WHEN sc = 'id' AND tc <> 'id' THEN {NEAR(_single('sd'), _single(_entity('tc')))}
    WHEN tc = 'id' AND sc <> 'id' THEN {NEAR(_single('td'), _single(_entity('sc')))}
    ELSE {_single(_entity('sc'))} = {_single(_entity('tc'))} END"""


CANDIDATE_PAIRS = "SELECT source_dataset AS sd, source_column AS sc, target_dataset AS td, target_column AS tc FROM candidates"


@query(
    "name_similarity",
    WITH
    + f""",\n{PROFILE},\n{CANDIDATES}
SELECT sd AS source_dataset, sc AS source_column, td AS target_dataset, tc AS target_column,
       CAST({SIMILARITY_SQL} AS DOUBLE) AS similarity FROM ({CANDIDATE_PAIRS})""",
)
def _(t):
    pairs = R.join_candidates(profile_of(t)).select(*R.PAIR)
    return pairs.select("*", R.name_similarity(*[F.col(c) for c in R.PAIR]).alias("similarity"))


CONFIDENCE = "n * 0.40 + overlap * 0.30 + card * 0.15 + d * 0.10 + overlap * 0.05"
RELATIONS = f"""ratios AS ({RATIO_SQL}), shares AS ({OVERLAP_SQL}),
evidence AS (SELECT c.*, o.overlap, s.distinct_ratio AS sr, t.distinct_ratio AS tr,
    k."column" IS NOT NULL AS is_key, c.source_dataset AS sd, c.source_column AS sc, c.target_dataset AS td, c.target_column AS tc
    FROM candidates c JOIN shares o USING (source_dataset, source_column, target_dataset, target_column)
    JOIN ratios s ON s.dataset = c.source_dataset AND s."column" = c.source_column
    JOIN ratios t ON t.dataset = c.target_dataset AND t."column" = c.target_column
    LEFT JOIN plain_roles k ON k.dataset = c.target_dataset AND k."column" = c.target_column
        AND list_contains(k.roles, 'identifier') AND (k.unique_pct >= 90 OR k."column" = 'id')),
kinds AS (SELECT *, {CARDINALITY_SQL.format(k="is_key", s="sr", t="tr")} AS cardinality, {SIMILARITY_SQL} AS n FROM evidence
    WHERE {PLAUSIBLE_SQL}),
parts AS (SELECT *, CASE WHEN cardinality IN ('many_to_one', 'one_to_one') THEN 1.0 WHEN cardinality = 'one_to_many' THEN 0.8
    ELSE 0.1 END AS card, CASE WHEN source_dtype = target_dtype THEN 1.0 ELSE 0.8 END AS d FROM kinds),
relationships AS (SELECT source_dataset, source_column, target_dataset, target_column,
    CASE WHEN {CONFIDENCE} >= 0.80 THEN 'Confirmed' ELSE 'Likely' END AS tier, cardinality,
    round(CAST({CONFIDENCE} AS DOUBLE), 4) AS join_confidence, round(overlap, 4) AS overlap_ratio,
    round(CAST(n * 0.40 AS DOUBLE), 4) AS name_part, round(overlap * 0.30, 4) AS integrity_part,
    round(CAST(card * 0.15 AS DOUBLE), 4) AS cardinality_part, round(CAST(d * 0.10 AS DOUBLE), 4) AS dtype_part,
    round(overlap * 0.05, 4) AS overlap_part, source_nulls > 0 AS optional, overlap >= 0.95 AND source_nulls = 0 AS required,
    CASE WHEN overlap >= 0.95 THEN 'inner' ELSE 'left' END AS join_type FROM parts WHERE {CONFIDENCE} >= 0.65)"""
WITH_RELATIONS = WITH + f",\n{ROLES},\n{CANDIDATES},\n{RELATIONS}\n"


def relations_of(t, roles=None):
    return R.detect_relationships(star(t), P.column_roles(profile_of(t)) if roles is None else roles)


@query("join_confidence", WITH_RELATIONS + "SELECT * FROM relationships")
def _(t):
    return relations_of(t)


@query(
    "join_plausibility",
    WITH
    + f""",\n{PROFILE},\n{CANDIDATES}
SELECT sd AS source_dataset, sc AS source_column, td AS target_dataset, tc AS target_column FROM ({CANDIDATE_PAIRS})
WHERE {KEYISH.format(c="sc")} AND {KEYISH.format(c="tc")} AND {PLAUSIBLE_SQL}""",
)
def _(t):
    pairs = R.join_candidates(profile_of(t)).select(*R.PAIR)
    return pairs.where(R.join_plausible(*[F.col(c) for c in R.PAIR]))


@query(
    "merge_plan",
    WITH_RELATIONS
    + """SELECT source_dataset AS left_dataset, target_dataset AS right_dataset, source_column AS left_on, target_column AS right_on,
    CASE WHEN required THEN 'inner' ELSE 'left' END AS join_type, optional, required, join_confidence AS confidence, cardinality,
    CASE cardinality WHEN 'many_to_one' THEN 'enrich_source_with_target' WHEN 'one_to_many' THEN 'aggregate_target_to_source'
         WHEN 'many_to_many' THEN 'bridge_or_aggregate_before_join' ELSE 'direct_join' END AS strategy,
    row_number() OVER (ORDER BY join_confidence DESC, source_dataset, source_column, target_dataset, target_column) AS rank
FROM relationships""",
)
def _(t):
    return R.merge_plan(relations_of(t))


@query(
    "relationship_graph",
    WITH_RELATIONS
    + f"""SELECT 'node' AS kind, id AS source, NULL AS target, CAST(degree AS VARCHAR) AS label FROM (
    SELECT v.id, count(r.id) AS degree FROM (VALUES {", ".join(f"('{d}')" for d in STAR)}) v(id)
    LEFT JOIN (SELECT source_dataset AS id FROM relationships UNION ALL SELECT target_dataset FROM relationships) r ON r.id = v.id
    GROUP BY v.id)
UNION ALL SELECT 'edge', source_dataset, target_dataset, source_column || ' -> ' || target_column FROM relationships""",
)
def _(t):
    relations = relations_of(t)
    nodes = R.graph_nodes(relations, list(STAR)).select(
        F.lit("node").alias("kind"),
        F.col("id").alias("source"),
        F.lit(None).cast("string").alias("target"),
        F.col("degree").cast("string").alias("label"),
    )
    edges = R.graph_edges(relations).select(F.lit("edge").alias("kind"), "source", "target", "label")
    return nodes.unionByName(edges)


# --------------------------------------------------------------------- advice

HAS = lambda role: f"list_contains(roles, '{role}')"
TGT, POST, PRE = _m(names.TARGET), _m(names.POST_EVENT), _m(names.PRE_EVENT)
NUM = "(is_numeric AND unique_count > 1)"
CAT = "(is_categorical AND unique_count BETWEEN 2 AND 20)"
TARGETS = f"""scores AS (SELECT dataset, "column", position,
    greatest(0, least(1, round(CAST(CASE WHEN {NUM} THEN 0.25 WHEN {CAT} THEN CASE WHEN {TGT} THEN 0.15 ELSE 0 END
      WHEN is_boolean AND {TGT} THEN 0.10 ELSE 0 END
    + CASE WHEN {HAS('potential_target')} THEN 0.15 ELSE 0 END + CASE WHEN {POST} THEN 0.35 ELSE 0 END
    - CASE WHEN {PRE} THEN 0.40 ELSE 0 END + CASE WHEN {TGT} THEN 0.20 ELSE 0 END
    - CASE WHEN null_pct > 30 THEN 0.15 ELSE 0 END AS DOUBLE), 4))) AS score,
    CASE WHEN {NUM} THEN 'regression' WHEN {CAT} THEN CASE WHEN {TGT} THEN 'classification' ELSE 'unknown' END
      WHEN is_boolean AND {TGT} THEN 'classification' ELSE 'unknown' END AS target_type
    FROM roles WHERE NOT ({HAS('foreign_key')} OR is_datetime OR ({HAS('timestamp')} AND NOT {POST}) OR {HAS('metadata')}
      OR ({HAS('distractor')} AND NOT {TGT} AND NOT {POST}) OR ({HAS('identifier')} AND NOT {TGT}) OR {_m(names.COORDINATE)})),
targets AS (SELECT dataset, "column", row_number() OVER (ORDER BY score DESC, dataset, position) AS rank, score,
    CASE WHEN score >= 0.85 THEN 'strong' WHEN score >= 0.5 THEN 'possible' ELSE 'weak' END AS tier, target_type
    FROM scores WHERE score >= 0.14)"""
WITH_TARGETS = WITH + f",\n{FK_ROLES},\n{TARGETS}"


@query("target_candidates", WITH_TARGETS + "\nSELECT * FROM targets")
def _(t):
    return A.target_candidates(roles_of(t))


NUMERIC = {d: [c for c, _, k in columns if k in ("integer", "float")] for d, columns in STAR.items()}
CORR_SQL = union_sql(
    [
        f"SELECT '{d}' AS dataset, '{a}' AS \"column\", '{b}' AS target, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) "
        f"AS pairs, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {d}"
        for d, columns in NUMERIC.items()
        for a in columns
        for b in columns
        if a != b
    ]
)
LATE = f"({_m(names.LEAKAGE, 'p.\"column\"')} AND (list_contains(p.roles, 'timestamp') OR p.is_datetime))"
NAMED = "contains(lower(p.\"column\"), lower(k.target))"
LEAKS = f"""checked AS (SELECT dataset, "column" AS target FROM targets WHERE tier <> 'weak'
      OR (rank <= 3 AND (SELECT count(*) FROM targets WHERE tier <> 'weak') = 0)),
corrs AS ({CORR_SQL}),
leaks AS (SELECT p.dataset, p."column", k.target,
    CASE WHEN {LATE} THEN 'HIGH' WHEN {NAMED} THEN 'HIGH' WHEN pairs >= 3 AND abs(r) >= 0.98 THEN 'HIGH'
         WHEN pairs >= 3 AND abs(r) >= 0.90 THEN 'MEDIUM' WHEN pairs >= 3 AND abs(r) >= 0.75 THEN 'LOW' END AS severity,
    CAST(CASE WHEN {LATE} THEN 0.95 WHEN {NAMED} THEN 0.92 WHEN pairs >= 3 AND abs(r) >= 0.98 THEN 0.98
         WHEN pairs >= 3 AND abs(r) >= 0.90 THEN 0.85 WHEN pairs >= 3 AND abs(r) >= 0.75 THEN 0.65 END AS DOUBLE) AS confidence,
    CASE WHEN {LATE} THEN 'post_event_timestamp' WHEN {NAMED} THEN 'name_contains_target'
         WHEN pairs >= 3 AND abs(r) >= 0.75 THEN 'correlation' END AS rule,
    CASE WHEN NOT {LATE} AND NOT {NAMED} AND pairs >= 3 AND abs(r) >= 0.75 THEN round(r, 3) END AS correlation
    FROM roles p JOIN checked k ON p.dataset = k.dataset AND p."column" <> k.target
    LEFT JOIN corrs c ON c.dataset = p.dataset AND c."column" = p."column" AND c.target = k.target)"""
WITH_LEAKS = WITH_TARGETS + f",\n{LEAKS}"


def leaks_of(t, roles, targets):
    return A.leakage_scan(star(t), roles, targets)


@query("leakage_scan", WITH_LEAKS + "\nSELECT * FROM leaks WHERE severity IS NOT NULL")
def _(t):
    roles = roles_of(t)
    return leaks_of(t, roles, A.target_candidates(roles))


ANNOTATED = """marked AS (SELECT * REPLACE (CASE WHEN (dataset, "column") IN (SELECT (dataset, "column") FROM leaks WHERE severity IS NOT NULL)
    THEN list_append(list_filter(roles, lambda x: x <> 'unknown'), 'potential_leakage') ELSE roles END AS roles) FROM roles)"""
WITH_MARKED = WITH_LEAKS + f",\n{ANNOTATED}"


def marked_of(t, plain=None):
    roles = roles_of(t, plain)
    targets = A.target_candidates(roles)
    leaks = leaks_of(t, roles, targets)
    return P.add_role(roles, leaks, "potential_leakage"), targets, leaks


@query(
    "annotate_leakage",
    WITH_MARKED + "\nSELECT dataset, \"column\", array_to_string(roles, ',') AS roles FROM marked",
)
def _(t):
    marked, _, _ = marked_of(t)
    return marked.select("dataset", "column", F.array_join("roles", ",").alias("roles"))


ADVICE_RULES = [
    (HAS("identifier"), "'identifier'", "ignore", "0.95", "NULL", "NULL", ""),
    (HAS("foreign_key"), "'identifier'", "ignore", "0.90", "NULL", "NULL", ""),
    (HAS("pii"), "'pii'", "ignore", "0.98", "NULL", "NULL", ""),
    (HAS("metadata"), "'metadata'", "ignore", "0.92", "NULL", "NULL", ""),
    (HAS("potential_leakage"), "'leakage'", "ignore", "0.96", "NULL", "NULL", ""),
    (HAS("potential_target"), "'target'", "ignore", "0.94", "NULL", "NULL", ""),
    (HAS("distractor"), "'distractor'", "ignore", "0.88", "NULL", "NULL", ""),
    ("null_pct > 80", "'optional_feature'", "weak_feature", "0.35", "NULL", "NULL", ""),
    ("is_datetime", "'derived_feature'", "derived_feature_candidate", "0.88", "'none'", "'none'",
     "extract_year,extract_month,extract_day_of_week,extract_hour"),
    ("is_text", "'derived_feature'", "derived_feature_candidate", "0.62", "NULL", "NULL",
     "text_length,token_count,embedding_candidate"),
    ("is_numeric", "CASE WHEN unique_pct > 90 THEN 'optional_feature' ELSE 'recommended_feature' END", "useful_feature",
     "CASE WHEN unique_pct > 90 THEN 0.55 ELSE 0.82 END", "'none'", "'standard_scaler'", ""),
    ("is_boolean", "'recommended_feature'", "useful_feature", "0.78", "'none'", "'none'", ""),
    ("is_categorical", "CASE WHEN unique_count <= 20 THEN 'recommended_feature' ELSE 'optional_feature' END", "useful_feature",
     "CASE WHEN unique_count <= 20 THEN 0.80 ELSE 0.58 END",
     "CASE WHEN unique_count <= 20 THEN 'one_hot' ELSE 'target_encoding' END", "'none'", ""),
    ("is_high_cardinality", "'optional_feature'", "weak_feature", "0.48", "'hashing_or_embedding'", "NULL", ""),
    ("true", "'unknown'", "weak_feature", "0.30", "NULL", "NULL", ""),
]


def _first(index: int, quote: bool = False) -> str:
    q = "'" if quote else ""
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {q}{r[index]}{q}" for r in ADVICE_RULES) + " END"


ADVICE = f"""advice AS (SELECT dataset, "column", {_first(1)} AS classification, {_first(2, True)} AS recommendation,
    CAST({_first(3)} AS DOUBLE) AS confidence, {_first(4)} AS encoding, {_first(5)} AS scaling, {_first(6, True)} AS derived FROM marked)"""
WITH_ADVICE = WITH_MARKED + f",\n{ADVICE}"


@query("feature_advice", WITH_ADVICE + "\nSELECT * FROM advice")
def _(t):
    return A.feature_advice(marked_of(t)[0])


@query(
    "data_dictionary",
    WITH_ADVICE
    + """\nSELECT m.dataset, m."column", m.logical_dtype, m.null_pct, m.unique_count, array_to_string(m.roles, ',') AS roles,
       a.classification, a.recommendation FROM marked m JOIN advice a ON a.dataset = m.dataset AND a."column" = m."column" """,
)
def _(t):
    marked, _, _ = marked_of(t)
    return P.data_dictionary(marked, A.feature_advice(marked))


@query(
    "intelligence_score",
    WITH_ADVICE
    + f""",\n{CANDIDATES},\n{RELATIONS},
one AS (SELECT 1.0 AS schema_part, (SELECT coalesce(avg(join_confidence), 0.5) FROM relationships) AS rel,
    (SELECT coalesce(avg(confidence) FILTER (WHERE classification NOT IN ('identifier', 'metadata', 'pii')), 0.5) FROM advice) AS feat,
    (SELECT coalesce(avg(score) FILTER (WHERE tier = 'strong'), avg(score) FILTER (WHERE rank <= 3), 0) FROM targets) AS tgt)
SELECT 100.0::DOUBLE AS discovery_quality, round(rel * 100, 2) AS relationship_confidence, 100.0::DOUBLE AS schema_confidence,
    round(feat * 100, 2) AS feature_confidence, round(tgt * 100, 2) AS target_confidence,
    round((100 + 100 + rel * 100 + feat * 100 + tgt * 100) * 0.20, 2) AS overall_score FROM one""",
)
def _(t):
    plain = P.column_roles(profile_of(t))  # one profile for all parts
    marked, targets, _ = marked_of(t, plain)
    return A.intelligence_score(plain, relations_of(t, plain), A.feature_advice(marked), targets)


# ------------------------------------------------------------------ decisions

ISSUE = "'{i}' AS issue_type, {ds} AS dataset, {c} AS \"column\", {s} AS severity, {p} AS null_pct, {n} AS count"


def _issue_sql(issue, source, where, severity, dataset="dataset", column='"column"', pct="NULL", count="NULL"):
    fields = ISSUE.format(
        i=issue, ds=dataset, c=column, s=severity, p=f"CAST({pct} AS DOUBLE)", n=f"CAST({count} AS BIGINT)"
    )
    return f"SELECT {fields} FROM {source} WHERE {where}"


def _null_issue(spec, columns):
    return [
        _issue_sql(
            "null_violation",
            f"(SELECT count(*) AS n, count(*) - count({c}) AS bad FROM {spec.name})",
            "bad > 0",
            "'HIGH'",
            f"'{spec.name}'",
            f"'{c}'",
            "round(bad / n * 100, 2)",
            "bad",
        )
        for c in columns
        if c not in spec.nullable
    ]


def _gps_issue(spec, column, bound):
    source = f"(SELECT count(*) FILTER (WHERE abs({column}) > {bound}) AS bad FROM {spec.name})"
    return _issue_sql("gps_invalid_bounds", source, "bad > 0", "'HIGH'", f"'{spec.name}'", f"'{column}'", "NULL", "bad")


CUSTOMERS, ORDERS = SPECS
VALIDATION_ISSUES = union_sql(
    _null_issue(ORDERS, ORDER_COLUMNS)
    + [
        _gps_issue(ORDERS, "drop_lat", 90), _gps_issue(ORDERS, "drop_lon", 180),
        _gps_issue(CUSTOMERS, "lat", 90), _gps_issue(CUSTOMERS, "lon", 180),
        _issue_sql("schema_missing_columns", "(SELECT 1)", "true", "'CRITICAL'", "'dirty_orders'", "NULL", "NULL", "1"),
        _issue_sql("schema_extra_columns", "(SELECT 1)", "true", "'LOW'", "'dirty_orders'", "NULL", "NULL", "1"),
        _issue_sql(
            "duplicate_rows",
            f"(SELECT sum(n - 1) AS bad FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {', '.join(ORDER_COLUMNS)}))",
            "bad > 0", "'HIGH'", "'dirty_orders'", "NULL", "NULL", "bad",
        ),
        _issue_sql(
            "foreign_key_orphan",
            "(SELECT count(*) AS bad FROM dirty_orders WHERE customer_id NOT IN (SELECT id FROM customers))",
            "bad > 0", "'MEDIUM'", "'dirty_orders'", "'customer_id'", "NULL", "bad",
        ),
    ]
)


def validation_issues(t):
    return D.issues_from_validation({"dirty_orders": t("dirty_orders"), "customers": t("customers")}, SPECS)


@query("issues_from_validation", DIRTY_BOTH + "\n" + VALIDATION_ISSUES)
def _(t):
    return validation_issues(t)


DIRTY_TYPES = {
    "id": ("bigint", "integer"), "customer_id": ("bigint", "integer"), "order_value": ("double", "float"),
    "order_status": ("string", "string"), "promo_code": ("string", "string"), "order_time": ("string", "string"),
    "drop_lat": ("double", "float"), "drop_lon": ("double", "float"), "order_size": ("bigint", "integer"),
    "delivery_minutes": ("double", "float"), "is_gift": ("string", "string"), "weight": ("string", "string"),
}
DIRTY_PROFILE = f"""dirty_profile AS ({union_sql(
    [_profile_sql("dirty_orders", i, c, *DIRTY_TYPES[c]) for i, c in enumerate(ORDER_COLUMNS)])})"""


def _profile_issue_sql(source: str) -> list[str]:
    beyond = "std > 0 AND (max > mean + 3 * std OR min < mean - 3 * std)"
    return [
        _issue_sql(
            "high_null_rate", source, "null_pct > 5", "CASE WHEN null_pct < 50 THEN 'MEDIUM' ELSE 'HIGH' END",
            pct="null_pct", count="null_count",
        ),
        _issue_sql("negative_value_anomaly", source, f"std > 0 AND min < 0 AND {_m(names.POSITIVE_ONLY)}", "'HIGH'"),
        _issue_sql("outlier_detected", source, beyond, "'MEDIUM'"),
    ]


PROFILE_ISSUES = union_sql(_profile_issue_sql("dirty_profile"))


def dirty_profile(t):
    return P.profile_columns(t("dirty_orders"), "dirty_orders")


@query("issues_from_profile", with_views("dirty_orders") + f",\n{DIRTY_PROFILE}\n{PROFILE_ISSUES}")
def _(t):
    return D.issues_from_profile(dirty_profile(t))


FEATURE_ISSUES = union_sql(
    [
        _issue_sql("pii_column", "advice", "classification = 'pii'", "'HIGH'"),
        _issue_sql(
            "categorical_needs_encoding", "advice", "classification = 'recommended_feature' AND encoding <> 'none'", "'INFO'"
        ),
        _issue_sql(
            "numeric_needs_scaling", "advice", "classification = 'recommended_feature' AND scaling <> 'none'", "'INFO'"
        ),
    ]
)


@query("issues_from_features", WITH_ADVICE + "\n" + FEATURE_ISSUES)
def _(t):
    return D.issues_from_features(A.feature_advice(marked_of(t)[0]))


LEAK_ISSUES = _issue_sql("target_leakage", "leaks", "severity IS NOT NULL", "severity")


@query("issues_from_leakage", WITH_LEAKS + "\n" + LEAK_ISSUES)
def _(t):
    return D.issues_from_leakage(marked_of(t)[2])


DIRTY_TARGETS = """dirty_targets AS (SELECT 'dirty_orders' AS dataset, 'delivery_minutes' AS "column", 'strong' AS tier
    UNION ALL SELECT 'dirty_orders', 'order_value', 'possible')"""
TARGET_ISSUES = _issue_sql(
    "target_contains_nulls",
    "(SELECT p.* FROM dirty_profile p JOIN dirty_targets k ON k.\"column\" = p.\"column\" AND k.tier = 'strong')",
    "null_count > 0",
    "'CRITICAL'",
    pct="null_pct",
    count="null_count",
)


def dirty_targets(t):
    from millrace.operators.rows import literal_table

    rows = [("dirty_orders", "delivery_minutes", "strong"), ("dirty_orders", "order_value", "possible")]
    return literal_table(t.spark, rows, "dataset string,column string,tier string")


@query("issues_from_target", with_views("dirty_orders") + f",\n{DIRTY_PROFILE},\n{DIRTY_TARGETS}\n{TARGET_ISSUES}")
def _(t):
    return D.issues_from_target(dirty_targets(t), dirty_profile(t))


DECIDE_WITH = DIRTY_BOTH + f",\n{DIRTY_PROFILE},\n{DIRTY_TARGETS},\nissues AS ({VALIDATION_ISSUES}\nUNION ALL\n{PROFILE_ISSUES}\nUNION ALL\n{TARGET_ISSUES})"
VERB = (
    "CASE "
    + " ".join(
        f"WHEN issue_type = '{i}' THEN "
        + ("CASE WHEN null_pct > 80 THEN 'DROP' ELSE 'IMPUTE' END" if v == "IMPUTE" else f"'{v}'")
        for i, (v, _) in D.ACTION_RULES.items()
    )
    + " END"
)
SURE = "CASE " + " ".join(f"WHEN issue_type = '{i}' THEN {c}" for i, (_, c) in D.ACTION_RULES.items()) + " END"
RECOMMENDED = f"""recommended AS (SELECT {VERB} AS action, dataset, "column", CAST({SURE} AS DOUBLE) AS confidence, severity AS priority,
    issue_type || ' on ' || dataset || coalesce('.' || "column", '') AS rationale FROM issues WHERE {VERB} IS NOT NULL)"""


def issues_of(t):
    profile = dirty_profile(t)
    return union_all(
        [validation_issues(t), D.issues_from_profile(profile), D.issues_from_target(dirty_targets(t), profile)]
    )


@query("recommend_actions", DECIDE_WITH + f",\n{RECOMMENDED}\nSELECT * FROM recommended")
def _(t):
    return D.recommend_actions(issues_of(t))


SLOTS = union_sql(
    [f"SELECT 'dirty_orders' AS dataset, '{c}' AS \"column\"" for c in ORDER_COLUMNS]
    + ["SELECT 'dirty_orders', NULL"]
)
DEFAULTS = f"""defaults AS (SELECT CASE WHEN s."column" IS NULL THEN 'LEAVE_UNCHANGED' ELSE 'KEEP' END AS action, s.dataset, s."column",
    1.0::DOUBLE AS confidence, 'INFO' AS priority,
    CASE WHEN s."column" IS NULL THEN 'no issue on the table' ELSE 'no issue on the column' END AS rationale
    FROM ({SLOTS}) s WHERE NOT EXISTS (SELECT 1 FROM recommended r WHERE r.dataset = s.dataset
        AND coalesce(r."column", '') = coalesce(s."column", '')))"""


def defaults_of(t, recommended):
    return D.default_actions(recommended, P.schema_registry(dirty_profile(t)))


@query("default_actions", DECIDE_WITH + f",\n{RECOMMENDED},\n{DEFAULTS}\nSELECT * FROM defaults")
def _(t):
    return defaults_of(t, D.recommend_actions(issues_of(t)))


RAISED = "(k.\"column\" IS NOT NULL AND r.priority IN ('HIGH', 'MEDIUM'))"
CALIBRATED = f"""calibrated AS (SELECT r.action, r.dataset, r."column", r.confidence,
    CASE WHEN {RAISED} THEN 'CRITICAL' ELSE r.priority END AS priority,
    CASE WHEN {RAISED} THEN '[target column] ' || r.rationale ELSE r.rationale END AS rationale
    FROM (SELECT * FROM recommended UNION ALL SELECT * FROM defaults) r
    LEFT JOIN dirty_targets k ON k.tier = 'strong' AND k.dataset = r.dataset AND k."column" = r."column")"""
WITH_CALIBRATED = DECIDE_WITH + f",\n{RECOMMENDED},\n{DEFAULTS},\n{CALIBRATED}"


def calibrated_of(t):
    recommended = D.recommend_actions(issues_of(t))
    return D.calibrate_priority(recommended.unionByName(defaults_of(t, recommended)), dirty_targets(t))


@query("calibrate_priority", WITH_CALIBRATED + "\nSELECT * FROM calibrated")
def _(t):
    return calibrated_of(t)


URGENCY = "CASE priority WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END"


@query(
    "approval_manifest",
    WITH_CALIBRATED
    + f"""\nSELECT printf('DEC-%03d', row_number() OVER (ORDER BY {URGENCY}, confidence DESC, dataset, coalesce("column", ''), action, rationale))
       AS decision_id, dataset, "column", action, priority, confidence, rationale, 'PENDING_APPROVAL' AS status FROM calibrated""",
)
def _(t):
    return D.approval_manifest(calibrated_of(t))


ORDER_OF = (
    "CASE action WHEN 'REMOVE_DUPLICATES' THEN 1 WHEN 'IMPUTE' THEN 2 WHEN 'FIX_GPS' THEN 5 WHEN 'REPAIR_FOREIGN_KEY' THEN 6 "
    "WHEN 'REMOVE_OUTLIERS' THEN 8 WHEN 'KEEP' THEN 10 WHEN 'LEAVE_UNCHANGED' THEN 10 END"
)


@query(
    "action_order",
    WITH_CALIBRATED
    + f""",\nmanifest AS (SELECT printf('DEC-%03d', row_number() OVER (ORDER BY {URGENCY}, confidence DESC, dataset,
       coalesce("column", ''), action, rationale)) AS decision_id, * FROM calibrated)
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY {ORDER_OF}, decision_id) AS step, decision_id, "column",
       action AS verb, {ORDER_OF} AS place FROM manifest WHERE {ORDER_OF} IS NOT NULL""",
)
def _(t):
    return action_order(D.approval_manifest(calibrated_of(t)), force_approve_all=True)


@query(
    "manifest_read",
    WITH_CALIBRATED
    + """\nSELECT dataset, "column", action, priority, confidence, rationale, 'PENDING_APPROVAL' AS status FROM calibrated""",
)
def _(t):
    # A manifest is one document: a few decisions per column of the schema.
    manifest = D.approval_manifest(calibrated_of(t)).withColumnRenamed("dataset", "dataset_id")
    path = f"{scratch(t)}/manifest"
    document = manifest.agg(F.collect_list(F.struct(*manifest.columns)).alias("manifest"))
    sink_report(document, path)
    return manifest_read(t.spark, path).drop("decision_id", "details")


@query(
    "decision_summary",
    WITH_CALIBRATED
    + "\n"
    + union_sql(
        [
            f"SELECT '{k}' AS kind, {c} AS name, count(*) AS decisions, round(avg(confidence), 10) AS mean_confidence "
            f"FROM calibrated GROUP BY ALL"
            for k, c in (("priority", "priority"), ("action", "action"), ("total", "'all'"))
        ]
    ),
)
def _(t):
    return D.decision_summary(calibrated_of(t))


IMPACT_WITH = (
    with_views("dirty_orders", "customers", *STAR)
    + f",\n{FK_ROLES},\n{TARGETS},\n{LEAKS},\n{ANNOTATED},\n{ADVICE},\n{DIRTY_PROFILE},\n{DIRTY_TARGETS},"
    + f"\nissues AS ({VALIDATION_ISSUES}\nUNION ALL\n{PROFILE_ISSUES}\nUNION ALL\n{TARGET_ISSUES}),\n{RECOMMENDED}"
)


@query(
    "impact_estimate",
    IMPACT_WITH
    + f""",\ncats AS ({CATEGORY_SQL}),
base AS (SELECT {", ".join(f"(SELECT average FROM cats WHERE category = '{c}') AS {c}" for c in ("nulls", "duplicates", "schema", "foreign_key", "gps"))},
    (SELECT round(sum(average * weight) / sum(weight), 2) FROM cats) AS quality,
    greatest(10, 100 - 15 * (SELECT count(*) FROM leaks WHERE severity IS NOT NULL)
        - 20 * (SELECT count(*) FROM advice WHERE classification = 'pii')) AS reliability,
    (SELECT bool_or(action = 'IMPUTE') FROM recommended) AS imp, (SELECT bool_or(action = 'DROP') FROM recommended) AS drp,
    (SELECT bool_or(action = 'REMOVE_DUPLICATES') FROM recommended) AS dup,
    (SELECT bool_or(action = 'REMOVE_OUTLIERS') FROM recommended) AS outl),
after AS (SELECT *, CASE WHEN imp OR drp THEN 100 ELSE nulls END AS c1,
    CASE WHEN dup AND drp THEN 100 WHEN dup THEN greatest(99, duplicates) ELSE (duplicates + schema) / 2 END AS k1,
    CASE WHEN outl THEN 100 ELSE least(foreign_key, gps) END AS i1, CASE WHEN drp THEN 100 ELSE reliability END AS r1 FROM base),
final AS (SELECT *, CASE WHEN round((c1 + k1 + i1 + r1) / 4, 2) > 98 THEN 98.5 ELSE round((c1 + k1 + i1 + r1) / 4, 2) END AS q1 FROM after)
"""
    + union_sql(
        [
            f"SELECT '{n}' AS dimension, CAST(round({b}, 2) AS DOUBLE) AS baseline, CAST(round({a}, 2) AS DOUBLE) AS target, "
            f"CAST(round({a} - {b}, 2) AS DOUBLE) AS delta FROM final"
            for n, b, a in (
                ("data_quality", "quality", "q1"),
                ("completeness", "nulls", "c1"),
                ("consistency", "least(duplicates, schema)", "k1"),
                ("integrity", "least(foreign_key, gps)", "i1"),
                ("model_reliability", "reliability", "r1"),
            )
        ]
    ),
)
def _(t):
    marked, _, leaks = marked_of(t)
    results = suite(t)
    return D.impact_estimate(
        S.category_scores(results),
        S.quality_score(results),
        leaks,
        A.feature_advice(marked),
        D.recommend_actions(issues_of(t)),
    )
