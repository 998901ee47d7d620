"""Applying an approved cleaning manifest to related tables."""

from __future__ import annotations

import re
from contextlib import suppress
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import names
from millrace.functions import types as ty
from millrace.functions import values as V
from millrace.operators import clean
from millrace.session import durable_checkpoint
from millrace.spec import TableSpec

# Position of every supported verb in the cleaning order.
ACTION_ORDER = {
    "REMOVE_DUPLICATES": 1,
    "IMPUTE": 2,
    "FIX_DATATYPE": 3,
    "STANDARDIZE_TIMESTAMP": 4,
    "FIX_GPS": 5,
    "REPAIR_FOREIGN_KEY": 6,
    "TRIM_WHITESPACE": 7,
    "FORMAT_STRING": 8,
    "REMOVE_OUTLIERS": 8,
    "KEEP": 10,
    "LEAVE_UNCHANGED": 10,
}
FLAG_DEFAULT = 7
FLAG_ROUTES = [
    (r"(time|date)", "STANDARDIZE_TIMESTAMP", 4),
    (r"(lat|lon)", "FIX_GPS", 5),
    (r"id", "FLAG_FOREIGN_KEY", 6),
]
AUDIT_SCHEMA = (
    "step int, dataset string, column string, action string, status string, "
    "records_before bigint, records_after bigint, error string"
)


def read_decisions(manifest: DataFrame, force_approve_all: bool = False) -> DataFrame:
    """Approved decisions with their place in the order.

    Unsupported verbs (DROP, scaling, encoding) are filtered out. A FLAG goes
    to the operator its column name suggests.
    """
    action, column = F.upper("action"), F.lower("column")
    order, verb = F, F
    for name, place in ACTION_ORDER.items():
        order, verb = order.when(action == name, place), verb.when(action == name, name)
    is_flag = (action == "FLAG") & F.col("column").isNotNull()
    for pattern, route, place in FLAG_ROUTES:
        order, verb = (
            order.when(is_flag & column.rlike(pattern), place),
            verb.when(is_flag & column.rlike(pattern), route),
        )
    order, verb = order.when(action == "FLAG", FLAG_DEFAULT), verb.when(action == "FLAG", "KEEP")
    approved = F.lit(True) if force_approve_all else F.col("status") == "APPROVED"
    details = F.col("details") if "details" in manifest.columns else F.lit(None).cast("map<string,string>")
    return (
        manifest.where(approved)
        .select("decision_id", "dataset", "column", verb.alias("verb"), order.alias("place"), details.alias("details"))
        .where("verb IS NOT NULL")
    )


def action_order(manifest: DataFrame, force_approve_all: bool = False) -> DataFrame:
    """Decisions numbered in execution order; stable within the same place.

    A manifest has a few rows per column, so one window numbers each table's.
    """
    by_table = Window.partitionBy("dataset").orderBy("place", "decision_id")
    decisions = read_decisions(manifest, force_approve_all)
    return decisions.select(
        "dataset", F.row_number().over(by_table).alias("step"), "decision_id", "column", "verb", "place"
    )


@dataclass
class CleaningResult:
    """Cleaned tables and one audit row per action."""

    tables: dict[str, DataFrame]
    audit: list[tuple] = field(default_factory=list)

    def audit_trail(self, spark) -> DataFrame:
        return spark.createDataFrame(self.audit, AUDIT_SCHEMA)


def _timestamp_columns(df: DataFrame, spec: TableSpec) -> list[str]:
    named = [c for c in df.columns if re.search(names.TIMESTAMP_TO_CLEAN, c.lower())]
    return [c for c in spec.timestamps if c in df.columns] + [c for c in named if c not in spec.timestamps]


def _steps(decisions: list, df: DataFrame, spec: TableSpec) -> list[tuple[str, str | None, dict]]:
    """Ordered (verb, column, details) of one table, timestamp repair included."""
    stamps = _timestamp_columns(df, spec)
    kept = [d for d in decisions if not (d["column"] in stamps and d["verb"] in ("KEEP", "LEAVE_UNCHANGED"))]
    chosen = [(d["place"], d["verb"], d["column"], d["details"] or {}) for d in kept]
    present = {c for _, verb, c, _ in chosen if verb == "STANDARDIZE_TIMESTAMP"}
    chosen += [(4, "STANDARDIZE_TIMESTAMP", c, {}) for c in stamps if c not in present]
    return [(verb, column, details) for _, verb, column, details in sorted(chosen, key=lambda s: s[0])]


def _axis(column: str, spec: TableSpec) -> str:
    if column in spec.longitude:
        return "longitude"
    if column in spec.latitude:
        return "latitude"
    return "longitude" if re.search(r"(lon|lng)", column.lower()) else "latitude"


class _TableRun:
    """Folds actions over one table and notes row counts where they can change.

    Statistics are read back as single rows and enter the plan as literals, so
    the plan stays one scan with filters. The table is cut to the checkpoint
    folder after a shuffle (duplicates, foreign keys) when more statistics
    follow, and once at the end.
    """

    def __init__(self, name: str, df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]):
        self.name, self.df, self.spec, self.parents = name, df, spec, parents
        self.rows = df.count()
        self.notes: list[list] = []
        self.fills: dict = {}

    def _count(self) -> int:
        return self.df.count()

    def step(self, verb: str, column: str | None, details: dict) -> None:
        before, after, status, error = self.rows, self.rows, "SUCCESS", None
        if column is not None and column not in self.df.columns:
            status, error = "FAILED", f"no column {column}"
        elif missing := self._missing(verb, column):
            status, error = "FAILED", missing
        else:
            held = self.df
            try:
                after = self._apply(verb, column, details)
            except Exception as reason:  # the audit names it, and the other actions go on
                self.df, after, status = held, before, "FAILED"
                error = f"{type(reason).__name__}: {str(reason).splitlines()[0][:200]}"
        self.rows = after
        self.notes.append([self.name, column, verb, status, before, after, error])

    def _missing(self, verb: str, column: str | None) -> str | None:
        """What an action lacks to be carried out."""
        if column is None and verb != "REMOVE_DUPLICATES":
            return "no column given"
        if verb in ("REPAIR_FOREIGN_KEY", "FLAG_FOREIGN_KEY"):
            fk = next((k for k in self.spec.foreign_keys if k.column == column), None)
            if fk is None:
                return f"{column} is no declared foreign key"
            if fk.parent not in self.parents:
                return f"no table {fk.parent}"
        return None

    def gather_fills(self, columns: list[str]) -> None:
        """Values for neighbouring imputations, which do not depend on each other, from one set of scans."""
        self.fills = {}
        present = list(dict.fromkeys(c for c in columns if c in self.df.columns))
        if len(present) > 1:
            with suppress(Exception):  # each is then tried, and failed, on its own
                row = clean.fill_values(self.df, present).first().asDict()
                self.fills = {c: row[f"fill_{c}"] for c in present}

    def _apply(self, verb: str, column: str | None, details: dict) -> int:
        df = self.df
        if verb == "REMOVE_DUPLICATES":
            key = [column] if column else None
            self.df = durable_checkpoint(clean.drop_duplicates(df, key, list(self.spec.timestamps)))
            return self._count()
        if verb == "IMPUTE" and column:
            value = self.fills.pop(column) if column in self.fills else clean.fill_values(df, [column]).first()[0]
            self.df = clean.apply_fill(df, column, value)
        elif verb == "FIX_DATATYPE" and column:
            self.df = clean.fix_datatype(df, column, details.get("target_dtype", "string"))
        elif verb == "STANDARDIZE_TIMESTAMP" and column:
            self.df = clean.standardize_timestamp(df, column)
        elif verb == "FIX_GPS" and column:
            self.df = clean.gps_nullify(df, column, _axis(column, self.spec))
        elif verb in ("REPAIR_FOREIGN_KEY", "FLAG_FOREIGN_KEY") and column:
            return self._foreign_key(verb, column)
        elif verb == "TRIM_WHITESPACE" and column:
            self.df = clean.trim_whitespace(df, column)
        elif verb == "FORMAT_STRING" and column:
            self.df = clean.format_string(df, column)
        elif verb == "REMOVE_OUTLIERS" and column and not clean.is_identifier_name(column):
            mean, std, _ = clean.moments(df, column).first()
            number = V.to_number(F.col(column), ty.dtype_of(df, column))
            literal = lambda v: F.lit(v).cast("double")
            keep = clean.outlier_condition(number, literal(mean), literal(std), clean.is_positive_only(column))
            self.df = df.where(keep)
            return self._count()
        return self.rows

    def _foreign_key(self, verb: str, column: str) -> int:
        fk = next((k for k in self.spec.foreign_keys if k.column == column), None)
        parent = self.parents.get(fk.parent) if fk else None
        if parent is None:
            return self.rows
        if verb == "FLAG_FOREIGN_KEY":
            self.df = clean.fk_flag(self.df, column, parent, fk.parent_column)
            return self.rows
        self.df = durable_checkpoint(clean.fk_repair(self.df, column, parent, fk.parent_column))
        return self._count()


def clean_tables(
    tables: dict[str, DataFrame],
    specs: list[TableSpec],
    manifest: DataFrame,
    force_approve_all: bool = False,
    drop_disables_repair: bool = True,
) -> CleaningResult:
    """Run the approved actions table by table, parents before children.

    Foreign keys without an action of their own are repaired against the
    cleaned parents. An approved DROP of a foreign key is unsupported here and,
    with ``drop_disables_repair``, also switches that automatic repair off.
    """
    # The manifest has a few rows per column of the schema.
    raw = manifest.select("dataset", "column", F.upper("action").alias("action"), "status").collect()
    decisions = read_decisions(manifest, force_approve_all).orderBy("place", "decision_id").collect()
    listed = {r["dataset"] for r in raw} or set(tables)
    off_verbs = {"REPAIR_FOREIGN_KEY", "DROP"} if drop_disables_repair else {"REPAIR_FOREIGN_KEY"}
    handled = {
        (r["dataset"], r["column"])
        for r in raw
        if (force_approve_all or r["status"] == "APPROVED") and r["action"] in off_verbs
    }
    result = CleaningResult(tables={})
    if not decisions:
        result.tables = {s.name: tables[s.name] for s in specs if s.name in listed and s.name in tables}
        return result
    for spec in specs:
        if spec.name not in listed or spec.name not in tables:
            continue
        parents = {**tables, **result.tables}
        run = _TableRun(spec.name, tables[spec.name], spec, parents)
        mine = [d for d in decisions if d["dataset"] == spec.name]
        steps = [s for s in _steps(mine, run.df, spec) if s[0] not in ("KEEP", "LEAVE_UNCHANGED")]
        for verb, group in groupby(steps, key=lambda s: s[0]):
            group = list(group)
            if verb == "IMPUTE":
                run.gather_fills([column for _, column, _ in group])
            for _, column, details in group:
                run.step(verb, column, details)
        for fk in spec.foreign_keys:
            if fk.column in run.df.columns and (spec.name, fk.column) not in handled:
                run.step("REPAIR_FOREIGN_KEY", fk.column, {})
        result.tables[spec.name] = durable_checkpoint(run.df)
        start = len(result.audit)
        result.audit += [
            (start + i + 1, name, column, verb, status, before, after, error)
            for i, (name, column, verb, status, before, after, error) in enumerate(run.notes)
        ]
    return result
