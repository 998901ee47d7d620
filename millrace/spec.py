"""Declared roles of a table's columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnSpec:
    """Expected column: logical type is integer, float, string, boolean or datetime."""

    name: str
    dtype: str = "string"
    required: bool = True
    nullable: bool = True


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableSpec:
    """Roles used by the checks and the cleaning plan; no column name is built in."""

    name: str
    id_column: str | None = None
    columns: tuple[ColumnSpec, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    latitude: tuple[str, ...] = ()
    longitude: tuple[str, ...] = ()
    timestamps: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    target_range: tuple[float, float] = field(default=(0.0, 1440.0))

    @property
    def required_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.required]

    @property
    def non_nullable(self) -> list[str]:
        return [c.name for c in self.columns if not c.nullable]

    @property
    def nullable(self) -> list[str]:
        return [c.name for c in self.columns if c.nullable]
