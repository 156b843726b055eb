"""Tenancy and row or column authority: filters that apply before any score, statistic or join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.errors import require


def tenant_scope(rows: DataFrame, tenant: str | None, *, mode: str = "enforced", column: str = "tenant_id") -> DataFrame:
    """Rows of the tenant. ``disabled`` and ``dry-run`` give all rows; enforced without a tenant is an error."""
    require(mode in ("disabled", "dry-run", "enforced"), "invalid_tenant_mode", mode)
    if mode != "enforced":
        return rows
    require(bool(tenant), "tenant_required", "a tenant is needed")
    return rows.where(F.col(column) == tenant)


@dataclass(frozen=True)
class Authority:
    """What a role may see: rows for which ``rows`` is TRUE, and only ``columns`` (None: all)."""

    rows: Column | None = None
    columns: tuple[str, ...] | None = None

    def view(self, df: DataFrame) -> DataFrame:
        out = df if self.rows is None else df.where(self.rows)
        return out if self.columns is None else out.select(*[c for c in df.columns if c in self.columns])

    def require_columns(self, names: Sequence[str]) -> None:
        hidden = [] if self.columns is None else [n for n in names if n not in self.columns]
        require(not hidden, "column_forbidden", f"not allowed: {hidden}")
