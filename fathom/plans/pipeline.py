"""A multi-model pipeline: vector, graph, relational and temporal stages joined into one DataFrame plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.errors import require

#: Names a trace may hold, in the order stages run.
STAGES = ("vector", "graph", "relational", "temporal", "join", "order", "limit", "project")


@dataclass(frozen=True)
class Join:
    """INNER or LEFT join of the stage ``alias`` where ``left`` = ``right``; both are alias.column."""

    kind: str
    alias: str
    left: str
    right: str


@dataclass
class Pipeline:
    stages: Mapping[str, DataFrame]
    joins: Sequence[Join]
    returning: Sequence[str]
    limit: int
    order: tuple[str, str] | None = None
    trace: list[str] = field(default_factory=list)


def with_ref(rows: DataFrame, namespace: str, id_col: str = "id") -> DataFrame:
    """Add record_ref, the typed key that joins a model's rows to others."""
    ref = F.struct(F.lit(namespace).alias("namespace"), F.col(id_col).cast("string").alias("id"))
    return rows.withColumn("record_ref", F.when(F.col(id_col).isNotNull(), ref))


def qualified(rows: DataFrame, alias: str) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in rows.columns])


def _column(name: str):
    return F.col(f"`{name}`")


def run(p: Pipeline) -> DataFrame:
    """Joins in the order given, each stage once, each linked to an earlier one; nulls never match; key types must be
    equal. ORDER BY puts null after everything ascending and first descending; ties go by the returned columns.
    Returned fields of one name are told apart as alias.field. The limit is required."""
    require(isinstance(p.limit, int) and p.limit > 0, "pipeline.limit_required", "a pipeline needs a positive limit")
    require(len(p.joins) >= 1, "pipeline.join_required", "a pipeline joins its stages")
    require(bool(p.returning), "pipeline.return_required", "a pipeline returns fields")
    names = list(p.stages)
    first = next((n for n in names if n not in {j.alias for j in p.joins}), None)
    require(first is not None, "pipeline.no_root", "one stage must not be joined")
    joined, out = {first}, qualified(p.stages[first], first)
    for j in p.joins:
        require(j.kind in ("inner", "left"), "pipeline.join_kind", "joins are INNER or LEFT")
        require(j.alias in p.stages and j.alias not in joined, "pipeline.join_stage", f"{j.alias} is unknown or joined twice")
        sides = {j.left.split(".", 1)[0], j.right.split(".", 1)[0]}
        require(j.alias in sides and len(sides & joined) == 1, "pipeline.join_keys", "a join links its stage with an earlier one")
        mine, other = (j.left, j.right) if j.left.split(".", 1)[0] == j.alias else (j.right, j.left)
        right = qualified(p.stages[j.alias], j.alias)
        require(mine in right.columns and other in out.columns, "pipeline.unknown_field", f"{mine} or {other}")
        require(_plain(right.schema[mine].dataType) == _plain(out.schema[other].dataType), "pipeline.key_type", f"{other} and {mine} differ in type")
        out = out.join(right, out[f"`{other}`"] == right[f"`{mine}`"], j.kind)
        joined.add(j.alias)
    require(joined == set(names), "pipeline.unjoined", f"not joined: {sorted(set(names) - joined)}")
    for f in p.returning:
        require(f in out.columns, "pipeline.unknown_field", f)
    if p.order:
        by, way = p.order
        require(by in out.columns and way in ("asc", "desc"), "pipeline.order", by)
        c = _column(by)
        ties = [_column(f).asc_nulls_last() for f in p.returning]
        out = out.orderBy(c.asc_nulls_last() if way == "asc" else c.desc_nulls_first(), *ties)
    short = [f.split(".", 1)[1] for f in p.returning]
    return out.limit(p.limit).select(*[_column(f).alias(f if short.count(s) > 1 else s) for f, s in zip(p.returning, short, strict=True)])


def _plain(kind) -> str:
    """The type without nullability."""
    return kind.simpleString()
