"""Changes as DataFrames: inserts with constraints, conflicts, updates, deletes, foreign keys, altered tables.

Each function takes a table and gives the changed table, so publishing is a separate step (``plans.store``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.constants import GRAPH_DEPTH
from fathom.errors import require


@dataclass
class Constraints:
    """What a table's rows must meet. Checks are SQL conditions; only FALSE breaks one."""

    primary_key: tuple[str, ...] = ()
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    vectors: dict[str, int] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)  # column to namespace


@dataclass
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "no action"
    on_update: str = "no action"
    match: str = "simple"
    deferrable: bool = False
    deferred: bool = False


def verify(rows: DataFrame, c: Constraints) -> None:
    """Refuse rows that break a constraint; the code is the SQLSTATE."""
    for name in dict.fromkeys([*c.primary_key, *c.not_null]):
        require(rows.where(F.col(name).isNull()).isEmpty(), "23502", f"{name} is null")
    for name, condition in c.checks.items():
        require(rows.where(~F.expr(condition)).isEmpty(), "23514", f"check {name} fails")
    for name, most in c.lengths.items():
        require(rows.where(F.length(name) > most).isEmpty(), "22001", f"{name} is longer than {most}")
    for name, size in c.vectors.items():
        require(rows.where(F.size(name) != size).isEmpty(), "22000", f"{name} must have {size} dimensions")
    for name, space in c.references.items():
        require(rows.where(F.col(name)["namespace"] != space).isEmpty(), "23503", f"{name} must refer to {space}")
    for name, columns in {**({"primary key": c.primary_key} if c.primary_key else {}), **c.unique}.items():
        whole = rows.where(" and ".join(f"`{x}` is not null" for x in columns))  # a null is equal to nothing
        require(whole.groupBy(*columns).count().where("count > 1").isEmpty(), "23505", f"duplicate key for {name}")


def insert(target: DataFrame, rows: DataFrame, constraints: Constraints | None = None) -> DataFrame:
    out = target.unionByName(rows.select(*target.columns))
    verify(out, constraints or Constraints())
    return out


def on_conflict(target: DataFrame, rows: DataFrame, key: Sequence[str], set_: Mapping[str, str] | None = None, condition: str | None = None) -> DataFrame:
    """ON CONFLICT (key) DO NOTHING, or DO UPDATE SET ... [WHERE ...]; expressions see the table's columns and
    ``excluded.column``. Of proposed rows with one key, DO NOTHING takes one; DO UPDATE refuses them. Null keys
    never conflict."""
    names = target.columns
    proposed = rows.select(F.struct(*names).alias("excluded"))
    for k in key:
        proposed = proposed.withColumn(f"_k_{k}", F.col(f"excluded.{k}"))
    keys = [f"_k_{k}" for k in key]
    if set_ is None:
        proposed = proposed.dropDuplicates(keys)
    else:
        again = proposed.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).count().where("count > 1")
        require(again.isEmpty(), "21000", "the statement would change a row twice")
    old = target.withColumns({f"_t_{k}": F.col(k) for k in key})
    on = [old[f"_t_{k}"] == proposed[f"_k_{k}"] for k in key]
    both = old.withColumn("_old", F.lit(True)).join(proposed, on, "full_outer")
    hit = F.col("_old") & F.col("excluded").isNotNull()
    change = hit & (F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)) if set_ is not None else F.lit(False)
    out = []
    for n in names:
        new = F.expr(set_[n]).cast(target.schema[n].dataType) if set_ and n in set_ else F.col(n)
        out.append(F.when(F.col("_old").isNull(), F.col(f"excluded.{n}")).when(F.coalesce(change, F.lit(False)), new).otherwise(F.col(n)).alias(n))
    return both.select(*out)


def update(target: DataFrame, set_: Mapping[str, str | Column], condition: str | Column | None = None, constraints: Constraints | None = None) -> DataFrame:
    """UPDATE ... SET ... WHERE: rows for which the condition is TRUE; all expressions see the row as it was."""
    hit = _true(condition)
    new = {n: F.when(hit, (F.expr(e) if isinstance(e, str) else e).cast(target.schema[n].dataType)).otherwise(F.col(n)) for n, e in set_.items()}
    out = target.select(*[new[n].alias(n) if n in new else F.col(n) for n in target.columns])
    verify(out, constraints or Constraints())
    return out


def delete(target: DataFrame, condition: str | Column | None = None) -> DataFrame:
    return target.where(~_true(condition))


def affected(target: DataFrame, condition: str | Column | None = None) -> DataFrame:
    """The rows that a change touches, for RETURNING and counts."""
    return target.where(_true(condition))


def _true(condition: str | Column | None) -> Column:
    if condition is None:
        return F.lit(True)
    return F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))


def broken_references(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows without a parent. SIMPLE: a null anywhere passes; FULL: all null passes, some null is broken."""
    null = [F.col(c).isNull() for c in fk.columns]
    any_null, all_null = null[0], null[0]
    for x in null[1:]:
        any_null, all_null = any_null | x, all_null & x
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(fk.parent_columns)])
    alone = child.where(~any_null).join(keys, [child[c] == keys[f"_p{i}"] for i, c in enumerate(fk.columns)], "left_anti")
    return alone.unionByName(child.where(any_null & ~all_null)) if fk.match == "full" else alone


def delete_rows(tables: Mapping[str, DataFrame], keys: Mapping[str, list[ForeignKey]], name: str, condition: str | Column, defaults: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, DataFrame]:
    """DELETE with foreign keys: ``keys`` are each child table's. Cascades run breadth first until nothing changes;
    RESTRICT is checked at once, NO ACTION on the outcome."""
    out, waiting = dict(tables), [(name, tables[name].where(_true(condition)))]
    out[name] = delete(tables[name], condition)
    for _ in range(GRAPH_DEPTH):
        after: list[tuple[str, DataFrame]] = []
        for parent, gone in waiting:
            for child, fks in keys.items():
                for fk in fks:
                    if fk.parent != parent:
                        continue
                    rows = out[child]
                    lost = gone.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(fk.parent_columns)]).distinct()
                    on = [rows[c] == lost[f"_p{i}"] for i, c in enumerate(fk.columns)]
                    hit = rows.join(lost, on, "left_semi")
                    if fk.on_delete == "restrict":
                        require(hit.isEmpty(), "23503", f"{fk.name} restricts the delete")
                    elif fk.on_delete == "cascade":
                        after.append((child, hit))
                        out[child] = rows.join(lost, on, "left_anti")
                    elif fk.on_delete in ("set null", "set default"):
                        given = (defaults or {}).get(child, {})
                        value = {c: F.expr(given.get(c, "null")) if fk.on_delete == "set default" else F.lit(None) for c in fk.columns}
                        changed = hit.select(*[value[c].cast(rows.schema[c].dataType).alias(c) if c in value else F.col(c) for c in rows.columns])
                        out[child] = rows.join(lost, on, "left_anti").unionByName(changed)
        waiting = [(n, g) for n, g in after if not g.isEmpty()]
        if not waiting:
            break
    for child, fks in keys.items():
        for fk in fks:
            if not fk.deferred:
                require(broken_references(out[child], out[fk.parent], fk).isEmpty(), "23503", f"{fk.name} is violated")
    return out


# --- altered tables -------------------------------------------------------------------------------------------------

#: Types that may be turned into each other.
FAMILIES = (("smallint", "int", "bigint"), ("float", "double"), ("string", "varchar"))


def add_column(df: DataFrame, name: str, kind: str, default: str | None = None) -> DataFrame:
    require(name not in df.columns, "42701", f"column {name} exists")
    return df.withColumn(name, F.expr(default or "null").cast(kind))


def drop_column(df: DataFrame, name: str, constraints: Constraints | None = None, cascade: bool = False) -> DataFrame:
    require(name in df.columns, "42703", f"no column {name}")
    c = constraints or Constraints()
    used = name in c.primary_key or any(name in u for u in c.unique.values()) or any(name in x for x in c.checks.values())
    require(cascade or not used, "2BP01", f"a constraint depends on {name}")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(old in df.columns, "42703", f"no column {old}")
    require(new not in df.columns, "42701", f"column {new} exists")
    return df.withColumnRenamed(old, new)


def family(kind: str) -> tuple[str, ...]:
    kind = kind.lower().split("(")[0]
    return next((f for f in FAMILIES if kind in f), (kind,))


def alter_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Within a family only; a value out of the new type's range is an error under ANSI rules."""
    require(kind.lower().split("(")[0] in family(df.schema[name].dataType.simpleString()), "42846", f"{name} can't become {kind}")
    return df.withColumn(name, F.col(name).cast(kind))


# --- points ---------------------------------------------------------------------------------------------------------


def live(log: DataFrame) -> DataFrame:
    """The current points of a change log (id, version, deleted, ...): the last version of each id, unless deleted.
    One partial aggregate over whole rows; no window."""
    rest = [c for c in log.columns if c not in ("id", "version")]
    last = log.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("row"))
    return last.where(~F.col("row.deleted")).select("id", *[F.col(f"row.{c}").alias(c) for c in rest if c != "deleted"])


def upsert_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins by id: ``new`` replaces whole points. Repeated ids in ``new`` must agree on a ``_seq`` column, or
    be distinct."""
    if "_seq" in new.columns:
        rest = [c for c in new.columns if c not in ("id", "_seq")]
        new = new.groupBy("id").agg(F.max_by(F.struct(*rest), "_seq").alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
    return points.join(new.select("id"), "id", "left_anti").unionByName(new.select(*points.columns))


def merge_payload(old: Column, new: Column, replace: bool = False) -> Column:
    """Payload maps: the new map's keys win; or it replaces all."""
    if replace:
        return new
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def zero_vectors(points: DataFrame, vector: str = "vector") -> DataFrame:
    """Points without a usable vector: null, empty or all zero."""
    return points.where(F.coalesce(~F.exists(vector, lambda x: x != 0), F.lit(True)))


def update_rows(tables: Mapping[str, DataFrame], keys: Mapping[str, list[ForeignKey]], name: str, set_: Mapping[str, str], condition: str | None = None, defaults: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, DataFrame]:
    """UPDATE with foreign keys: where referenced columns change, children follow by ON UPDATE (one level: a
    child whose own key is referenced again is checked on the outcome)."""
    out = dict(tables)
    out[name] = update(tables[name], set_, condition)
    waiting = [(name, tables[name].where(_true(condition)), dict(set_))]
    for parent, old, change in waiting:
        for child, fks in keys.items():
            for fk in fks:
                if fk.parent != parent or not set(fk.parent_columns) & set(change):
                    continue
                moved = old.select(
                    *[F.col(p).alias(f"_o{i}") for i, p in enumerate(fk.parent_columns)],
                    *[(F.expr(change[p]).cast(old.schema[p].dataType) if p in change else F.col(p)).alias(f"_n{i}") for i, p in enumerate(fk.parent_columns)],
                ).where(" or ".join(f"not (_o{i} <=> _n{i})" for i in range(len(fk.columns)))).distinct()
                rows = out[child]
                on = [rows[c] == moved[f"_o{i}"] for i, c in enumerate(fk.columns)]
                hit = rows.join(moved, on)
                if fk.on_update == "restrict":
                    require(hit.isEmpty(), "23503", f"{fk.name} restricts the update")
                elif fk.on_update in ("cascade", "set null", "set default"):
                    given = (defaults or {}).get(child, {})
                    new = {c: F.col(f"_n{i}") if fk.on_update == "cascade" else F.expr(given.get(c, "null")) if fk.on_update == "set default" else F.lit(None) for i, c in enumerate(fk.columns)}
                    changed = hit.select(*[new[c].cast(rows.schema[c].dataType).alias(c) if c in new else F.col(c) for c in rows.columns])
                    out[child] = rows.join(moved, on, "left_anti").unionByName(changed)
    for child, fks in keys.items():
        for fk in fks:
            if not fk.deferred and name in (child, fk.parent):
                require(broken_references(out[child], out[fk.parent], fk).isEmpty(), "23503", f"{fk.name} is violated")
    return out
