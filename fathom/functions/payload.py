"""Payload filters: a JSON object of conditions becomes one column over a VARIANT payload, or over promoted columns.

A field's values are found by its literal key, else by its dotted path; arrays on the way are flattened. A field
matches if one of its values satisfies all of the field's operators; a missing field matches nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.constants import FILTER_DEPTH, FILTER_FIELD, FILTER_ITEMS, FILTER_NODES
from fathom.errors import require
from fathom.functions.tokens import tokens, words

NUMERIC = ("gt", "gte", "lt", "lte")


def checked(given, depth: int = 1) -> int:
    """Nodes of the filter; refuses filters beyond the limits."""
    require(depth <= FILTER_DEPTH, "invalid_filter", "filter is too deep")
    nodes = 1
    if isinstance(given, dict):
        for key, value in given.items():
            require(len(str(key).encode()) <= FILTER_FIELD, "invalid_filter", "field name is too long")
            nodes += checked(value, depth + 1)
    elif isinstance(given, list):
        require(len(given) <= FILTER_ITEMS, "invalid_filter", "too many items")
        nodes += sum(checked(v, depth + 1) for v in given)
    require(nodes <= FILTER_NODES, "invalid_filter", "filter has too many nodes")
    return nodes


def _step(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _get(value: Column, key: str) -> Column:
    return F.try_variant_get(value, _step(key), "variant")


def once(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once a row: the optimizer copies a column's expression, a payload's parsing
    among them, to each place that names it, but never into a lambda's argument."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _elements(value: Column) -> Column:
    none = F.array().cast("array<variant>")
    return F.when(value.isNull(), none).when(
        F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    ).otherwise(F.array(value))


def _flat(value: Column) -> Column:
    """The value's elements if it is an array, itself if it is not, nothing if it is missing."""
    return once(value, _elements)


def _into(part: str):
    return lambda x: _flat(_get(x, part))


def values(payload: Column, field: str) -> Column:
    parts = [p.removesuffix("[]") for p in field.split(".")]
    found = F.array(payload)
    for part in parts:
        found = F.flatten(F.transform(found, _into(part)))
    if len(parts) == 1 and parts[0] == field:
        return found
    return once(_get(payload, field), lambda plain: F.when(plain.isNotNull(), _elements(plain)).otherwise(found))


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _is_number(x: Column) -> Column:
    return _kind(x).rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$")


def _equal(x: Column, bound) -> Column:
    """JSON equality, strict in type: 1 is not 1.0."""
    if bound is None:
        return F.is_variant_null(x)
    if isinstance(bound, bool):
        return (_kind(x) == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == bound)
    if isinstance(bound, int):
        return (_kind(x) == "BIGINT") & (F.try_variant_get(x, "$", "bigint") == bound)
    if isinstance(bound, float):
        return _is_number(x) & (_kind(x) != "BIGINT") & (F.try_variant_get(x, "$", "double") == bound)
    if isinstance(bound, str):
        return (_kind(x) == "STRING") & (F.try_variant_get(x, "$", "string") == bound)
    return F.to_json(x) == F.to_json(F.parse_json(F.lit(json.dumps(bound))))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _operator(x: Column, op: str, bound) -> Column:
    if op == "eq":
        return _true(_equal(x, bound))
    if op == "ne":
        return ~_true(_equal(x, bound))
    if op in NUMERIC:
        if isinstance(bound, bool) or not isinstance(bound, (int, float)):
            return F.lit(False)
        v = F.try_variant_get(x, "$", "double")
        compare = {"gt": v > bound, "gte": v >= bound, "lt": v < bound, "lte": v <= bound}[op]
        return _true(_is_number(x) & compare)
    if op == "in":
        some = [_true(_equal(x, b)) for b in bound] if isinstance(bound, list) else []
        return _any(some)
    if op == "text":
        asked = sorted(set(words(bound))) if isinstance(bound, str) else []
        if not asked:
            return F.lit(False)
        held = tokens(F.try_variant_get(x, "$", "string"))
        return _true((_kind(x) == "STRING") & (F.size(F.array_except(F.array(*map(F.lit, asked)), held)) == 0))
    if op == "nested":
        inner = bound.get("filter", bound) if isinstance(bound, dict) else {}
        return _true(_kind(x).startswith("OBJECT")) & _matches(x, inner)
    return F.lit(False)


def _any(some: list[Column]) -> Column:
    out = F.lit(False)
    for c in some:
        out = out | c
    return out


def _all(every: list[Column]) -> Column:
    out = F.lit(True)
    for c in every:
        out = out & c
    return out


def conditions(bound) -> dict:
    """A field's operators; anything but an object is equality."""
    return bound if isinstance(bound, dict) else {"eq": bound}


def _satisfies(ops: dict):
    return lambda x: _all([_operator(x, op, v) for op, v in ops.items()])


def matches(payload: Column, given) -> Column:
    """The filter as a column over a VARIANT payload, which is evaluated once a row; a filter that is no object matches
    everything."""
    return F.exists(F.array(payload), lambda p: _matches(p, given)) if isinstance(given, dict) else F.lit(True)


def _matches(payload: Column, given) -> Column:
    if not isinstance(given, dict):
        return F.lit(True)
    one = [F.exists(values(payload, field), _satisfies(conditions(bound))) for field, bound in given.items()]
    return _true(_all(one))


def where(df: DataFrame, given, payload: str = "payload") -> DataFrame:
    """Filter by payload. Scalar conditions on fields that are columns of ``df`` stay plain comparisons, which reach the
    scan; the rest goes to the VARIANT column."""
    if not isinstance(given, dict):
        return df
    checked(given)
    names, out, rest = set(df.columns), df, {}
    for field, bound in given.items():
        ops = conditions(bound)
        if field in names and field != payload and not {"nested"} & ops.keys():
            for op, b in ops.items():
                out = out.where(column_operator(F.col(f"`{field}`"), op, b))
        else:
            rest[field] = bound
    if rest:
        require(payload in names, "unknown_field", f"no such field: {sorted(rest)}")
        out = out.where(matches(F.col(payload), rest))
    return out


def column_operator(c: Column, op: str, bound) -> Column:
    """The operator on a promoted column: null is a missing field."""
    if op == "eq":
        return c.isNull() if bound is None else c == F.lit(bound)
    if op == "ne":
        return c.isNotNull() if bound is None else c.isNotNull() & (c != F.lit(bound))
    if op in NUMERIC:
        return {"gt": c > bound, "gte": c >= bound, "lt": c < bound, "lte": c <= bound}[op]
    if op == "in":
        return c.isin(list(bound)) if bound else F.lit(False)
    if op == "text":
        asked = sorted(set(words(bound)))
        return F.lit(False) if not asked else F.size(F.array_except(F.array(*map(F.lit, asked)), tokens(c))) == 0
    return F.lit(False)


def _unlike(test):
    return lambda x: ~F.is_variant_null(x) & ~test(x)


def _violation(payload: Column, schema: dict[str, str]) -> Column:
    broken = F.lit(None).cast("string")
    for field, rule in reversed(schema.items()):
        optional, nullable = rule.startswith("optional_"), rule.startswith("nullable_")
        kind = rule.removeprefix("optional_").removeprefix("nullable_")
        found = values(payload, field)
        raw = _get(payload, field)
        test = {
            "string": lambda x: _kind(x) == "STRING", "number": _is_number, "bool": lambda x: _kind(x) == "BOOLEAN",
            "object": lambda x: _kind(x).startswith("OBJECT"),
        }.get(kind)
        if kind == "array":
            wrong = raw.isNotNull() & ~F.is_variant_null(raw) & ~_kind(raw).startswith("ARRAY")
        else:
            require(test is not None, "invalid_schema", f"unknown payload type {rule}")
            wrong = F.exists(found, _unlike(test))
        missing = F.lit(False) if optional else (raw.isNull() if "." not in field else F.size(found) == 0)
        null = F.lit(False) if optional or nullable else F.exists(found, F.is_variant_null)
        broken = F.when(_true(wrong) | _true(missing) | _true(null), field).otherwise(broken)
    return broken


def violations(df: DataFrame, schema: dict[str, str], payload: str = "payload") -> DataFrame:
    """Rows with the first field whose value breaks the payload schema: string, number, bool, object or array, each
    alone (required), ``optional_`` (may be missing or null) or ``nullable_`` (may be null); arrays go by element.

    A generator makes the violations and drops the other rows at once: a filter would evaluate them a second time."""
    found = F.filter(F.transform(F.array(payload), lambda p: _violation(p, schema)), lambda v: v.isNotNull())
    return df.drop("violation").select("*", F.explode(found).alias("violation"))
