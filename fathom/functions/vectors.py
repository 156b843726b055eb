"""Dense scores and distances as column expressions; scores are better when higher."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.constants import MAX_DIMENSION
from fathom.errors import require

METRICS = ("cosine", "l2", "dot")


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def parse(text: str, dimension: int | None = None) -> list[float]:
    """A vector literal '[1, 2]'; NaN, infinities and a wrong dimension are refused."""
    try:
        values = [float(v) for v in json.loads(text)]
    except (TypeError, ValueError) as e:
        raise_invalid(str(e))
    require(all(math.isfinite(v) for v in values), "22023", "vector values must be finite")
    require(0 < len(values) <= MAX_DIMENSION, "22023", "vector dimension out of range")
    require(dimension is None or len(values) == dimension, "22000", f"expected {dimension} dimensions, not {len(values)}")
    return values


def raise_invalid(why: str):
    require(False, "22P02", f"invalid vector: {why}")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.when(size != 0, size))


def score(metric: str, query: Column, vector: Column) -> Column:
    require(metric in METRICS, "invalid_metric", f"metric must be one of {METRICS}")
    if metric == "l2":
        return -l2_distance(query, vector)
    return cosine(query, vector) if metric == "cosine" else dot(query, vector)


def distance(operator: str, query: Column, vector: Column) -> Column:
    """The SQL operators <-> (L2), <#> (negative inner product), <=> (cosine distance)."""
    found = {"<->": lambda: l2_distance(query, vector), "<#>": lambda: -dot(query, vector), "<=>": lambda: 1 - cosine(query, vector)}
    require(operator in found, "0A000", f"distance operator {operator} is not supported")
    return found[operator]()


def checked(vector: Column, dimension: int) -> Column:
    """The vector, or an error for a row of another dimension."""
    wrong = F.concat(F.lit(f"expected {dimension} dimensions, not "), F.size(vector).cast("string"))
    return F.when(vector.isNull() | (F.size(vector) == dimension), vector).otherwise(F.raise_error(wrong).cast("array<double>"))
