"""Time series by (tenant, asset, property): append, history and latest. Times are nanoseconds in a bigint."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.constants import SERIES_BYTES, TEMPORAL_BATCH, TEMPORAL_HISTORY
from fathom.errors import require
from fathom.functions.payload import where
from fathom.materialize import small

KEY = ["tenant", "asset", "property"]


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _kind(value: DataFrame) -> str:
    return value.schema["value"].dataType.simpleString()


def appended(series: DataFrame, samples: DataFrame, *, batch: int | None = TEMPORAL_BATCH) -> tuple[DataFrame, int]:
    """The samples that are new, and how many. A sample that is there already is no change; another value at its time,
    NaN, a series key that is too long or a batch of more than 1024 rejects all of it. Late samples are fine."""
    require(_kind(series) == _kind(samples), "temporal_type", "a series has values of one type")
    if batch:
        require(0 < samples.count() <= batch, "temporal_batch", f"1 to {batch} samples")
    size = F.octet_length("tenant") + F.octet_length("asset") + F.octet_length("property")
    bad = (size > SERIES_BYTES) | F.col("time_ns").isNull() | F.col("value").isNull()
    if _kind(samples) == "double":
        bad = bad | F.isnan("value")
    require(samples.where(F.coalesce(bad, F.lit(True))).isEmpty(), "temporal_sample", "a sample is null, NaN or has too long a key")
    own = samples.groupBy(*KEY, "time_ns").agg(F.min("value").alias("value"), F.max("value").alias("most"))
    require(own.where(~_same(F.col("value"), F.col("most"))).isEmpty(), "temporal_conflict", "two values at one time in the batch")
    new = own.drop("most")
    held = series.select(*KEY, "time_ns", F.col("value").alias("held"))
    both = new.join(held, [*KEY, "time_ns"], "left")
    require(both.where(F.col("held").isNotNull() & ~_same(F.col("held"), F.col("value"))).isEmpty(), "temporal_conflict", "another value at that time")
    fresh = both.where("held is null").select(*KEY, "time_ns", "value")
    return fresh, fresh.count()


def fresh_samples(series: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, conflicting) of any number of samples, in one join: for bulk loads and streams, where a conflict is a row."""
    own = samples.groupBy(*KEY, "time_ns").agg(F.min("value").alias("value"), F.max("value").alias("most"))
    both = own.join(series.select(*KEY, "time_ns", F.col("value").alias("held")), [*KEY, "time_ns"], "left")
    clash = ~_same(F.col("value"), F.col("most")) | (F.col("held").isNotNull() & ~_same(F.col("held"), F.col("value")))
    return both.where(F.col("held").isNull() & ~clash).select(*KEY, "time_ns", "value"), both.where(clash).select(*KEY, "time_ns", "value", "held")


def of(series: DataFrame, asset: str, prop: str, tenant: str | None = None) -> DataFrame:
    rows = series.where((F.col("asset") == asset) & (F.col("property") == prop))
    return rows.where(F.col("tenant") == tenant) if tenant is not None else rows


def shown(rows: DataFrame, namespace: str = "assets") -> DataFrame:
    """asset_ref, property, time_ns as text, value; infinities are spelt out by ``value_text``."""
    ref = F.struct(F.lit(namespace).alias("namespace"), F.col("asset").alias("id"))
    return rows.select(ref.alias("asset_ref"), "property", F.col("time_ns").cast("string").alias("time_ns"), "value")


def value_text(value: float | bool) -> float | bool | str:
    if isinstance(value, float) and math.isinf(value):
        return "+Infinity" if value > 0 else "-Infinity"
    return value


def _on_assets(rows: DataFrame, assets: DataFrame | None, payload_filter: dict | None) -> DataFrame:
    if assets is None:
        return rows
    passing = where(assets, payload_filter).select(F.col("id").alias("asset")).distinct()
    return rows.join(passing, "asset", "left_semi")


def history(
    series: DataFrame, asset: str, prop: str, start: int, end: int, limit: int, *, tenant: str | None = None, assets: DataFrame | None = None,
    payload_filter: dict | None = None,
) -> DataFrame:
    """The earliest ``limit`` samples with start <= time < end, ascending."""
    require(start <= end, "temporal_range", "the range ends before it starts")
    require(1 <= limit <= TEMPORAL_HISTORY, "temporal_limit", f"limit is 1 to {TEMPORAL_HISTORY}")
    rows = of(series, asset, prop, tenant).where((F.col("time_ns") >= start) & (F.col("time_ns") < end))
    return _on_assets(rows, assets, payload_filter).orderBy("time_ns").limit(limit)


def latest(series: DataFrame, asset: str, prop: str, *, tenant: str | None = None, assets: DataFrame | None = None, payload_filter: dict | None = None) -> DataFrame:
    """The sample of greatest time, or no row."""
    return _on_assets(of(series, asset, prop, tenant), assets, payload_filter).orderBy(F.desc("time_ns")).limit(1)


def latest_of_all(series: DataFrame, tenant_col: str = "tenant") -> DataFrame:
    """The latest sample of every series: one partial aggregate, no window."""
    found = series.groupBy(tenant_col, "asset", "property").agg(F.max(F.struct("time_ns", "value")).alias("at"))
    return found.select(tenant_col, "asset", "property", "at.time_ns", "at.value")


def history_of(series: DataFrame, assets: DataFrame, prop: str, start: int, end: int, limit: int) -> DataFrame:
    """The pipeline's stage: the earliest ``limit`` samples of each distinct asset of (asset), at most 4096 in all."""
    require(start <= end, "temporal_range", "the range ends before it starts")
    wanted = assets.select("asset").where("asset is not null").distinct()
    require(wanted.count() * limit <= TEMPORAL_HISTORY, "temporal_limit", f"assets times limit is at most {TEMPORAL_HISTORY}")
    rows = series.where((F.col("property") == prop) & (F.col("time_ns") >= start) & (F.col("time_ns") < end))
    rows = rows.join(small(wanted), "asset", "left_semi")
    rank = F.row_number().over(Window.partitionBy("asset").orderBy("time_ns"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def coverage(low: int, high: int, start: int, end: int) -> str:
    """How a block of times low to high meets [start, end): Skip, All or Partial."""
    if start >= end or high < start or low >= end:
        return "Skip"
    return "All" if start <= low and high < end else "Partial"
