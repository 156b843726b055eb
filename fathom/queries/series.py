"""Time series made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import temporal
from fathom.registry import query
from fathom.sources.tables import series, table

S = "WITH s AS (SELECT 't' AS tenant, user_id::VARCHAR AS asset, event_type AS property, epoch_us(ts) * 1000 AS time_ns, value FROM events)"
FROM, TO = 1_704_067_200_000_000_000, 1_735_689_600_000_000_000


@query("temporal_history", f"{S} SELECT 'assets' AS namespace, asset AS id, property, time_ns::VARCHAR AS time_ns, value FROM s WHERE asset = '8' AND property = 'error' AND time_ns >= {FROM} AND time_ns < {TO} ORDER BY s.time_ns LIMIT 7")
def temporal_history(spark, sf_dir):
    rows = temporal.shown(temporal.history(series(spark, sf_dir), "8", "error", FROM, TO, 7, tenant="t"))
    return rows.select("asset_ref.namespace", "asset_ref.id", "property", "time_ns", "value")


@query("temporal_latest", f"{S} SELECT asset, property, time_ns, value FROM s WHERE asset = '46' AND property = 'click' ORDER BY time_ns DESC LIMIT 1")
def temporal_latest(spark, sf_dir):
    return temporal.latest(series(spark, sf_dir), "46", "click").select("asset", "property", "time_ns", "value")


@query("temporal_latest_of_all", f"{S} SELECT tenant, asset, property, max(time_ns) AS time_ns, arg_max(value, time_ns) AS value FROM s GROUP BY ALL")
def temporal_latest_of_all(spark, sf_dir):
    return temporal.latest_of_all(series(spark, sf_dir))


@query("temporal_asset_filter", f"{S} SELECT asset, property, time_ns, value FROM s WHERE asset = '8' AND property = 'view' AND 'src' = 'src' ORDER BY time_ns LIMIT 4096")
def temporal_asset_filter(spark, sf_dir):
    assets = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.lit("truck").alias("kind")).distinct()
    return temporal.history(series(spark, sf_dir), "8", "view", 0, 1 << 62, 4096, assets=assets, payload_filter={"kind": "truck"}).select("asset", "property", "time_ns", "value")


@query("temporal_history_of", f"{S} SELECT asset, property, time_ns, value FROM s WHERE asset IN ('8', '46', '3') AND property = 'click' QUALIFY row_number() OVER (PARTITION BY asset ORDER BY time_ns) <= 5")
def temporal_history_of(spark, sf_dir):
    assets = spark.createDataFrame([("8",), ("46",), ("3",), ("8",), (None,), ("none",)], "asset string")
    return temporal.history_of(series(spark, sf_dir), assets, "click", 0, 1 << 62, 5).select("asset", "property", "time_ns", "value")


def _samples(spark, sf_dir):
    """Of all events: every third as it is, every third moved back a nanosecond, every third with another value."""
    s = series(spark, sf_dir).withColumn("k", F.expr("(time_ns div 1000) % 3"))
    return s.withColumn("time_ns", F.when(F.col("k") == 1, F.col("time_ns") - 1).otherwise(F.col("time_ns"))).withColumn(
        "value", F.when(F.col("k") == 2, F.col("value") + 1).otherwise(F.col("value"))
    ).drop("k")


@query("temporal_append", f"{S} SELECT tenant, asset, property, time_ns - 1 AS time_ns, value FROM s WHERE (time_ns // 1000) % 3 = 1")
def temporal_append(spark, sf_dir):
    """Samples already there are no change, conflicting ones are told apart, late ones are new."""
    return temporal.fresh_samples(series(spark, sf_dir), _samples(spark, sf_dir))[0]


@query("temporal_conflicts", f"{S} SELECT tenant, asset, property, time_ns, value + 1 AS value, value AS held FROM s WHERE (time_ns // 1000) % 3 = 2")
def temporal_conflicts(spark, sf_dir):
    return temporal.fresh_samples(series(spark, sf_dir), _samples(spark, sf_dir))[1]
