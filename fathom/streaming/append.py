"""Structured Streaming into a time-series table: each micro-batch adds new samples once and sets conflicts aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from fathom.operators import temporal


def append_stream(samples: DataFrame, series_path: str, conflicts_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer to start. A batch that is run again finds its samples there already, so the sink is idempotent; samples
    may come late or twice. A sample that contradicts a stored one goes to ``conflicts_path``."""
    kind = samples.schema["value"].dataType.simpleString()
    schema = f"tenant string, asset string, property string, time_ns bigint, value {kind}"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").parquet(series_path)  # so that the folder exists
        held = spark.read.schema(schema).parquet(series_path)
        fresh, clash = temporal.fresh_samples(held, batch.select(*temporal.KEY, "time_ns", "value"))
        clash.write.mode("append").parquet(conflicts_path)
        fresh.write.mode("append").parquet(series_path)

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed(samples: DataFrame, *, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Event-time windows of each series with a watermark: count, least, greatest and mean. ``time_ns`` is in whole
    microseconds here."""
    from pyspark.sql import functions as F

    timed = samples.withColumn("at", F.timestamp_micros(F.expr("time_ns div 1000"))).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", width).alias("w"), *temporal.KEY)
    return grouped.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean")).select(*temporal.KEY, F.col("w.start").alias("start"), "n", "least", "most", "mean")
