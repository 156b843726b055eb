"""SparkSession factory with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "fathom", **conf: str) -> SparkSession:
    """A session with ANSI SQL, UTC and adaptive execution on.

    ``master`` is only set when given, so that ``spark-submit`` decides on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
