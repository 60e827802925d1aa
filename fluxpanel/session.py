"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "fluxpanel", master: str | None = None, **conf: str) -> SparkSession:
    """AQE, Arrow and filters for Python sources on, UTC; anything in `conf` (dots as double underscores) wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
