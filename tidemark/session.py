"""A Spark session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Longer generated methods aren't compiled by HotSpot: such stages then run as split expressions, which are.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """UTC clocks, adaptive execution with skew-join handling, Arrow transfer; conf overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        HUGE_METHOD[0]: HUGE_METHOD[1],
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
