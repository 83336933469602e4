"""Session settings that every answer of this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps period texts equal everywhere; AQE re-plans joins and splits skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with SETTINGS; keyword names write dots as double underscores."""
    builder = SparkSession.builder.master(master)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
