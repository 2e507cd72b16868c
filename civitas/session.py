"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "civitas", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive plans; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
