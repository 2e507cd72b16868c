"""The catalog: bridged tables as views, what they hold, and the rows that a new store starts with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.operators import merge
from civitas.sources import bridge

TABLES = {"venues": bridge.venues_full, "events": bridge.events_full, "predictions": bridge.predictions, "demographics": bridge.demographics, "weather": bridge.weather, "runs": bridge.runs}
CONFIG = "config_key string, config_value string, config_type string"
SOURCES = "source_name string, source_type string, is_enabled boolean, daily_quota int, requests_made_today int"


def register(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """A temporary view for each table, for SQL; their names."""
    for name, of in TABLES.items():
        of(spark, sf_dir).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in TABLES]


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, position, column_name, type) of every table, from their schemas alone."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, of in TABLES.items() for i, f in enumerate(of(spark, sf_dir).schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, records) of every table."""
    each = [of(spark, sf_dir).agg(F.count("*").alias("records")).select(F.lit(name).alias("name"), "records") for name, of in TABLES.items()]
    return reduce(DataFrame.unionByName, each)


def seed_config(config: DataFrame, values: dict[str, object]) -> DataFrame:
    """``config`` with ``values`` for the keys that it lacks, each with the tag of its type."""
    kind = {bool: "boolean", int: "integer", float: "float"}
    rows = [(k, str(v), kind.get(type(v), "string")) for k, v in values.items()]
    return merge.insert_absent(config, config.sparkSession.createDataFrame(rows, CONFIG), ["config_key"])


def seed_sources(sources: DataFrame, names: dict[str, str]) -> DataFrame:
    """``sources`` with those of ``names`` (name to kind) that it lacks, enabled and without a quota."""
    rows = [(name, kind, True, None, 0) for name, kind in names.items()]
    return merge.insert_absent(sources, sources.sparkSession.createDataFrame(rows, SOURCES), ["source_name"])
