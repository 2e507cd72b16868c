"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a local one is set if all
    of Spark runs on this machine; on a cluster that is an error, as executors don't see each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "/tmp/civitas-checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/civitas/{re.sub('[^a-z0-9_]', '_', name.lower())}-{uuid.uuid4().hex}"
    _STAGED.append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables that this process has staged; returns how many. To be called when results
    that read them are written: a result is computed from staged tables when it is read."""
    dropped = 0
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        dropped += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return dropped
