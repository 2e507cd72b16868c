"""Streams of events: windowed counts, keyed state in snapshots, retention by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civitas.operators.merge import Snapshots, upsert
from civitas.operators.store import latest


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and category; rows later than ``late`` are dropped, and the
    state of a closed window with them. Works on a stream and on a batch."""
    timed = events.withColumn("start_time", F.col("start_time").cast("timestamp"))
    by = timed.withWatermark("start_time", late).groupBy(F.window("start_time", size), "category")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "category", "n", "value")


def upsert_stream(events: DataFrame, store: Snapshots, keys: list[str], checkpoint: str, time: str | None = None) -> StreamingQuery:
    """Each micro-batch merged into the store as one version numbered by the batch, so that a batch
    that is run again after a failure replaces nothing that it has not written. Of a key the latest
    row by ``time`` counts, ties to the row that sorts last; an empty store starts with the first batch."""

    def merge(batch: DataFrame, number: int) -> None:
        order = [F.desc(c) for c in ([time] if time else []) + [c for c in batch.columns if c != time]]
        rows = latest(batch, keys, order)
        held = store.read() if store.versions().limit(1).count() else batch.limit(0)
        store.commit(upsert(held, rows, keys), number + 1)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
