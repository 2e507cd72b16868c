"""Keyed merges, seeds, retention and run status on immutable snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` (one per key) merged in, in ``target``'s columns.

    A matched key takes ``update`` columns (default: all others) from the source, where the
    source has them; a new key is inserted; other rows stay. Null keys match null keys.
    """
    rest = [c for c in target.columns if c not in keys]
    update = rest if update is None else update
    new = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns), F.lit(True).alias("s__there"))
    both = target.withColumn("t__there", F.lit(True)).join(new, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys], "full_outer")
    def pick(c: str) -> Column:
        if f"s_{c}" not in new.columns:
            return F.col(c)
        theirs = F.col("s__there") & (F.col("t__there").isNull() | F.lit(c in update))
        return F.when(theirs, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*(pick(c) for c in target.columns))


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it lacks."""
    held = target.select(*(F.col(k).alias(f"t_{k}") for k in keys))
    return target.unionByName(source.join(held, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys], "left_anti"))


def replace_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the keys of ``source``, and ``source``; columns it lacks become null."""
    gone = source.select(*(F.col(k).alias(f"s_{k}") for k in keys))
    kept = target.join(gone, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys], "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def retain(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; rows without a time stay."""
    return df.where(F.col(time).isNull() | (F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS")))


#: Health in tenths: where it starts, what a success gains and a failure loses, the least and the most.
START, GAIN, LOSS, LEAST, MOST = 5, 1, 2, 0, 10
_FAR = 1 << 40


def _composed(success: np.ndarray) -> tuple[int, int, int]:
    """(d, low, high): what runs in order make of a health x is min(high, max(low, x + d)).

    Such functions compose to one of their kind, so neighbours are composed in pairs until one is left.
    """
    d = np.where(success, GAIN, -LOSS).astype(np.int64)
    low, high = np.where(success, -_FAR, LEAST), np.where(success, MOST, _FAR)
    while len(d) > 1:
        if len(d) % 2:
            d, low, high = np.append(d, 0), np.append(low, -_FAR), np.append(high, _FAR)
        then, least, most = d[1::2], low[1::2], high[1::2]
        d, low, high = d[::2] + then, np.clip(low[::2] + then, least, most), np.clip(high[::2] + then, least, most)
    return int(d[0]), int(low[0]), int(high[0])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each source of each batch of (source_name, success) in order."""
    part = TaskContext.get().partitionId()
    for place, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        names = batch.column(0)
        code = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        rows = []
        for own in np.split(good, first[1:]):
            streak = len(own) - 1 - int(np.flatnonzero(own)[-1]) if own.any() else len(own)
            rows.append((part, place, streak, bool(own.any()), *_composed(own)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([names.take(pa.array(first)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["source_name", "part", "place", "streak", "any", "d", "low", "high"])


def run_status(runs: DataFrame) -> DataFrame:
    """One row for each source from its runs (source_name, seq, success, duration, records): counts,
    consecutive errors, mean duration of successes, and health, which starts at 0.5, gains 0.1 up to
    1 on success and loses 0.2 down to 0 on failure, in order of seq.

    Counts and means are partial aggregates. What needs the order is folded in blocks: runs are
    sorted into ranges of (source_name, seq, ...), so that a source with most of the runs is in many
    tasks; a batch becomes a row, and only these few rows of a source are gathered. A null success is
    a failure; null durations and records don't count.
    """
    good, zero = F.coalesce("success", F.lit(False)), lambda c, x: F.coalesce(c, F.lit(x))
    counts = runs.groupBy("source_name").agg(
        F.count_if(good).alias("success_count"), F.count_if(~good).alias("error_count"),
        zero(F.avg(F.when(good, F.col("duration").cast("double"))), 0.0).alias("avg_duration"), zero(F.sum(F.when(good, F.col("records").cast("long"))), 0).alias("total_records"),
    )
    order = ["source_name", "seq", "success", "duration", "records"]
    ranges = runs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("source_name", "success")
    kind = runs.schema["source_name"].dataType.simpleString()
    blocks = ranges.mapInArrow(_blocks, f"source_name {kind}, part long, place long, streak long, any boolean, d long, low long, high long")
    ordered = F.array_sort(F.collect_list(F.struct("part", "place", "streak", "any", "d", "low", "high")))

    def step(a: Column, x: Column) -> Column:
        streak = F.when(x["any"], x["streak"]).otherwise(a["streak"] + x["streak"])
        return F.struct(streak.alias("streak"), F.least(x["high"], F.greatest(x["low"], a["health"] + x["d"])).alias("health"))

    begin = F.struct(F.lit(0).cast("long").alias("streak"), F.lit(START).cast("long").alias("health"))
    folded = blocks.groupBy(F.col("source_name").alias("name")).agg(F.aggregate(ordered, begin, step).alias("s"))
    both = counts.join(folded, F.col("source_name").eqNullSafe(F.col("name")))
    return both.select("source_name", "success_count", "error_count", F.col("s.streak").alias("consecutive_errors"), "avg_duration", (F.col("s.health") / 10).alias("health"), "total_records")


def full_status(runs: DataFrame) -> DataFrame:
    """``run_status`` with the totals and the last times, records and duration of ``runs`` (also ran_at)."""
    good = F.coalesce("success", F.lit(False))
    of_last = lambda c: F.max_by(c, F.when(good, F.col("seq")))
    last = runs.groupBy(F.col("source_name").alias("name")).agg(
        F.count("*").alias("total_runs"), F.max(F.when(good, F.col("ran_at"))).alias("last_successful_collection"), F.max("ran_at").alias("last_attempted_collection"),
        of_last("records").alias("records_last_run"), of_last("duration").alias("last_duration_seconds"),
    )
    both = run_status(runs).join(last, F.col("source_name").eqNullSafe(F.col("name")))
    return both.select("source_name", "total_runs", F.col("success_count").alias("successful_runs"), "error_count", "last_successful_collection", "last_attempted_collection", "consecutive_errors", F.col("total_records").alias("total_records_collected"), "records_last_run", "last_duration_seconds", F.col("health").alias("collection_health_score"))


def health(sources: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """How each of ``sources`` (source_name, source_type, is_enabled, daily_quota, requests_made_today) does by its
    ``status``, the worst first. A source that failed and is also stale counts as stale."""
    last = F.col("last_successful_collection")
    state = F.when(last.isNull(), "Never Run").when(last < now - F.expr("INTERVAL 24 HOURS"), "Stale").when(F.col("consecutive_errors") > 3, "Failing").when(F.col("collection_health_score") < 0.5, "Unhealthy").otherwise("Healthy")
    used = F.when(F.col("daily_quota") > 0, F.col("requests_made_today").cast("double") / F.col("daily_quota")).otherwise(0.0)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("error_count", "consecutive_errors", "total_records_collected")]
    out = sources.join(status, "source_name", "left").select("source_name", "source_type", "is_enabled", "collection_health_score", "last_successful_collection", state.alias("status"), *zero, "records_last_run", "requests_made_today", "daily_quota", used.alias("quota_used_pct"))
    place = F.array_position(F.array(*map(F.lit, ("Failing", "Unhealthy", "Stale", "Never Run", "Healthy"))), F.col("status"))
    return out.orderBy(place)


@dataclass
class Snapshots:
    """A table as immutable versions under ``root``: a commit writes a new version and then a pointer
    row; readers take the newest pointer, so the path that is read is never overwritten."""

    spark: SparkSession
    root: str

    def commit(self, df: DataFrame, version: int) -> None:
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(at)
        self.spark.createDataFrame([(version, at)], "version long, path string").coalesce(1).write.mode("append").json(f"{self.root}/versions")

    def versions(self) -> DataFrame:
        """(version, path) of all commits; none in a store that nothing has been written to."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "version long, path string")
        return self.spark.read.schema("version long, path string").json(f"{self.root}/versions")

    def read(self, version: int | None = None) -> DataFrame:
        rows = self.versions() if version is None else self.versions().where(F.col("version") == version)
        found = rows.orderBy(F.desc("version")).first()
        if found is None:
            raise ValueError(f"no version in {self.root}")
        return self.spark.read.parquet(found.path)
