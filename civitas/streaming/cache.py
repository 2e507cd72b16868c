"""A cache of answers with a time to live, kept by a stream of requests, and the same over a batch of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
_REQUEST = "request_id long, at long, until long, answer string"
_FOUND = "request_id long, at long, hit boolean, answer string"
#: The state store that keyed state with timers needs: set it as ``spark.sql.streaming.stateStore.providerClass``.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(requests: DataFrame) -> DataFrame:
    """Requests with times in microseconds; one that sets has the ``until`` of its answer."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    sets = F.col("kind") == "set"
    until = F.when(sets, at + F.coalesce("ttl_hours", F.lit(0)).cast("long") * HOUR)
    kept = requests.where("cache_key IS NOT NULL AND at IS NOT NULL AND kind IN ('set', 'get')")
    return kept.select("cache_key", F.col("request_id").cast("long").alias("request_id"), F.col("at").cast("timestamp").alias("time"), at.alias("at"), until.alias("until"), F.when(sets, F.col("answer")).alias("answer"))


def replay(requests: DataFrame) -> DataFrame:
    """(cache_key, request_id, at, hit, answer) of each ``get`` of ``requests`` (cache_key, request_id, at, kind: set or get, answer, ttl_hours).

    A get is a hit if the last set of its key before it, in order of (at, request_id), lives on: at + ttl_hours lies after the get. A set
    without a ttl has none; requests without a key or time, or of another kind, take no part. A key's requests are split
    by the hour, and the last set of each hour is carried on, so no key is whole in one task.
    """
    rows = _plain(requests).withColumn("hour", F.floor(F.col("at") / HOUR))
    sets = F.col("until").isNotNull()
    last = rows.where(sets).groupBy("cache_key", "hour").agg(F.max_by(F.struct("until", "answer"), F.struct("at", "request_id")).alias("own"))
    hours = rows.select("cache_key", "hour").distinct().join(last, ["cache_key", "hour"], "left")
    earlier = Window.partitionBy("cache_key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select("cache_key", "hour", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
    before = Window.partitionBy("cache_key", "hour").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("near", F.last(F.when(sets, F.struct("until", "answer")), ignorenulls=True).over(before)).where(~sets)
    held = F.coalesce("near", "carried")
    hit = F.coalesce(held["until"] > F.col("at"), F.lit(False))
    found = seen.join(carried, ["cache_key", "hour"]).select("cache_key", "request_id", "at", hit.alias("hit"), F.when(hit, held["answer"]).alias("answer"))
    return found.withColumn("at", _time(F.col("at")))


def _time(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


class _Cache(StatefulProcessor):
    """Per key: the answer held, and the requests that the watermark hasn't passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "until long, answer string")
        self.waiting = handle.getListState("waiting", _REQUEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(i), int(at), None if pd.isna(until) else int(until), answer) for batch in rows for i, at, until, answer in zip(batch["request_id"], batch["at"], batch["until"], batch["answer"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(_ms(min(at for _, at, _, _ in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in waiting if r[1] <= passed), key=lambda r: (r[1], r[0]))
        later = [r for r in waiting if r[1] > passed]
        held = tuple(self.held.get()) if self.held.exists() else None
        found = []
        for number, at, until, answer in ready:
            if until is not None:
                held = (until, answer)
            else:
                hit = held is not None and held[0] > at
                found.append((number, at, hit, held[1] if hit else None))
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if held is None or held[0] <= passed:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(_ms(held[0]))
        if later:
            self.handle.registerTimer(_ms(min(r[1] for r in later)))
        if found:
            out = pd.DataFrame(found, columns=["request_id", "at", "hit", "answer"])
            yield out.assign(cache_key=key[0])[["cache_key", *out.columns]]

    def close(self) -> None:
        pass


def _ms(micros: int) -> int:
    return -(-micros // 1000)


def cached(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """The rows of ``replay`` on a stream of requests: whatever the batches they come in, requests of a key are answered in their order once the
    watermark, ``late`` behind the newest, has passed them; what comes later than that is dropped. State goes when an answer's time is over. A task holds the
    requests of one key within ``late`` at a time."""
    rows = _plain(requests).withWatermark("time", late)
    key = rows.schema["cache_key"].dataType.simpleString()
    found = rows.groupBy("cache_key").transformWithStateInPandas(_Cache(), outputStructType=f"cache_key {key}, {_FOUND}", outputMode="Append", timeMode="EventTime")
    return found.withColumn("at", _time(F.col("at")))
