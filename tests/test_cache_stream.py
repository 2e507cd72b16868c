"""The cache kept by a stream answers like the one replayed over a batch, which answers like a plain loop."""

import datetime as dt
import random

import pytest

from civitas.streaming import cache

SCHEMA = "cache_key string, request_id long, at timestamp_ntz, kind string, answer string, ttl_hours int"
START = dt.datetime(2024, 1, 1)


def some(n: int, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "set" if rng.random() < 0.3 else "get"
        at = START + dt.timedelta(seconds=rng.choice((0, 1, 60, 3600)) * rng.randrange(60), microseconds=rng.randrange(3))
        # a hot key has a third of all requests
        rows.append((rng.choice(("hot", "hot", "a", "b", "", "c")), i, at, kind, f"r{i}" if rng.random() < 0.9 else None, rng.choice((0, 1, 2, 30, None)) if kind == "set" else None))
    return rows


def looped(rows: list[tuple]) -> list[tuple]:
    held, out = {}, []
    for key, i, at, kind, answer, ttl in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        if kind == "set":
            held[key] = (at + dt.timedelta(hours=ttl or 0), answer)
        elif kind == "get":
            until, what = held.get(key, (at, None))
            out.append((key, i, at, until > at, what if until > at else None))
    return sorted(out, key=lambda r: r[1])


def as_rows(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in ("cache_key", "request_id", "at", "hit", "answer")) for r in df.collect()), key=lambda r: r[1])


def test_replay_answers_like_a_loop_over_all_requests(spark):
    odd = [(None, 900, START, "get", None, None), ("a", 901, None, "get", None, None), ("a", 902, START, "drop", None, None), ("alone", 903, START, "get", None, None)]
    rows = some(400) + odd
    assert as_rows(cache.replay(spark.createDataFrame(rows, SCHEMA))) == looped(rows)
    assert any(r[3] for r in looped(rows)) and not all(r[3] for r in looped(rows))
    assert cache.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_key_with_most_requests_is_split_by_the_hour(spark):
    plan = cache.replay(spark.createDataFrame(some(10), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line]
    assert any("hour" in line.split("last(", 1)[1].split("], [")[1] for line in windows)


@pytest.fixture
def keyed_state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, cache.PROVIDER)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_the_stream_answers_like_the_batch_whatever_its_batches(spark, tmp_path, keyed_state):
    rows = some(120)
    # rows come out of order by less than the watermark's delay, and a last request moves the watermark past all
    end = ("end", 10_000, START + dt.timedelta(days=30), "get", None, None)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    for part, own in enumerate((mixed[:50], mixed[50:], [end], [(*end[:1], 10_001, end[2] + dt.timedelta(days=30), *end[3:])])):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    live = cache.cached(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")), late="10 days")
    query = live.writeStream.format("memory").queryName("cached_answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r for r in as_rows(spark.table("cached_answers")) if r[1] < 10_000]
    assert got == looped(rows)
    # every answer's time is over, and nothing but the last request waits
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "held").load()
    assert held.count() == 0
