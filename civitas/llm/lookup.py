"""Per-document sums of a value that is looked up for every token.

The join behind token counts and corpus-wide probabilities: a table of distinct tokens is
joined to per-document token frequencies and the products are summed. Token frequencies are
Zipfian, so the join is split by frequency: the frequent tokens (at most ``MOST_FREQUENT``,
keys of at most 33 bytes, so their size is bounded) are broadcast and summed where the text
is, and only occurrences of the rest are shuffled, none of which is hot.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast part, and of a task's counter before it is flushed.
MOST_FREQUENT, FLUSH = 131_072, 150_000

Split = Callable[[str | None], Iterable[bytes]]


def key_of(token: bytes) -> bytes:
    """A token's join key: itself up to 32 bytes, else a marker and a 128-bit digest."""
    return token if len(token) <= 32 else b"\x00" + hashlib.blake2b(token, digest_size=16).digest()


def token_counts(docs: DataFrame, split: Split) -> DataFrame:
    """(token binary, n long): occurrences of each distinct token of ``docs.text``, combined
    in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text))
                if len(seen) >= FLUSH:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_bound(table: DataFrame, most: int = MOST_FREQUENT) -> int:
    """The smallest power of two ``f`` such that at most ``most`` tokens occur ``f`` times or
    more, from a histogram of at most 64 rows."""
    bins = {r.b: r["count"] for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}
    total = 0
    for b in range(63, -1, -1):
        total += bins.get(b, 0)
        if total > most:
            return 1 << (b + 1)
    return 1


def summed(docs: DataFrame, keep: list[str], split: Split, table: DataFrame, values: dict[str, str], absent: dict[str, float | int]) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with, for each value, its sum over the row's tokens.

    ``table``: (key binary, n long, values...), one row per distinct token; ``values``: name to
    SQL type (long or double); ``absent``: the value of a token that ``table`` lacks. A row
    without tokens sums to zero.
    """
    spark = docs.sparkSession
    names = list(values)
    bound = frequent_bound(table)
    frequent = spark.sparkContext.broadcast({bytes(r.key): tuple(r[v] for v in names) for r in table.where(F.col("n") >= bound).select("key", *names).toLocalIterator()})
    rare = table.where(F.col("n") < bound).select("key", *(F.col(v).alias(f"rare_{v}") for v in names))
    kept = [(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    source = docs.select(F.monotonically_increasing_id().alias("row"), "text", *(F.col(c).alias(k) for (k, _), c in zip(kept, keep)))
    schema = f"row long, {''.join(f'{k} {t.simpleString()}, ' for k, t in kept)}{''.join(f'{v} {t}, ' for v, t in values.items())}key binary, freq long"
    kinds = [{"long": pa.int64(), "double": pa.float64()}[t] for t in values.values()]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sums, at, keys, freqs = [[] for _ in names], [], [], []
            for row, text in zip(rows, texts):
                total = [0] * len(names)
                for token, n in Counter(split(text)).items():
                    if (found := known.get(k := key_of(token))) is None:
                        at.append(row)
                        keys.append(k)
                        freqs.append(n)
                    else:
                        for i, v in enumerate(found):
                            total[i] += v * n
                for s, v in zip(sums, total):
                    s.append(v)
            own = pa.array([b"\x00%d" % r for r in rows], pa.binary())  # matches nothing and spreads
            columns = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.record_batch([batch.column(0), *columns, *(pa.array(s, k) for s, k in zip(sums, kinds)), own, pa.nulls(len(rows), pa.int64())], names=fields)
            if keys:
                none = [pa.nulls(len(keys), c.type) for c in columns]
                yield pa.record_batch([pa.array(at, pa.int64()), *none, *(pa.nulls(len(keys), k) for k in kinds), pa.array(keys, pa.binary()), pa.array(freqs, pa.int64())], names=fields)

    fields = ["row", *(k for k, _ in kept), *names, "key", "freq"]
    parts = source.mapInArrow(look_up, schema).join(rare, "key", "left")
    looked = [F.coalesce(F.col(v), F.coalesce(F.col(f"rare_{v}"), F.lit(absent[v]).cast(t)) * F.col("freq")).alias(v) for v, t in values.items()]
    out = parts.select("row", *(k for k, _ in kept), *looked).groupBy("row").agg(*(F.max(k).alias(k) for k, _ in kept), *(F.sum(v).alias(v) for v in names))
    return out.select(*(F.col(k).alias(c) for (k, _), c in zip(kept, keep)), *names)
