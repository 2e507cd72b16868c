"""Aggregates over ranges of an ordered column by running totals: no pair of rows is ever made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitas.staging import staged


def running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``run_<c>``, the sum of the long column c over all rows up to and with its own in ``order``, exactly; nulls count 0.

    Rows are sorted into ranges and summed in each; what the ranges before it hold is added to each. The table is written to the shared
    folder, and one row of sums for each range comes to the driver. ``order`` must be total for the result to be the same each time.
    """
    names = [f"run_{c}" for c in sums]
    at = [df.columns.index(c) for c in sums]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = [0] * len(at), TaskContext.get().partitionId()
        for batch in batches:
            columns = []
            for i, k in enumerate(at):
                total = np.cumsum(batch.column(k).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) + before[i]
                before[i] = int(total[-1]) if len(total) else before[i]
                columns.append(pa.array(total, pa.int64()))
            yield pa.record_batch([*batch.columns, *columns, pa.array(np.full(batch.num_rows, part, np.int64))], [*batch.schema.names, *names, "__part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {n} long" for n in names) + ", __part long"
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), "running")
    totals = rows.groupBy("__part").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")).alias(c) for c in sums)).orderBy("__part").collect()
    starts, now = [], [0] * len(sums)
    for r in totals:
        starts.append((r["__part"], *map(str, now)))
        now = [a + int(r[c]) for a, c in zip(now, sums)]
    parts = df.sparkSession.createDataFrame(starts, "__part long" + "".join(f", start_{k} string" for k in range(len(sums))))
    both = rows.join(F.broadcast(parts), "__part")
    return both.select(*df.columns, *((F.col(n).cast("decimal(38,0)") + F.col(f"start_{k}").cast("decimal(38,0)")).alias(n) for k, n in enumerate(names)))


def totals_within(left: DataFrame, right: DataFrame, at: str, r_at: str, width: int, values: dict[str, str]) -> DataFrame:
    """``left`` with ``matches``, how many rows of ``right`` have |at - r_at| < ``width`` (all long), and for each of ``values`` (new name: long column of
    ``right``) the sum over these rows, as a decimal; 0 where there are none, or where ``at`` is null. A null value counts 0.

    Both sides are reduced to one row for each time; a range is the difference of two running totals. So the work is that of a sort of both
    sides, however many rows lie in a range.
    """
    none = [F.lit(0).cast("long").alias(c) for c in ("matches", *values)]
    times = left.where(F.col(at).isNotNull()).select(F.col(at).alias("time")).distinct()
    marks = right.where(F.col(r_at).isNotNull()).groupBy(F.col(r_at).alias("t")).agg(F.count("*").alias("matches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in values.items()))
    marks = marks.select("t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("time"), "matches", *values)
    # of equal times the end of a range stands before, and its start after, the rows: neither border belongs to it
    bound = lambda kind, shift: times.select((F.col("time") + shift).alias("t"), F.lit(kind).alias("kind"), "time", *none)
    rows = running(marks.unionByName(bound(0, width)).unionByName(bound(2, -width)), ["t", "kind"], ["matches", *values]).where("kind <> 1")
    sign = F.when(F.col("kind") == 0, 1).otherwise(-1)
    found = rows.groupBy("time").agg(*(F.sum(sign * F.col(f"run_{c}")).alias(c) for c in ("matches", *values)))
    both = left.join(found, F.col(at) == F.col("time"), "left").drop("time")
    return both.withColumns({"matches": F.coalesce("matches", F.lit(0)).cast("long"), **{n: F.coalesce(n, F.lit(0).cast("decimal(38,0)")) for n in values}})
