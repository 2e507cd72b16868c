"""Exact positions in a global order, without a single task that holds all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitas.staging import staged


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its rows' positions from 0 in ascending ``order`` (nulls first), which must be total for the
    result to be the same each time.

    Rows are sorted into ranges, and each range is numbered from the count of rows before it. The table is
    written to the shared folder, sorted; only a count of each range comes to the driver.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = staged(sorted_rows, "ranked").withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part").count().orderBy("__part").collect()
    starts = accumulate((r["count"] for r in sizes[:-1]), initial=0)
    parts = df.sparkSession.createDataFrame([(r["__part"], at) for r, at in zip(sizes, starts)], "__part long, __start long")
    inside = F.col("__at") - F.shiftleft("__part", 33)
    return rows.join(F.broadcast(parts), "__part").withColumn(name, F.col("__start") + inside).select(*df.columns, name)
