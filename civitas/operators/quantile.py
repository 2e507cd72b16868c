"""An exact quantile of a column of any size."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_quantile(df: DataFrame, column: str, q: float, few: int = 100_000) -> float | None:
    """The quantile with linear interpolation between neighbours; nulls don't count, None without values.

    An approximate quantile from bounded sketches gives bounds of where it lies; rows between them
    are counted and bounded again until few are left, which are ranked. So no task holds all values.
    """
    part = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = left = part.count()
    if not n:
        return None
    at = q * (n - 1)
    k, below, margin = floor(at), 0, 0.002
    while left > few:
        rank = (k - below) / (left - 1)
        low, high = part.approxQuantile("x", [max(0.0, rank - margin), min(1.0, rank + margin)], margin / 4)
        less, inside = part.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
        if not (less <= k - below and min(k + 1, n - 1) - below < less + inside):
            margin *= 4  # the bounds miss it
            if margin > 1:
                break
            continue
        below, part = below + less, part.where(F.col("x").between(low, high))
        if low == high:
            return low
        if inside == left:
            break
        left = inside
    first, *second = (r.x for r in part.orderBy("x").offset(k - below).limit(2).collect())
    return first + (at - k) * ((second or [first])[0] - first)
