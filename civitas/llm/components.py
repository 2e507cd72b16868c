"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitas.llm.common import staged


def _toward_least(edges: DataFrame) -> DataFrame:
    """Every neighbour v of u with the least of u and its neighbours, u included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _toward_least(down)
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) reaches, for all but
    the least nodes themselves.

    Loops, repeated edges and either direction are allowed; an edge with a null end is none. The
    rounds grow with the logarithm of the longest path; each is written to the shared folder.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        if (seen := tuple(now.agg(F.count("*"), sums).first())) == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
        now = staged(_small(_large(now)).where("u <> v").distinct(), "edges")
