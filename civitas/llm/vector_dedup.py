"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one node. A node has a signature, the signs of its products with random directions; each pass
orders all nodes lexicographically by its own 32 of these bits and compares every node with its
``WINDOW`` neighbours on either side. Pairs whose signatures allow it are verified by exact cosines, and the verified pairs of all passes are united.

A pair of cosine c stands within the window in one pass with probability about (1 - acos(c) / pi) ** log2(n / WINDOW),
so there are as many passes as a pair of cosine ``COSINE`` needs to be missed once in ``1 / MISSED`` times. A dense group can be larger than
every window: the nodes that the passes united are therefore compared in full, block by block, to count links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import finite, grouped, staged, tune
from civitas.llm.components import components
from civitas.llm.dedup import HOT, hot_join
from civitas.operators.order import ranked

#: Least cosine of a link, neighbours compared on either side, bits that order a pass.
COSINE, WINDOW, BITS = 0.95, 32, 32
#: Share of the pairs at the least cosine that all passes together may miss; least passes; standard deviations below the
#: mean that a pair's equal bits may lie.
MISSED, LEAST_PASSES, DEVIATIONS = 5e-4, 12, 4.5
#: Rows of a block of the order, nodes of a block of a component.
ROWS, BLOCK = 2048, 1024


def passes(n: int) -> int:
    """How many passes ``n`` nodes need."""
    once = (1 - math.acos(COSINE) / math.pi) ** math.ceil(math.log2(max(2.0, n / WINDOW)))
    return max(LEAST_PASSES, math.ceil(math.log(MISSED) / math.log(1 - once)))


@functools.cache
def directions(size: int, bits: int) -> np.ndarray:
    return np.random.default_rng((size, 12)).normal(size=(size, bits))


def units(column: pa.Array) -> list[np.ndarray]:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    values, at = np.asarray(column.flatten(), np.float64), np.cumsum([0, *column.value_lengths().to_numpy()])
    each = [values[a:b] / np.abs(values[a:b]).max() for a, b in zip(at, at[1:])]
    return [x / np.sqrt(x @ x) for x in each]


def signatures(nodes: DataFrame, count: int) -> DataFrame:
    """(turn, size, head, node, key, bits): for each of ``count`` passes the 32 bits that order it; size: components."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            every = [np.packbits(x @ directions(len(x), count * BITS) > 0) for x in units(batch.column(2))]
            heads = np.stack(every).view(">u4").astype(np.int64)
            n, size = len(every), batch.column(2).value_lengths().cast(pa.int64())
            again = pa.array(np.repeat(np.arange(n), count))
            yield pa.record_batch([pa.array(np.tile(np.arange(count), n)), size.take(again), pa.array(heads.ravel()), batch.column(0).take(again), batch.column(1).take(again), pa.array([x.tobytes() for x in every], pa.binary()).take(again)], ["turn", "size", "head", "node", "key", "bits"])

    return nodes.select("node", "key", "embedding").mapInArrow(sign, "turn long, size long, head long, node long, key string, bits binary")


def window_pairs(signed: DataFrame, count: int) -> DataFrame:
    """The distinct pairs (u, v) of nodes in one window of a pass whose signatures allow a link."""
    total = count * BITS
    equal = 1 - math.acos(COSINE) / math.pi
    least = int(total * equal - DEVIATIONS * math.sqrt(total * equal * (1 - equal)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 1):
            own, turn, size, node = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
            bits = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint32).reshape(len(node), -1)
            for d in range(1, min(WINDOW, len(node) - 1) + 1):
                near = np.flatnonzero(own[d:] & (turn[d:] == turn[:-d]) & (size[d:] == size[:-d]) & (node[d:] != node[:-d]))
                near = near[total - np.bitwise_count(bits[near + d] ^ bits[near]).sum(1, dtype=np.int64) >= least]
                if len(near):
                    a, b = node[near], node[near + d]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    order = ranked(signed, ["turn", "size", "head", "node", "key"], "place")
    block, at = F.floor(F.col("place") / ROWS), F.col("place") % ROWS
    # the last rows of a block are also the first of the next, which compares its own with them
    to = F.when(at >= ROWS - WINDOW, F.array(block, block + 1)).otherwise(F.array(block))
    rows = order.select(F.explode(to).alias("block"), "place", "turn", "size", "node", "bits").withColumn("own", F.floor(F.col("place") / ROWS) == F.col("block"))
    rows = rows.select("block", "place", "own", "turn", "size", "node", "bits").repartition("block").sortWithinPartitions("block", "place")
    return rows.mapInArrow(compare, "u long, v long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose vectors have a cosine of ``COSINE`` or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = units(batch.column(2)), units(batch.column(3))
                good = [len(a) == len(b) and a @ b >= COSINE for a, b in zip(x, y)]
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    own = lambda c, x: nodes.select(F.col("node").alias(c), F.col("embedding").alias(x))
    return pairs.join(own("u", "x"), "u").join(own("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(check, "u long, v long").distinct()


def link_counts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(key, links) of the nodes in the components ``found`` (node, component): rows of other nodes that a
    node's vector is linked with. Each pair of blocks of a component is one group, of which only counts are given on."""
    roots = found.select("component").distinct().select(F.col("component").alias("node"), "component")
    members = staged(nodes.join(found.unionByName(roots), "node").withColumn("size", F.size("embedding").cast("long")), "members")
    sizes = members.groupBy("component", "size").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    large = sizes.where(F.col("blocks") > HOT // BLOCK).select("component").distinct()
    members = hot_join(members.withColumn("at", F.struct("component", "size")), sizes.select(F.struct("component", "size").alias("at"), "blocks"), "at", sizes.join(large, "component", "left_semi").select(F.struct("component", "size").alias("at")))
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    rows = members.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", "size", F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"), "own", "node", "key", "rows", "embedding")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 4):
            p, q = (group.column(k)[0].as_py() for k in (2, 3))
            own, node, weight = (group.column(k).to_numpy() for k in (4, 5, 7))
            x = np.stack(units(group.column(8)))
            linked = (x @ x.T >= COSINE) & (node[:, None] != node)
            if p != q:
                linked &= own[:, None] != own
            yield pa.record_batch([group.column(6), pa.array((linked * weight).sum(1))], ["key", "links"])

    keys = ["component", "size", "p", "q"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "key string, links long").groupBy("key").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Linked: another id's vector of as many components with a cosine of 0.95 or more, in double precision. A vector that is null, empty or
    zero or that has a null or non-finite component links with nothing. Rows with one id are one vertex of the graph; equal rows are one vector. A row with a
    null id takes no part: its component is null and it isn't kept. Other columns are ignored; an empty table gives an empty result.
    """
    tune(vectors.sparkSession)
    part = F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    key = F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "embedding")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(part, F.lit(False)).alias("part")).withColumn("key", F.when(F.col("part"), key))
    keyed = staged(rows.select("vec_id", "key", F.when(F.col("part"), F.col("embedding")).alias("embedding")), "vectors")
    ids = keyed.where("key IS NOT NULL").groupBy("key", "vec_id").agg(F.first("embedding").alias("embedding"))
    nodes = staged(ids.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("rows"), F.first("embedding").alias("embedding")), "nodes")
    count = passes(nodes.count())
    edges = verified(window_pairs(signatures(nodes, count), count), nodes)
    # several ids with one vector, or several vectors with one id, are one vertex
    found = staged(components(edges), "components")
    links = staged(link_counts(nodes, found), "links")
    classes = nodes.select("key", "node", "rows").join(found, "node", "left").join(links, "key", "left")
    classes = staged(classes.select("key", (F.col("rows") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"), F.coalesce("component", "node").alias("component_id"), "rows"), "classes")
    own = hot_join(keyed.where("key IS NOT NULL").select("vec_id", "key"), classes.drop("rows"), "key", classes.where(F.col("rows") > HOT).select("key"))
    rest = keyed.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.select("vec_id", "n_links", "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all embeddings: vec_id, n_links, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT u, w FROM links UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u), least AS (SELECT u, min(w) AS m FROM reach GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(least.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(least.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN least ON least.u = e.vec_id"""
