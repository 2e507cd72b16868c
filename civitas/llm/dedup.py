"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets.

Documents with equal shingle sets are one node. A node has ``HALVES`` left and ``HALVES`` right
half-keys of ``ROWS`` minhashes each; its table keys are all pairs of a left and a right half,
so ``HALVES`` squared tables of ``2 * ROWS`` minhashes need only ``2 * HALVES * ROWS`` minhashes.
Two sets of similarity s share a key with probability (1 - (1 - s**ROWS)**HALVES)**2: 0.9997 at
0.75. Only halves that some other node shares are expanded to keys.

Every node of a bucket is first compared with the bucket's hub, a number of pairs in proportion
to the nodes. After that, only buckets whose nodes are still in different components are compared
pair by pair, in blocks, on the minhash sketches. A pair is linked on its full sets alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import Memo, documents, named, staged, tune, words_of
from civitas.llm.components import components

WIDTH, PERCENT = 5, 75
HALVES, ROWS = 16, 3
HASHES = 2 * HALVES * ROWS
#: Sketch positions that must agree before a pair is confirmed: 3.8 standard deviations below 0.75.
AGREE = 56
#: One-bit minhashes that pairs in different components are compared on before their texts travel, and
#: the positions that must agree: 4 standard deviations below what similarity 0.75 gives.
BITS = 2048
AGREE_BITS = int(BITS * (0.875 - 4 * (0.875 * 0.125 / BITS) ** 0.5))
#: Members of a bucket's block, texts sent with one copy of a hub, and rows up to which a plan is broadcast.
BLOCK, PER_HUB, MOST_BROADCAST = 1024, 512, 1_000_000
#: Rows of one key from which a join doesn't deal them to one task.
HOT = 1024

_SEED = np.random.default_rng(20)
_A = _SEED.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _SEED.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = (out * _P) ^ mixed(h[k : k + n])
    return np.unique(mixed(out))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes of non-empty sets, a row for each."""
    every = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(every * a + b, starts) for a, b in zip(_A, _B)], 1)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, halves, sketch, marks) of every row; the last four are null
    for an empty set. Marks: 32 bits of each half."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes().hold()
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            keys = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
            low = minhashes(some) if some else np.zeros((0, HASHES), np.uint32)
            halves = np.full((len(some), 2 * HALVES), 7, np.uint64)
            for k in range(ROWS):
                halves = mixed(halves * _P ^ low[:, k::ROWS].astype(np.uint64))
            sketch, marks, halves = iter(low.astype(np.uint8)), iter(halves.astype(np.uint32)), iter(halves.view(np.int64))
            yield pa.record_batch([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                pa.array([next(halves) if k else None for k in keys], pa.list_(pa.int64())), *(pa.array([next(x).tobytes() if k else None for k in keys], pa.binary()) for x in (sketch, marks)),
            ], ["doc_id", "n_shingles", "set_key", "halves", "sketch", "marks"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, halves array<long>, sketch binary, marks binary")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, i, j, node) for each table key of each node, of the half-keys that another node
    shares; i and j number the halves."""
    halves = nodes.select("node", F.posexplode("halves").alias("i", "half"))
    shared = halves.groupBy("i", "half").count().where("count > 1").select("i", "half")
    own = staged(halves.join(shared, ["i", "half"]), "halves")
    left = own.where(F.col("i") < HALVES)
    right = own.where(F.col("i") >= HALVES).select("node", F.col("i").alias("j"), F.col("half").alias("other"))
    return left.join(right, "node").select(F.xxhash64("i", "half", "j", "other").alias("key"), F.col("i").cast("byte").alias("i"), F.col("j").cast("byte").alias("j"), "node")


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (a row a key) on ``key``, of which ``hot`` has the values with many rows
    on the left: their few rows on the right are broadcast, so no such group is dealt to one task."""
    hot = staged(hot, "hot")
    n = hot.count()
    if not n or n > MOST_BROADCAST // 16:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(staged(right.join(hot, key, "left_semi"), "hot_rows"))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def _hub_order(key) -> F.Column:
    """One of four orders of the nodes, as a mask to apply before taking the least."""
    return F.shiftrightunsigned(F.xxhash64(F.pmod(key, F.lit(4))), 1)


def hub_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The (key, i, j, node, n) of buckets with n > 1 nodes, and the distinct pairs (hub, node)."""
    order = _hub_order(F.col("key"))
    hubs = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(order)).alias("least")).where("n > 1")
    hubs = hubs.select("key", "n", F.col("least").bitwiseXOR(order).alias("hub"))
    hubs = staged(hubs, "hubs")
    shared = staged(hot_join(members, hubs, "key", hubs.where(F.col("n") > HOT).select("key")), "buckets")
    return shared, shared.where("hub <> node").select("hub", "node").distinct()


def bit_sketches(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, bits) for the distinct ``nodes`` (node): ``BITS`` one-bit minhashes of their sets."""
    rng = np.random.default_rng(21)
    odd, add = rng.integers(0, 1 << 32, BITS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, BITS, dtype=np.uint32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(1).to_pylist():
                own = (shingle_set(text) >> np.uint64(32)).astype(np.uint32)
                low = np.full(BITS, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(own), 256):
                    low = np.minimum(low, (own[at : at + 256, None] * odd + add).min(0))
                bits.append(np.packbits((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.binary())], ["node", "bits"])

    nodes = staged(nodes, "open_nodes")
    if nodes.count() <= MOST_BROADCAST:
        nodes = F.broadcast(nodes)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node")
    return texts.mapInArrow(sketch, "node long, bits binary").dropDuplicates(["node"])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (hub, node) whose set sizes and sketches allow a link."""
    own = lambda p: nodes.select(F.col("node").alias(p), F.col("n_shingles").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch"))
    least, most = F.least("hub_n", "node_n"), F.greatest("hub_n", "node_n")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(1) >= AGREE))

    pairs = staged(pairs, "hub_pairs")
    hot = pairs.groupBy("hub").count().where(F.col("count") > HOT).select("hub")
    both = hot_join(pairs.join(own("node"), "node"), own("hub"), "hub", hot).where(100 * least >= PERCENT * most)
    return both.select("hub", "node", "hub_sketch", "node_sketch").mapInArrow(agree, "hub long, node long")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) for the distinct pairs (hub, node) linked by their full sets.

    Each node's text travels to its hub's group; a hub with many nodes has several groups, each
    with a copy of its text, so no group has more than about ``PER_HUB`` texts.
    """
    pairs = staged(pairs, "pairs")
    copies = staged(pairs.groupBy("hub").agg(F.ceil(F.count("*") / PER_HUB).cast("int").alias("copies")), "copies")
    nodes = hot_join(pairs, copies, "hub", copies.where(F.col("copies") > HOT // PER_HUB).select("hub")).select(F.col("node").alias("id"), "hub", F.pmod(F.xxhash64("node"), "copies").cast("int").alias("part"))
    hubs = copies.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    plan = staged(nodes.unionByName(hubs), "plan")
    if plan.count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(plan, "id")
    dealt = texts.select("hub", "part", "id", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes().hold()
        group, own = None, []
        for batch in batches:
            u, v = [], []
            for hub, part, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, part) != group:
                    group, own = (hub, part), []
                s = shingle_set(text)
                if at == hub:
                    own.append(s)
                elif any(linked(s, o) for o in own):
                    u.append(hub)
                    v.append(at)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(confirm, "u long, v long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= 75 * union; empty sets never."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def open_pairs(shared: DataFrame, nodes: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(hub, node): pairs of a bucket in different components that sketches and sizes allow.

    Buckets are cut into blocks of about ``BLOCK`` nodes and each pair of blocks is a group. Of the
    tables that a pair shares only the first counts, so pairs are distinct.
    """
    rows = shared.where("n > 2").select("key", "i", "j", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_keys = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    rows = staged(rows.join(mixed_keys, "key"), "open_rows")
    rows = rows.join(nodes.select("node", "n_shingles", "marks"), "node").join(bit_sketches(rows.select("node").distinct(), docs), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "key"), blocks).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"), "i", "j", "own", "node", "component", "n_shingles", "marks", "bits")
    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            if row[:3] != group:
                yield from pairs(held)
                group, held = row[:3], []
            held.append(row)
        yield from pairs(held)

    def pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        _, p, q, i, j = held[0][:5]
        own, node, part, size = (np.array(x) for x in list(zip(*held))[5:9])
        marks = np.frombuffer(b"".join(r[9] for r in held), np.uint32).reshape(-1, 2 * HALVES)
        bits = np.frombuffer(b"".join(r[10] for r in held), np.uint64).reshape(-1, BITS // 64)
        for k in range(len(held)):
            near = np.flatnonzero((part != part[k]) & (node > node[k]) & ((own != own[k]) | (p == q)) & (100 * np.minimum(size, size[k]) >= PERCENT * np.maximum(size, size[k])))
            near = near[BITS - np.bitwise_count(bits[near] ^ bits[k]).sum(1) >= AGREE_BITS]
            same = marks[near] == marks[k]
            near = near[~(same[:, :i].any(1) | same[:, HALVES:j].any(1))]  # else an earlier table has the pair
            if len(near):
                yield pa.record_batch([pa.array(np.full(len(near), node[k]), pa.int64()), pa.array(node[near], pa.int64())], ["hub", "node"])

    return dealt.mapInArrow(compare, "hub long, node long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text, ...).

    Linked: shingle sets with 100 * intersection >= 75 * union. A null, empty or blank text has
    an empty set and is its own component. Rows with one id are one document. A row with a null
    id takes no part: its component is null and it isn't kept. Ids are integers, or cast to them: others
    raise an error. Other columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    signed = staged(signatures(docs), "signatures")
    some = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    sets = staged(some.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "sets")
    classes, copied = sets.select("set_key", "node"), sets.where(F.col("rows") > HOT).select("set_key")
    first = some.groupBy("doc_id", "set_key").agg(F.min("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"))
    nodes = staged(classes.join(first.withColumnRenamed("doc_id", "node"), ["set_key", "node"]), "nodes")
    shared, pairs = hub_pairs(bucket_members(nodes))
    tried = staged(likely(pairs, nodes), "tried")
    # rows of one id are one document, whatever their texts
    several = some.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a < b").select("doc_id")
    same = some.join(several, "doc_id", "left_semi").join(classes, "set_key").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    edges = staged(confirmed(tried, docs).unionByName(same), "links")
    found = components(edges)
    tried_both = tried.unionByName(tried.select(F.col("node").alias("hub"), F.col("hub").alias("node")))
    left = open_pairs(shared, nodes, found, docs).join(tried_both, ["hub", "node"], "left_anti")
    more = staged(confirmed(left, docs), "links")
    if not more.isEmpty():
        found = components(edges.unionByName(more))
    rows = hot_join(signed.select("doc_id", "n_shingles", "set_key"), classes, "set_key", copied, "left")
    nodes = rows.where("node IS NOT NULL").groupBy("node").count().where(F.col("count") > HOT).select("node")
    rows = hot_join(rows, found, "node", nodes, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one of smallest doc_id, and one
    row of it. Rows with a null id stay."""
    found = staged(near_duplicates(docs), "components")
    gone = found.where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    again = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    few = lambda ids: F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    again, gone = staged(again, "again"), staged(gone, "gone")
    names = [named(c) for c in docs.columns]
    rows = docs.join(few(gone), "doc_id", "left_anti").select(names)
    if again.isEmpty():
        return rows
    again = few(again)
    once = rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.join(again, "doc_id", "left_anti").unionByName(once).select(names)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
