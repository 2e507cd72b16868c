"""Nearest neighbours by additive quantisation, confirmed exactly.

A unit vector is the sum of one word from each of ``BOOKS`` full-dimensional codebooks, chosen
by beam search over the residuals; its code, the norm of the sum and what the sum misses of the vector
are stored. A query scores all codes through tables of its products with the words. The best are compared
exactly, which gives each query a bound; every vector whose code leaves it a chance to reach that bound is
compared exactly too, so none is missed however close vectors lie. Equal vectors are indexed once, with the
ids that a result can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitas.llm.common import staged, tune

#: Codebooks, words of each, kept beams, vectors to fit on (about), candidates that give a query's bound.
BOOKS, WORDS, BEAMS, SAMPLE, CANDIDATES = 16, 256, 4, 16_384, 200
#: Least and most codes of a search task (of 64 dimensions), queries of a broadcast and of a table.
LEAST_OF_TASK, PER_TASK, QUERIES, AT_ONCE = 4096, 32_768, 16_384, 64
#: More than float32 errs in a product of unit vectors and in the sum of a code's products.
SLACK, CODE_SLACK = 1e-5, 1e-4


@dataclass
class Codebooks:
    """``words``: books x words x dimensions."""

    words: np.ndarray

    def encode(self, vectors: np.ndarray, beams: int = BEAMS) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the norms of their sums, by beam search: at each book the ``beams`` best
        (beam, word) extensions by squared residual stay."""
        n = len(vectors)
        left, codes = vectors[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
        for book in self.words:
            cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beams, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep]
            beam, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            left = left[rows, beam] - book[word]
            codes = np.concatenate([codes[rows, beam], word[:, :, None].astype(np.uint8)], 2)
        at = (left**2).sum(2).argmin(1)
        codes = codes[np.arange(n), at]
        return codes, np.linalg.norm(self.decode(codes), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.words))


def _means(book: np.ndarray, near: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each word of ``book`` as the mean of the rows of ``of`` that are ``near`` it; others as they are."""
    order = np.argsort(near, kind="stable")
    named, first = np.unique(near[order], return_index=True)
    out = book.copy()
    out[named] = np.add.reduceat(of[order], first, axis=0) / np.diff(first, append=len(order))[:, None]
    return out


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 4, sweeps: int = 3) -> Codebooks:
    """Codebooks for unit vectors: k-means of each residual in turn, then least squares over all words
    for the sample's beam-search codes, solved book by book: with the other books as they are, the
    best words are means of what the others leave over. Memory follows the sample alone."""
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float32)
    left, out = sample.copy(), []
    near = np.zeros(len(left), np.int64)

    def assign(book: np.ndarray) -> None:
        norm = (book**2).sum(1)
        for at in range(0, len(left), 2048):
            near[at : at + 2048] = (norm - 2 * left[at : at + 2048] @ book.T).argmin(1)

    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(8):
            assign(book)
            empty = np.bincount(near, minlength=words) == 0
            book = _means(book, near, left)
            book[empty] = left[rng.integers(0, len(left), int(empty.sum()))]
        assign(book)
        left -= book[near]
        out.append(book)
    model = Codebooks(np.stack(out))
    codes = np.concatenate([model.encode(sample[at : at + 512])[0] for at in range(0, len(sample), 512)])
    left = sample - model.decode(codes)
    for _ in range(sweeps):
        for book, near in zip(model.words, codes.T):
            left += book[near]
            book[:] = _means(book, near, left)
            left -= book[near]
    return model


def unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors`` (vec_id, embedding) that take part: an id, and a vector of the
    commonest dimension, neither zero nor with a null or non-finite component."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("embedding", lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (most.d if most else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, candidates: int = CANDIDATES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` of largest cosine for each row of
    ``queries`` (both vec_id, embedding), its own id left out; ties to the smaller vec_id.

    Vectors null, zero, of another than the commonest dimension or with a null or non-finite
    component take no part, on either side; fewer than ``k`` candidates give fewer ranks. Rows
    with one id and different vectors count as several; repeated rows as one. No queries or
    no vectors give no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors).withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding"))
    order = Window.partitionBy("h", "g").orderBy("vec_id")
    # the ids of equal vectors that a result can need: k and the query's own
    members = staged(rows.dropDuplicates(["h", "g", "vec_id"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1), "members")
    classes = members.where("place = 1").select(F.col("vec_id").alias("class"), "embedding", "h", "g")
    total, named = classes.agg(F.count("*"), F.count_distinct("class")).first()
    asked = staged(usable(queries).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id"), "queries")
    count = asked.count()
    if not total or not count:
        return spark.createDataFrame([], schema)

    part = F.pmod(F.xxhash64("class", F.lit(3)), F.lit(1_000_000_000)) < 1_000_000_000 * min(1.0, sample / total)
    chosen = classes.where(part).orderBy("class").limit(2 * sample).select("embedding").toArrow()
    model = spark.sparkContext.broadcast(fit(unit((chosen if len(chosen) else classes.limit(1).select("embedding").toArrow())["embedding"].combine_chunks())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(3))
            codes, norms = model.value.encode(x)
            gaps = np.linalg.norm(x - model.value.decode(codes), axis=1)
            yield pa.record_batch([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(gaps.astype(np.float32))], ["class", "h", "g", "embedding", "code", "norm", "gap"])

    # what a task gives doesn't depend on the number of tasks, so neither does the result
    most = max(LEAST_OF_TASK // 4, PER_TASK * 64 // max(64, model.value.words.shape[2]))
    tasks = max(-(-total // most), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_OF_TASK)))
    coded = classes.select("class", "h", "g", "embedding").repartition(tasks, "class").mapInArrow(encode, "class long, h long, g long, embedding array<double>, code binary, norm float, gap float")
    index = staged(coded, "codes").repartition(tasks, "class")
    blocks = -(-count // QUERIES)
    in_block = lambda b: asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
    # one block of queries at a time is at the driver and the tasks
    found = reduce(DataFrame.unionByName, [_search(index, in_block(b), model, k, candidates) for b in range(blocks)])
    # a result's class is among the first k + 1, one of which can be the query's own; ids with several vectors push it further back
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class", "h", "g")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1 + total - named).select("query_id", "h", "g", "score")
    every = found.join(members.select("h", "g", "vec_id"), ["h", "g"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of one vector and many, each row for itself, so that they don't depend on the other rows."""
    return (q * v).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def _search(index: DataFrame, asked: DataFrame, model, k: int, candidates: int) -> DataFrame:
    """(query_id, class, h, g, score): of each task the vectors that can be among the ``k`` nearest of each query of a block, as a
    table in the shared folder. These are the best k + 1, as one can be the query's own, and one more for each id that a task holds again."""
    table = asked.toArrow()
    ids, vectors = table["query_id"].to_numpy(), np.asarray(table["embedding"].combine_chunks().flatten(), np.float64).reshape(len(table), -1) if len(table) else None
    block = index.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = block.value
        held = [b for b in batches if b.num_rows]
        if not held or vectors is None:
            return
        own, h, g = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
        order = np.lexsort((g, h, own))  # ties go to the smaller id
        own, h, g = own[order], h[order], g[order]
        whole = np.concatenate([np.asarray(b.column(3).flatten(), np.float64) for b in held]).reshape(len(own), -1)[order]
        codes = np.frombuffer(b"".join(x for b in held for x in b.column(4).to_pylist()), np.uint8).reshape(len(own), -1)[order].astype(np.int64)
        norms, gaps = (np.concatenate([b.column(c).to_numpy() for b in held])[order] for c in (5, 6))
        held.clear()
        units = (whole / np.linalg.norm(whole, axis=1, keepdims=True)).astype(np.float32)
        wanted = min(k + 1 + len(own) - len(np.unique(own)), len(own))
        first = min(max(candidates, wanted), len(own))
        for at in range(0, len(ids), AT_ONCE):
            some = vectors[at : at + AT_ONCE]
            asks = (some / np.linalg.norm(some, axis=1, keepdims=True)).astype(np.float32)
            near = np.zeros((len(some), len(own)), np.float32)
            for m, book in enumerate(model.value.words):
                near += (asks @ book.T)[:, codes[:, m]]
            best = np.argpartition(-near / np.maximum(norms, 1e-12), first - 1, axis=1)[:, :first]
            exact = np.einsum("qd,qcd->qc", asks, units[best])
            bound = np.partition(exact, first - wanted, axis=1)[:, first - wanted] - SLACK - CODE_SLACK
            near += gaps
            rest = np.flatnonzero((near >= bound[:, None]).any(axis=0))
            rows, scores, sizes = [], [], []
            for vector, close in zip(some, asks @ units[rest].T):
                least = np.partition(close, len(rest) - wanted)[len(rest) - wanted] - 2 * SLACK
                mine = rest[close >= least]
                score = _cosines(vector, whole[mine])
                top = np.argsort(-score, kind="stable")[:wanted]
                rows.append(mine[top])
                scores.append(score[top])
                sizes.append(len(top))
            rows = np.concatenate(rows)
            yield pa.record_batch([pa.array(np.repeat(ids[at : at + AT_ONCE], sizes)), pa.array(own[rows]), pa.array(h[rows]), pa.array(g[rows]), pa.array(np.concatenate(scores))], ["query_id", "class", "h", "g", "score"])

    found = staged(index.mapInArrow(search, "query_id long, class long, h long, g long, score double"), "found")
    block.unpersist()
    return found


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
