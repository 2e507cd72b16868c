"""Quality by compression: how much better good text's dictionary serves a text than bad text's.

One zstandard dictionary is built from blocks of good texts and one from blocks of bad texts.
A text is compressed block by block with both; the normalised difference of the two sizes, the
size per byte and the length give a score through a logistic fit on further labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civitas.llm.common import documents, held_out, staged, tune

#: Labelled texts of a class for its dictionary, whole, and again for the fit (about); bytes of the blocks
#: they are cut into; a dictionary's bytes; bytes compressed at once; zstandard's level.
SAMPLE, CUT, DICTIONARY, CHUNK, LEVEL = 2000, 512, 112_640, 1024, 3
#: Bytes of the whole texts of a class that come to the driver for its dictionary; the first comes in any case.
MOST_BYTES = 64 << 20


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; where the blocks are too few to train on, the blocks themselves, joined, up to its size."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[:DICTIONARY]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    of = zstandard.ZstdCompressionDict(data) if data else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=of, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Quality:
    """Fitted dictionaries and logistic weights over standardised features."""

    good: bytes
    bad: bytes
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Difference of the compressed sizes over their sum, good size per byte, log of the bytes."""
        by = [compressor(d) for d in (self.bad, self.good)]
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "replace")
            if data:
                bad, good = (sum(len(c.compress(data[at : at + CHUNK])) for at in range(0, len(data), CHUNK)) for c in by)
                out[i] = (bad - good) / (bad + good), good / len(data), np.log(len(data))
        return out

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = np.c_[_squares((sizes - self.middle) / self.spread), np.ones(len(sizes))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _squares(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -4, 4)
    return np.c_[x, x**2, *(x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of ``x`` is the constant."""
    w, r = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(r), x.T @ (weight * (y - p)) - r * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Quality | float:
    """Learn from ``docs`` (doc_id, text) and their ``labels`` (doc_id, quality 0 or 1): about ``sample``
    texts of each class for its dictionary and as many others for the fit, chosen by a hash of
    the id; a dictionary takes whole texts in that order up to ``MOST_BYTES``. Labels of other ids than those of
    ``docs``, and of null or empty texts, count for nothing. With labels of one class only or none, the share of class 1 (0.5: none)."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes > 0")
    known = staged(sizes.join(known, "doc_id"), "labelled")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    rate = {q: min(0.5, sample / n) for q, n in counts.items()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000 / F.when(F.col("quality") == 1, rate[1]).otherwise(rate[0])
    chosen = known.withColumn("place", place).where("place < 2")  # about 4 * sample rows: few enough to be in one window and to broadcast
    before = F.sum("bytes").over(Window.partitionBy("quality").orderBy("place", "doc_id", "bytes").rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("fits", (F.col("before") == 0) | (F.col("before") + F.col("bytes") <= MOST_BYTES))
    chosen = staged(chosen.select("doc_id", "quality", "place", "fits"), "chosen").distinct()
    texts = docs.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(chosen), "doc_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, out = [], []
            for q, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "replace")
                for at in range(0, len(data), CUT):
                    quality.append(q)
                    out.append(data[at : at + CUT])
            yield pa.record_batch([pa.array(quality, pa.int32()), pa.array(out, pa.binary())], ["quality", "block"])

    parts = texts.where("place < 1 AND fits").select("quality", "text").mapInArrow(blocks, "quality int, block binary").toArrow()
    own = {q: sorted(b for k, b in zip(parts["quality"].to_pylist(), parts["block"].to_pylist()) if k == q) for q in (0, 1)}
    rng = np.random.default_rng(3)
    model = Quality(*(dictionary([own[q][i] for i in rng.permutation(len(own[q]))]) for q in (1, 0)), np.zeros(3), np.ones(3), np.zeros(10))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.sizes(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), *(pa.array(c) for c in x.T)], ["quality", "a", "b", "c"])

    got = texts.where("place >= 1").select("quality", "text").mapInArrow(measure, "quality int, a double, b double, c double").toArrow()
    y = got["quality"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return counts[1] / sum(counts.values())
    x = np.stack([got[k].to_numpy() for k in "abc"], 1)
    x = x[order := np.lexsort(x.T)]
    y = y[order]
    model.middle, model.spread = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic(np.c_[_squares((x - model.middle) / model.spread), np.ones(len(x))], y, np.where(y == 1, 1 / rate[1], 1 / rate[0]) * min(rate.values()))
    return model


def score(docs: DataFrame, model: Quality | float, least: float = 0.3) -> DataFrame:
    """``doc`` (all columns of ``docs`` as a struct), score and predicted (score >= ``least``).

    Whole texts are scored; a null or empty text gets the score of no bytes. Columns of ``docs``
    may have any names; repeated rows are scored alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.struct("*").alias("doc"), "text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(1).to_pylist(), shared.value
            found = own.score(own.sizes(texts)) if isinstance(own, Quality) else np.full(len(texts), own)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["doc", "score"])

    out = source.mapInArrow(rate, T.StructType([source.schema["doc"]]).add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, by a model of the labelled ones that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = fit(docs.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc.doc_id", "doc.held_out", "score", "predicted")
