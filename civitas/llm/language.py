"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary classifier over hashed byte n-grams says
how likely the languages with a 1 there are against those with a 0. Decoding takes the codeword
of least loss, bits weighted by how well they told the training texts apart, and flags a text
whose runner-up is close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civitas.llm.common import documents, held_out, slices, tune

#: Hash buckets of the n-grams, longest n-gram in bytes, and texts of a language to learn from (about).
BUCKETS, LONGEST, SAMPLE = 1 << 15, 4, 10_000
#: Languages whose counts are at one place at once.
AT_ONCE = 256
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)

# Bytes that stand for themselves in an n-gram: lower-case letters and all of UTF-8 beyond ASCII.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = range(97, 123)
_LETTER[128:] = range(128, 256)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1 and -1: all splits of the languages in two while they are few, else
    the best of random ones by least distance; no bit is constant."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        bits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(bits).T.astype(float)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best = max((rng.choice([-1.0, 1.0], (n, length)) for _ in range(50)), key=lambda c: ((c[:, None] != c[None]).sum(2) + length * np.eye(n)).min())
    return best[:, np.abs(best.sum(0)) < n]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams (1 to ``LONGEST`` bytes) of all texts and the number in each text.

    Letters are lower-cased, anything else is one space; grams that are only a space don't count.
    """
    flat, sizes = [], []
    for text in texts:
        # an upper-case text of bytes beyond ASCII is lower-cased as a string
        b = _LETTER[np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "replace"), np.uint8)]
        b = b[(b > 0) | np.concatenate([[True], b[:-1] > 0])]  # runs of spaces are one
        flat.append(b)
        sizes.append(len(b))
    every = np.concatenate(flat).astype(np.uint32) if flat else np.zeros(0, np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(every))
    out, keep = np.zeros((LONGEST, len(every)), np.uint32), np.zeros((LONGEST, len(every)), bool)
    h = np.zeros(len(every), np.uint32)
    for n in range(LONGEST):
        h = h * np.uint32(257) + np.pad(every[n:], (0, min(n, len(every))))
        out[n] = ((h ^ np.uint32(n)) * np.uint32(_MULT[n])) >> np.uint32(17)
        keep[n] = (at + n < ends) & ((every > 0) if n == 0 else True)
    counts = np.add.reduceat(keep.sum(0), np.cumsum([0, *sizes[:-1]])) if sizes else np.zeros(0, int)
    return out.T[keep.T], counts


@dataclass
class Codes:
    """A fitted model: languages, their codewords, and for each bit n-gram weights, an offset and a weight."""

    languages: list[str]
    code: np.ndarray
    table: np.ndarray
    scale: np.ndarray
    worth: np.ndarray

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text and a column for each bit; a text without n-grams has zeros."""
        found, counts = grams(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        some = counts > 0
        if some.any():
            starts = np.cumsum([0, *counts[some][:-1]])
            for k in range(out.shape[1]):
                out[some, k] = np.add.reduceat(self.table[k][found], starts) / np.sqrt(counts[some])
        return out * self.scale

    def decode(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and gap to the runner-up of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        margins = self.margins(texts)
        # a bit of 1 costs log(1 + exp(-margin)), one of -1 log(1 + exp(margin))
        loss = (np.logaddexp(0, -margins) * self.worth) @ (self.code > 0).T + (np.logaddexp(0, margins) * self.worth) @ (self.code < 0).T
        like = np.exp(loss.min(1, keepdims=True) - loss)
        like /= like.sum(1, keepdims=True)
        order = np.sort(like, 1)
        best = like.argmax(1)
        named = [self.languages[b] if t and any(c.isalpha() for c in t) else "und" for b, t in zip(best, texts)]
        score = np.where([n == "und" for n in named], 0.0, order[:, -1])
        return named, score, order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Codes:
    """Learn from ``docs`` (doc_id, text, lang): about ``sample`` texts of each language, chosen by
    a hash of the id; n-grams are counted by the tasks and arrive here summed.
    Every language is learned, in blocks of ``AT_ONCE``: memory follows the bits, not the languages.
    """
    tune(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Codes([], codewords(0), np.zeros((0, BUCKETS)), np.ones(0), np.ones(0))
    code, blocks = codewords(len(languages)), range(0, len(languages), AT_ONCE)

    def counted(at: int) -> np.ndarray:
        """The n-grams of a block of languages, a row for each."""
        return _counted(known, {k: min(1.0, sample / sizes[k]) for k in languages[at : at + AT_ONCE]})

    # several blocks are counted twice rather than kept
    kept = counted(0) if len(blocks) == 1 else None

    def rates(at: int) -> np.ndarray:
        own = counted(at) if kept is None else kept
        return (own + 0.5) / (own.sum(1, keepdims=True) + 0.5 * BUCKETS)  # languages weigh the same

    sums = np.zeros((2, code.shape[1], BUCKETS))
    for at in blocks:
        own = rates(at)
        for side, sign in enumerate((1, -1)):
            sums[side] += (code[at : at + AT_ONCE] == sign).T.astype(float) @ own
    ones = (code > 0).sum(0)[:, None]
    table = (np.log(sums[0] / ones) - np.log(sums[1] / (len(languages) - ones))).astype(np.float32)
    # what an n-gram of each language is worth to a bit on average: how surely the bit is told
    sure = np.full(code.shape[1], np.inf)
    for at in blocks:
        sure = np.minimum(sure, (rates(at) @ table.T * code[at : at + AT_ONCE]).min(0, initial=np.inf))
    sure = np.maximum(sure, 1e-6)
    return Codes(languages, code, table, np.ones(code.shape[1]), sure / sure.mean() if len(sure) else sure)


def _counted(known: DataFrame, rate: dict[str, float]) -> np.ndarray:
    """N-grams in texts of each language of ``rate``, of which that share is read."""
    place = {k: i for i, k in enumerate(rate)}
    part = F.create_map(*(F.lit(x) for kv in rate.items() for x in kv))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.try_element_at(part, F.col("lang")) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            langs = iter(batch.column(1).to_pylist())
            for texts in slices(batch.column(0).to_pylist()):
                lang = np.array([place[next(langs)] for _ in texts])
                found, counts = grams(texts)
                total += np.bincount(np.repeat(lang, counts) * BUCKETS + found, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["at", "n"])

    summed = chosen.select("text", "lang").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(place) * BUCKETS)
    out[summed["at"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(len(place), BUCKETS)


def identify(docs: DataFrame, model: Codes, least_gap: float = 0.2) -> DataFrame:
    """``doc`` (all columns of ``docs`` as a struct), lang_pred, score and ambiguous for every row.

    A null text or one without a letter is ``und`` with score 0. Whole texts are read; columns of
    ``docs`` may have any names. Ties go to the language that sorts first.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct("*").alias("doc"), "text")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.decode(texts) for texts in slices(batch.column(1).to_pylist())]
            named, score, gap = sum((p[0] for p in parts), []), *(np.concatenate([p[k] for p in parts] or [np.zeros(0)]) for k in (1, 2))
            lang = pa.array(named, pa.string())
            close = pa.array([bool(g < least_gap) or n == "und" for g, n in zip(gap, named)])
            yield pa.record_batch([batch.column(0), lang, pa.array(score, pa.float64()), close], ["doc", "lang_pred", "score", "ambiguous"])

    schema = T.StructType([source.schema["doc"]]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return source.mapInArrow(decode, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc.doc_id", "doc.held_out", "lang_pred", "score", "ambiguous")
