"""Helpers shared by the text operators: staged tables, batch sizes, hashes."""

from __future__ import annotations

import shutil
import tempfile
import weakref
from collections.abc import Iterable, Iterator
from itertools import filterfalse
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.staging import drop_staged, shared_dir, staged  # noqa: F401

#: Rows and bytes of an Arrow batch handed to a Python worker: documents are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tune(spark: SparkSession) -> None:
    """Give the Python workers this package, and keep Arrow batches small, so that a worker's
    memory doesn't follow the longest texts."""
    context = spark.sparkContext
    if not getattr(context, "_civitas_shipped", False):
        root = Path(__file__).resolve().parents[2]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/civitas", "zip", root, "civitas"))
        context._civitas_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def named(column: str, of: str | None = None) -> Column:
    """The column of exactly this name, dots included; with ``of``, the field of that struct column."""
    return F.col(of)[column] if of else F.col("`" + column.replace("`", "``") + "`")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or one made of it that no column has, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def held_out(col: Column, mod: int, at: int) -> Column:
    """A null id is never held out."""
    return F.coalesce(remainder(col, mod) == at, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, A-Z lower-cased; none for a null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def slices(texts: list[str | None], most: int = 1 << 19) -> Iterator[list[str | None]]:
    """``texts`` in order, in lists of about ``most`` characters: bounds what a task holds at once."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def changes(*columns: pa.Array) -> np.ndarray:
    """Where a row of ``columns`` (without nulls) differs from the one before it; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns], 0)
    return out


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group of equal values in the first ``keys`` columns (without nulls), of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(changes(*batch.columns[:keys])).tolist()
        if held and all(held[0].column(k)[0] == batch.column(k)[0] for k in range(keys)):
            starts[0] = -1  # goes on with the group that is held
        for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
            if begin >= 0 and held:
                yield pa.concat_batches(held)
                held = []
            held.append(batch[max(begin, 0) : end])
    if held:
        yield pa.concat_batches(held)


def finite(embedding: Column) -> Column:
    """Whether an array of numbers has only finite components, none null, and at least one; never null."""
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Memo(dict):
    """A bounded memo of ``of(key)``: emptied when full, so a worker's memory has a bound."""

    live: weakref.WeakValueDictionary = weakref.WeakValueDictionary()

    def __init__(self, of, most: int = 400_000):
        super().__init__()
        self.of, self.most = of, most
        Memo.live[id(self)] = self

    def hold(self, *others: Memo) -> Memo:
        """Empty every other memo of this worker, which earlier operators left."""
        for memo in list(Memo.live.values()):
            if memo is not self and not any(memo is m for m in others):
                memo.clear()
        return self

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.of(key)
        return out


class Generations(Memo):
    """A bounded memo of two generations: when full, the younger becomes the old one, from which
    entries that are still asked for come back."""

    def __init__(self, most: int):
        super().__init__(None, most)
        self.old: dict = {}

    def ready(self, keys: set) -> list:
        """Of ``keys``, those that have no entry in either generation; room is made for them."""
        missing = self.lacking(keys)
        if len(self) + len(missing) > self.most:
            self.old = dict(self)
            super().clear()
            missing = keys
        new = []
        for key in missing:
            if (found := self.old.get(key)) is None:
                new.append(key)
            else:
                self[key] = found
        return new

    def lacking(self, keys: Iterable) -> set:
        """Of ``keys``, those without a young entry. (``set.difference`` walks a whole subclass of dict.)"""
        return set(filterfalse(self.__contains__, keys))

    def find(self, key):
        """An entry of either generation, or None."""
        found = self.get(key)
        return self.old.get(key) if found is None else found

    def clear(self) -> None:
        super().clear()
        self.old = {}
