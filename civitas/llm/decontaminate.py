"""Benchmark passages in documents, small edits included.

The CGK embedding reads a word sequence by a random walk: at each step it gives the word under the
pointer and moves on or stays, as a random function of the step and the word says. Two sequences that
differ by few edits fall back into step, so an edit distance becomes a Hamming distance between the
walks. A walk starts at every word of a document; keys are made of a few sampled steps of it (bit
sampling), within windows of the items' own sizes (in bands of a ratio of two). An item of n words may
differ by n * ``PERCENT`` // 100 edits, which an exact edit distance over its whole length confirms at
the places found.

The random functions repeat after ``PERIOD`` steps: a walk of any length is then a few lookups in the
map of where one period leads, for all starts and all window sizes at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import documents, slices, staged, tune

#: Edits allowed for each 100 words of an item.
PERCENT = 20
#: Items of a block: one broadcast (about 256 keys of 24 bytes for each).
ITEMS = 8192
#: Walks, samples of each and steps of a sample: with items' windows from several starts, 0.99 of random edits
#: up to ``PERCENT`` are found at every length (tests); steps after which the random functions repeat.
WALKS, SAMPLES, STEPS, PERIOD = 8, 2, 3, 16
#: Steps of a walk within which a sample lies, so that a long item's edits don't all come between.
STRETCH = 24
#: Characters of the texts that are walked at once: what the walks read stays in the processor's cache.
CHUNK = 1 << 17
#: Starts of an item that are indexed, spread over those its band's window can have.
STARTS = 16
#: Words of an item for each word of its window, at least.
SLACK = 1.35

_rng = np.random.default_rng(12)
_WALK, _FOLD = _rng.integers(1, 1 << 63, (2, 4), dtype=np.uint64) | np.uint64(1)

_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum() and not chr(b).isspace())
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, lower-cased and without ASCII punctuation: each byte of a word
    counts by its value and place in it."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION), np.uint8)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(np.append(0, starts[1:]), np.diff(np.append(0, starts[1:]), append=len(data)))
    place[: starts[0]] = 0
    place[starts[0] : starts[1] if len(starts) > 1 else None] -= starts[0]
    return _mixed(np.add.reduceat(_BYTE[data] * _mixed(place.astype(np.uint64) + np.uint64(1)), starts))


def window(n: int) -> int:
    """Words of the window of an item of ``n`` words: its band."""
    if n * PERCENT < 100:
        return n  # no edit allowed: the whole item
    size = 4.0
    while 2 * size * SLACK <= n:
        size *= 2
    return int(size)


@functools.cache
def samples(size: int) -> list[list[tuple[int, ...]]]:
    """For each walk, the sampled steps of its keys in a window of ``size`` words: one of each third of a
    stretch of ``STRETCH`` steps, anywhere among those that the walk takes within the window on average."""
    rng = np.random.default_rng(size)
    steps = int(2 * size - size**0.5)
    span = min(STRETCH, steps)
    cuts = [span * k // STEPS for k in range(STEPS + 1)]

    def one() -> tuple[int, ...]:
        first = int(rng.integers(steps - span + 1))
        return tuple(first + int(rng.integers(a, b)) for a, b in zip(cuts, cuts[1:]))

    return [[one() for _ in range(SAMPLES)] for _ in range(WALKS)]


def embedded(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], int]]:
    """(size, key, positions, salt): for each key of a window of each of ``sizes``, its 32 bits at every
    start, the words that the sampled steps stand at, and what tells it from other keys."""
    n = len(words)
    folded = [(words * f >> np.uint64(32)).astype(np.uint32) for f in _FOLD[:STEPS]]
    start = np.arange(n)
    for size in (s for s in sizes if s * PERCENT < 100):  # no edits: all words of the window
        places = [np.minimum(start + k, n - 1) for k in range(size)]
        yield size, functools.reduce(lambda key, place: key * np.uint32(0x9E3779B1) + folded[0].take(place, mode="clip"), places, np.full(n, size, np.uint32)), places, size
    sizes = [s for s in sizes if s * PERCENT >= 100 or s == 4]
    for walk in range(WALKS if sizes else 0):
        if walk % 4 == 0:
            four = _mixed(words ^ _WALK[walk // 4]).view(np.uint8).reshape(n, 8)
        moves = np.ascontiguousarray(np.unpackbits(four[:, walk % 4 * 2 : walk % 4 * 2 + 2], axis=1).T)
        moves[:, -1:] = 0  # the last word stays
        at, period = start, []
        for q in range(PERIOD):
            period.append(at)
            at = at + moves[q].take(at, mode="clip")
        jumps = [start, at]
        while len(jumps) * PERIOD < 2 * max(sizes):
            jumps.append(at.take(jumps[-1], mode="clip"))
        for size in sizes:
            for number, steps in enumerate(samples(size)[walk]):
                places = [period[p % PERIOD].take(jumps[p // PERIOD], mode="clip") if p >= PERIOD else period[p] for p in steps]
                salt = ((size << 8 | walk) << 8 | number) * 0x9E3779B1 & (1 << 32) - 1
                key = folded[0].take(places[0], mode="clip")
                for place, own in zip(places[1:], folded[1:]):
                    key += own.take(place, mode="clip")
                key += np.uint32(salt)
                yield size, key, places, salt


def whole(words: np.ndarray, places: list[np.ndarray], salt: int) -> np.ndarray:
    """The 64-bit key of the words at each of ``places``."""
    key = np.full(len(places[0]), salt, np.uint64)
    for place in places:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + words[place])
    return key


class Table:
    """Items and places in them by a key, of which the upper bits of the short form tell fast whether any
    item may have it."""

    def __init__(self, short: np.ndarray, keys: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.item, self.offset = item[order].astype(np.int32), offset[order].astype(np.int32)
        self.known, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        width = min(24, max(8, int(256 * len(self.known)).bit_length()))
        self.shift = np.uint32(32 - width)
        self.there = np.zeros(1 << width, bool)
        self.there[short >> self.shift] = True

    def find(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of ``at`` whose key is known, once for each item that has it, that item and the place in it."""
        if not len(self.known):
            return at[:0], self.item, self.offset
        place = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        same = self.known[place] == keys
        at, place = at[same], place[same]
        count = self.first[place + 1] - self.first[place]
        entry = np.repeat(self.first[place + 1] - np.cumsum(count), count) + np.arange(count.sum())
        return np.repeat(at, count), self.item[entry], self.offset[entry]


class Index:
    """A table for each key. Items are told apart by their place in the list, not by their ids, which
    may be null or repeated."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids, self.items = [i for i, _ in items], [w for _, w in items]
        self.words = [set(w.tolist()) for w in self.items]
        lengths = np.array([len(w) for w in self.items], np.int64)
        own = np.array([window(n) for n in lengths.tolist()], np.int64)
        self.sizes = sorted(set(own.tolist()))
        ends = np.cumsum(lengths)
        # where windows of each size start, and whose they are
        starts, whose = {}, {}
        for size in self.sizes:
            each = [(i, ends[i] - lengths[i] + o) for i in np.flatnonzero(own == size).tolist() for o in np.unique(np.linspace(0, lengths[i] - size, min(STARTS, int(lengths[i]) - size + 1)).astype(int)).tolist()]
            whose[size], starts[size] = np.array(each, np.int64).T
        self.tables: dict[int, Table] = {}
        words = np.concatenate(self.items) if items else np.zeros(0, np.uint64)
        for size, key, places, salt in embedded(words, self.sizes) if items else ():
            item, at = whose[size], starts[size]
            exact = lengths[item] * PERCENT < 100
            # a key within the item, of several words where the window has enough of them
            distinct = 1 + sum((b[at] > a[at]).astype(int) for a, b in zip(places, places[1:]))
            keep = (places[-1][at] < ends[item]) & (exact == (salt == size)) & (exact | (distinct >= min(STEPS, max(2, size // 2))))
            item, at = item[keep], at[keep]
            self.tables[salt] = Table(key[at], whole(words, [p[at] for p in places], salt), item, places[-1][at] - (ends - lengths)[item])

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, item, diagonal) of windows that share a key with an item: the word of the
        window's start, the last that the key read, and where the item would begin if it were in step there."""
        for _, key, places, salt in embedded(words, self.sizes) if self.sizes and len(words) else ():
            own = self.tables[salt]
            at = np.flatnonzero(own.there.take((key >> own.shift).astype(np.int64), mode="clip"))
            if len(at):
                at, item, offset = own.find(at, whole(words, [p[at] for p in places], salt))
                last = places[-1][at]
                yield at, last, item, last - offset

    def matches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """(text, item, (edits, start, end)): the best place of each item within the allowed edits."""
        words, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
        stops = np.cumsum(lengths)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried = set()
        for start, end, item, diagonal in self.candidates(words):
            text = np.searchsorted(stops, start, "right")
            inside = end < stops[text]
            for t, i, at in zip(text[inside].tolist(), item[inside].tolist(), (diagonal - (stops - lengths)[text])[inside].tolist()):
                if (t, i, at) not in tried and best.get((t, i), (1,))[0]:
                    tried.add((t, i, at))
                    if hit := self.confirm(texts[t], i, at):
                        best[t, i] = min(hit, best.get((t, i), hit))
        for (t, item), hit in sorted(best.items()):
            yield t, self.ids[item], hit

    def confirm(self, words: np.ndarray, item: int, at: int) -> tuple[int, int, int] | None:
        own = self.items[item]
        most = len(own) * PERCENT // 100
        if 0 <= at <= len(words) - len(own) and (words[at : at + len(own)] == own).all():
            return 0, at, at + len(own)
        low, high = max(0, at - most), min(len(words), at + len(own) + most)
        if len(self.words[item].difference(words[low:high].tolist())) > most:  # each is an edit
            return None
        edits, start, end = nearest(own, words[low:high])
        return (edits, low + start, low + end) if edits <= most else None


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edits between ``item`` and the nearest stretch of ``text``, and that stretch (the first that
    ends earliest)."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    step = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        swap = cost[:-1] + (text != word)
        drop = cost + 1
        new, origin = drop.copy(), start.copy()
        better = swap < new[1:]
        new[1:][better], origin[1:][better] = swap[better], start[:-1][better]
        reach = np.minimum.accumulate(new - step)  # words of the text that the item lacks
        source = np.maximum.accumulate(np.where(new - step == reach, step, 0))
        cost, start = reach + step, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start_word, end_word: each item of ``items`` (item_id, text) that
    a row of ``docs`` (doc_id, text, ...) holds within ``PERCENT`` edits for 100 of its words; at least
    0.97 of those at any length are found, and all that are unchanged.

    Edits and positions count words, lower-cased and without punctuation; the end is exclusive.
    Items without words are in no document; null and empty texts hold none. Null and repeated ids,
    of documents and of items, give rows like others: two texts of one item_id are two items, equal
    rows of ``items`` are one. Empty tables give an empty result.
    """
    tune(docs.sparkSession)
    found = []
    for index, several in _indexes(items):  # one index at a time is at the driver and the tasks
        found.append(staged(_search(docs, index), "leaks") if several else _search(docs, index))
    return functools.reduce(DataFrame.unionByName, found)


def _indexes(items: DataFrame) -> Iterator[tuple[Index, bool]]:
    """An index for each block of items, and whether there are several; one without items if there are none."""
    known = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-known.count() // ITEMS))
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        split = [(r.item_id, word_hashes(r.text)) for r in own]
        yield Index([(i, w) for i, w in split if len(w)]), blocks > 1


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, ...) that hold none of ``items`` (item_id, text), with all their columns."""
    tune(docs.sparkSession)
    for index, several in _indexes(items):
        docs = staged(_clean(docs, index), "clean") if several else _clean(docs, index)
    return docs


def _clean(docs: DataFrame, index: Index) -> DataFrame:
    shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, done = np.ones(batch.num_rows, bool), 0
            for part in slices(batch.column(at).to_pylist(), CHUNK):
                for i, *_ in shared.value.matches([word_hashes(t) for t in part]):
                    keep[done + i] = False
                done += len(part)
            yield batch.filter(pa.array(keep))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns' names are
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


def _search(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            row, found, at = [], [], 0
            for part in slices(batch.column(1).to_pylist(), CHUNK):
                texts = [word_hashes(t) for t in part]
                for i, item, hit in own.matches(texts):
                    row.append(at + i)
                    found.append((item, *hit))
                at += len(part)
            columns = list(zip(*found)) or [()] * 4
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "edits", "start_word", "end_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, item_id long, edits long, start_word long, end_word long")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
