"""Best-fit packing of token sequences under several capacities.

Documents are encoded, cut only where longer than a sequence, and their pieces dealt by hash
to buckets of bounded size; each bucket is packed by vector best-fit. A bucket wastes at most
about one sequence in thousands, and nothing passes through one task.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import Generations, documents, staged, tune

#: Pieces of a bucket, on average.
BUCKET = 8192
_ODD = re.compile("[\x1c-\x1f]")  # white space to str.split, symbols to the tokenizer
# The pre-token rule for lower-cased text below U+0250, where the classes \p{L} and \p{N} are these.
_L, _N = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_PRE = re.compile(rf"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_L}{_N}]+")
_BEYOND = re.compile("[^\x00-\u024f]")


@functools.cache
def _encoder(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@functools.cache
def _memo(path: str) -> Generations:
    """Ids of pre-tokens, and of the words that only the tokenizer can cut."""
    return Generations(500_000)


def ids_of(text: str, path: str) -> bytes:
    """Little-endian 32-bit ids of ``text``, encoded whole."""
    return np.array(_encoder(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def _last(path: str) -> np.ndarray:
    """Which ids end a pre-token."""
    vocabulary = _encoder(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return out


def _encode_parts(parts: list[str], path: str) -> list[bytes]:
    """Ids of pre-tokens, encoded many at a time and cut where an id ends one."""
    ids = np.array(_encoder(path).encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
    ends = np.flatnonzero(_last(path)[ids]) + 1
    if len(ends) != len(parts):
        return [ids_of(p, path) for p in parts]
    data, ends = ids.tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _cut(text: str, odd: set[str]) -> list[str]:
    """The pre-tokens of a text; words that only the tokenizer can cut stay whole and are added to ``odd``."""
    low = text.lower()
    if not (_BEYOND.search(low) or "<|" in low or _ODD.search(low)):
        return _PRE.findall(low)
    if _ODD.search(text):
        odd.add(text)
        return [text]
    words, own, at = text.split(), [], 0
    for i, word in enumerate(words):
        if "<|" in word or (not word.isascii() and _BEYOND.search(word.lower())):
            own += _PRE.findall(" ".join(words[at:i]).lower())
            own.append(word)
            odd.add(word)
            at = i + 1
    return own + _PRE.findall(" ".join(words[at:]).lower())


def encode_all(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text under a word-level pre-tokenizer that drops white space, so that the ids
    of a text are those of its pre-tokens one after the other. Short ones are encoded once while the
    memo keeps them."""
    memo, odd = _memo(path), set()
    split = [_cut(text or "", odd) for text in texts]
    new = [w for w in memo.ready({w for own in split for w in memo.lacking(own) if len(w) <= 64})]
    whole = [w for w in new if w in odd]
    memo.update((w, ids_of(w, path)) for w in whole)
    parts = [w for w in new if w not in odd] if whole else new
    for at in range(0, len(parts), 512):
        memo.update(zip(parts[at : at + 512], _encode_parts(parts[at : at + 512], path)))
    get = memo.get
    for own in split:
        try:
            yield b"".join(map(get, own))
        except TypeError:  # one is long or of the older generation
            yield b"".join([ids_of(w, path) if (ids := memo.find(w)) is None else ids for w in own])


def pieces_of(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a closing id 0, cut
    into pieces of ``capacity`` where longer."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memo(path).hold()
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for i, ids in enumerate(encode_all(batch.column(1).to_pylist(), path)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            start = np.array(piece, "i8") * capacity
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], by: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, given longest first.

    An item needs (length, 1, length squared) of a bin's token, document and attention
    capacities. Of the bins where every need fits, it goes to the one whose weighted residual
    after it is smallest (``by="norm"``) or whose residual has the largest weighted dot-product
    with the need (``by="dot"``); ties to the bin opened first; none fits: a new bin.
    """
    most, w = np.array(capacities, float), np.array(weights, float)
    needs = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1).astype(float)
    room, name, used = np.zeros((0, 3)), np.zeros(0, "i8"), np.zeros(0, "i8")
    bins, offsets, opened = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8"), 0
    size, least = 0, needs.min(0) if len(needs) else None
    for i, need in enumerate(needs):
        left = room[:size] - need
        fits = (left >= 0).all(1)
        at = -1
        if fits.any():
            if by == "norm":
                cost = ((w * left / most) ** 2).sum(1)
            else:
                cost = -(w * (need / most) * (room[:size] / most)).sum(1)
            cost[~fits] = np.inf
            at = int(cost.argmin())
        if at < 0:
            if size == len(room):
                keep = (room >= least).all(1)  # the others can take nothing more
                room, name, used = room[keep], name[keep], used[keep]
                size = len(room)
                more = max(64, size)
                room, name, used = np.concatenate([room, np.zeros((more, 3))]), np.concatenate([name, np.zeros(more, "i8")]), np.concatenate([used, np.zeros(more, "i8")])
            at, size = size, size + 1
            room[at], name[at], used[at], opened = most, opened, 0, opened + 1
        room[at] -= need
        bins[i], offsets[i] = name[at], used[at]
        used[at] += int(need[0])
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, most_documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), by: str = "norm", bucket: int = BUCKET) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text, ...) with their sequence and place in it:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``capacity`` tokens, ``most_documents`` pieces and ``attention`` (sum of squared lengths)
    bound each sequence; the last two don't bind by default. A piece that alone exceeds
    ``attention`` raises an error. A null or empty text is the closing id alone. Rows with a null
    or repeated id are packed like others; further columns are ignored; no rows give no pieces.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    tune(docs.sparkSession)
    capacities = (capacity, most_documents or capacity, attention or float(capacity) ** 2)
    if capacity**2 > capacities[2]:
        raise ValueError("attention must allow one full piece")
    pieces = staged(pieces_of(docs, path, capacity), "pieces").withColumn("uid", F.monotonically_increasing_id())
    full, part = F.col("length") == capacity, F.col("length") < capacity
    buckets = max(1, -(-pieces.where(part).count() // bucket))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), capacities, weights, by)
        ids = (np.int64(table["bucket"][0].as_py()) << 31 | bins) * 2
        return table.drop_columns(["uid", "bucket"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = pieces.where(part).select(*own, "uid", F.pmod(F.xxhash64("doc_id", "piece", "uid"), F.lit(buckets)).alias("bucket"))
    packed = shared.groupBy("bucket").applyInArrow(one, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = pieces.where(full).select(*own, (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
