"""Token counts without token ids.

A BPE never merges across pre-tokens, so a text's token count is the sum over its pre-tokens
of their piece counts. Pieces are counted once per distinct pre-token of the corpus, that
table is joined to per-document pre-token frequencies, and the products are summed.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civitas.llm.common import documents, staged, tune
from civitas.llm.lookup import key_of, summed, token_counts

# The byte-level pre-token rule for texts below U+0250, where the classes \p{L} (L), \p{N} (N)
# and \s (S) are these; other texts are cut by the tokenizer's own pre-tokenizer.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads keep more memory
    return Tokenizer.from_file(path)


@functools.cache
def specials(path: str) -> re.Pattern | None:
    """The special strings that the library finds inside texts by default."""
    found = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True)))) if found else None


def pre_tokens(text: str | None, path: str) -> list[bytes]:
    """The pre-tokens of ``text`` under the byte-level tokenizer at ``path``, special strings
    among them whole; none for a null."""
    if not text:
        return []
    cut = specials(path)
    if cut is None or "<|" not in text:
        return [t.encode() for t in _cut(text, path)]
    out, at = [], 0
    for m in cut.finditer(text):
        out += [*_cut(text[at : m.start()], path), m[0]]
        at = m.end()
    return [t.encode() for t in [*out, *_cut(text[at:], path)]]


def _cut(text: str, path: str) -> list[str]:
    if not _BEYOND.search(text):
        return _PRE.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)] if text else []


def piece_counts(table: DataFrame, path: str) -> DataFrame:
    """(key, n, pieces) from (token, n): pieces of each distinct pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            sizes = [len(e.ids) for e in encode.encode_batch_fast([t.decode() for t in tokens], add_special_tokens=False)]
            yield pa.record_batch([pa.array(map(key_of, tokens), pa.binary()), batch.column("n"), pa.array(sizes, pa.int64())], ["key", "n", "pieces"])

    return table.select("token", "n").mapInArrow(count, "key binary, n long, pieces long")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text, ...).

    ``path``: a byte-level BPE of the tokenizers library. A null text counts as empty: no bytes,
    no tokens. A null id, repeated ids and repeated rows give a row each; other columns are
    ignored. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    tune(docs.sparkSession)
    split = functools.partial(pre_tokens, path=path)
    own = docs.select("doc_id", "text")
    pieces = staged(piece_counts(token_counts(own, split), path), "pieces")
    sized = own.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = summed(sized, ["doc_id", "n_bytes"], split, pieces, {"pieces": "long"}, {"pieces": 0})
    return out.select("doc_id", "n_bytes", F.col("pieces").alias("n_tokens"), (F.col("pieces") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
