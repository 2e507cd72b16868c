"""How the sources of a language differ in their use of terms: a sort-based streaming audit.

Tasks count terms of the documents they read and give a row for each (lang, term, source), with the
first document of those counted. These rows are sorted into ranges of (lang, term, source, document), so that even
a term of every document is in as many tasks as its rows need, and a run-length scan gives document frequencies
and counts. A second scan, over runs of the kept terms, gives partial sums for pairs of sources. While they are sorted, lang
and term are one string, divided by a character that no term has, so that most rows differ in their first bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitas.llm.common import changes, documents, grouped, staged, tune

#: Documents of a language that a term must be in, terms listed of a group, added to each count.
LEAST_DOCS, TERMS, ADDED = 30, 50, 5
#: Entries that a task counts before it gives them on, sources of a block, terms of a part, terms held as a matrix.
HELD, BLOCK, PER_PART, AT_ONCE = 600_000, 256, 4096, 256
#: Groups (lang, source) up to which they are broadcast.
MOST_BROADCAST = 50_000

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters from U+0080 on of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(key, source, document, docs, n): how many documents hold a term and how often, for parts of ``docs``; key: lang,
    a character U+0000 and the term; ``document``: the first of the part's documents."""

    def rows(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (first, held, n) in counts.items():
            begin, names = lang.encode() + b"\0", list(n)
            same = lambda x, t: pa.array([x] * len(names), t)
            keys = pa.array([begin + t for t in names], pa.binary()).cast(pa.string())
            yield pa.record_batch([keys, same(source, pa.string()), same(first, pa.int64()), pa.array([held[t] for t in names], pa.int64()), pa.array(list(n.values()), pa.int64())], ["key", "source", "document", "docs", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, entries = {}, 0
        for batch in batches:
            for lang, source, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = counts.get((lang, source)) or counts.setdefault((lang, source), (at, Counter(), Counter()))
                terms, before = terms_of(text), len(own[2])
                own[1].update(set(terms))
                own[2].update(terms)
                entries += len(own[2]) - before
                if entries >= HELD:
                    yield from rows(counts)
                    counts, entries = {}, 0
        yield from rows(counts)

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(count, "key string, source string, document long, docs long, n long")


def _merged(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted (key, source, docs, n) with one row for each source of a key."""
    first = np.flatnonzero(changes(*rows.columns[:2]))
    keep = pa.array(first)
    return pa.record_batch([*(c.take(keep) for c in rows.columns[:2]), *(pa.array(np.add.reduceat(c.to_numpy(), first)) for c in rows.columns[2:])], rows.schema.names)


def runs(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, total, lead) of the terms in ``least`` documents of their language: occurrences in
    the source and in the language, and true in one row of each (lang, term).

    A run that the border of a range cuts is merged afterwards: two for each range at most.
    """

    def told(rows: pa.RecordBatch, edge: tuple[bool, bool]) -> pa.RecordBatch:
        """The runs of ``rows``, whole ones of enough documents; ``edge``: whether the first, or the last, is cut."""
        rows = _merged(rows)
        lead = changes(rows.column(0))
        first, run = np.flatnonzero(lead), np.cumsum(lead) - 1
        docs, total = (np.add.reduceat(rows.column(k).to_numpy(), first) for k in (2, 3))
        cut = np.zeros(len(first), bool)
        cut[0] |= edge[0]
        cut[-1] |= edge[1]
        out = pa.record_batch([*rows.columns, pa.array(total[run]), pa.array(lead), pa.array(cut[run])], ["key", "source", "docs", "n", "total", "lead", "cut"])
        return out.filter(pa.array((cut | (docs >= least))[run]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            last = int(np.flatnonzero(changes(rows.column(0)))[-1])
            if last:
                yield told(rows[:last], (not begun, False))
                begun = True
            held = _merged(rows[last:])
        if held is not None:
            yield told(held, (True, True))

    order = ["key", "source", "document"]
    ranges = counts.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "source", "docs", "n")
    found = staged(ranges.mapInArrow(scan, "key string, source string, docs long, n long, total long, lead boolean, cut boolean"), "runs")
    cut = found.where("cut").groupBy("key", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = cut.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.min("source").alias("least")).where(F.col("docs") >= least).drop("docs")
    mended = cut.join(whole, "key").select("key", "source", "n", "total", (F.col("source") == F.col("least")).alias("lead"))
    every = found.where("NOT cut").select("key", "source", "n", "total", "lead").unionByName(mended)
    term = F.substring_index("key", "\0", -1)
    lang = F.substring(F.col("key"), F.lit(1), F.char_length("key") - F.char_length(term) - 1)
    return every.select(lang.alias("lang"), term.alias("term"), "source", "n", "total", "lead")


def share(count: str, of: str, terms: str) -> Column:
    """1 + floor(1000000000 * (count + 5) / (of + 5 * terms)), exactly; null where nothing is kept."""
    return F.expr(f"1 + (cast({count} + {ADDED} as decimal(20,0)) * 1000000000) div cast(nullif({of} + {ADDED} * {terms}, 0) as decimal(20,0))")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, total, seen) of each part (lang, p, q, part), whose rows (term, place, share) stand in order:
    those without a term first, with the share of a source that lacks a term."""
    names = ["lang", "a", "b", "total", "seen"]

    def matrix_sums(rows: pa.RecordBatch) -> pa.RecordBatch:
        lang, p, q = (rows.column(k)[0].as_py() for k in range(3))
        place, value = rows.column(5).to_numpy(), rows.column(6).to_numpy()
        base = rows.column(4).null_count
        sources, zero = place[:base], value[:base]
        at = np.searchsorted(sources, place[base:])
        terms = np.cumsum(changes(rows.column(4)[base:])) - 1 if len(at) else np.zeros(0, int)
        seen = int(terms[-1]) + 1 if len(terms) else 0
        mine, theirs = (np.flatnonzero(sources // BLOCK == x) for x in (p, q))
        total = np.zeros((len(mine), len(theirs)), np.int64)
        for begin in range(0, seen, AT_ONCE):
            some = slice(*np.searchsorted(terms, [begin, begin + AT_ONCE]))
            m = np.repeat(zero[None, :], min(AT_ONCE, seen - begin), 0)
            m[terms[some] - begin, at[some]] = value[base:][some]
            for i, k in enumerate(mine):
                total[i] += np.abs(m[:, theirs] - m[:, k : k + 1]).sum(0)
        a, b = np.nonzero(sources[mine][:, None] < sources[theirs])
        return pa.record_batch([pa.array([lang] * len(a), pa.string()), pa.array(sources[mine][a]), pa.array(sources[theirs][b]), pa.array(total[a, b]), pa.array(np.full(len(a), seen, np.int64))], names)

    yield from map(matrix_sums, grouped(batches, 4))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (doc_id, lang, source, text).

    A language keeps the terms in ``least`` of its documents. A group's share of a kept term is 1 + floor(10**9 * (count + 5) /
    (N + 5 * V)), N its occurrences of all V kept terms. Part ``pair``: each other source of the language with
    the summed differences of the shares; part ``term``: the ``terms`` kept terms that occur in the group and have a
    larger share in it than in the language, with the difference. Ranks are by value, then by item in UTF-8 order.

    Every row is a document, whatever its id; repeated rows count each. A null text, lang or source is ''. A group without
    terms counts 0 of each; a language without kept terms has pairs of value 0. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    counts = staged(runs(staged(term_counts(docs), "term_counts"), least), "kept_terms")
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = counts.groupBy("lang").agg(F.sum("n").alias("every"), F.count_if("lead").alias("terms"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("of"))
    groups = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["of", "every", "terms"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("place", place.cast("long")).withColumn("block", F.floor(F.col("place") / BLOCK)).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    groups = staged(groups.withColumn("zero", share("0", "of", "terms")), "groups")
    few = F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups

    shares = counts.join(few, ["lang", "source"]).withColumn("share", share("n", "of", "terms")).withColumn("q", share("total", "every", "terms"))
    value = F.col("share") - F.col("q")
    high = shares.where(value > 0).select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    high = high.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= terms)

    other, parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), F.ceil(F.col("terms") / PER_PART)
    part = F.pmod(F.xxhash64("term"), parts)
    rows = shares.select("lang", "block", other, part.alias("part"), "term", "place", "share")
    absent = groups.where("terms > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).select("lang", "block", other, "part", F.lit(None).cast("string").alias("term"), "place", F.col("zero").alias("share"))
    rows = rows.unionByName(absent).select("lang", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "part", "term", "place", "share")
    keys = ["lang", "p", "q", "part"]
    sums = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("term").asc_nulls_first(), "place").mapInArrow(_pair_sums, "lang string, a long, b long, total long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))

    mine = groups.select("lang", "source", "place", "zero", "terms", other.alias("block"))
    theirs = groups.select("lang", "block", F.col("source").alias("item"), F.col("place").alias("place2"), F.col("zero").alias("zero2"))
    both = mine.join(theirs, ["lang", "block"]).where("place <> place2").withColumn("a", F.least("place", "place2")).withColumn("b", F.greatest("place", "place2"))
    none = F.lit(0).cast("long")
    # terms that neither has differ by what an absent term gives
    value = F.coalesce("total", none) + (F.col("terms") - F.coalesce("seen", none)) * F.coalesce(F.abs(F.col("zero") - F.col("zero2")), none)
    pairs = both.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(by))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long"), "rank")
    return columns(pairs, "pair").unionByName(columns(high, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``divergence`` of all documents: lang, source, part, item, value, rank."""
    return divergence(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"))


ORACLE = rf"""WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
per AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM per GROUP BY lang, term HAVING sum(docs) >= {LEAST_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT grp.lang, grp.source, kept.term, coalesce(per.n, 0) AS n, kept.total FROM grp JOIN kept USING (lang) LEFT JOIN per ON per.lang = grp.lang AND per.source = grp.source AND per.term = kept.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + {ADDED})) // (sum(n) OVER g + {ADDED} * count(*) OVER g) AS p, 1 + (1000000000 * (total + {ADDED})) // (sum(total) OVER g + {ADDED} * count(*) OVER g) AS q FROM dense WINDOW g AS (PARTITION BY lang, source)),
differ AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN differ d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
rows AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TERMS}"""
