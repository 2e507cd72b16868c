"""Secret scan over a trigram inverted index, with built-in functions only.

From each rule's pattern a Boolean query over mandatory trigrams is derived. Postings (trigram,
document key) are built for the trigrams that some query names, intersected per document, and
the documents that satisfy a query are verified with the pattern itself. A rule without
mandatory trigrams is verified on every text.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import documents, named, staged

try:
    from re import _constants as sre
    from re import _parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as _parser

#: Candidates up to which they are broadcast (16 bytes and a short list each); beyond, the join shuffles.
MOST_BROADCAST = 1_000_000
#: Alternatives to which a part of a pattern is expanded.
MOST_ALTERNATIVES = 24


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if ``group`` (0: all of it) has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
#: The cheap test that spares texts the long runs of short matches of a rule that scans fully.
FIRST_TEST = {"hex": "[0-9a-f]{32}"}


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """A pattern's Boolean query, lower-cased: all of these, each any of these, each all of these
    trigrams. Empty: the pattern has no mandatory trigram."""
    found: list[list[list[str]]] = []

    def close(run: set[str]) -> set[str]:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(sets):
            least = {s for s in sets if not any(t < s for t in sets)}
            found.append(sorted(sorted(s) for s in least))
        return {""}

    def exact(items) -> set[str] | None:
        """All strings that the items match, if few."""
        run = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                add = {chr(arg).lower()}
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
                add = {chr(c).lower() for _, c in arg}
            elif op is sre.SUBPATTERN:
                add = exact(arg[-1])
            elif op is sre.BRANCH:
                each = [exact(x) for x in arg[1]]
                add = None if None in each else set().union(*each)
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
                add = (one := exact(arg[2])) and one | {""}
            else:
                add = None
            if not add or len(run) * len(add) > MOST_ALTERNATIVES:
                return None
            run = {a + b for a in run for b in add}
        return run

    def walk(items, run: set[str]) -> set[str]:
        for item in items:
            op, arg = item
            if (add := exact([item])) is not None and len(run) * len(add) <= MOST_ALTERNATIVES:
                run = {a + b for a in run for b in add}
            elif op is sre.SUBPATTERN:
                run = walk(arg[-1], run)
            elif op is sre.MAX_REPEAT and arg[0] >= 1 and exact(arg[2]) is not None:
                close({a + b for a in run for b in exact(arg[2])})
                run = {""}
            else:
                run = close(run)
                if add is not None:
                    run = add
        return run

    close(walk(_parser.parse(pattern), {""}))
    return [q for q in found if q]


def _holds(present: Column, query: list[list[list[str]]]) -> Column:
    both, either = (functools.partial(functools.reduce, op) for op in (operator.and_, operator.or_))
    return both([either([both([F.array_contains(present, t) for t in every]) for every in some]) for some in query])


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, k): the documents that hold each of the trigrams, whatever the letters' case;
    k is a 64-bit hash of id and text."""
    low = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("k", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k, kinds): the rules whose trigram query a document satisfies, for those with any."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    named = sorted({t for q in queries.values() for some in q for every in some for t in every})
    if not named:
        return docs.sparkSession.createDataFrame([], "k long, kinds array<string>")
    present = postings(docs, named).groupBy("k").agg(F.collect_set("trigram").alias("present"))
    kinds = F.array_compact(F.array(*(F.when(_holds(F.col("present"), q), F.lit(kind)) for kind, q in queries.items())))
    return present.select("k", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, order: int) -> Column:
    """Matches of a rule in ``body`` as (start, order, end, kind), in code points: a match starts
    after all that was split off and matched before it."""
    body, pattern = F.col("body"), F.lit(rule.pattern)
    between = F.split(body, rule.pattern, -1)
    hits = F.arrays_zip(between.alias("b"), F.regexp_extract_all(body, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(body, pattern, F.lit(rule.group)).alias("v"))
    hits = F.slice(hits, 1, F.greatest(F.size(hits) - 1, F.lit(0)))
    nothing = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["b"])
        end = (start + F.char_length(x["m"])).alias("end")
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end, F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.char_length(x["v"]) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    every = F.aggregate(hits, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])
    wanted = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
    return F.when(wanted & F.rlike(body, F.lit(FIRST_TEST.get(rule.kind, rule.pattern))), every).otherwise(nothing)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc`` (all columns of ``docs`` (doc_id, text, ...) as a struct) and ``secret_spans``: array of
    (start, ord, end, kind) of all rules, by start, then in the rules' order; start and end are code
    points, end exclusive.

    A null or empty text has no spans. Null and repeated ids and repeated rows are scanned like
    others; columns of ``docs`` may have any names. An empty table gives an empty result.
    """
    found = staged(candidates(docs, rules), "secret_candidates")
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("body"), F.xxhash64("doc_id", "text").alias("k")).join(found, "k", "left")
    spans = F.array_sort(F.concat(*(_spans(rule, i) for i, rule in enumerate(rules))))
    return rows.select("doc", spans.alias("secret_spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping spans by one);
    its other columns are as they were, whatever their names. A text without spans is unchanged."""
    text = F.col("doc.text")

    def step(acc: Column, s: Column) -> Column:
        clean = F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), clean.alias("done"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["done"].alias("done")))

    out = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("done")), step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    clean = F.when(F.size("secret_spans") > 0, out).otherwise(text)
    return scan(docs, rules).select(*((clean if c == "text" else named(c, "doc")).alias(c) for c in docs.columns))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("secret_spans")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.filter(spans, lambda x: x["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    base = F.filter(spans, lambda x: x["ord"] < len(BASE_RULES))
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc.doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def _sql_spans(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    m, b, v = f"regexp_extract_all(body, '{p}')", f"string_split_regex(body, '{p}')", f"regexp_extract_all(body, '{p}', {rule.group})"
    return f"""SELECT id, {{'start': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'ord': {order}, 'len': length(m[i]), 'kind': '{rule.kind}'}} AS s
FROM (SELECT id, m, b, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, {m} AS m, {b} AS b, {v} AS v FROM docs WHERE regexp_matches(body, '{p}'))) WHERE length(v[i]) >= {rule.least}"""


ORACLE = f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({' UNION ALL '.join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
shown AS (SELECT id, s, s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.len AS BIGINT) AS t FROM spans),
one AS (SELECT id, {', '.join(f"count(*) FILTER (s.kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
  string_agg(t, ',' ORDER BY s.start, s.ord) FILTER (s.ord < {len(BASE_RULES)}) AS base, string_agg(t, ',' ORDER BY s.start, s.ord) AS spans FROM shown GROUP BY id)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN one USING (id)"""
