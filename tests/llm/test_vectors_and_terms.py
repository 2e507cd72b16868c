"""Source divergence, near-duplicate vectors and exact clusters against brute force, with hard rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from civitas.llm import clusters, divergence, vector_dedup

NAN, INF = float("nan"), float("inf")


def expected_divergence(docs, least, most):
    """The rows of ``divergence`` for (lang, source, text), term by term."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))) for lang, source, text in docs]
    held, of, groups = Counter(), defaultdict(Counter), sorted({d[:2] for d in docs})
    for lang, source, terms in docs:
        held.update((lang, t) for t in set(terms))
        of[lang, source].update(terms)
    rows = []
    for lang, source in groups:
        kept = [t for x, t in held if x == lang and held[x, t] >= least]
        share = lambda counts: {t: 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for t in kept}
        every = sum((of[g] for g in groups if g[0] == lang), Counter())
        p, q = share(of[lang, source]), share(every)
        pairs = [(sum(abs(p[t] - s[t]) for t in kept), other) for g, other in groups if g == lang and other != source for s in [share(of[lang, other])]]
        terms = [(p[t] - q[t], t) for t in kept if of[lang, source][t] and p[t] > q[t]]
        for part, found, top in (("pair", pairs, None), ("term", terms, most)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
            rows += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(rows)


def found_divergence(df, **options):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.divergence(df, **options).collect())


DOCS = "doc_id long, lang string, source string, text string, term string, n long, `a.b` string, total long"


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, "x", 1, "y", 2) for i, d in enumerate(docs)], DOCS)


def test_op11_more_sources_than_a_block(spark):
    rng = np.random.default_rng(4)
    words = ["Zebra", "élan", "ÉLAN", "jazz", "a", "straße", "blue-note", "x1y", "日本", "the"]
    docs = [("en", f"s{i % 300}", " ".join(rng.choice(words, 6))) for i in range(600)] + [("fr", "s0", "le jazz"), ("fr", "s1", "")]
    assert found_divergence(frame(spark, docs), least=30, terms=3) == expected_divergence(docs, 30, 3)


def test_op11_hard_rows(spark):
    docs = [(None, None, None), (None, "a", "jazz jazz"), ("", "", "JAZZ"), ("en", None, ""), ("en", "b", "1 2 !?"), ("en", "c", "tie one"), ("en", "d", "tie one"), ("en", "d", "tie one"), ("de", "c", "wort " * 50_000)]
    for least in (1, 2, 3, 30):
        assert found_divergence(frame(spark, docs), least=least) == expected_divergence(docs, least, 50)
    assert divergence.divergence(frame(spark, docs).where("false")).count() == 0


def test_op11_runs_over_borders_of_ranges(spark):
    rows = [(f"e\0n\0{t}", f"s{i % 7}", i, 1, 1 + i % 3) for t in ("a", "b", "c") for i in range(400)] + [("e\0n\0rare", "s1", 1, 29, 40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small ranges are read as one
    try:
        df = spark.createDataFrame(rows, "key string, source string, document long, docs long, n long")
        found = divergence.runs(df.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    n = Counter()
    for key, source, _, _, k in rows:
        n[key[4:], source] += k
    assert {r.lang for r in found} == {"e\0n"}
    assert {(r.term, r.source): r.n for r in found} == {k: v for k, v in n.items() if k[0] != "rare"} and len(found) == 21
    assert Counter(r.term for r in found if r.lead) == {"a": 1, "b": 1, "c": 1} and all(r.total == sum(v for k, v in n.items() if k[0] == r.term) for r in found)


def expected_links(rows, least=0.95):
    """vec_id: (links, component) by comparing all pairs of (vec_id, vector)."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    top, links = {i: i for i, _ in rows if i is not None}, Counter()

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for at, (i, x) in enumerate(good):
        for j, y in good[at + 1 :]:
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.update((i, j))
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (links[i], root(i)) for i in top}


VECTORS = "vec_id long, embedding array<double>, key string, node long, rows long, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, 2, 3) for i, v in rows], VECTORS)


def near(rng, x, cosine):
    other = rng.normal(size=len(x))
    other -= other @ x * x
    return cosine * x + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_op12_pairs_at_the_least_cosine(spark):
    """600 pairs from just above to just below the least cosine, among 3,000 others; copies and scaled copies."""
    rng = np.random.default_rng(6)
    unit = lambda: (x := rng.normal(size=24)) / np.linalg.norm(x)
    rows = [unit() for _ in range(3000)]
    for c in np.repeat([0.9501, 0.955, 0.97, 0.9499], 150):
        x = unit()
        rows += [x, near(rng, x, c)]
    rows += [rows[0], rows[0] * 7, rows[1], rows[1] * -1]
    numbered = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(vectors(spark, numbered)).collect()}
    assert found == expected_links(numbered)


def test_op12_a_group_larger_than_blocks_and_windows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=24)
    x /= np.linalg.norm(x)
    rows = [(i, near(rng, x, 0.97 + 0.02 * rng.random()).tolist()) for i in range(2200)] + [(i, rng.normal(size=24).tolist()) for i in range(2200, 2400)]
    found = vector_dedup.near_duplicates(vectors(spark, rows)).collect()
    expected = expected_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == expected
    assert all(r.kept == (r.vec_id == expected[r.vec_id][1]) for r in found)


def test_op12_hard_rows(spark):
    rows = [(9, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [2.0, 0.1]), (1, [0.0, 0.0]), (2, None), (4, []), (6, [NAN, 1.0]), (7, [INF, 1.0]), (8, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e200, 1e199]), (12, [1e-200, 1e-201]), (None, [1.0, 0.0])]
    found = vector_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert by[3] == (4, 3, True) and by[9] == (4, 3, False) and by[5] == by[11] == by[12] == (4, 3, False)
    assert by[None] == (0, None, False) and all(by[i] == (0, i, True) for i in (1, 2, 4, 6, 7, 8, 10))
    assert vector_dedup.near_duplicates(vectors(spark, rows).where("false")).count() == 0


def test_op12_passes_grow_with_the_table():
    assert vector_dedup.passes(0) == vector_dedup.passes(500) == 12 and vector_dedup.passes(10**7) > vector_dedup.passes(10**5) > 12


def expected_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [q for _, q in sorted(kept, key=order)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), at) for at, c in enumerate(centroids))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, q in kept:
            by[near(q)[1]].append(q)
        for at, own in by.items():
            centroids[at] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = Counter()
    for _, at, far in found:
        inertia[at] += far
    return sorted((str(i), at, far, inertia[at], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[at])).encode()).hexdigest()) for i, at, far in found)


@pytest.mark.parametrize("n", [1, 30, 400])
def test_op13_hard_rows(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), (rng.normal(size=64) * (1000 if i % 9 == 0 else 1)).tolist()) for i in range(n)]
    rows += [(10_000 + i, rows[0][1]) for i in range(1500)] + [rows[0], rows[-1], (None, rows[0][1]), (None, rng.normal(size=64).tolist())]
    rows += [(1, None), (2, []), (3, [1.0] * 63), (4, [NAN] * 64), (5, [INF] + [0.0] * 63), (6, [None] + [0.0] * 63), (7, [0.0] * 64), (8, [-1e-9] * 64)]
    found = clusters.clusters(vectors(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == expected_clusters(rows)


def test_op13_edges(spark):
    assert clusters.clusters(vectors(spark, [(1, [0.0]), (2, None)])).count() == 0
    large = [(i, [s * 524_000.0] * 64) for i, s in enumerate((1, -1, 1, 0.5))]
    found = clusters.clusters(vectors(spark, large), k=1).collect()
    assert len(found) == 4 and sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == expected_clusters(large, k=1)
    with pytest.raises(PySparkException, match="squared distances"):
        clusters.clusters(vectors(spark, [(1, [1e30] * 64)])).collect()


def test_op13_weighted_sums_are_exact_at_any_size():
    values, weights = np.array([[1 << 26, -3], [1 << 26, 5]]), np.array([1 << 40, 1 << 39])
    assert clusters.weighted(values, weights).tolist() == [(1 << 66) + (1 << 65), -3 * (1 << 40) + 5 * (1 << 39)]


def test_registered_over_whole_tables(spark, sf):
    from civitas.llm import queries

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert queries.QUERIES["op12_embedding_duplicates"](spark, sf).count() == queries.QUERIES["op13_clusters"](spark, sf).count() == vectors.count()
    groups = spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").agg(F.count_distinct("source").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0]
    assert queries.QUERIES["op11_source_divergence"](spark, sf).where("part = 'pair'").count() == groups
