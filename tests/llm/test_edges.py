"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from civitas.llm import decontaminate, dedup, language, licenses, lm, neighbours, packing, quality, secrets, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` long, `key` string, n long, bucket long, doc string, body string, k long, score double, node long, held_out boolean, secret_spans string, `a.b` string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = " ".join(f"{WORDS[i % 10]}{i % 997}" for i in range(60_000))


def _rows():
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n"), (None, "some text without an id"), (5, LONG), (6, "é ß \U0001f600 <|endoftext|> token=abcdefgh12"), (7, "!!! 123")]
    return [(i, t, "en" if i != 2 else None, "s", None, 1, "x", 2, 3, "d", "b", 4, 0.5, 9, False, "x", "y") for i, t in texts]


OPERATORS = {
    "language": lambda d: language.identify(d, language.fit(d)).select("doc.doc_id", "lang_pred"),
    "near_duplicates": dedup.near_duplicates,
    "without_copies": dedup.without_copies,
    "leaks": lambda d: decontaminate.leaks(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1")),
    "without_leaks": lambda d: decontaminate.without_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 3")),
    "quality": lambda d: quality.score(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")))),
    "lm": lambda d: lm.score(d.withColumn("held_out", F.lit(False)), d),
    "secrets": secrets.scan,
    "redact": secrets.redact,
    **{name: lambda d, stage=stage: stage(d.sparkSession, d, os.environ["EDGE_SF_DIR"]) for name, stage in corpus_pipeline.STAGES},
    "licenses": licenses.licenses,
    "tokens": tokens.count_tokens,
    "pack": packing.pack,
}
EXPECTED = {"without_copies": 8, "leaks": 2, "pack": None, "best_fit_packing": None, "language_id": 5, "near_duplicates": 8}


@pytest.fixture(scope="module")
def rows(spark, sf):
    os.environ["EDGE_SF_DIR"] = sf
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(rows, name):
    found = OPERATORS[name](rows).collect()
    if EXPECTED.get(name, 0) is None:
        assert sum(1 for r in found if r.piece == 0) == len(_rows())
    else:
        assert len(found) == EXPECTED.get(name, len(_rows()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(rows, name):
    assert OPERATORS[name](rows.where("false")).count() == 0


def test_defined_results(rows):
    near = {(r.doc_id, r.n_shingles): r for r in dedup.near_duplicates(rows).collect()}
    assert near[1, 3].kept and near[2, 0].component_id == 2 and near[3, 0].component_id == 3
    unknown = next(r for k, r in near.items() if k[0] is None)
    assert unknown.component_id is None and not unknown.kept
    lang = {r.doc_id: r.lang_pred for r in OPERATORS["language"](rows).collect()}
    assert lang[2] == lang[3] == lang[4] == lang[7] == "und" and lang[1] == "en"
    counted = {r.doc_id: r for r in tokens.count_tokens(rows).collect()}
    assert (counted[2].n_bytes, counted[2].n_tokens) == (0, 0) and counted[5].over_limit
    scored = {r.doc_id: r for r in OPERATORS["lm"](rows).collect()}
    assert scored[2].n_tokens == scored[3].n_tokens == 1 and scored[2].score == scored[3].score
    packed = packing.pack(rows).where("doc_id = 2").first()
    assert (packed.length, packed.start) == (1, 0)
    found = {r.doc_id: r for r in secrets.redact(rows).collect()}
    assert found[6].text.endswith("[SECRET]") and found[2].text is None and found[5].text == LONG


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    found = neighbours.nearest(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(50, 1, 1), (50, 2, 2), (50, 3, 3)]
    assert np.allclose([r.score for r in found], [1, 1, 0])
    assert neighbours.nearest(df.where("false"), df).count() == neighbours.nearest(df, df.where("false")).count() == 0
