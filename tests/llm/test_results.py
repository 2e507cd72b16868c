"""Each operator against a brute-force version, a library, SQL, a round trip or held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from civitas.llm import attention, decontaminate, language, licenses, lm, packing, queries, secrets


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def components(rows):
    """Smallest reachable id of each (id, text), by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


def test_op1_held_out_accuracy(spark, sf, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    rows = queries.QUERIES["op1_language_id"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) == len(docs) and np.mean(judged) >= 0.95


def test_codewords_differ():
    for n in (2, 4, 5, 9, 40):
        code = language.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 1


def test_op2_brute_force(spark, sf, docs):
    found, sizes = components([(d["doc_id"], d["text"]) for d in docs])
    rows = queries.QUERIES["op2_near_duplicates"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (sizes[i], c, i == c) for i, c in found.items()}


def edits(item, text):
    """Fewest edits between the item and any stretch of the text."""
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, cost = cost, [i]
        for j, t in enumerate(text, 1):
            cost.append(min(last[j - 1] + (w != t), last[j] + 1, cost[-1] + 1))
    return min(cost)


def test_op3_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, list(rng.choice(vocabulary, int(rng.integers(9, 40))))) for i in range(12)]
    texts = []
    for i in range(60):
        text = list(rng.choice(vocabulary, 60))
        if i % 2:
            own = list(items[i % 12][1])
            for _ in range(int(rng.integers(0, len(own) * 20 // 100 + 3))):
                at = int(rng.integers(len(own)))
                own[at : at + 1] = [[], ["changed"], [own[at], "added"]][int(rng.integers(3))]
            text[20:20] = own
        texts.append((i, text))
    expected = {(d, i) for d, t in texts for i, w in items if edits(w, t) <= len(w) * 20 // 100}
    frame = lambda rows, names: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], names)
    rows = decontaminate.leaks(frame(texts, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert set(found) <= expected and len(found) >= 0.97 * len(expected) and expected
    for (d, i), r in found.items():
        assert r.edits == edits(dict(items)[i], dict(texts)[d])


@pytest.mark.parametrize("percent", [10, 20])
@pytest.mark.parametrize("n", [6, 8, 10, 12, 14, 20, 30, 40, 60, 80])
def test_op3_recall_at_every_length(n, percent):
    """Items with edits of each kind at random words or with the first word changed: 0.97 are found."""
    rng = np.random.default_rng(n + percent)
    for kinds, first in (((0, 1, 2), False), ((0, 1, 2), True), ((0,), False), ((1,), True), ((2,), False)):
        items = [rng.integers(1, 1 << 63, n, dtype=np.uint64) for _ in range(100)]
        texts = []
        for item in items:
            own, at = item.tolist(), rng.choice(n, n * percent // 100, replace=False).tolist()
            at = [0, *at[1:]] if first and at and 0 not in at else at
            for place in sorted(at, reverse=True):
                new = int(rng.integers(1, 1 << 63))
                own[place : place + 1] = [[], [new], [own[place], new]][int(rng.choice(kinds))]
            texts.append(np.concatenate([rng.integers(1, 1 << 63, 30, dtype=np.uint64), np.array(own, np.uint64), rng.integers(1, 1 << 63, 30, dtype=np.uint64)]))
        found = {(t, i) for t, i, _ in decontaminate.Index(list(enumerate(items))).matches(texts)}
        assert sum((i, i) in found for i in range(100)) >= 97


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 12, 13, 15, 20, 40, 100])
def test_op3_finds_items_of_every_length_at_the_most_edits(n):
    rng = np.random.default_rng(n)
    new = lambda k: rng.integers(1, 1 << 63, k, dtype=np.uint64)
    for trial in range(100):
        item = new(n)
        own = item.tolist()
        # the first word and others are changed, taken away or put in
        for at in sorted([0, *(1 + rng.choice(n - 1, n * 20 // 100 - 1, replace=False)).tolist()] if n >= 5 else [], reverse=True):
            own[at : at + 1] = [[], new(1).tolist(), [own[at], *new(1).tolist()]][int(rng.integers(3)) if trial % 2 else 1]
        text = np.concatenate([new(30), np.array(own, np.uint64), new(30)])
        ((_, i, (k, *_)),) = decontaminate.Index([(7, item)]).matches([text])
        assert i == 7 and k <= n * 20 // 100


def test_op3_items_of_one_id_or_none(spark):
    docs = spark.createDataFrame([(1, "so the red fox runs home now"), (2, "a grey owl sleeps all day long"), (3, "then the white hen lays an egg"), (4, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "the red fox runs"), (5, "grey owl sleeps all"), (None, "white hen lays an"), (5, "the red fox runs"), (6, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(1, 5), (2, 5), (3, None)]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [4]


def test_op4_tells_quality(spark, sf):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet").to_pylist()}
    rows = queries.QUERIES["op4_quality"](spark, sf.replace("sf0.001", "sf0.01")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    pairs = [(r.score, label[r.doc_id]) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.75


def test_op4_learns_nothing_from_held_out_labels(spark, sf, tmp_path):
    """Other labels of held-out documents, or of ids without a document, change no score."""
    docs = [(i, ("good clear words about music " if i % 3 else "zz qq xx 1 2 ") * (5 + i % 7)) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}

    def scores(label):
        rows = [(i, label(i)) for i in range(500)]
        spark.createDataFrame(rows, "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return {r.doc_id: r.score for r in queries.QUERIES["op4_quality"](spark, str(tmp_path)).collect()}

    for own in (lambda i: int(i % 3 > 0), lambda i: 1):
        assert scores(own) == scores(lambda i, own=own: 1 - own(i) if out.get(i, True) else own(i))
    assert set(scores(lambda i: int(not out.get(i, True))).values()) == {1.0}


def test_op4_score_by_hand(spark):
    """Sizes compressed piece by piece with zstandard, and the fitted curve."""
    import zstandard

    from civitas.llm import quality

    rng = np.random.default_rng(2)
    make = lambda own: " ".join(rng.choice(own, 80))
    texts = [(i, make(["music", "venue", "evening", "concert"] if i % 2 else ["buy", "now", "$$$", "click"])) for i in range(300)] + [(300, ""), (301, None), (302, "é" * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(250)], "doc_id long, quality int"))
    rows = {r.doc.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    for i, text in texts:
        data, sizes = (text or "").encode(), [0, 0]
        for k, words in enumerate((model.bad, model.good)):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = sum(len(c.compress(data[at : at + 1024])) for at in range(0, len(data), 1024))
        x = np.array([(sizes[0] - sizes[1]) / sum(sizes), sizes[1] / len(data), math.log(len(data))] if data else [0, 0, 0])
        z = np.clip((x - model.middle) / model.spread, -4, 4)
        terms = [*z, *(z * z), z[1] * z[0], z[2] * z[0], z[2] * z[1], 1]
        expected = 1 / (1 + math.exp(-min(30, max(-30, float(np.dot(terms, model.weights))))))
        assert math.isclose(rows[i][0], expected, rel_tol=1e-9) and rows[i][1] == (expected >= 0.3)
    assert np.mean([rows[i][0] for i in range(251, 300, 2)]) > 0.9 > 0.1 > np.mean([rows[i][0] for i in range(250, 300, 2)])


def test_op5_base(spark, sf, docs):
    tokens = {d["doc_id"]: [*words(d["text"]), b""] for d in docs}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = queries.QUERIES["op5_lm_score"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_op5_gain(spark, sf):
    rows = queries.QUERIES["op5_lm_score"](spark, sf.replace("sf0.001", "sf0.1")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_op5_score_word_by_word(spark):
    """The score from the model's parts, a word at a time; and the same model whatever the partitions are."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["blue", "room", "stage", "night", "of", "the", "kansas"], 60)) for _ in range(60)]
    schema = "doc_id long, text string"
    learn = spark.createDataFrame(list(enumerate(texts)), schema)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counts = Counter(w for t in texts for w in lm.tokens_of(t))
    table = spark.createDataFrame(list(counts.items()), "token binary, n long")
    model = lm.train(learn, table, path)
    other = lm.train(learn.repartition(5), table, path)
    assert all(np.array_equal(model.weights[k], other.weights[k]) for k in model.weights)
    assert any(not np.array_equal(model.weights[k], lm.start(table, path).weights[k]) for k in model.weights)
    new = ["the blue room zyxomat the zyxomat " + "stage night " * 30, "", "kansas"]
    rows = lm.score(spark.createDataFrame([(i, t, True) for i, t in enumerate(new)], schema + ", held_out boolean"), learn).collect()
    total = sum(counts.values())
    first = {w: int(lm.first_ids([w], path)[0]) for t in new for w in lm.tokens_of(t)}
    of_first = Counter()
    for w, n in counts.items():
        of_first[int(lm.first_ids([w], path)[0])] += n
    for r in rows:
        tokens, expected = lm.tokens_of(new[r.doc_id]), 0.0
        heads = model.first_logs(np.array([first[w] for w in tokens]), np.array([len(tokens)]))
        for at, w in enumerate(tokens):
            unseen = math.exp(model.unseen[first[w]])
            tail = (1 - unseen) * counts[w] / of_first[first[w]] if w in counts else math.exp(model.spelled(lm._ids([w], path))[0])
            mine = lm.OWN * at / (at + lm.HALF)
            expected += math.log10((1 - mine) * math.exp(heads[at]) * tail + mine * tokens[:at].count(w) / max(at, 1))
        assert math.isclose(r.score, expected, rel_tol=1e-5) and r.train_tokens == total


def test_op5_spells_by_every_pair_of_ids(spark, monkeypatch):
    """Pairs beyond those that every task holds count as much as these."""
    rng = np.random.default_rng(5)
    parts = ["zy", "xo", "mat", "kra", "plu", "vint", "sque", "mor"]
    made = ["".join(rng.choice(parts, 4)) for _ in range(400)] + ["longer" * 9]
    learn = spark.createDataFrame([(i, " ".join(made[i : i + 20])) for i in range(0, 300, 10)], "doc_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(made[i : i + 30] + made[:2]), i >= 300) for i in range(200, 400, 10)] + [(1, made[-1], True), (2, "", True), (3, None, True)], "doc_id long, text string, held_out boolean")
    scores = lambda: {r.doc_id: r for r in lm.score(docs, learn).collect()}
    whole = scores()
    for most in (0, 40):
        monkeypatch.setattr(lm, "MOST_PAIRS", most)
        some = scores()
        assert len(some) == 23
        for i, r in whole.items():
            assert some[i][:5] == r[:5] and math.isclose(some[i].base_score, r.base_score, rel_tol=1e-9) and math.isclose(some[i].score, r.score, rel_tol=1e-6)


def test_op5_asks_once_for_equal_tokens():
    """Texts are cut, lower-cased and laid out as ``tokens_of`` does it, with each different word listed once."""
    texts = ["  The room\tTHE\x0broom É\x85é\x1f ", "", None, "room", "\n", "the the"]
    for column in (pa.array(texts), pa.array(["cut", *texts]).slice(1), pa.array(texts, pa.large_string())):
        words, at, sizes = lm.coded(column)
        tokens = [lm.tokens_of(t) for t in texts]
        assert [words[i] for i in at] == [w for t in tokens for w in t] and sizes.tolist() == [len(t) for t in tokens]
        assert len(set(words) - {b""}) == sum(w != b"" for w in words)
        before = lm.earlier(at, np.repeat(np.arange(len(sizes)), sizes))
        assert before.tolist() == [t[:i].count(w) for t in tokens for i, w in enumerate(t)]
        assert [x for piece in lm.pieces(column, 8) for x in piece.to_pylist()] == texts


def test_op5_trains_on_every_position_once():
    sizes = np.array([1, 31, 32, 33, 200])
    seen, wanted, real = attention.training_windows(np.arange(sizes.sum()), sizes)
    assert sorted(wanted[real].tolist()) == list(range(sizes.sum()))
    trainer = attention.Trainer(attention.fresh(np.zeros(attention.CLASSES)))
    trainer.add(seen % attention.CLASSES, wanted % attention.CLASSES, real)
    trainer.step()
    assert trainer.tokens == sizes.sum()


def test_attention_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    w = attention.fresh(np.zeros(attention.CLASSES))
    sizes = np.array([attention.SPAN, 20])
    classes = rng.integers(0, attention.CLASSES, 52)
    found = attention.training_windows(classes, sizes)
    for name, g in attention.gradients(w, *found).items():
        way = rng.normal(size=g.shape).astype(np.float32) * np.float32(0.02)
        loss = [-attention.token_logs(w | {name: w[name] + s * way}, classes, sizes).mean() for s in (1, -1)]
        assert math.isclose((loss[0] - loss[1]) / 2, float((g * way).sum()), rel_tol=0.05, abs_tol=2e-4)


def test_attention_scores_each_token_once_from_what_is_before_it():
    rng = np.random.default_rng(1)
    w = attention.fresh(np.zeros(attention.CLASSES))
    classes, sizes = rng.integers(0, attention.CLASSES, 200), np.array([150, 1, 49])
    logs = attention.token_logs(w, classes, sizes)
    assert np.isfinite(logs).all() and (logs < 0).all()
    mass = np.zeros(200)
    for c in range(attention.CLASSES):  # the last of each text takes every class
        other = classes.copy()
        other[np.cumsum(sizes) - 1] = c
        mass += np.exp(attention.token_logs(w, other, sizes))
    assert np.allclose(mass[np.cumsum(sizes) - 1], 1, atol=1e-3)
    later = classes.copy()
    later[100:] = (later[100:] + 1) % attention.CLASSES
    assert np.allclose(attention.token_logs(w, later, sizes)[:100], logs[:100], atol=1e-5)


def test_op6_recall_of_many_vectors_in_several_tasks(spark):
    """60,000 random vectors, of which 60 are queries, against brute force; scores exactly."""
    from civitas.llm.neighbours import nearest

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60_000, 32)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
    found = defaultdict(list)
    for r in nearest(rows, rows.where("vec_id % 1000 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 1000):
        near = unit @ unit[q]
        near[q] = -2
        best = np.argsort(-near)[:5]
        hits += len({v for v, _ in found[q]} & set(best.tolist()))
        assert all(math.isclose(s, near[v], abs_tol=1e-12) for v, s in found[q])
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
    assert hits >= 0.9 * 5 * 60


def test_op6_finds_the_nearest_of_many_near_copies(spark):
    """Groups of near copies far larger than what a code tells apart, one of them of one vector scaled, against brute force."""
    from civitas.llm.neighbours import nearest

    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(4, 32)), 1500, axis=0)
    x[1500:] += 1e-3 * rng.normal(size=x[1500:].shape)
    x[:1500] *= 1 + rng.permutation(1500)[:, None]
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
    found = defaultdict(list)
    for r in nearest(rows, rows.where("vec_id % 200 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert len(found) == 30
    norm = np.sqrt((x * x).sum(1))
    for q, got in found.items():
        near = (x * x[q]).sum(1) / (norm[q] * norm)
        near[q] = -2
        best = np.lexsort((np.arange(len(x)), -near))[:5]
        assert got == [(v, near[v]) for v in best.tolist()]


def test_op6_recall(spark, sf):
    table = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    ids, x = [r["vec_id"] for r in table], np.array([r["embedding"] for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(list)
    for r in queries.QUERIES["op6_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    hits = total = 0
    for i, q in zip(ids, x):
        if i % 50 == 0:
            best = [v for _, v in sorted((-s, v) for s, v in zip((x @ q).round(12), ids) if v != i)[:5]]
            hits, total = hits + len(set(best) & set(found[i])), total + 5
    assert total and hits / total >= 0.9


def test_op7_brute_force(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_secret_scan"](spark, sf).collect()}
    for d in docs:
        spans = []
        for order, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, d["text"] or ""):
                if len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), order, m.end(), rule.kind))
        assert rows[d["doc_id"]].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") == [] and secrets.trigram_query(r"AKIA[A-Z0-9]+") == [[["aki", "kia"]]]


def test_op8_sequences(spark):
    text = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nLicensed under the MIT License."
    (row,) = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.licenses == ["MIT", "ISC"] and row.sentence_ids == ["isc-grant", "mit-ref"]


OFFICIAL = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD-2-Clause": """1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
}
FULL = {"LGPL-2.1-or-later": "lgpl21-notice", "Zlib": "zlib-text", "MIT": "mit-text", "BSD-2-Clause": "bsd2-text", "BSD-3-Clause": "bsd3-text", "Apache-2.0": "apache-notice", "GPL-3.0-or-later": "gpl-notice", "MPL-2.0": "mpl-reference", "ISC": "isc-text"}


@pytest.mark.parametrize("leader", ["", " * ", "// ", "# ", "dnl "])
def test_op8_names_official_texts_as_they_are_wrapped(spark, leader):
    lines = lambda t: "\n".join((leader + x).rstrip() for x in ["Copyright (c) 2024 A Name", "", *t.split("\n"), "", "some code"])
    texts = [(k, e, lines(t).replace("\n", e)) for k, t in OFFICIAL.items() for e in ("\n", "\r\n")]
    for r in licenses.licenses(spark.createDataFrame(texts, "doc_id string, ends string, text string")).collect():
        assert (r.licenses, r.rules) == ([r.doc.doc_id], [FULL[r.doc.doc_id]])


@pytest.mark.parametrize("text,found", [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]), ("Foo is licensed under the MIT License.", ["MIT"]), ("This software is licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("SPDX-License-Identifier: MIT OR Apache-2.0 OR GPL-2.0-only", ["Apache-2.0", "MIT", "GPL-2.0-only"]), ("## License\nMIT License", ["MIT"]), ('"license": "ISC",', ["ISC"]),
    ("# GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", ["GPL-3.0"]), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", ["LGPL-2.1"]), ("distributed under the terms of the GNU GPL v3 or later", ["GPL-3.0-or-later"]),
    ("licensed under the\n * GNU General Public License v2.0\n * and more", ["GPL-2.0"]), ("Dual licensed under the MIT license or the Apache License 2.0.", ["Apache-2.0", "MIT"]), ("available under either the BSD 2-Clause License", ["BSD-2-Clause"]), ("subject to the terms of the Mozilla Public License, v. 2.0", ["MPL-2.0"]),
    ("mit freundlichen Gruessen", []), ("Released under mitigation", []), ("PostgreSQL", []), ("mit", []), ("under the MIT roof", []), ("licensed under the GPL 9", []), ("licensed under", []),
])
def test_op8_references_tags_and_titles(spark, text, found):
    (row,) = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.licenses == found


def test_op8_every_name_is_found_in_each_form(spark):
    each = [(k, form.format(n)) for k, (_, names) in licenses.NAMES.items() for n in names for form in ("this is licensed under the {} see there", "x\nspdx license identifier: {}\ny", "license: {}")]
    rows = licenses.licenses(spark.createDataFrame(each, "doc_id string, text string")).collect()
    assert len(licenses._BY_NAME) == sum(len(names) for _, names in licenses.NAMES.values()) > 500
    assert [(r.doc.text, r.sentence_ids) for r in rows if r.sentence_ids != [r.doc.doc_id]] == []
    every = [(k, f"Before.\n{s.upper()}.\nafter") for k, own in licenses.SENTENCES.items() for s in own]
    assert [r.doc for r in licenses.licenses(spark.createDataFrame(every, "doc_id string, text string")).collect() if r.sentence_ids != [r.doc.doc_id]] == []


def test_an_unlabelled_corpus_stays(spark, sf):
    docs = spark.createDataFrame([(1, "some words", None), (2, "été", None), (3, "12 !", None), (4, None, None), (5, "字", None)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]


def test_op9_equals_the_library(spark, sf, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in queries.QUERIES["op9_token_counts"](spark, sf).collect()}
    for d in docs:
        n = len(own.encode(d["text"] or "", add_special_tokens=False).ids)
        r = rows[d["doc_id"]]
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 1024, len((d["text"] or "").encode()))


def test_op10_round_trip(spark, sf, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op10_pack"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for d in docs:
        ids = np.array([*own.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        found = sorted(pieces[d["doc_id"]], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in found] == [(k, at, min(2048, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 2048))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in found)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.03 * -(-total // 2048) + 1


def test_best_fit_keeps_every_capacity():
    lengths = np.sort(np.random.default_rng(2).integers(1, 500, 300))[::-1]
    for by in ("norm", "dot"):
        bins, offsets = packing.best_fit(lengths, (1000, 6, 400_000), (1, 0.1, 0.1), by)
        for b in set(bins):
            held = lengths[bins == b]
            assert held.sum() <= 1000 and len(held) <= 6 and (held**2).sum() <= 400_000


def test_pipeline_stage_by_stage(spark, sf, docs):
    from civitas.llm.common import documents, staged

    now, names = documents(spark, sf), documents(spark, sf).columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in now.collect()}
        now = staged(stage(spark, now, sf), name)
        after = {r.doc_id: r for r in now.collect()}
        assert now.columns == names and set(after) <= set(before)
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "near_duplicates":
            found, _ = components([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, c in found.items() if i == c}
        if name == "decontamination":
            items = [r["text"].lower() for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
            assert not any(t and t in r.text.lower() for r in after.values() for t in items)
        if name == "secret_redaction":
            changed = {i for i, r in after.items() if r.text != before[i].text}
            assert set(after) == set(before) and all("[SECRET]" in after[i].text for i in changed) and all(r.n_chars == len(r.text) for r in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(after)
