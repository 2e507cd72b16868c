"""Operators on small tables whose results are known."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civitas.functions import quality as q
from civitas.functions import scoring as sc
from civitas.functions import text as tx
from civitas.operators import geo, joins, merge, model
from civitas.streaming import events as stream


def test_band_join_meets_brute_force_and_keeps_unmatched_rows(spark):
    left = [(i, x) for i, x in enumerate([0.0, 0.009, 0.01, -0.001, 5.0, None])]
    right = [(i, x) for i, x in enumerate([0.0, 0.0099, 0.02, -0.01, None])]
    found = joins.band_join(spark.createDataFrame(left, "a long, x double"), spark.createDataFrame(right, "b long, y double"), [("x", "y", 0.01)])
    pairs = {(r.a, r.b) for r in found.collect()}
    near = {(a, b) for a, x in left for b, y in right if x is not None and y is not None and abs(x - y) < 0.01}
    assert pairs == near | {(a, None) for a, _ in left if a not in {m for m, _ in near}}


def test_names_match_exactly_then_by_containment(spark):
    names = spark.createDataFrame([("THE BLUE ROOM",), ("blue room annex",), ("Theater!",), ("nothing",), (None,)], "query string")
    places = spark.createDataFrame([(1, "The Blue Room"), (2, "Blue Room"), (3, None)], "place_id long, name string")
    assert {(r.query, r.place_id, r.how) for r in joins.match_names(names, places).collect()} == {("THE BLUE ROOM", 1, "exact"), ("blue room annex", 2, "contained")}


def test_names_are_matched_by_equi_joins_like_all_pairs(spark, sf):
    import re

    bare = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_\s]", "", re.sub(r"\b(theater|theatre|center|centre|hall|club|district)\b", "", t.lower()))).strip()
    customers = [(r.c_custkey, r.c_name) for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name").collect()][:150]
    places = [*customers, (1001, "Blue Room Hall"), (1002, "ab"), (1003, "Ω"), (1004, "!")]
    asked = [n.upper() for _, n in customers[:20]] + [f"The {n} Hall" for _, n in customers[20:60]] + [n[3:] for _, n in customers[60:80]] + ["Theatre: Blue Room", "c", "cab", "nothing like it", "", "Ω bar", "club"]
    low = lambda q, n: q.lower() in n.lower() or n.lower() in q.lower()
    for known in (places, [*places, (2000, "")]):
        expected = set()
        for q in asked:
            clean = [i for i, n in known if bare(q) and bare(n) and (bare(q) in bare(n) or bare(n) in bare(q))]
            for how, hits in (("exact", [i for i, n in known if n.lower() == q.lower()]), ("contained", [i for i, n in known if low(q, n)]), ("cleaned", clean)):
                if hits:
                    expected.add((q, min(hits), how))
                    break
        got = joins.match_names(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(known, "place_id long, name string"))
        assert {tuple(r) for r in got.collect()} == expected
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_heat_counts_a_missing_rating_as_three(spark):
    rows = [(1, 39.1, -94.6, 4.0), (2, None, None, 3.5), (3, 39.2, -94.5, 4.2), (4, None, -94.7, 3.8)]
    venues = spark.createDataFrame(rows, "venue_id long, lat double, lng double, avg_rating double")
    bounds = geo.Bounds(39.0, 39.3, -94.8, -94.4)
    cells = geo.heat(geo.grid(spark, bounds), venues).collect()
    assert len(cells) == 400 and all(0.6 <= c.value <= 0.62 for c in cells)
    more = venues.unionByName(spark.createDataFrame([(5, 39.1, -94.6, None)], venues.schema))
    assert geo.heat(geo.grid(spark, bounds), more).count() == 400
    assert geo.heat(geo.grid(spark, bounds), venues.where("lat IS NULL")).count() == 0
    assert geo.grid(spark, geo.Bounds(39.3, 39.0, -94.8, -94.4)).count() == 0


def test_centre_of_nothing_is_the_default(spark):
    none = spark.createDataFrame([], "lat double, lng double")
    assert tuple(geo.centre(none).first()) == (39.0997, -94.5786)


def test_geojson_lines(spark, tmp_path):
    venues = spark.createDataFrame([(1, "a", 39.0, -94.0), (2, "b", None, -94.0)], "venue_id long, name string, lat double, lng double")
    geo.write_geojson(venues, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first().value
    assert '"coordinates":[-94.0,39.0]' in line and '"name":"a"' in line


@pytest.mark.parametrize("answer,titles", [
    ('```json\n[{"title": "A", "date": "2025-12-15", "time": "7:30 PM"}]\n```', ["A"]),
    ('[{"title": "A",},]', ["A"]),
    ("[{'title': 'A'}]", ["A"]),
    ('Sure: [{"title": "A", "tags": "x"}] done', ["A"]),
    ('{"events": [{"title": "A"}, {"title": ""}, {"date": "x"}]}', ["A"]),
    ("garbage", []),
    (None, []),
    ("[" + ",".join('{"title": "t%d"}' % i for i in range(60)) + "]", [f"t{i}" for i in range(50)]),
])
def test_answers_are_parsed_and_mended(spark, answer, titles):
    df = spark.createDataFrame([(answer,)], "answer string").select(tx.parse_events(F.col("answer")).alias("e"))
    assert [e.title for e in df.first().e] == titles


@pytest.mark.parametrize("day,time,at", [
    ("2025-12-15", "7:30 PM", datetime(2025, 12, 15, 19, 30)), ("12/5/2025", None, datetime(2025, 12, 5)), ("December 15, 2025", "19:30", datetime(2025, 12, 15, 19, 30)),
    ("on 2025-1-5 perhaps", "soon", datetime(2025, 1, 5)), ("never", None, None), (None, None, None),
])
def test_dates(spark, day, time, at):
    row = spark.createDataFrame([(day, time)], "d string, t string").select(tx.parse_time(F.col("d"), F.col("t")).cast("timestamp_ntz").alias("at")).first()
    assert row.at == at


def test_html(spark):
    html = "<html><head><title> T </title><meta name='description' content='D'><style>x{}</style></head><body><nav>n</nav><p>Hello\n<b>you</b></p><script>s()</script></body></html>"
    df = spark.createDataFrame([(html,), (None,)], "html string")
    row, none = df.select(tx.strip_html(F.col("html")).alias("text"), tx.page_title(F.col("html")).alias("title"), tx.meta_description(F.col("html")).alias("meta"), tx.acceptable(F.col("html")).alias("ok")).collect()
    assert row.text == "T Hello you" and row.title == "T" and row.meta == "D" and not row.ok
    assert none.text is None and none.ok is False


def test_blocks_of_the_first_selector(spark):
    html = "<div class='card x'>one</div><div class='event'>two</div><div class='card'>three</div>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = tx.first_blocks(pages, [("li", "event"), ("div", "card")]).orderBy("place").collect()
    assert [r.block for r in rows] == ["<div class='card x'>one</div>", "<div class='card'>three</div>"]


def _verdict(spark, rule, value, kind="string"):
    r = spark.createDataFrame([(value,)], f"c {kind}").select(rule(F.col("c")).alias("r")).first().r
    return r.is_valid, round(r.score, 4)


@pytest.mark.parametrize("rule,value,expected", [
    (q.name, "a", (False, 0.2)), (q.name, "x" * 201, (False, 0.3)), (q.name, "12345", (False, 0.4)), (q.name, "abc", (True, 0.7)), (q.name, "x" * 101, (True, 0.8)), (q.name, "a fine name", (True, 1.0)), (q.name, None, (False, 0.2)),
    (q.description, "short", (False, 0.6)), (q.description, "x" * 30, (True, 0.7)), (q.description, "x" * 60, (True, 1.0)), (q.description, "x" * 2001, (False, 0.3)),
    (q.phone, "+1-816-555-0123", (True, 1.0)), (q.phone, "555-0123", (False, 0.5)), (q.url, "https://a.org/x", (True, 1.0)), (q.url, "http://a.org", (True, 0.8)), (q.url, "nope", (False, 0.0)),
    (lambda c: q.coordinate(c, "lat"), "39.1", (True, 1.0)), (lambda c: q.coordinate(c, "lat"), "45", (True, 0.7)), (lambda c: q.coordinate(c, "lat"), "91", (False, 0.0)), (lambda c: q.coordinate(c, "lat"), "x", (False, 0.0)),
    (q.model_version, "v1.2", (True, 1.0)), (q.model_version, "one", (False, 0.7)), (q.feature_list, '["a"]', (True, 1.0)), (q.feature_list, "[]", (False, 0.3)), (q.feature_list, "[1]", (False, 0.6)), (q.feature_list, "x", (False, 0.0)),
    (q.scores, '{"fun": 0.5}', (True, 1.0)), (q.scores, '{"fun": 2}', (True, 0.7)), (q.scores, '{"x": "y"}', (True, 0.45)), (q.scores, "bad", (False, 0.0)),
])
def test_validators(spark, rule, value, expected):
    assert _verdict(spark, rule, value) == expected


def test_keyword_scores_and_markers(spark):
    row = spark.createDataFrame([("Party and MUSIC",), (None,)], "t string").select(*(c.alias(k) for k, c in sc.keyword_scores(F.col("t"), sc.VENUE_KEYWORDS).items())).collect()
    assert row[0].fun == 2 / 8 and row[1].fun == 0
    got = spark.createDataFrame([(0.8,), (0.79,), (0.1,)], "s double").select(sc.marker(F.col("s")).radius.alias("r")).collect()
    assert [r.r for r in got] == [12, 10, 4]


def test_upsert_replace_and_seed(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id long, name string, n long")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 9), (None, "N", 8)], "id long, name string, n long")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(merge.upsert(old, new, ["id"])) == {(1, "a", 1), (2, "B", None), (3, "c", 9), (None, "N", 8)}
    assert rows(merge.upsert(old, new, ["id"], ["name"])) == {(1, "a", 1), (2, "B", 2), (3, "c", 9), (None, "N", 3)}
    assert rows(merge.insert_absent(old, new, ["id"])) == rows(old) | {(3, "c", 9)}
    assert rows(merge.replace_by_key(old, new.drop("n"), ["id"])) == {(1, "a", 1), (2, "B", None), (3, "c", None), (None, "N", None)}


def test_run_status_folds_in_order(spark):
    runs = spark.createDataFrame([("s", 3, False, 9.0, 0), ("s", 1, True, 2.0, 5), ("s", 2, True, 4.0, 5), ("t", 1, False, 1.0, 0)], "source_name string, seq long, success boolean, duration double, records long")
    got = {r.source_name: r for r in merge.run_status(runs).collect()}
    assert (got["s"].success_count, got["s"].error_count, got["s"].consecutive_errors, got["s"].avg_duration, round(got["s"].health, 6), got["s"].total_records) == (2, 1, 1, 3.0, 0.5, 10)
    assert round(got["t"].health, 6) == 0.3


def test_run_status_of_a_hot_source_needs_no_array_of_its_runs(spark):
    import random

    rng = random.Random(4)
    rows = [("hot", k, rng.random() < 0.6, float(k % 7), k % 5) for k in range(3000)] + [(None, k, k % 3 == 0, 1.0, 1) for k in range(10)] + [("bad", k, False, 1.0, 1) for k in range(5)]
    rng.shuffle(rows)
    runs = spark.createDataFrame(rows, "source_name string, seq long, success boolean, duration double, records long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # many blocks of a source
    try:
        status = merge.run_status(runs)
        got = {r.source_name: r for r in status.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {"hot", None, "bad"}
    for name, r in got.items():
        health, streak = 5, 0
        for _, _, good, *_ in sorted((x for x in rows if x[0] == name), key=lambda x: x[1]):
            health, streak = (min(10, health + 1), 0) if good else (max(0, health - 2), streak + 1)
        known = [x for x in rows if x[0] == name and x[2]]
        assert (r.health, r.consecutive_errors, r.success_count) == (health / 10, streak, len(known))
        assert r.total_records == sum(x[4] for x in known) and abs(r.avg_duration - sum(x[3] for x in known) / max(1, len(known))) < 1e-9
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(seq" not in plan and "RepartitionByExpression" in plan


def test_snapshots_and_a_stream_into_them(spark, tmp_path):
    store = merge.Snapshots(spark, str(tmp_path / "store"))
    with pytest.raises(Exception):
        store.read()
    schema = "event_id long, category string"
    store.commit(spark.createDataFrame([(1, "a")], schema), 0)
    spark.createDataFrame([(1, "b"), (2, "c")], schema).write.parquet(str(tmp_path / "in"))
    stream.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, ["event_id"], str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in store.read().collect()} == {(1, "b"), (2, "c")}
    assert {tuple(r) for r in store.read(0).collect()} == {(1, "a")}


def test_windowed_counts_stream_equals_batch(spark, sf, tmp_path):
    from civitas.sources import bridge

    batch = bridge.events(spark, sf).select("start_time", "category", "value")
    batch.write.parquet(str(tmp_path / "in"))
    live = stream.windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    live.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: {(r.start, r.category, r.n) for r in df.collect()}
    assert rows(spark.table("windows")) == rows(stream.windowed_counts(batch))


def test_folds_expand_and_training_needs_both_labels(spark):
    df = spark.range(60).withColumnRenamed("id", "venue_id")
    sizes = [r["count"] for r in model.folds(df, "venue_id").groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [10] * 6
    assert [r["count"] for r in model.folds(df.where("venue_id < 47"), ["venue_id"]).groupBy("fold").count().orderBy("fold").collect()] == [12, 7, 7, 7, 7, 7]
    assert {r.fold for r in model.folds(df.where("venue_id < 4"), "venue_id").collect()} == {0}
    rows = df.select("venue_id", *(F.lit(1.0).alias(c) for c in model.FEATURES), F.lit(1).alias("label"))
    with pytest.raises(ValueError):
        model.train(rows, n=2, rounds=1)


def test_gbt_query_trains_with_all_folds_and_stops_by_the_fold(spark, sf, monkeypatch):
    import inspect

    from civitas.plans import registry

    seen = []

    def spy(rows, *args, **named):
        seen.append((args, named))
        raise StopIteration

    defaults = {k: p.default for k, p in inspect.signature(model.train).parameters.items()}
    assert (defaults["n"], defaults["rounds"]) == (5, 1000)
    monkeypatch.setattr(model, "train", spy)
    with pytest.raises(StopIteration):
        registry.QUERIES["gbt_train_predict"](spark, sf)
    assert seen == [((), {"order": ["seen", "venue_id"]})]


def test_exact_quantile_narrows_to_the_value(spark):
    from civitas.operators.quantile import exact_quantile

    rng = np.random.default_rng(4)
    for x in (rng.normal(size=5000), np.repeat([1.0, 2.0, 3.0], 2000), rng.integers(0, 5, 5001).astype(float), np.array([7.0])):
        df = spark.createDataFrame(pa.table({"x": x}))
        for q in (0.0, 0.3, 0.8, 1.0):
            assert abs(exact_quantile(df, "x", q, few=50) - np.quantile(x, q)) < 1e-12
    assert exact_quantile(df.where("false"), "x", 0.5) is None


def test_a_reader_refuses_filters_that_it_does_not_know(spark):
    from civitas.operators import reader

    df = spark.createDataFrame([(1, "bar")], "venue_id long, category string")
    with pytest.raises(ValueError, match="unknown filters: city"):
        reader.get_venues(df, {"city": "x"})
    assert reader.get_venues(df, {"category": None}).count() == 1


def test_an_empty_store_has_no_version(spark, tmp_path):
    from civitas.operators.merge import Snapshots

    store = Snapshots(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.read()
    store.commit(spark.range(2).toDF("x"), 1)
    assert store.read().count() == 2


def test_collection_falls_back_and_models_age(spark, tmp_path):
    from pyspark.sql import functions as F

    from civitas.operators import collect, model

    own = spark.createDataFrame([("a", 1)], "provider string, n int")
    more = spark.createDataFrame([("a", 2), ("b", 3)], "provider string, n int")
    assert sorted(r.n for r in collect.with_fallback(own, more).collect()) == [1, 3]
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    ages = spark.createDataFrame([("2024-01-10",), ("2024-01-01",), (None,)], "t string").select(model.is_recent(F.col("t").cast("timestamp_ntz"), now).alias("r"))
    assert [r.r for r in ages.collect()] == [True, False, False]


def test_the_catalog_lists_tables_and_seeds_what_is_absent(spark, sf):
    from civitas.sources import catalog

    names = catalog.register(spark, sf, "seen_")
    assert spark.sql("SELECT count(*) AS n FROM seen_venues").first().n == {r.name: r.records for r in catalog.counts(spark, sf).collect()}["venues"]
    assert {f"seen_{r.table_name}" for r in catalog.columns(spark, sf).collect()} == set(names)
    config = spark.createDataFrame([("a", "9", "integer")], catalog.CONFIG)
    found = {r.config_key: (r.config_value, r.config_type) for r in catalog.seed_config(config, {"a": 1, "b": 0.5, "c": True, "d": "x"}).collect()}
    assert found == {"a": ("9", "integer"), "b": ("0.5", "float"), "c": ("True", "boolean"), "d": ("x", "string")}
    sources = spark.createDataFrame([("own", "api", False, 5, 1)], catalog.SOURCES)
    assert sorted((r.source_name, r.is_enabled) for r in catalog.seed_sources(sources, {"own": "api", "new": "scraped"}).collect()) == [("new", True), ("own", False)]


def test_noise_follows_from_key_and_seed_and_collections_hold_all_features(spark):
    import json

    df = spark.range(500).select(F.col("id").alias("venue_id"), (F.col("id") / 10).alias("lat"), F.lit(1.0).alias("lng"))
    one = {r.venue_id: r.n for r in df.select("venue_id", sc.noise(F.col("venue_id"), 0.1).alias("n")).collect()}
    again = {r.venue_id: r.n for r in df.repartition(7).select("venue_id", sc.noise(F.col("venue_id"), 0.1).alias("n")).collect()}
    assert one == again and all(abs(n) <= 0.1 for n in one.values()) and len(set(one.values())) > 490
    parts = geo.feature_collections(df, 100).collect()
    held = [f["properties"]["venue_id"] for r in parts for f in json.loads(r.geojson)["features"]]
    assert sorted(held) == list(range(500)) and len(parts) > 1 and sum(r.features for r in parts) == 500


@pytest.mark.parametrize("text,at", [
    ("2025-12-15 19:30:00", datetime(2025, 12, 15, 19, 30)), ("2025-12-15T19:30:00.250Z", datetime(2025, 12, 15, 19, 30, 0, 250000)), ("Dec 15, 2025", datetime(2025, 12, 15)), ("15 December 2025", datetime(2025, 12, 15)),
    ("December 15 2025", datetime(2025, 12, 15)), ("12-15-2025", datetime(2025, 12, 15)), ("12/15/25", datetime(2025, 12, 15)), ("Mon, 15 Dec 2025", datetime(2025, 12, 15)), ("15/12/2025", datetime(2025, 12, 15)),
    ("Doors open Friday, Dec 5 at 7:30 PM", datetime(2025, 12, 5, 19, 30)), ("friday 8 p.m.", datetime(2025, 11, 21, 20)), ("thursday", datetime(2025, 11, 20)), ("7:30 PM", datetime(2025, 11, 20, 19, 30)), ("12:05 am", datetime(2025, 11, 20, 0, 5)),
    ("February 2025", datetime(2025, 2, 20)), ("20251215T193000", datetime(2025, 12, 15, 19, 30)), ("3/4", datetime(2025, 3, 4)), ("the 4th of July 2026", datetime(2026, 7, 4)), ("May 5 '26", datetime(2026, 5, 5)), ("1. Jan. 1999", datetime(1999, 1, 1)),
    ("Sept 3rd, 2025, 19:30", datetime(2025, 9, 3, 19, 30)), ("1/2/80", datetime(1980, 1, 2)), ("Dec 15 19:30", datetime(2025, 12, 15, 19, 30)), ("Feb 30 2025", None), ("every day", None), ("mayor 5", None), ("25:70", None), ("", None), (None, None),
])
def test_times_as_people_write_them(spark, text, at):
    now = F.lit(datetime(2025, 11, 20, 10))
    assert spark.createDataFrame([(text,)], "t string").select(tx.flexible_time(F.col("t"), now).alias("at")).first().at == at


@pytest.mark.parametrize("day,time,at", [("2025-12-15T18:00", "8pm", datetime(2025, 12, 15, 20)), ("2025-12-15 18:00", "soon", datetime(2025, 12, 15, 18)), ("2025-12-15T18:00:00", None, datetime(2025, 12, 15, 18))])
def test_a_time_that_is_there_stays(spark, day, time, at):
    row = spark.createDataFrame([(day, time)], "d string, t string").select(tx.parse_time(F.col("d"), F.col("t")).cast("timestamp_ntz").alias("at")).first()
    assert row.at == at


def test_damaged_answers_give_what_a_json_parser_gives_of_whole_ones(spark):
    """Random values full of quotes, commas, braces and escapes; commas too many, and single quotes around some."""
    import json

    rng = random.Random(5)
    pieces = ["\"", "'", ",", "}", "]", "{", "[", ":", "\\", "\n", "é", "a", "Jazz", " ", "x: 'y', z", ",}", "it's", "\\\"", "\t"]
    value = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(8))) + "end"
    rows, expected = [], []
    for at in range(400):
        events = [{"title": value(), "date": value(), "price": value()} for _ in range(rng.randrange(1, 4))]
        gap = lambda: rng.choice(["", " ", "\n", ","]) * (at % 4 > 0)
        quoted = lambda key: f"'{key}'" if at % 4 == 2 else json.dumps(key)
        each = ["{" + ", ".join(f"{quoted(k)} : {json.dumps(v)}" for k, v in e.items()) + gap() + "}" for e in events]
        rows.append((at, "[" + ",".join(each) + gap() + "]" + (" trailing words" if at % 4 == 3 else "")))
        expected.append([tuple(e.values()) for e in events])
    found = {r.at: [(e.title, e.date, e.price) for e in r.e] for r in spark.createDataFrame(rows, "at int, a string").select("at", tx.parse_events(F.col("a")).alias("e")).collect()}
    assert [found[at] for at in range(400)] == expected


@pytest.mark.parametrize("answer,titles", [
    ('[{"title": "x: \'y\', z",}]', ["x: 'y', z"]), ("[{'title': 'say \"hi\", it's me'}]", ['say "hi", it\'s me']), ('[{"title": "The "Best" Show",},]', ['The "Best" Show']), ('go [{"title": "a {b} c",} and {"title": "d"} and {"title": ]', ["a {b} c", "d"]),
    ('[{"title": "' + 'long \\" text, ' * 20_000 + '",}]', ['long " text, ' * 20_000]), ("[{'title': 'un", []), ("[", []),
])
def test_values_keep_their_quotes_and_braces(spark, answer, titles):
    assert [e.title for e in spark.createDataFrame([(answer,)], "a string").select(tx.parse_events(F.col("a")).alias("e")).first().e] == titles


@pytest.mark.parametrize("seed", range(3))
def test_totals_within_meet_brute_force(spark, seed):
    from civitas.operators import ranges

    rng = np.random.default_rng(seed)
    left = [(i, int(x)) for i, x in enumerate(rng.integers(-50, 50, 300))] + [(300, None), (301, 10**15)]
    right = [(int(x), int(v)) for x, v in zip(rng.integers(-60, 60, 400), rng.integers(-(10**15), 10**15, 400))] + [(None, 5), (0, None)] + [(7, 1)] * 200
    found = ranges.totals_within(spark.createDataFrame(left, "id long, at long"), spark.createDataFrame(right, "r long, v long").repartition(3), "at", "r", 10, {"total": "v"}).collect()
    assert {r.id: (r.matches, int(r.total)) for r in found} == {i: (sum(x is not None and abs(x - t) < 10 for x, _ in right), sum(v or 0 for x, v in right if x is not None and abs(x - t) < 10)) if t is not None else (0, 0) for i, t in left}
    empty = spark.createDataFrame([], "r long, v long")
    assert {(r.matches, int(r.total)) for r in ranges.totals_within(spark.createDataFrame(left, "id long, at long"), empty, "at", "r", 10, {"total": "v"}).collect()} == {(0, 0)}
    assert ranges.totals_within(spark.createDataFrame([], "id long, at long"), empty, "at", "r", 10, {}).count() == 0


def test_running_totals_over_borders_of_ranges(spark):
    from civitas.operators import ranges

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small ranges are read as one
    try:
        rows = ranges.running(spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "9000000000000000 + (id * 37) % 1000 AS v"), ["k"], ["v"]).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total = 0
    for k, r in enumerate(rows):
        total += 9_000_000_000_000_000 + k
        assert (r.k, int(r.run_v)) == (k, total)


def test_ranks_over_borders_of_ranges(spark):
    from civitas.operators.order import ranked

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1000).selectExpr("CAST(id % 7 AS INT) AS a", "id AS b", "'x' AS other").unionByName(spark.createDataFrame([(None, 5, "y")], "a int, b long, other string"))
        rows = ranked(df, ["a", "b"]).orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r.rank for r in rows] == list(range(1001)) and rows[0].other == "y"
    assert [(r.a, r.b) for r in rows[1:]] == sorted((i % 7, i) for i in range(1000))
    assert ranked(df.where("false"), ["a"]).count() == 0


def _learnable(spark, n=80):
    rng = np.random.default_rng(1)
    rows = [(i, *(float(x) for x in rng.normal(size=len(model.FEATURES)))) for i in range(n)]
    df = spark.createDataFrame(rows, "venue_id long, " + ", ".join(f"{c} double" for c in model.FEATURES))
    return df.withColumn("label", (F.col("avg_rating") + F.col("fun") / 2 > 0).cast("int"))


def test_patience_finds_the_least_loss(spark):
    from pyspark.ml import Pipeline

    rows = model.folds(_learnable(spark), "venue_id").withColumn("label", F.col("label").cast("double"))
    past, now = rows.where("fold < 2"), rows.where("fold = 2")
    whole = Pipeline(stages=model._stages("label", 8)).fit(past)
    loss = whole.stages[1].evaluateEachIteration(whole.stages[0].transform(now))
    found = model.patient(past, now, "label", 8, 2)
    trees = found.stages[1].getNumTrees
    ends = [k for k in range(1, 9) if loss[k - 1] == min(loss[: min(8, k + 2)])]
    assert trees in ends and found.stages[1].evaluateEachIteration(found.stages[0].transform(now)) == pytest.approx(loss[:trees])


def test_models_are_stored_found_and_kept_while_recent(spark, tmp_path):
    root, now, rows = str(tmp_path / "models"), datetime(2025, 1, 10), _learnable(spark, 40)
    assert model.newest(spark, root) is None and model.stored(spark, root).count() == 0
    assert not model.train_stored(rows.where("false"), root, "v0", now).success
    assert model.train_stored(rows.withColumn("label", F.lit(1)), root, "v0", now, n=2, rounds=1).message == "no fold has both labels"
    first = model.train_stored(rows, root, "v1", now, n=2, rounds=2)
    assert first.success and (first.rows, first.message) == (40, None)
    again = model.train_stored(rows, root, "v2", datetime(2025, 1, 16), n=2, rounds=2)
    assert (again.version, again.rows, again.score) == ("v1", 0, first.score)
    assert model.train_stored(rows, root, "v2", datetime(2025, 1, 18), n=2, rounds=1).version == "v2"
    assert model.train_stored(rows, root, "v3", datetime(2025, 1, 18), retrain=True, n=2, rounds=1).version == "v3"
    assert [(r.version, r.trained_at.day) for r in model.stored(spark, root).orderBy("version").collect()] == [("v1", 10), ("v2", 18), ("v3", 18)]
    made, kept = model.predict(model.load(root, "v3"), rows), model.predict(model.newest(spark, root), rows)
    assert made.collect() == kept.collect()
    stored = model.prediction_rows(made, "v3", F.lit(now)).first()
    assert (stored.prediction_type, stored.model_version, stored.generated_at) == ("attendance", "v3", now) and 0 <= stored.prediction_value <= 1


@pytest.mark.parametrize("metres", [30_000.0, 2_000_000.0, 15_000_000.0])
def test_covered_meets_brute_force_at_poles_and_the_date_line(spark, metres):
    import math

    rng = np.random.default_rng(int(metres))
    spots = lambda n: [(float(a), float(b)) for a, b in zip(np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n))]
    close = [(89.99, 10.0), (89.95, -170.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -179.9), (0.1, 179.95), (51.0, -0.05), (51.0, 0.05), (90.0, 77.0), (None, 1.0)]
    records, points = [(i, *x) for i, x in enumerate(spots(120) + close)], [(i, *x) for i, x in enumerate(spots(80) + close)]

    def far(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * geo.RADIUS * math.asin(math.sqrt(min(1, h)))

    expected = {(r, p): far(a, b, c, d) for r, a, b in records if a is not None for p, c, d in points if c is not None}
    expected = {k: v for k, v in expected.items() if v <= metres}
    df, at = spark.createDataFrame(records, "id long, lat double, lng double"), spark.createDataFrame(points, "point_id long, p_lat double, p_lng double")
    found = [(r.id, r.point_id, r.distance) for r in geo.covered(df, at, metres).collect()]
    assert sorted(x[:2] for x in found) == sorted(expected) and all(math.isclose(d, expected[a, b], rel_tol=1e-6, abs_tol=1e-3) for a, b, d in found)
    nearest = {r.id: r.point_id for r in geo.nearest_point(df, at, "id", metres).collect()}
    assert nearest.keys() == {a for a, _ in expected} and all(math.isclose(expected[a, p], min(d for (x, _), d in expected.items() if x == a), rel_tol=1e-6, abs_tol=1e-3) for a, p in nearest.items())


def test_answer_files_and_pages_of_a_search(spark, tmp_path):
    import json

    from civitas.operators import collect

    place = lambda k: {"place_id": f"p{k}", "name": f"n{k}", "rating": 4.5, "types": ["bar"], "geometry": {"location": {"lat": 39.0, "lng": -94.5}}}
    own = {"a": {"search_id": "x", "next_page_token": "1", "results": [place(1)]}, "b": {"search_id": "x", "page_token": "1", "next_page_token": "2", "results": [place(2), place(1)]}, "c": {"search_id": "x", "page_token": "2", "next_page_token": "3", "results": [place(3)]},
           "d": {"search_id": "x", "page_token": "3", "results": [place(4)]}, "e": {"search_id": "y", "page_token": "1", "results": [place(5)]}, "f": {"search_id": "z", "results": []}, "g": {"results": [place(6)]}}
    for name, body in own.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "h.json").write_text('{"search_id": "w", "results": [')
    answers = collect.answer_files(spark, str(tmp_path))
    assert {r.file: r.problem is not None for r in answers.collect()} == {f"{k}.json": k in "gh" for k in "abcdefgh"}
    found = collect.search_pages(answers)
    assert sorted((r.search_id, r.page) for r in found.collect()) == [("x", 1), ("x", 2), ("x", 3), ("z", 1)]
    assert sorted(r.external_id for r in collect.place_rows(found).collect()) == ["p1", "p2", "p3"]


def test_every_filter_of_venues(spark):
    from civitas.operators import reader

    rows = [(1, 39.0, -94.5, "a", '{"fun": 0.2, "social": 0.9}'), (2, 39.5, -94.5, "a", '{"fun": 0.8}'), (3, 39.0, -94.9, "b", None), (4, None, None, "a", "broken")]
    df = spark.createDataFrame(rows, "venue_id long, lat double, lng double, provider string, psychographic_relevance string")
    ids = lambda **f: [r.venue_id for r in reader.get_venues(df, f).orderBy("venue_id").collect()]
    assert ids(provider="a") == [1, 2, 4] and ids(psychographic_min=0.85) == [1] and ids(bounds={"min_lat": 39.2}) == [2] and ids(bounds={"max_lat": 39.2, "min_lng": -94.6, "max_lng": -94.0}) == [1]
    assert ids(bounds={"min_lat": 39.0, "max_lat": 39.5}, provider="a", psychographic_min=0.5) == [1, 2] and ids(bounds={}) == [1, 2, 3, 4]


def test_names_without_city_words_and_with_letters_of_every_script(spark):
    places = spark.createDataFrame([(1, "Jazz House (Kansas City)"), (2, "Café Zoë"), (4, "The Hall")], "place_id long, name string")
    expected = {"Kansas City Jazz": 1, "Jazz House Kansas City": 1, "jazz house kc": 1, "Café Zoë!": 2, "The Hall": 4}
    asked = spark.createDataFrame([(q,) for q in (*expected, "KC", "caf zo")], "query string")
    assert {r.query: r.place_id for r in joins.match_names(asked, places).collect()} == expected


def test_nearest_of_dense_and_repeated_places_meets_brute_force(spark):
    rng = np.random.default_rng(3)
    spot = lambda n, width: np.round(rng.uniform(0, width, (n, 2)), 6) + [39.0, -94.0]
    dense, wide = spot(1500, 0.002), spot(60, 0.05)
    places = np.concatenate([dense, dense[:300], wide, wide])
    asked = np.concatenate([spot(40, 0.002), spot(80, 0.05), dense[:5]])
    rows = [(i, *map(float, x)) for i, x in enumerate(asked)] + [(1000, None, 1.0), (1001, 10.0, 10.0)]
    points = [(i, *map(float, x), 10 * i) for i, x in enumerate(places)]
    df, at = spark.createDataFrame(rows, "id long, lat double, lng double"), spark.createDataFrame(points, "p long, r_lat double, r_lng double, income long")
    assert joins.levels(at.select("r_lat", "r_lng").distinct(), F.struct(F.floor(F.col("r_lat") / 0.01), F.floor(F.col("r_lng") / 0.01))) > 2
    found = {r.id: (r.p, r.income, r.distance) for r in joins.nearest_in_box(df, at, "id", "p").collect()}
    expected = {1000: (None, None, None), 1001: (None, None, None)}
    for i, x in enumerate(asked):
        gap = np.abs(places - x)
        near = [(round(float(a + b), 9), p, 10 * p) for p, (a, b) in enumerate(gap.tolist()) if a < 0.01 and b < 0.01]
        d, p, income = min(near, default=(None, None, None))
        expected[i] = (p, income, d)
    assert found == expected
    at = at.select(F.col("p").alias("point_id"), F.col("r_lat").alias("p_lat"), F.col("r_lng").alias("p_lng"))
    all_pairs = geo.covered(df, at, 1500.0).groupBy("id").agg(F.min(F.struct("distance", "point_id")).alias("b")).select("id", "b.point_id", "b.distance")
    assert sorted(map(tuple, geo.nearest_point(df, at, "id", 1500.0).collect())) == sorted(map(tuple, all_pairs.collect()))


def test_nearest_makes_no_pairs_of_repeated_places(spark):
    """Two thousand rows and points of one place: pairs of rows would be four million."""
    df = spark.range(2000).select("id", F.lit(39.0).alias("lat"), F.lit(-94.0).alias("lng"))
    at = spark.range(2000).select(F.col("id").alias("p"), F.lit(39.001).alias("r_lat"), F.lit(-94.0).alias("r_lng"))
    found = joins.nearest_in_box(df, at, "id", "p").agg(F.count("*"), F.min("p"), F.max("p")).first()
    assert tuple(found) == (2000, 0, 0)
    plan = joins.nearest_in_box(df, at, "id", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") >= 3  # points, rows and pairs are aggregated, and no pair is sorted


def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading

    both, fit = threading.Barrier(2, timeout=60), model.Pipeline.fit

    def meet(self, rows):
        both.wait()  # broken if the other fold's fit begins after this one
        return fit(self, rows)

    monkeypatch.setattr(model.Pipeline, "fit", meet)
    rows = spark.range(60).select(F.col("id").alias("venue_id"), *((F.col("id") % 7).cast("double").alias(c) for c in model.FEATURES), (F.col("id") % 2).alias("label"))
    trained, score = model.train(rows, n=2, rounds=1)
    assert trained.stages[-1].getNumTrees == 1 and 0 <= score <= 1


def test_names_are_matched_without_a_broadcast(spark):
    names, places = spark.createDataFrame([("the blue room", 1)], "name string, place_id long"), spark.createDataFrame([("Blue Room",)], "query string")
    plans = [joins.match_names(places, names), joins.containing(places.select(F.col("query").alias("small")), names.select(F.col("name").alias("large")))]
    assert all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in plans)


def test_a_square_of_pairs_is_dealt_over_tasks(spark, monkeypatch):
    """All rows of both sides lie within a cell: no task meets more than its share, and every pair is met once."""
    left = spark.range(2003).select(F.col("id").alias("a"), F.when(F.col("id") < 2000, (F.col("id") % 100).cast("double")).alias("at"))
    right = spark.range(150).select(F.col("id").alias("b"), F.col("id").cast("double").alias("r_at"))
    monkeypatch.setattr(joins, "PER_TASK", 30_000)
    monkeypatch.setattr(joins, "PER_KEY", 3_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for sides that are too large
    try:
        found = joins.band_join(left, right, [("at", "r_at", 1000.0)], deal=["a"])
        rows = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("b").alias("n"), F.count("*").alias("all"), F.count_distinct("a", "b").alias("pairs")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(r.n for r in rows) == sum(r.pairs for r in rows) == 2000 * 150 and sum(r["all"] for r in rows) == 2000 * 150 + 3
    assert max(r.n for r in rows) < 75_000 and len([r for r in rows if r.n]) >= 5
