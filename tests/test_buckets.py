"""Stores by key and by place: what a merge touches, what a join exchanges, what a box reads."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from civitas.operators import buckets

SCHEMA = "id long, kind string, name string, rating double"


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/data") for f in names if f.startswith("part-")}


def test_a_merge_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path / "s"), ["id", "kind"], SCHEMA, 16)
    assert store.latest() is None and store.read().count() == 0 and store.read().columns == ["id", "kind", "name", "rating"]
    rows = [(i, "a" if i % 2 else None, f"n{i}", 1.0) for i in range(400)]
    assert store.merge(spark.createDataFrame(rows, SCHEMA)) == 0
    before, first = _files(store.root), store.manifest()
    assert len(first) == 16 and sorted(map(tuple, store.read().collect()), key=str) == sorted(rows, key=str)
    new = [(3, "a", "new", None), (900, None, "more", 2.0)]
    assert store.merge(spark.createDataFrame(new, SCHEMA), ["name"]) == 1
    after, second = _files(store.root), store.manifest()
    changed = {k for k in range(16) if first.get(k) != second.get(k)}
    assert 1 <= len(changed) <= 2 and all(after[f] == t for f, t in before.items())
    assert len(set(after) - set(before)) == len(changed)
    found = {(r.id, r.kind): (r.name, r.rating) for r in store.read().collect()}
    assert len(found) == 401 and found[3, "a"] == ("new", 1.0) and found[900, None] == ("more", 2.0) and found[4, None] == ("n4", 1.0)
    assert {tuple(r) for r in store.read(0).collect()} == set(rows)
    assert store.merge(spark.createDataFrame([], SCHEMA)) == 1
    assert [r.name for r in store.find(spark.createDataFrame([(900, None), (5, "b")], "id long, kind string")).collect()] == ["more"]


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path / "s"), ["id"], "id long, name string", 4)
    store.merge(spark.createDataFrame([(1, "a")], "id long, name string"))
    late = buckets.BucketStore(spark, store.root, ["id"], store.schema, 4)
    late.latest = lambda: None  # it read the store before the first write
    with pytest.raises(AnalysisException):
        late.merge(spark.createDataFrame([(2, "b")], "id long, name string"))
    assert [r.id for r in store.read().collect()] == [1]


def test_tables_by_key_join_and_group_without_an_exchange(spark):
    left = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("p"), F.rand(1).alias("x"))
    right = left.where("k % 3 = 0").select("k", "p", F.lit("y").alias("y"))
    a, b = (buckets.save_by_key(df, f"by_key_{n}", ["k", "p"], 8) for n, df in enumerate((left, right)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, grouped = a.join(b, ["k", "p"], "full_outer"), a.groupBy("k", "p").agg(F.sum("x"))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (joined, grouped)]
        assert joined.count() == 1000 and joined.where("y IS NOT NULL").count() == 334 and grouped.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("Exchange" not in p and "Bucketed: true" in p for p in plans)
    for n in (0, 1):
        spark.sql(f"DROP TABLE by_key_{n}")


def test_the_curve_interleaves_bits(spark):
    rows = [(-90.0, -180.0, 0), (90.0, 180.0, (1 << 32) - 1), (0.0, -180.0, 1 << 31), (-90.0, 0.0, 1 << 30), (None, 1.0, None)]
    found = spark.createDataFrame(rows, "lat double, lng double, at long").select("at", buckets.curve(F.col("lat"), F.col("lng")).alias("c")).collect()
    assert [r.c for r in found] == [r.at for r in found]
    cells = spark.range(256 * 256).select((F.col("id") % 256).alias("i"), F.floor(F.col("id") / 256).alias("j"))
    lat, lng = -90 + (F.col("i") + 0.5) * 180 / 256, -180 + (F.col("j") + 0.5) * 360 / 256
    assert cells.select(buckets.curve(lat, lng, 8).alias("c")).distinct().agg(F.count("*"), F.max("c")).first()[:] == (65536, 65535)


def test_a_box_reads_few_row_groups(spark, tmp_path):
    df = spark.range(40_000).select(F.col("id").alias("k"), (38 + (F.col("id") * 7919 % 20_011) / 10_000).alias("lat"), (-95 + (F.col("id") * 6007 % 20_021) / 10_000).alias("lng"))
    at = str(tmp_path / "places")
    buckets.save_by_place(df, at, 16, 500)
    box = buckets.near(spark.read.parquet(at), 39.0, -94.0, 0.05)
    assert {r.k for r in box.collect()} == {r.k for r in df.where("abs(lat - 39.0) < 0.05 AND abs(lng + 94.0) < 0.05").collect()} != set()
    assert "PushedFilters: [IsNotNull(lat), IsNotNull(lng), GreaterThan(lat" in box._jdf.queryExecution().executedPlan().toString()
    hit = total = 0
    for name in os.listdir(at):
        if name.endswith(".parquet"):
            meta = pq.read_metadata(f"{at}/{name}")
            for g in range(meta.num_row_groups):
                lat, lng = (meta.row_group(g).column(c).statistics for c in (1, 2))
                total += 1
                hit += lat.max > 38.95 and lat.min < 39.05 and lng.max > -94.05 and lng.min < -93.95
    assert total >= 16 and 0 < hit <= total / 3
