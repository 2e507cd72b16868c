"""Tables laid out by key or by place: merges that rewrite what they touch, joins without an exchange, boxes that skip row groups."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.operators import merge


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass
class BucketStore:
    """A table of ``schema`` under ``root`` in ``buckets`` by a hash of its unique ``keys``, as versions: a manifest names the folder of
    each bucket, and a merge writes new folders for the buckets that its keys fall in and a new manifest. Files are never changed, so older
    versions stay readable; a merge reads and writes no other bucket.

    A version exists once its manifest is there, written last, to a folder of its own that must not exist: of two writers of one version the second fails.
    """

    spark: SparkSession
    root: str
    keys: list[str]
    schema: str
    buckets: int = 256

    MANIFEST = "bucket int, path string"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def latest(self) -> int | None:
        """The newest version; None in a store that nothing has been written to."""
        if not _exists(self.spark, f"{self.root}/manifests"):
            return None
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        names = [s.getPath() for s in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return max((int(p.getName()) for p in names if _exists(self.spark, f"{p}/_SUCCESS")), default=None)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows, of a version or the newest."""
        version = self.latest() if version is None else version
        if version is None:
            return {}
        return {r.bucket: r.path for r in self.spark.read.schema(self.MANIFEST).json(f"{self.root}/manifests/{version}").collect()}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of its buckets ``only``; none in an empty store."""
        paths = [p for k, p in self.manifest(version).items() if only is None or k in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def find(self, values: DataFrame) -> DataFrame:
        """The rows of the keys in ``values``, from the buckets that these fall in."""
        touched = {r.b for r in values.select(self._bucket().alias("b")).distinct().collect()}
        own = values.select(*(F.col(k).alias(f"v_{k}") for k in self.keys)).distinct()
        return self.read(only=touched).join(own, [F.col(k).eqNullSafe(F.col(f"v_{k}")) for k in self.keys], "left_semi")

    def merge(self, source: DataFrame, update: list[str] | None = None) -> int:
        """Merge ``source`` (a row for each key; see ``merge.upsert``) into the newest version; returns the new one, or the newest where
        there is nothing to merge."""
        version = self.latest()
        touched = {r.b for r in source.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets``
        if not touched and version is not None:
            return version
        merged = merge.upsert(self.read(version, touched), source, self.keys, update).withColumn("bucket", self._bucket())
        at, number = f"{self.root}/data/{uuid.uuid4().hex}", 0 if version is None else version + 1
        merged.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(at)
        entries = self.manifest(version) | {k: f"{at}/bucket={k}" for k in touched}
        self.spark.createDataFrame(sorted(entries.items()), self.MANIFEST).coalesce(1).write.mode("error").json(f"{self.root}/manifests/{number}")
        return number


def save_by_key(df: DataFrame, table: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """``df`` as a table of the catalog in buckets by ``keys``, sorted by them inside: joins and merges of two such tables, and
    groups by the keys, need no exchange of either."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def curve(lat: Column, lng: Column, bits: int = 16) -> Column:
    """A place's position on a space-filling curve: the bits of both coordinates in turn. Near places mostly have near positions; null without a place."""
    cell = lambda x, low, high: F.least(F.greatest(F.floor((x - low) / (high - low) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    at = F.shiftleft(spread(cell(lat, -90.0, 90.0)), 1).bitwiseOR(spread(cell(lng, -180.0, 180.0)))
    return F.when(lat.isNotNull() & lng.isNotNull(), at)


def save_by_place(df: DataFrame, path: str, files: int, rows_of_group: int = 20_000) -> None:
    """``df`` (lat, lng, ...) as Parquet in ``files`` ranges of ``curve``, sorted by it in groups of about ``rows_of_group`` rows: a filter on a
    box of coordinates skips the files' row groups that lie elsewhere, by their least and greatest values."""
    at = df.withColumn("__at", curve(F.col("lat"), F.col("lng")))
    at.repartitionByRange(files, "__at").sortWithinPartitions("__at").drop("__at").write.option("parquet.block.row.count.limit", rows_of_group).parquet(path)


def near(df: DataFrame, lat: float, lng: float, width: float) -> DataFrame:
    """Rows within less than ``width`` of a place on either axis; the bounds reach the scan as filters."""
    return df.where((F.col("lat") > lat - width) & (F.col("lat") < lat + width) & (F.col("lng") > lng - width) & (F.col("lng") < lng + width))


def forecast(weather: DataFrame, lat: float, lng: float, now: Column, hours: int = 24, width: float = 0.1) -> DataFrame:
    """The forecasts of ``weather`` (lat, lng, is_forecast, forecast_timestamp, ...) near a place from ``now`` to ``hours`` later, in order of time."""
    ahead = F.col("forecast_timestamp").between(now, now + F.make_dt_interval(hours=F.lit(hours)))
    return near(weather.where("is_forecast"), lat, lng, width).where(ahead).orderBy("forecast_timestamp")
