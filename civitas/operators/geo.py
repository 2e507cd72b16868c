"""Grids, inverse-distance heat, centres and GeoJSON."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.operators.joins import levels
from civitas.staging import staged


@dataclass(frozen=True)
class Bounds:
    south: float = 38.9
    north: float = 39.3
    west: float = -94.8
    east: float = -94.4

    def valid(self) -> bool:
        return self.south < self.north and self.west < self.east


def grid(spark: SparkSession, bounds: Bounds = Bounds(), n: int = 20) -> DataFrame:
    """(cell, g_lat, g_lng) of an n by n grid without the far edges; no rows for invalid bounds."""
    cells = spark.range(n * n if bounds.valid() else 0)
    lat = F.lit(bounds.south) + F.floor(F.col("id") / n) * F.lit((bounds.north - bounds.south) / n)
    lng = F.lit(bounds.west) + (F.col("id") % n) * F.lit((bounds.east - bounds.west) / n)
    return cells.select(F.col("id").alias("cell"), lat.alias("g_lat"), lng.alias("g_lng"))


def heat(grid_cells: DataFrame, venues: DataFrame) -> DataFrame:
    """(cell, g_lat, g_lng, value): inverse-distance weighted value of located venues, at most 1; cells over 0.1.

    The grid is small and fixed, so it is the broadcast side: each venue meets every cell where it
    is read, and only a partial sum per cell is shuffled. A null rating counts as 3.
    """
    located = venues.where("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng", F.coalesce("avg_rating", F.lit(3.0)).alias("rating"))
    pairs = located.join(F.broadcast(grid_cells))
    weight = 1 / (1 + 100 * F.sqrt(F.pow(F.col("g_lat") - F.col("lat"), 2) + F.pow(F.col("g_lng") - F.col("lng"), 2)))
    pairs = pairs.select("cell", "g_lat", "g_lng", weight.alias("w"), (0.5 + 0.1 * (F.col("rating") - 3)).alias("x"))
    sums = pairs.groupBy("cell", "g_lat", "g_lng").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    return sums.select("cell", "g_lat", "g_lng", F.least(F.col("wx") / F.col("w"), F.lit(1.0)).alias("value")).where("value > 0.1")


def grid_predictions(cells: DataFrame) -> DataFrame:
    """Cells of ``heat`` as predictions of places without a venue."""
    # fixed values: their confidence, venues and kind
    return cells.select("cell", F.col("g_lat").alias("lat"), F.col("g_lng").alias("lng"), F.col("value").alias("prediction_value"), F.lit(0.4).alias("confidence_score"), F.lit(0).alias("venue_count"), F.lit("grid_prediction").alias("area_type"))


def search_grid(spark: SparkSession, bounds: Bounds, km: float = 5.0) -> DataFrame:
    """(s_lat, s_lng) of search points ``km`` apart, both edges included (111 and 85 km a degree)."""
    dlat, dlng = km / 111.0, km / 85.0
    rows, cols = (int((b - a) / d + 1e-9) + 1 for a, b, d in ((bounds.south, bounds.north, dlat), (bounds.west, bounds.east, dlng)))
    lat, lng = F.lit(bounds.south) + F.floor(F.col("id") / cols) * dlat, F.lit(bounds.west) + (F.col("id") % cols) * dlng
    return spark.range(rows * cols if bounds.valid() else 0).select(lat.alias("s_lat"), lng.alias("s_lng"))


def intensity(df: DataFrame, value: str) -> DataFrame:
    """``df`` with max(0.1, value / largest); values of 0 and below go."""
    most = df.agg(F.max(value).alias("__most"))
    return df.where(F.col(value) > 0).join(F.broadcast(most)).withColumn("intensity", F.greatest(F.lit(0.1), F.try_divide(F.col(value), F.col("__most")))).drop("__most")


def centre(df: DataFrame, default: tuple[float, float] = (39.0997, -94.5786)) -> DataFrame:
    """One row: mean lat and lng, or the default where nothing is located."""
    return df.agg(F.coalesce(F.avg("lat"), F.lit(default[0])).alias("lat"), F.coalesce(F.avg("lng"), F.lit(default[1])).alias("lng"))


def features(df: DataFrame) -> DataFrame:
    """A GeoJSON feature (struct) for each located row: [lng, lat] and the other columns as properties."""
    rest = [c for c in df.columns if c not in ("lat", "lng")]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    return df.where("lat IS NOT NULL AND lng IS NOT NULL").select(feature.alias("feature"))


def write_geojson(df: DataFrame, path: str) -> None:
    """One feature a line, written in parallel (GeoJSON text sequence)."""
    features(df).select(F.to_json("feature").alias("value")).write.mode("overwrite").text(path)


def feature_collections(df: DataFrame, per: int = 10_000) -> DataFrame:
    """(part, features, geojson): the features of ``df`` in collections of about ``per``, each a GeoJSON
    document of its own, so that none is gathered whole."""
    each = features(df)
    parts = max(1, -(-each.count() // per))
    part = F.pmod(F.xxhash64(F.to_json("feature")), F.lit(parts)).cast("int").alias("part")
    grouped = each.groupBy(part).agg(F.collect_list("feature").alias("f"))
    return grouped.select("part", F.size("f").alias("features"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("f").alias("features"))).alias("geojson"))


def in_bounds(b: Bounds, lat: Column | None = None, lng: Column | None = None) -> Column:
    return (F.col("lat") if lat is None else lat).between(b.south, b.north) & (F.col("lng") if lng is None else lng).between(b.west, b.east)


#: Metres of a degree of latitude, of the earth's radius that ``distance_m`` takes.
RADIUS = 6_371_008.8
DEGREE = RADIUS * math.pi / 180


def distance_m(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two places along the sphere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat, lat2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * half(lng, lng2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def covered(records: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """Each row of ``records`` (lat, lng, ...) with every one of ``points`` (point_id, p_lat, p_lng) within ``metres``, and the ``distance``.

    The earth is cut into bands of that height and these into cells at least as wide; a point stands in its own and the neighbouring
    cells of its own and the neighbouring bands, across the date line too, so an equi-join on the cell finds each pair once. Distances decide. Rows
    without a place have no pairs.
    """
    height = min(metres / DEGREE * 1.001, 180.0)
    band = lambda lat: F.floor((lat + 90) / height)

    def cells(at: Column) -> Column:
        """How many cells a band has: as wide as ``height`` where the band and its neighbours are nearest to a pole."""
        edge = F.greatest(F.abs((at - 1) * height - 90), F.abs((at + 2) * height - 90))
        wide = F.when(edge < 90, height / F.cos(F.radians(F.least(edge, F.lit(89.999))))).otherwise(360.0)
        return F.greatest(F.floor(360 / wide), F.lit(1))

    cell = lambda at, lng: F.pmod(F.floor((lng + 180) / 360 * cells(at)), cells(at))
    own = records.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("__band", band(F.col("lat"))).withColumn("__cell", cell(F.col("__band"), F.col("lng")))
    spread = points.where("p_lat IS NOT NULL AND p_lng IS NOT NULL").withColumn("__b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: band(F.col("p_lat")) + d)))
    near = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(cell(F.col("__b"), F.col("p_lng")) + d, cells(F.col("__b")))))
    spread = spread.withColumn("__c", F.explode(near))
    pairs = own.join(spread, (F.col("__band") == F.col("__b")) & (F.col("__cell") == F.col("__c")))
    far = distance_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    return pairs.withColumn("distance", far).where(F.col("distance") <= metres).drop("__band", "__cell", "__b", "__c")


def nearest_point(records: DataFrame, points: DataFrame, key: str, metres: float) -> DataFrame:
    """(key, point_id, distance): of the points within ``metres`` of each record the nearest, ties to the smaller id; records without one have no row.

    Only different places meet, each with its smallest id. Where points are dense, narrower circles are searched first: what lies in one
    is nearer than all that lies outside.
    """
    spots = points.where("p_lat IS NOT NULL AND p_lng IS NOT NULL").groupBy("p_lat", "p_lng").agg(F.min("point_id").alias("point_id"))
    located = records.where("lat IS NOT NULL AND lng IS NOT NULL").select(key, "lat", "lng")
    asked, side = located.select("lat", "lng").distinct(), metres / DEGREE
    best = None
    for level in reversed(range(levels(spots, F.struct(F.floor(F.col("p_lat") / side), F.floor(F.col("p_lng") * F.cos(F.radians("p_lat")) / side))))):
        found = covered(asked, spots, metres / 4**level).groupBy("lat", "lng").agg(F.min(F.struct("distance", "point_id")).alias("b"))
        if level:
            found = staged(found, "nearest")
            asked = staged(asked.join(found.select("lat", "lng"), ["lat", "lng"], "left_anti"), "nearest_rest")
        best = found if best is None else best.unionByName(found)
    return located.join(best, ["lat", "lng"]).select(key, "b.point_id", "b.distance")
