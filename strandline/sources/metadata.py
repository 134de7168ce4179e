"""Scene metadata: band coefficients (XML), search results and boundaries (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of the metadata files and the bands in use.
ROW_TAG = "ps:EarthObservation"
BAND_TAG = "ps:bandSpecificMetadata"
BANDS = ["1", "2", "3", "4"]
BAND_SCHEMA = "`ps:bandNumber` string, `ps:radiometricScaleFactor` double, `ps:reflectanceCoefficient` double"
SCENE_SCHEMA = (
    "`gml:metaDataProperty` struct<`ps:EarthObservationMetaData`: struct<`eop:identifier`: string>>, "
    "`gml:resultOf` struct<`ps:EarthObservationResult`: struct<"
    f"`{BAND_TAG}`: array<struct<`ps:bandNumber`: string, `ps:radiometricScaleFactor`: double, `ps:reflectanceCoefficient`: double>>>>"
)
POLYGON_SCHEMA = "type string, coordinates array<array<array<double>>>"
SEARCH_SCHEMA = (
    "features array<struct<id: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>, "
    "properties: struct<acquired: timestamp, cloud_cover: double, `columns`: int, `rows`: int, epsg_code: int, "
    "origin_x: double, origin_y: double, pixel_resolution: double, satellite_id: string>>>"
)


def band_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, band, coeff) from XML metadata files, read with a fixed schema (no inference pass)."""
    scenes = spark.read.format("xml").option("rowTag", ROW_TAG).schema(SCENE_SCHEMA).load(path)
    band = F.explode(F.col(f"`gml:resultOf`.`ps:EarthObservationResult`.`{BAND_TAG}`"))
    scene_id = F.col("`gml:metaDataProperty`.`ps:EarthObservationMetaData`.`eop:identifier`")
    return (
        scenes.select(F.trim(scene_id).alias("scene_id"), band.alias("b"))
        .where(F.col("b.`ps:bandNumber`").isin(BANDS))
        .select("scene_id", F.col("b.`ps:bandNumber`").cast("int").alias("band"),
                F.col("b.`ps:reflectanceCoefficient`").alias("coeff"))
    )


def search_features(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature of saved search responses."""
    pages = spark.read.schema(SEARCH_SCHEMA).option("multiLine", "true").json(path)
    return pages.select(F.inline("features")).withColumnRenamed("id", "scene_id")


def ring_vertices(polygons: DataFrame, key: str, coordinates: Column | str = "coordinates") -> DataFrame:
    """(key, ring, seq, x, y) from polygon coordinates."""
    return (
        polygons.select(key, F.posexplode(coordinates).alias("ring", "vertices"))
        .select(key, "ring", F.posexplode("vertices").alias("seq", "xy"))
        .select(key, "ring", "seq", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    )


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Boundary polygons by file; a file that does not parse gives no row."""
    raw = spark.read.schema(POLYGON_SCHEMA + ", _corrupt_record string").option("multiLine", "true").option(
        "mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    return ring_vertices(raw.where("_corrupt_record is null and coordinates is not null"), "file")


def boundary_json(rings: DataFrame, key: str = "poly_id", pretty: bool = False) -> DataFrame:
    """(key, value): the polygon of each key as JSON text; rings is (key, ring, seq, x, y).

    A polygon is one JSON document and so one row by nature; its vertices are what a
    boundary file holds.
    """
    one = rings.groupBy(key, "ring").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.array("x", "y").alias("xy")))).alias("v")
    )
    poly = one.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ring", F.transform("v", lambda p: p["xy"]).alias("xy")))).alias("r")
    )
    shape = F.struct(F.lit("Polygon").alias("type"), F.transform("r", lambda p: p["xy"]).alias("coordinates"))
    return poly.select(key, F.to_json(shape, {"pretty": "true" if pretty else "false"}).alias("value"))


def write_boundaries(rings: DataFrame, folder: str, key: str = "poly_id", pretty: bool = False) -> None:
    """One folder a polygon, one JSON document in it."""
    boundary_json(rings, key, pretty).write.partitionBy(key).option("lineSep", "\n").text(folder)
