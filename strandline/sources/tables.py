"""Pixel, vector, grid and series tables: reading, writing, splitting by date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Side of a storage block in pixels, blocks a file, columns of the daily files.
BLOCK = 256
FILE_BLOCKS = 64
DAILY_SCHEMA = (
    "_c0 bigint, date string, transect int, ID string, tsk double, u10 double, v10 double, seaice double, "
    "psfc double, t2 double, `Wind Speed` double, `Wind Direction` double"
)
GRID_SCHEMA = "hour int, yi int, xi int, yc double, xc double, value double, var string, year int"


def write_pixels(pixels: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Parquet by scene and block row, so that a window or a scene reads only its folders.

    The blocks of a row are brought together before writing, up to FILE_BLOCKS in one
    file, so that a scene of usual width gets one file a folder and no task more than that.
    """
    blocked = pixels.withColumn("block_row", F.expr(f"row div {BLOCK}").cast("int")).withColumn(
        "block_col", F.expr(f"col div {BLOCK}").cast("int")
    )
    (
        blocked.repartition("scene_id", "block_row", F.expr(f"block_col div {FILE_BLOCKS}"))
        .sortWithinPartitions("scene_id", "block_row", "block_col", "row", "col")
        .write.mode(mode).partitionBy("scene_id", "block_row").parquet(folder)
    )


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_by_date(table: DataFrame, folder: str, date: str, mode: str = "overwrite") -> None:
    """Parquet below year=/month=, the month by name."""
    dated = table.withColumn("year", F.year(date)).withColumn("month", F.date_format(date, "MMMM"))
    dated.write.mode(mode).partitionBy("year", "month").parquet(folder)


def read_grid(spark: SparkSession, *paths: str) -> DataFrame:
    """Hourly grid table below var=/year=; unreadable or missing files are passed over."""
    reader = spark.read.schema(GRID_SCHEMA).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    found = [p for p in paths if path_exists(spark, p)]
    return reader.parquet(*found) if found else spark.createDataFrame([], GRID_SCHEMA)


def write_grid(grid: DataFrame, folder: str, mode: str = "overwrite") -> None:
    grid.write.mode(mode).partitionBy("var", "year").parquet(folder)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it names."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def read_daily_csv(spark: SparkSession, *paths: str, schema: str = DAILY_SCHEMA) -> DataFrame:
    """Daily files without their leading index column; missing paths are reported and passed over."""
    found = []
    for p in paths:
        if path_exists(spark, p):
            found.append(p)
        else:
            print(f"not found, passed over: {p}")
    if not found:
        return spark.createDataFrame([], schema).drop("_c0")
    return spark.read.schema(schema).option("header", "true").csv(found).drop("_c0")


def write_daily_csv(daily: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """CSV with header, one folder a year; column names with spaces stay as they are."""
    daily.write.mode(mode).option("header", "true").partitionBy("year").csv(folder)


def write_wkt_lines(lines: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Polyline vertices (feature_id, part, seq, x, y, epsg) as Parquet; each row is a vertex with its WKT point.

    A coastline may be longer than a row can hold, so the line stays a vertex table
    ordered by (part, seq) instead of one text value.
    """
    wkt = F.concat(F.lit("POINT ("), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")), F.lit(")"))
    (
        lines.withColumn("wkt", wkt)
        .repartitionByRange("feature_id", "part", "seq")
        .sortWithinPartitions("feature_id", "part", "seq")
        .write.mode(mode).parquet(folder)
    )


def union_years(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns aligned by name, absent ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
