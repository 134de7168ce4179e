"""Scene selection: search filter, seasons, request checks, day groups, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import names

# Cloud limit, winter days of the year, first valid year.
CLOUD_LIMIT = 0.1
WINTER_START, WINTER_END = 290, 136
FIRST_YEAR = 2009


def search(scenes: DataFrame, start: str, end: str, cloud: float = CLOUD_LIMIT) -> DataFrame:
    """Scenes with little cloud acquired after the start of the first day up to the end of the last.

    The filter is plain comparisons, so it reaches the scan. Join with
    spatial.in_polygons() for the geometry condition.
    """
    t = F.col("acquired")
    return scenes.where(
        (F.col("cloud_cover") <= cloud)
        & (t > F.to_timestamp(F.lit(f"{start} 00:00:00")))
        & (t <= F.to_timestamp(F.lit(f"{end} 23:59:59")))
    )


def outside_winter(
    scenes: DataFrame, layout: str = "scene", winter_start: int = WINTER_START, winter_end: int = WINTER_END
) -> DataFrame:
    """Scenes whose id gives a day of the year between winter end and winter start; ids without a time drop out."""
    day = F.dayofyear(names.id_time("scene_id", layout))
    return scenes.where((day > winter_end) & (day < winter_start))


def checked_requests(requests: DataFrame) -> DataFrame:
    """start_text, end_text with their dates and whether they make a valid range (NULL dates where a text does not parse)."""
    iso = r"^\d{4}-\d{1,2}-\d{1,2}$"

    def parsed(c: str) -> Column:
        return F.when(F.col(c).rlike(iso), F.try_to_date(F.col(c), "yyyy-M-d"))

    start, end = parsed("start_text"), parsed("end_text")
    both = start.isNotNull() & end.isNotNull()
    valid = both & (F.year(start) >= FIRST_YEAR) & (F.year(end) >= FIRST_YEAR) & (start < end)
    return requests.select(
        "*", F.when(both, start).alias("start"), F.when(both, end).alias("end"), F.coalesce(valid, F.lit(False)).alias("valid")
    )


def by_day(files: DataFrame) -> DataFrame:
    """Files with year, month name and day taken from the start of their name.

    The day stays a key of the rows: a day with very many files is never put into one list.
    """
    t = names.id_time(names.base_name("path"))
    return files.withColumn("year", F.year(t)).withColumn("month", F.date_format(t, "MMMM")).withColumn("day", F.day(t))


def mosaic(pixels: DataFrame, bands: list[str], group: list[str], order: str = "path", nodata: float = 0) -> DataFrame:
    """One plane for each group from overlapping images (group..., order, wx, wy, bands).

    wx, wy are pixel positions in the world grid. In every band the first image in
    `order` that has data wins; an aggregate with map-side combine, no sort of the images.
    """
    first = [
        F.coalesce(F.min_by(b, F.when(F.col(b) != nodata, F.col(order))), F.lit(nodata)).alias(b) for b in bands
    ]
    return pixels.groupBy(*group, "wy", "wx").agg(*first)


def extent(pixels: DataFrame, group: list[str], x: str = "wx", y: str = "wy") -> DataFrame:
    """Bounds and size of each group."""
    return pixels.groupBy(*group).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        (F.max(x) - F.min(x) + 1).alias("width"), (F.max(y) - F.min(y) + 1).alias("height"),
    )
