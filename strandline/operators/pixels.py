"""Band projections and per-scene statistics of pixel tables (scene_id, row, col, bands...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import settled

KEY = ["scene_id", "row", "col"]


def named_bands(pixels: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Only the named bands; column pruning takes this down to the scan."""
    return pixels.select(*KEY, *[F.col(c).alias(role) for role, c in roles.items()])


def last_band(bands: Column | str) -> Column:
    """NIR of a stack held as an array, whatever its depth."""
    return F.element_at(bands, -1)


def pixel_window(pixels: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """Pixels of one rectangle; block columns, if the table has them, prune its folders."""
    inside = (F.col("row") >= row) & (F.col("row") < row + height) & (F.col("col") >= col) & (F.col("col") < col + width)
    if "block_row" in pixels.columns:
        inside &= F.col("block_row").between(row // 256, (row + height - 1) // 256)
        inside &= F.col("block_col").between(col // 256, (col + width - 1) // 256)
    return pixels.where(inside)


def toa_reflectance(pixels: DataFrame, coeffs: DataFrame, bands: dict[int, str]) -> DataFrame:
    """Digital numbers times the coefficient of their band; coeffs is (scene_id, band, coeff).

    The coefficients become one row a scene before they meet the pixels. A band without a
    coefficient is NULL; no pixel is dropped.
    """
    wide = settled(
        coeffs.where(F.col("band").isin(list(bands)))
        .groupBy("scene_id")
        .agg(*[F.max(F.when(F.col("band") == k, F.col("coeff"))).alias(f"_c{k}") for k in bands]),
        "coeffs",
    )
    return pixels.join(wide, "scene_id", "left").select(
        *KEY, *[(F.col(c) * F.col(f"_c{k}")).alias(c) for k, c in bands.items()]
    )


def coefficient_lookup(bands: DataFrame, coeffs: DataFrame) -> DataFrame:
    """Long form: rows (scene_id, row, col, band, value) with the coefficient of their scene and band, NULL where there is none."""
    known = settled(coeffs.select("scene_id", "band", "coeff"), "coeffs")
    return bands.join(known, ["scene_id", "band"], "left")


def add_blank_bands(pixels: DataFrame, bands: list[str], n: int) -> DataFrame:
    """n zero planes after the last band, typed like the first band."""
    kind = pixels.schema[bands[0]].dataType
    return pixels.select(
        *KEY, *bands, *[F.lit(0).cast(kind).alias(f"b{len(bands) + i}") for i in range(1, n + 1)]
    )


def labelled_stack(pixels: DataFrame, label: DataFrame, visible: list[str], nir: str) -> DataFrame:
    """Five planes: three visible bands, NIR, and the label, void where the first band has no data."""
    both = pixels.join(label.select(*KEY, "label"), KEY, "left")
    return both.select(
        *KEY, *[F.col(c).alias(f"b{i}") for i, c in enumerate(visible, start=1)], F.col(nir).alias("b4"),
        F.when(F.col(visible[0]) == 0, 0).otherwise(F.coalesce("label", F.lit(0))).cast("int").alias("b5"),
    )


def raster_stats(pixels: DataFrame, value: str, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Pixel count, valid count, least, greatest and mean valid value of each scene."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(v).alias("valid"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean")
    )


def equal_bins(pixels: DataFrame, value: str, bins: int) -> DataFrame:
    """Histogram of `bins` equal steps between the least and greatest value of each scene; the last bin is closed. A constant scene is all in bin 0."""
    span = settled(raster_stats(pixels, value).select("scene_id", "lo", "hi"), "span")
    step = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins
    return (
        pixels.where(F.col(value).isNotNull())
        .join(span, "scene_id")
        .groupBy("scene_id", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(step))).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
