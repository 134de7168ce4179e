"""Images and coarse label images to labelled, tiled and augmented training pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import labels as lb
from strandline.operators import pixels as px
from strandline.operators import tiles as ti


def labelled_images(
    bands: DataFrame, label: DataFrame, factor: int, visible: list[str], nir: str, smooth: bool = True
) -> DataFrame:
    """Five-band pixels (b1..b4, label b5) from band pixels and a label plane `factor` times as coarse.

    smooth resamples by cubic B-spline and drops the fraction; without it classes stay whole.
    """
    fine = lb.upsample(label, "label", factor) if smooth else lb.upsample_nearest(label, "label", factor)
    return px.labelled_stack(bands, fine.withColumn("label", F.col("label").cast("int")), visible, nir)


def reprojected_images(
    bands: DataFrame, label: DataFrame, frames: DataFrame, visible: list[str], nir: str, smooth: bool = True
) -> DataFrame:
    """labelled_images for label planes on a grid and in a projection of their own (frames: see labels.reproject)."""
    fine = lb.reproject(label, "label", frames, smooth)
    return px.labelled_stack(bands, fine.withColumn("label", F.col("label").cast("int")), visible, nir)


def labelled_tiles(images: DataFrame, rows: Column, cols: Column, side: int = ti.TILE, skip_void: bool = True) -> DataFrame:
    """Full tiles of labelled images with all eight copies of each pixel (scene_id, tile, copy, tile_row, tile_col, b1..b5).

    A tile with a void pixel in an image band is left out; the label band may be 0. Tiles
    cut by the frame are turned within their own size.
    """
    tiled = ti.make_tiles(images, rows, cols, side, side, ["b1", "b2", "b3", "b4"] if skip_void else None)
    height, width = F.least(F.lit(side), rows - F.col("wy")), F.least(F.lit(side), cols - F.col("wx"))
    wide = ti.augment(tiled, height, width, "tile_row", "tile_col")
    return wide.select("scene_id", "tile", "copy", "tile_row", "tile_col", "b1", "b2", "b3", "b4", "b5")
