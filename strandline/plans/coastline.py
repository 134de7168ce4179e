"""Index plane to coastline polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import spectral as sp
from strandline.functions.projection import pixel_xy
from strandline.operators import contour, snake, stencil
from strandline.session import settled

# Side of the cleaning kernel, code of UTM zone 3N.
KERNEL = 9
EPSG = 32603


def coast_mask(pixels: DataFrame, value: str, steps: int = snake.STEPS, kernel: int = KERNEL, block: int = 256) -> DataFrame:
    """Two-region segmentation of the encoded index, opened and closed: (scene_id, row, col, u)."""
    coded = pixels.select("scene_id", "row", "col", sp.encode_floor(value).alias("code"))
    return stencil.open_close(snake.segment(coded, "code", steps, block=block), "u", kernel, kernel, block)


def coast_lines(
    mask: DataFrame, value: str, origin_x: Column | float, origin_y: Column | float, size: Column | float, epsg: int = EPSG, block: int = 256
) -> DataFrame:
    """Vertices of the coastline (feature_id, scene_id, part, seq, x, y, closed, epsg): one feature of many lines."""
    segs = settled(contour.level_segments(mask, value, block), "pieces")
    v = contour.polylines(segs, block)
    x, y = pixel_xy(F.col("y") / 2, F.col("x") / 2, origin_x, origin_y, size)
    return v.select(F.lit(1).alias("feature_id"), "scene_id", "part", "seq", x.alias("x"), y.alias("y"), "closed", F.lit(epsg).alias("epsg"))
