"""Water labels from windows around shoreline points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import spectral as sp
from strandline.operators import points as pt
from strandline.operators import stencil, threshold
from strandline.session import settled

# Half side of the windows in pixels, blur, vote share, lift of the mean threshold.
HALF = 100
BLUR_SIZE, BLUR_SIGMA = 9, 6.0
MAJORITY = 0.55
MEAN_LIFT = 10


def box_thresholds(coded: DataFrame, boxes: DataFrame, block: int = pt.PACKED) -> DataFrame:
    """Otsu threshold of every box; coded is (scene_id, row, col, code)."""
    return threshold.otsu(pt.box_histograms(coded, boxes, block), tuple(pt.BOX))


def label_from_points(
    bands: DataFrame, points: DataFrame, georef: DataFrame, green: str, nir: str, half: int = HALF,
    blurring: bool = True, rows: Column | int | None = None, cols: Column | int | None = None, block: int = 256,
) -> DataFrame:
    """Four label planes for each pixel.

    label_any: water in one covering window; label_majority: in more than MAJORITY of them;
    label_mean: reaches the mean of the window thresholds plus MEAN_LIFT; label_final:
    label_any inside the windows, label_mean outside. cover counts the windows on a pixel.
    """
    index = bands.select("scene_id", "row", "col", sp.water_index(green, nir, empty=0.0).alias("v"))
    if blurring:
        index = stencil.gaussian_blur(index, "v", BLUR_SIZE, BLUR_SIGMA, rows, cols, block)
    coded = index.select("scene_id", "row", "col", sp.encode_trunc("v").alias("code"))
    return label_codes(coded, points, georef, half, min(block, pt.COUNTED))


def label_codes(coded: DataFrame, points: DataFrame, georef: DataFrame, half: int, block: int = pt.COUNTED) -> DataFrame:
    """The same from encoded pixels (scene_id, row, col, code)."""
    boxes = pt.distinct_boxes(pt.point_boxes(points, georef, half))
    limits = settled(box_thresholds(coded, boxes, min(block, pt.PACKED)).join(boxes, pt.BOX), "limits")
    mean = settled(
        limits.groupBy("scene_id").agg(
            (F.sum(F.col("threshold") * F.col("weight")) / F.sum("weight") + MEAN_LIFT).alias("mean_threshold")
        ),
        "means",
    )
    votes = pt.box_counts(coded, limits, "threshold", block)
    label_any = (F.col("hits") > 0).cast("int")
    by_mean = sp.at_least("code", F.col("mean_threshold"))
    return votes.join(mean, "scene_id", "left").select(
        "scene_id", "row", "col", "cover", label_any.alias("label_any"),
        (F.col("hits") > F.col("cover") * MAJORITY).cast("int").alias("label_majority"),
        by_mean.alias("label_mean"),
        F.when(F.col("cover") > 0, label_any).otherwise(by_mean).alias("label_final"),
    )
