"""Edges of an 8-bit plane: gradient, thinning, hysteresis (Canny 1986)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.blocks import along_col, along_row, core, with_halo
from strandline.operators.components import label_pixels
from strandline.operators.stencil import gaussian_blur, thicken
from strandline.session import settled

# Blur size, thresholds of the gradient, width of the drawn edges.
BLUR, LOW, HIGH, WIDTH = 15, 30, 80, 3
TAN_22, TAN_67 = math.tan(math.radians(22.5)), math.tan(math.radians(67.5))


def gradients(pixels: DataFrame, value: str, block: int = 256) -> DataFrame:
    """(scene_id, row, col, dx, dy, size, ridge): 3 x 3 derivatives, |dx| + |dy|, and whether it peaks across the edge.

    Border pixels repeat outside the frame; beyond it there is no gradient.
    """
    v = F.col(value)

    def near(c: str, window) -> tuple[Column, Column]:
        return F.coalesce(F.lag(c).over(window), F.col(c)), F.coalesce(F.lead(c).over(window), F.col(c))

    df = with_halo(pixels, [value], 2, block)
    left, right = near(value, along_row())
    df = df.withColumns({"_dx": right - left, "_sx": left + 2 * v + right})
    (up_d, down_d), (up_s, down_s) = near("_dx", along_col()), near("_sx", along_col())
    df = df.withColumns({"dx": up_d + 2 * F.col("_dx") + down_d, "dy": down_s - up_s})
    df = df.withColumn("size", F.abs("dx") + F.abs("dy"))
    zero = F.lit(0)
    line = F.struct(
        F.coalesce(F.lag("size").over(along_row()), zero).alias("l"), F.col("size").alias("m"),
        F.coalesce(F.lead("size").over(along_row()), zero).alias("r"),
    )
    df = df.withColumn("_line", line)
    df = df.withColumns({"_above": F.lag("_line").over(along_col()), "_below": F.lead("_line").over(along_col())})

    def at(c: str) -> Column:
        return F.coalesce(F.col(c), zero)

    m, ax, ay = F.col("size"), F.abs("dx"), F.abs("dy")
    flat = (m > at("_line.l")) & (m >= at("_line.r"))
    steep = (m > at("_above.m")) & (m >= at("_below.m"))
    rising = (m > at("_above.r")) & (m > at("_below.l"))
    falling = (m > at("_above.l")) & (m > at("_below.r"))
    ridge = (
        F.when(ay < ax * TAN_22, flat).when(ay > ax * TAN_67, steep)
        .when(F.col("dx") * F.col("dy") < 0, rising).otherwise(falling)
    )
    return core(df.withColumn("ridge", ridge), "dx", "dy", "size", "ridge")


def find_edges(pixels: DataFrame, value: str, low: float = LOW, high: float = HIGH, block: int = 256) -> DataFrame:
    """Edge pixels (scene_id, row, col): ridges above low that hang together with one above high."""
    weak = settled(
        gradients(pixels, value, block).where(F.col("ridge") & (F.col("size") > low)).select(
            "scene_id", "row", "col", (F.col("size") > high).alias("strong"), F.lit(1).alias("m")),
        "ridges",
    )
    parts = label_pixels(weak, "m", eight=True, block=block)
    strong = parts.join(weak.where("strong"), ["scene_id", "row", "col"], "left_semi").select("scene_id", "component").distinct()
    return parts.join(strong, ["scene_id", "component"], "left_semi").select("scene_id", "row", "col")


def edge_raster(
    pixels: DataFrame, value: str, rows: Column | int, cols: Column | int, low: float = LOW, high: float = HIGH,
    blur: int = BLUR, width: int = WIDTH, block: int = 256,
) -> DataFrame:
    """Blurred plane, its edges, drawn `width` pixels wide: (scene_id, row, col, edge)."""
    plane = pixels.select("scene_id", "row", "col", F.col(value).cast("double").alias("v"))
    smooth = gaussian_blur(plane, "v", blur, 0.0, rows, cols, block).withColumn("v", F.floor(F.col("v") + 0.5).cast("int"))
    edges = find_edges(smooth, "v", low, high, block).withColumn("edge", F.lit(1))
    full = pixels.select("scene_id", "row", "col").join(edges, ["scene_id", "row", "col"], "left")
    return thicken(full.withColumn("edge", F.coalesce("edge", F.lit(0))), "edge", width, block)
