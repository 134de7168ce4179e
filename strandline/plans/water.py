"""Sliding-window water classification of an index plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import spectral as sp
from strandline.operators import stencil, threshold, windows
from strandline.session import settled

# Window step and size, ratio above which a window is all water, kernel side.
STEP, SIZE = 50, 100
ALL_WATER = 0.9
KERNEL = 15


def threshold_mask(pixels: DataFrame, value: str, find=threshold.otsu) -> DataFrame:
    """Pixels with `water` = 1 where the encoded value reaches the threshold of its scene."""
    coded = pixels.withColumn("code", sp.encode_floor(value))
    limit = settled(find(threshold.histogram(coded, "code")), "threshold")
    return coded.join(limit, "scene_id").select(
        "scene_id", "row", "col", sp.at_least("code", F.col("threshold")).alias("water")
    )


def window_classes(coded: DataFrame, step: int, height: int, width: int, water_class: Column | None = None) -> DataFrame:
    """Histogram of every window with its class facts: (scene_id, wy, wx, bin, n, class, doubt, water).

    Water is the most frequent class of the top left window, or `water_class`, an
    expression over the number of classes (F.lit(2) takes the class with the highest centre).
    """
    cell = windows.cell_size(step, height, width)
    counted = settled(
        threshold.histogram(windows.with_cell(coded, cell), "code", ("scene_id", "cy", "cx")), "cells"
    )
    scene = counted.groupBy("scene_id", "bin").agg(F.sum("n").alias("n"))
    cuts = threshold.exact_means(scene, 3)
    shares = threshold.class_shares(scene, cuts, 3)
    doubt = shares.groupBy("scene_id").agg(F.max("doubt").alias("doubt"))
    corner = (
        counted.where((F.col("cy") < height // cell) & (F.col("cx") < width // cell))
        .join(cuts, "scene_id")
        .groupBy("scene_id", threshold.class_of("bin", "cuts").alias("class"))
        .agg(F.sum("n").alias("n"))
        .groupBy("scene_id")
        .agg(F.max_by("class", F.struct(F.col("n"), -F.col("class"))).alias("water"))
    )
    # Where the top left window is all void, the most frequent class of the scene stands in.
    usual = (
        scene.join(cuts, "scene_id")
        .groupBy("scene_id", threshold.class_of("bin", "cuts").alias("class"))
        .agg(F.sum("n").alias("n"))
        .groupBy("scene_id")
        .agg(F.max_by("class", F.struct(F.col("n"), -F.col("class"))).alias("usual"))
    )
    known = doubt.join(usual, "scene_id").join(corner, "scene_id", "left").withColumn("water", F.coalesce("water", "usual")).drop("usual")
    facts = settled(cuts.join(known, "scene_id"), "facts")
    if water_class is not None:
        facts = facts.withColumn("water", water_class.cast("int"))
    by_window = (
        windows.cells_to_windows(counted, cell, step, height, width)
        .groupBy("scene_id", "wy", "wx", "bin")
        .agg(F.sum("n").alias("n"))
    )
    return by_window.join(facts, "scene_id").select(
        "scene_id", "wy", "wx", "bin", "n", threshold.class_of("bin", "cuts").alias("class"), "doubt", "water"
    )


def window_facts(classes: DataFrame) -> DataFrame:
    """Water ratio of each window and whether it holds both water and the class in doubt."""
    water = F.coalesce(F.sum(F.when(F.col("class") == F.col("water"), F.col("n"))), F.lit(0))
    return classes.groupBy("scene_id", "wy", "wx").agg(
        (water / F.sum("n")).alias("water_ratio"),
        (F.bool_or(F.col("class") == F.col("doubt")) & F.bool_or(F.col("class") == F.col("water"))).alias("mixed"),
    )


def window_limits(classes: DataFrame) -> DataFrame:
    """Lowest code that counts as water in each window: Otsu in a mixed one, 0 in an all-water one, else none."""
    otsu = threshold.otsu(classes, ("scene_id", "wy", "wx"))
    return (
        window_facts(classes)
        .join(otsu, ["scene_id", "wy", "wx"])
        .select(
            "scene_id", "wy", "wx", "water_ratio", "mixed",
            F.when(F.col("mixed"), F.col("threshold")).when(F.col("water_ratio") > ALL_WATER, 0).alias("limit"),
        )
    )


def classify(
    pixels: DataFrame, value: str, step: int = STEP, height: int = SIZE, width: int = SIZE, kernel: int | None = KERNEL,
    water_class: Column | None = None, block: int = 256,
) -> DataFrame:
    """Water plane of each scene: windows vote by OR, then opening and closing.

    A pixel is water if its code reaches the limit of any covering window, that is, the
    least of them; so the windows reduce to one limit a cell and each pixel is joined once.
    """
    coded = pixels.select("scene_id", "row", "col", sp.encode_floor(value).alias("code"))
    cell = windows.cell_size(step, height, width)
    limits = window_limits(window_classes(coded, step, height, width, water_class)).where("limit is not null")
    by_cell = settled(
        windows.windows_to_cells(limits, cell, height, width)
        .groupBy("scene_id", "cy", "cx")
        .agg(F.min("limit").alias("limit")),
        "limits",
    )
    water = windows.with_cell(coded, cell).join(by_cell, ["scene_id", "cy", "cx"], "left").select(
        "scene_id", "row", "col", sp.at_least("code", F.col("limit")).alias("water")
    )
    return stencil.open_close(water, "water", kernel, kernel, block) if kernel else water
