"""Sliding windows over a scene.

Overlapping windows are unions of square cells, so window statistics are sums of cell
statistics: pixels are counted once per cell and only cell rows are repeated for the
windows that hold them.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def origins(pos: Column | str, step: int, size: int) -> Column:
    """Origins (multiples of step from 0) of the windows of `size` that cover a position."""
    p = F.col(pos) if isinstance(pos, str) else pos
    first = F.greatest(F.lit(0), F.floor((p - size) / step) + 1)
    last = F.floor(p / step)
    # step > size leaves positions no window covers
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: (i * step).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def sliding_windows(pixels: DataFrame, step: int, height: int, width: int) -> DataFrame:
    """Each pixel once for every window that covers it, with the window origin (wy, wx)."""
    return pixels.withColumn("wy", F.explode(origins("row", step, height))).withColumn(
        "wx", F.explode(origins("col", step, width))
    )


def cell_size(step: int, height: int, width: int) -> int:
    return gcd(step, gcd(height, width))


def with_cell(pixels: DataFrame, cell: int) -> DataFrame:
    return pixels.withColumn("cy", F.floor(F.col("row") / cell).cast("int")).withColumn(
        "cx", F.floor(F.col("col") / cell).cast("int")
    )


def cells_to_windows(cells: DataFrame, cell: int, step: int, height: int, width: int) -> DataFrame:
    """Rows of (cy, cx) repeated for the windows that hold the cell, brought together by window."""
    return (
        cells.withColumn("wy", F.explode(origins(F.col("cy") * cell, step, height)))
        .withColumn("wx", F.explode(origins(F.col("cx") * cell, step, width)))
        .repartition("scene_id", "wy", "wx")
    )


def windows_to_cells(windows: DataFrame, cell: int, height: int, width: int) -> DataFrame:
    """Rows of (wy, wx) repeated for the cells they hold; cells past the frame meet no pixel."""
    def inside(origin: str, size: int) -> Column:
        first = F.expr(f"{origin} div {cell}").cast("int")
        return F.sequence(first, first + size // cell - 1)

    return windows.withColumn("cy", F.explode(inside("wy", height))).withColumn("cx", F.explode(inside("wx", width)))
