"""Half-overlapping tiles and their rotated and flipped copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators.windows import cells_to_windows, origins, windows_to_cells, with_cell

# Tile side; name suffix, flip and quarter turns of each copy.
TILE = 512
COPIES = (
    ("", False, 0), ("_rot90", False, 1), ("_rot180", False, 2), ("_rot270", False, 3),
    ("_flip", True, 0), ("_rot90_flip", True, 1), ("_rot180_flip", True, 2), ("_rot270_flip", True, 3),
)


def _count(n: Column, step: int) -> Column:
    return F.ceil(n / step)


def tile_number(rows: Column, step: int) -> Column:
    """Number from 1, down each column of tiles before the next one to the right."""
    return (F.floor(F.col("wx") / step) * _count(rows, step) + F.floor(F.col("wy") / step) + 1).cast("int")


def void_tiles(pixels: DataFrame, bands: list[str], height: int = TILE, width: int = TILE) -> DataFrame:
    """Origins of the tiles that hold a pixel with no data (0) in some band."""
    step = height // 2
    void = reduce(lambda a, b: a | b, [F.col(b) == 0 for b in bands])
    cells = with_cell(pixels.where(void), step).groupBy("scene_id", "cy", "cx").agg(F.count("*").alias("voids"))
    return cells_to_windows(cells, step, step, height, width).groupBy("scene_id", "wy", "wx").agg(F.sum("voids").alias("voids"))


def make_tiles(
    pixels: DataFrame, rows: Column, cols: Column, height: int = TILE, width: int = TILE, skip_void: list[str] | None = None
) -> DataFrame:
    """Each pixel once for every tile over it, with tile origin, number, total and position in the tile.

    Tiles advance by half a side and end at the frame. skip_void names the bands whose
    zeros drop a tile: the void pixels are found by cell, so the pixels are joined before
    they are repeated for their tiles.
    """
    if height != width:
        raise ValueError("tiles are square")
    step = height // 2
    tiled = pixels.withColumn("_wy", origins("row", step, height)).withColumn("_wx", origins("col", step, width))
    pairs = F.flatten(
        F.transform("_wy", lambda y: F.transform("_wx", lambda x: F.struct(y.alias("wy"), x.alias("wx"))))
    )
    tiled = tiled.withColumn("_tiles", pairs).drop("_wy", "_wx")
    if skip_void:
        bad = (
            windows_to_cells(void_tiles(pixels, skip_void, height, width), step, height, width)
            .groupBy("scene_id", "cy", "cx")
            .agg(F.collect_set(F.struct("wy", "wx")).alias("_bad"))
        )
        tiled = with_cell(tiled, step).join(bad, ["scene_id", "cy", "cx"], "left").drop("cy", "cx")
        tiled = tiled.withColumn(
            "_tiles", F.when(F.col("_bad").isNull(), F.col("_tiles")).otherwise(F.array_except("_tiles", "_bad"))
        ).drop("_bad")
    return (
        tiled.select("*", F.inline("_tiles"))
        .drop("_tiles")
        .withColumn("tile", tile_number(rows, step))
        .withColumn("tiles", (_count(rows, step) * _count(cols, step)).cast("int"))
        .withColumn("tile_row", F.col("row") - F.col("wy"))
        .withColumn("tile_col", F.col("col") - F.col("wx"))
    )


def augment(tiles: DataFrame, height: Column | int, width: Column | int, row: str = "row", col: str = "col") -> DataFrame:
    """Every tile with its three turned and four flipped copies; turns run counter-clockwise, the flip (up/down) comes first."""
    h = F.lit(height) if isinstance(height, int) else height
    w = F.lit(width) if isinstance(width, int) else width
    copies = F.array(*[F.struct(F.lit(s).alias("copy"), F.lit(f).alias("_flip"), F.lit(q).alias("_turn")) for s, f, q in COPIES])
    r = F.when(F.col("_flip"), h - 1 - F.col(row)).otherwise(F.col(row))
    c = F.col(col)
    turn = F.col("_turn")
    new_row = F.when(turn == 0, r).when(turn == 1, w - 1 - c).when(turn == 2, h - 1 - r).otherwise(c)
    new_col = F.when(turn == 0, c).when(turn == 1, r).when(turn == 2, w - 1 - c).otherwise(h - 1 - r)
    return (
        tiles.select("*", F.inline(copies))
        .withColumn("_r", new_row)
        .withColumn("_c", new_col)
        .drop("_flip", "_turn", row, col)
        .withColumnsRenamed({"_r": row, "_c": col})
    )


def copies_of(paths: DataFrame) -> DataFrame:
    """Names of the copies of each original tile file; files that are copies themselves are left out."""
    name = names.base_name("path")
    originals = paths.where(name.endswith(".tif") & ~name.contains("rot") & ~name.contains("flip"))
    suffix = F.explode(F.array(*[F.lit(s) for s, _, _ in COPIES]))
    return originals.withColumn("copy", suffix).withColumn(
        "copy_path",
        F.concat(names.dir_name("path"), F.lit("/"), names.stem("path"), F.col("copy"), names.extension("path")),
    )
