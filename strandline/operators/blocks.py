"""Square blocks with a halo: one exchange, then any number of local neighbourhood passes.

with_halo() sends each pixel to its own block and to each block whose halo it lies in,
and partitions by block. Window passes over (block, row) or (block, col) then find
their rows already together (a hash partitioning by the block satisfies both), so a
chain of stencils pays for one shuffle and each sort group is one line of a block,
however large the scene is or how many of all pixels it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["scene_id", "block_row", "block_col"]


def _copies(pos: str, size: Column | None, radius: int, block: int) -> Column:
    """Array of (q, block) one pixel takes along one axis; `size` asks for mirrored copies at both ends."""
    p = F.col(pos)

    def near(q: Column) -> Column:
        blocks = F.sequence(
            F.greatest(F.lit(0), F.floor((q - radius) / block)).cast("int"), F.floor((q + radius) / block).cast("int")
        )
        return F.transform(blocks, lambda b: F.struct(q.cast("int").alias("q"), b.alias("b")))

    offset = F.pmod(p, F.lit(block))
    inner = (offset >= radius) & (offset < block - radius)
    copies = near(p)
    if size is not None:
        low = F.when((p >= 1) & (p <= radius), near(-p)).otherwise(F.array().cast("array<struct<q:int,b:int>>"))
        high = F.when((p <= size - 2) & (p >= size - 1 - radius), near(2 * (size - 1) - p)).otherwise(
            F.array().cast("array<struct<q:int,b:int>>")
        )
        copies = F.concat(copies, low, high)
        inner &= (p > radius) & (p < size - 1 - radius)
    own = F.array(F.struct(p.cast("int").alias("q"), F.floor(p / block).cast("int").alias("b")))
    return F.when(inner, own).otherwise(copies)


def with_halo(
    pixels: DataFrame,
    values: list[str],
    radius: int | tuple[int, int],
    block: int = 256,
    mirror: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Pixels by block with `radius` (rows, columns) of neighbours around each block.

    mirror = (rows, columns) of the scene adds the pixels mirrored at the frame (the
    border pixel itself is not repeated), as smoothing filters expect. `core` marks
    the rows that belong to the block itself; keep those when the passes are done.
    """
    ry, rx = (radius, radius) if isinstance(radius, int) else radius
    rows, cols = mirror if mirror else (None, None)
    return (
        pixels.select("scene_id", "row", "col", *values)
        .withColumn("_r", F.explode(_copies("row", rows, ry, block)))
        .withColumn("_c", F.explode(_copies("col", cols, rx, block)))
        .select(
            "scene_id", F.col("_r.b").alias("block_row"), F.col("_c.b").alias("block_col"),
            F.col("_r.q").alias("row"), F.col("_c.q").alias("col"),
            ((F.col("_r.q") == F.col("row")) & (F.col("_c.q") == F.col("col"))
             & (F.floor(F.col("row") / block) == F.col("_r.b")) & (F.floor(F.col("col") / block) == F.col("_c.b"))).alias("core"),
            *values,
        )
        .repartition(*BLOCK)
    )


def core(blocks: DataFrame, *columns: str | Column) -> DataFrame:
    """Drop the halo again."""
    return blocks.where("core").select("scene_id", "row", "col", *columns)


def along_row():
    return Window.partitionBy(*BLOCK, "row").orderBy("col")


def along_col():
    return Window.partitionBy(*BLOCK, "col").orderBy("row")
