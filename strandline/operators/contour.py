"""Outlines of masks: outer boundary pixels, and level lines as ordered polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.projection import pixel_xy
from strandline.operators.blocks import along_col, along_row, core, with_halo
from strandline.operators.chains import order_pieces
from strandline.operators.components import label_pixels
from strandline.operators.stencil import thicken


def outer_boundary(mask: DataFrame, value: str, rows: Column | int, cols: Column | int, block: int = 256) -> DataFrame:
    """Pixels (scene_id, row, col, edge): 1 where the mask meets the background around it.

    Background that a region encloses does not count, nor do regions inside it. The
    frame is background. Background pixels hang together by their four sides.
    """
    rows, cols = (F.lit(n) if isinstance(n, int) else n for n in (rows, cols))
    at_frame = (F.col("row") == 0) | (F.col("row") == rows - 1) | (F.col("col") == 0) | (F.col("col") == cols - 1)
    ground = mask.select("scene_id", "row", "col", (F.col(value) == 0).cast("int").alias("g"))
    parts = label_pixels(ground, "g", eight=False, block=block)
    open_parts = parts.where(at_frame).select("scene_id", "component").distinct()
    outside = parts.join(open_parts, ["scene_id", "component"], "left_semi").select("scene_id", "row", "col", F.lit(1).alias("out"))
    marked = mask.join(outside, ["scene_id", "row", "col"], "left").select(
        "scene_id", "row", "col", F.col(value).alias("m"), F.coalesce("out", F.lit(0)).alias("out"), at_frame.cast("int").alias("frame")
    )
    halo = with_halo(marked, ["m", "out", "frame"], 1, block)
    beside = F.greatest(*[F.coalesce(f("out").over(w), F.lit(0)) for w in (along_row(), along_col()) for f in (F.lag, F.lead)])
    edge = ((F.col("m") == 1) & ((F.col("frame") == 1) | (beside == 1))).cast("int")
    return core(halo.withColumn("edge", edge), "edge")


def contour_raster(mask: DataFrame, value: str, rows: Column | int, cols: Column | int, width: int = 3, block: int = 256) -> DataFrame:
    """The outer boundary drawn `width` pixels wide."""
    return thicken(outer_boundary(mask, value, rows, cols, block), "edge", width, block)


def level_segments(mask: DataFrame, value: str, block: int = 256) -> DataFrame:
    """Directed pieces of the line between 0 and 1 (scene_id, row, col, n, y0, x0, y1, x1), high values on the left.

    Marching squares on 2 x 2 pixels; y, x count half pixels. A piece enters a square
    through one side and leaves through another: which way follows from the pixels at the
    ends of the side, so neighbouring squares agree and the pieces link up. In the two
    ambiguous squares the low pixels stay connected.
    """
    halo = with_halo(mask, [value], 1, block)
    side = halo.withColumn("ur", F.lead(value).over(along_row()))
    square = side.withColumn("ll", F.lead(value).over(along_col())).withColumn("lr", F.lead("ur").over(along_col()))
    square = core(square.withColumnRenamed(value, "ul"), "ul", "ur", "ll", "lr").where(
        "ur is not null and ll is not null and lr is not null and not (ul = ur and ul = ll and ul = lr)"
    )
    y, x = F.col("row") * 2, F.col("col") * 2
    top, bottom = F.struct(y.alias("y"), (x + 1).alias("x")), F.struct((y + 2).alias("y"), (x + 1).alias("x"))
    left, right = F.struct((y + 1).alias("y"), x.alias("x")), F.struct((y + 1).alias("y"), (x + 2).alias("x"))

    def on(a: str, b: str) -> Column:
        return (F.col(a) == 1) & (F.col(b) == 0)

    enter = F.when(on("ur", "ul"), top).when(on("lr", "ur"), right).when(on("ll", "lr"), bottom).when(on("ul", "ll"), left)
    leave = F.when(on("ul", "ur"), top).when(on("ur", "lr"), right).when(on("lr", "ll"), bottom).when(on("ll", "ul"), left)

    def piece(a: Column, b: Column) -> Column:
        return F.struct(a["y"].alias("y0"), a["x"].alias("x0"), b["y"].alias("y1"), b["x"].alias("x1"))

    falling = on("ul", "ur") & on("lr", "ll")
    rising = on("ur", "ul") & on("ll", "lr")
    pieces = (
        F.when(falling, F.array(piece(left, top), piece(right, bottom)))
        .when(rising, F.array(piece(top, right), piece(bottom, left)))
        .otherwise(F.array(piece(enter, leave)))
    )
    return square.select("scene_id", "row", "col", F.posexplode(pieces).alias("n", "p")).select(
        "scene_id", "row", "col", "n", "p.y0", "p.x0", "p.y1", "p.x1"
    )


def to_world(segs: DataFrame, origin_x: Column | float, origin_y: Column | float, size: Column | float) -> DataFrame:
    """Half pixels to world coordinates; extra columns stay."""
    ends = {}
    for k in ("0", "1"):
        ends[f"x{k}"], ends[f"y{k}"] = pixel_xy(F.col(f"y{k}") / 2, F.col(f"x{k}") / 2, origin_x, origin_y, size)
    return segs.withColumns(ends)


def polylines(segs: DataFrame, block: int = 256) -> DataFrame:
    """Vertices (scene_id, part, seq, y, x, closed) of the lines that the pieces make up, in order.

    part names a line by the square of its first piece. A closed line repeats its first vertex at the end.
    """
    placed = order_pieces(segs, block)
    followed = placed.select("chain", (F.col("seq") - 1).alias("seq"))
    # The last piece of a line also gives its end vertex.
    tail = placed.join(followed, ["chain", "seq"], "left_anti")
    vertices = placed.select("chain", "seq", F.col("y0").alias("y"), F.col("x0").alias("x"), "closed").unionByName(
        tail.select("chain", (F.col("seq") + 1).alias("seq"), F.col("y1").alias("y"), F.col("x1").alias("x"), "closed")
    )
    part = F.concat_ws("_", *[F.col(f"chain.{c}").cast("string") for c in ("row", "col", "n")])
    return vertices.select(F.col("chain.scene_id").alias("scene_id"), part.alias("part"), "seq", "y", "x", "closed")
