"""Square windows around points, matched to pixels by block.

Statistics of many overlapping windows do not pair pixels with windows: histograms come from
packed blocks of pixels that meet the parts of the windows in them, counts of windows from their
corners (a two-dimensional difference plane), so a pixel is moved once however many windows lie on it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.blocks import BLOCK
from strandline.session import settled

BOX = ["scene_id", "r0", "r1", "c0", "c1"]
#: Sides of the blocks that are packed for histograms (at most 256: places are 16-bit) and for counts.
PACKED, COUNTED = 64, 128


def square_buffer(points: DataFrame, half: Column | float) -> DataFrame:
    """Corners of the square around each point; half is in world units."""
    return points.select(
        "*", (F.col("x") - half).alias("x0"), (F.col("y") - half).alias("y0"),
        (F.col("x") + half).alias("x1"), (F.col("y") + half).alias("y1"),
    )


def point_boxes(points: DataFrame, georef: DataFrame, half: int) -> DataFrame:
    """Pixel box of the square of `half` pixels around each point, cut at the frame.

    points (point_id, scene_id, x, y); georef (scene_id, origin_x, origin_y, pixel_size,
    nrows, ncols). A pixel belongs to the box when its centre does. `whole` is false
    when a side falls under 2 * half pixels.
    """
    fx = (F.col("x") - F.col("origin_x")) / F.col("pixel_size") - 0.5
    fy = (F.col("origin_y") - F.col("y")) / F.col("pixel_size") - 0.5
    box = points.join(georef, "scene_id").select(
        "point_id", "scene_id",
        F.greatest(F.lit(0), F.ceil(fy - half)).cast("int").alias("r0"),
        F.least(F.col("nrows") - 1, F.floor(fy + half)).cast("int").alias("r1"),
        F.greatest(F.lit(0), F.ceil(fx - half)).cast("int").alias("c0"),
        F.least(F.col("ncols") - 1, F.floor(fx + half)).cast("int").alias("c1"),
    )
    whole = (F.col("r1") - F.col("r0") + 1 >= 2 * half) & (F.col("c1") - F.col("c0") + 1 >= 2 * half)
    return box.withColumn("whole", whole)


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """Equal boxes once, with their number as weight.

    Points may crowd, but the boxes that can differ inside a block are bounded by its
    pixels, which keeps the block join bounded too. The result is written, so that the
    joins below broadcast it only when its size allows.
    """
    return settled(boxes.where("whole").groupBy(*BOX).agg(F.count("*").alias("weight")), "boxes")


def _located(pixels: DataFrame, block: int) -> DataFrame:
    return pixels.withColumn("block_row", F.expr(f"row div {block}").cast("int")).withColumn(
        "block_col", F.expr(f"col div {block}").cast("int")
    )


def box_parts(boxes: DataFrame, block: int) -> DataFrame:
    """Each box once for every block it lies on."""
    def blocks(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.expr(f"{lo} div {block}").cast("int"), F.expr(f"{hi} div {block}").cast("int")))

    some = boxes.where("r0 <= r1 and c0 <= c1")
    return some.withColumn("block_row", blocks("r0", "r1")).withColumn("block_col", blocks("c0", "c1"))


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, block: int = 256, how: str = "inner") -> DataFrame:
    """Each pixel once for every box around it; how="left" keeps the pixels outside all boxes."""
    a, b = _located(pixels, block).alias("a"), box_parts(boxes, block).alias("b")
    on = (
        (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.block_row") == F.col("b.block_row"))
        & (F.col("a.block_col") == F.col("b.block_col"))
        & F.col("a.row").between(F.col("b.r0"), F.col("b.r1")) & F.col("a.col").between(F.col("b.c0"), F.col("b.c1"))
    )
    keep = [c for c in boxes.columns if c != "scene_id"]
    return a.join(b, on, how).select(*[F.col(f"a.{c}") for c in pixels.columns], *[F.col(f"b.{c}") for c in keep])


def _pack_block(block: int):
    import numpy as np

    def run(key, table):
        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        place = (row - key[1].as_py() * block) * block + col - key[2].as_py() * block
        cells = place.astype("<u2").tobytes(), table.column("code").to_numpy().astype("<i2").tobytes()
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([c], pa.binary()) for c in cells],
                        names=[*BLOCK, "places", "codes"])

    return run


def _count_parts(block: int):
    import numpy as np

    def run(batches):
        for batch in batches:
            get = {c: batch.column(c).to_numpy() for c in ("r0", "r1", "c0", "c1", "block_row", "block_col")}
            at, bins, counts = [], [], []
            for i in range(batch.num_rows):
                place = np.frombuffer(batch.column("places")[i].as_buffer(), "<u2")
                code = np.frombuffer(batch.column("codes")[i].as_buffer(), "<i2")
                top, left = get["block_row"][i] * block, get["block_col"][i] * block
                row, col = place // block, place % block
                held = code[(row >= get["r0"][i] - top) & (row <= get["r1"][i] - top)
                            & (col >= get["c0"][i] - left) & (col <= get["c1"][i] - left)]
                if len(held):
                    low = int(held.min())
                    n = np.bincount(held.astype("int64") - low)
                    seen = np.flatnonzero(n)
                    at.append(np.full(len(seen), i)), bins.append(seen + low), counts.append(n[seen])
            if at:
                rows = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in BOX], pa.array(np.concatenate(bins), pa.int32()),
                     pa.array(np.concatenate(counts), pa.int64())], [*BOX, "bin", "n"])

    return run


def box_histograms(coded: DataFrame, boxes: DataFrame, block: int = PACKED) -> DataFrame:
    """(scene_id, r0, r1, c0, c1, bin, n) of distinct boxes; coded is (scene_id, row, col, code), codes of 16 bits.

    Pixels are packed once into a row for each block; a box then meets a row for each block it lies on
    and leaves its partial counts, which are combined before they are shuffled. NULL codes count nowhere.
    """
    if block > 256:
        raise ValueError("places in a block are 16-bit")
    kind = {f.name: f.dataType.simpleString() for f in coded.schema}["scene_id"]
    valid = _located(coded.where(F.col("code").isNotNull()).select("scene_id", "row", "col", "code"), block)
    packed = valid.groupBy(*BLOCK).applyInArrow(
        _pack_block(block), f"scene_id {kind}, block_row int, block_col int, places binary, codes binary")
    met = packed.join(box_parts(boxes.select(*BOX), block), BLOCK)
    parts = met.mapInArrow(_count_parts(block), f"scene_id {kind}, r0 int, r1 int, c0 int, c1 int, bin int, n bigint")
    return parts.groupBy(*BOX, "bin").agg(F.sum("n").alias("n"))


def _count_block(block: int, columns: list[str]):
    import numpy as np

    def run(key, pixels, corners):
        row = pixels.column("row").to_numpy() - key[1].as_py() * block
        col = pixels.column("col").to_numpy() - key[2].as_py() * block
        code = pixels.column("code").to_numpy(zero_copy_only=False).astype(float)  # NULL as NaN: reaches nothing
        level, r, c, w = (corners.column(x).to_numpy() for x in ("level", "r", "c", "w"))
        hits, plane = np.zeros(len(row), np.int64), np.zeros((block, block), np.int64)
        order = np.argsort(level, kind="stable")
        levels, starts = np.unique(level[order], return_index=True)
        for i, part in enumerate(np.split(order, starts[1:]) if len(levels) else []):
            step = np.zeros((block, block), np.int64)
            np.add.at(step, (r[part], c[part]), w[part])
            plane += step.cumsum(0).cumsum(1)
            # Boxes up to this level are on the plane: what codes below the next level reach.
            here = code >= levels[i]
            if i + 1 < len(levels):
                here &= code < levels[i + 1]
            hits[here] = plane[row[here], col[here]]
        out = pixels.select(columns)
        return out.append_column("cover", pa.array(plane[row, col])).append_column("hits", pa.array(hits))

    return run


def box_counts(coded: DataFrame, boxes: DataFrame, level: Column | str, block: int = COUNTED) -> DataFrame:
    """coded (scene_id, row, col, code) with the weight of the boxes on each pixel (cover) and of those
    whose level its code reaches (hits); boxes are (scene_id, r0, r1, c0, c1, weight) and a number as level.

    A box becomes four corners in each block it lies on. Equal corners of a level are added before the
    shuffle, so a block gets at most levels * block * block of them, whatever the number of boxes, and
    running sums over its plane give the counts. Boxes without a level count nowhere.
    """
    columns = ["scene_id", "row", "col", "code"]
    lv = F.col(level) if isinstance(level, str) else level
    parts = box_parts(boxes.select(*BOX, "weight", lv.cast("double").alias("level")).where("level is not null"), block)
    top, left = F.col("block_row") * block, F.col("block_col") * block
    r0, c0 = F.greatest(F.col("r0") - top, F.lit(0)), F.greatest(F.col("c0") - left, F.lit(0))
    r1, c1 = F.col("r1") - top + 1, F.col("c1") - left + 1
    w = F.col("weight").cast("long")
    four = [F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), v.alias("w"))
            for r, c, v in ((r0, c0, w), (r0, c1, -w), (r1, c0, -w), (r1, c1, w))]
    corners = (
        parts.select(*BLOCK, "level", F.inline(F.array(*four))).where((F.col("r") < block) & (F.col("c") < block))
        .groupBy(*BLOCK, "level", "r", "c").agg(F.sum("w").alias("w")).where("w <> 0")
    )
    kinds = {f.name: f.dataType.simpleString() for f in coded.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in columns], "cover bigint", "hits bigint"])
    located = _located(coded.select(*columns), block)
    return located.groupBy(*BLOCK).cogroup(corners.groupBy(*BLOCK)).applyInArrow(_count_block(block, columns), schema)
