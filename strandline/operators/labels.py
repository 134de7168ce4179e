"""Label images: month selection, matching to input dates, overlay, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.projection import affine_pixel, affine_xy, with_utm_lonlat
from strandline.operators.blocks import BLOCK, along_row, with_halo
from strandline.operators.spatial import in_polygons
from strandline.session import spread

# A month label stands for the day this many days after its first.
LABEL_DAY = 14
MAX_KERNEL = 2


def clip_pixels(pixels: DataFrame, rings: DataFrame, strip: float, poly_key: str = "poly_id") -> DataFrame:
    """Pixels (scene_id, row, col, x, y, ...) whose centre lies in a polygon."""
    keyed = pixels.withColumn("_id", F.struct("scene_id", "row", "col"))
    inside = in_polygons(keyed, "_id", rings, poly_key, strip).select("_id").distinct()
    return keyed.join(inside, "_id", "left_semi").drop("_id")


def valid_images(
    pixels: DataFrame, start: str, end: str, rings: DataFrame, nodata_limit: int, strip: float = 0.01
) -> DataFrame:
    """Images in [start, end) with fewer than nodata_limit void pixels (value < 1) inside a region.

    pixels (image_id, time_start, pixel_id, value, lon, lat). The date filter comes
    first and reaches the scan. One row for each region and image with a pixel in it.
    """
    dated = pixels.where((F.col("time_start") >= F.lit(start).cast("date")) & (F.col("time_start") < F.lit(end).cast("date")))
    points = dated.select(
        F.struct("image_id", "pixel_id", "time_start", "value").alias("_id"), F.col("lon").alias("x"), F.col("lat").alias("y")
    )
    inside = in_polygons(points, "_id", rings, strip=strip).select("poly_id", "_id.*")
    return (
        inside.groupBy("poly_id", "image_id", "time_start")
        .agg(F.count("*").alias("pixels"), F.sum((F.col("value") < 1).cast("int")).alias("nodata_count"))
        .where(F.col("nodata_count") < nodata_limit)
    )


def image_months(images: DataFrame) -> DataFrame:
    """Month (yyyy-MM) and day (yyyy-MM-dd) of each kept image; a listing of rows, its count is an aggregate."""
    return images.select(
        "image_id", F.date_format("time_start", "yyyy-MM").alias("month"), F.date_format("time_start", "yyyy-MM-dd").alias("day")
    )


def label_date(month: Column | str) -> Column:
    """yyyy_MM to the date the label stands for."""
    month = F.col(month) if isinstance(month, str) else month
    return F.date_add(F.try_to_date(F.concat(month, F.lit("_01")), "yyyy_MM_dd"), LABEL_DAY)


def nearest_label(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each input (input_date, ...) with the label (label_date, label) nearest in time, the earlier one on a tie.

    Two-sided as-of match without pairing inputs and labels: both are reduced to their
    distinct days, each day looks back and ahead among the label days, and the inputs
    join their day. Days are few (a century has 36,525), so the unpartitioned sort is small
    however many images share a day. Of several labels on one date the last by name counts.
    """
    one = labels.groupBy("label_date").agg(F.max("label").alias("label"))
    days = inputs.select(F.col("input_date").alias("day")).distinct()
    marks = days.select("day", F.lit(None).cast("struct<d:date,label:string>").alias("mark"), F.lit(True).alias("asked")).unionByName(
        one.select(F.col("label_date").alias("day"), F.struct(F.col("label_date").alias("d"), "label").alias("mark"), F.lit(False).alias("asked"))
    )
    back = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, 0)
    both = marks.withColumn("b", F.last("mark", ignorenulls=True).over(back)).withColumn(
        "a", F.last("mark", ignorenulls=True).over(ahead)
    )
    gap_b, gap_a = F.datediff("day", "b.d"), F.datediff("a.d", "day")
    pick = F.when(F.col("a.d").isNull() | (gap_b <= gap_a), F.col("b")).otherwise(F.col("a"))
    chosen = both.where("asked").select(F.col("day").alias("input_date"), pick.alias("m"))
    return inputs.join(chosen, "input_date").select(
        *inputs.columns, F.col("m.d").alias("label_date"), F.col("m.label").alias("label")
    )


def first_input_of_day(matched: DataFrame) -> DataFrame:
    """Inputs of one date share an output name; the first by path is made."""
    return matched.groupBy("input_date").agg(F.min_by(F.struct(*[c for c in matched.columns if c != "input_date"]), "path").alias("m")).select(
        "input_date", "m.*"
    ).withColumn("output", F.concat(F.date_format("input_date", "yyyy-MM-dd"), F.lit("_labeled.tif")))


def overlay(pixels: DataFrame, label: DataFrame, first_band: str) -> DataFrame:
    """Pixels with the label of their place (scene_id, row, col); image extent wins, void pixels get label 0."""
    key = ["scene_id", "row", "col"]
    value = F.when(F.col(first_band) == 0, 0).otherwise(F.coalesce("label", F.lit(0)))
    return pixels.join(label.select(*key, "label"), key, "left").withColumn("label", value)


def _spline(d: float) -> float:
    """Cubic B-spline at distance d."""
    a = abs(d)
    return (4 - 6 * a**2 + 3 * a**3) / 6 if a < 1 else (2 - a) ** 3 / 6 if a < 2 else 0.0


def _fine(value: str, factor: int, window) -> Column:
    """Values of the `factor` target positions over a source position, from its neighbours along the window."""
    taps = range(-MAX_KERNEL, MAX_KERNEL + 1)
    near = {k: F.lag(value, -k).over(window) for k in taps}

    def at(j: int) -> Column:
        weights = {k: _spline((j + 0.5) / factor - 0.5 - k) for k in taps}
        used = {k: w for k, w in weights.items() if w > 0}
        total = sum((F.coalesce(near[k] * w, F.lit(0.0)) for k, w in used.items()), F.lit(0.0))
        weight = sum((F.when(near[k].isNotNull(), w).otherwise(0.0) for k, w in used.items()), F.lit(0.0))
        return F.try_divide(total, weight)

    return F.array(*[at(j) for j in range(factor)])


def upsample(source: DataFrame, value: str, factor: int, block: int = 256) -> DataFrame:
    """Plane on a grid `factor` times as fine, by cubic B-spline; at the frame the weights that exist are normalised.

    The coarse pixels are exchanged once, by block with a halo; both axes are refined
    inside the block, so nothing of the size of the fine plane is shuffled.
    """
    halo = with_halo(source, [value], MAX_KERNEL, block)
    across = halo.select(*BLOCK, "row", "col", "core", _fine(value, factor, along_row()).alias("_v"))
    wide = across.select(*BLOCK, "row", "col", "core", F.posexplode("_v").alias("_j", value))
    down = Window.partitionBy(*BLOCK, "col", "_j").orderBy("row")
    fine = wide.select("scene_id", "row", "col", "core", "_j", _fine(value, factor, down).alias("_v")).where("core")
    return fine.select(
        "scene_id", "row", (F.col("col") * factor + F.col("_j")).alias("_c"), F.posexplode("_v").alias("_i", value)
    ).select("scene_id", (F.col("row") * factor + F.col("_i")).alias("row"), F.col("_c").alias("col"), value)


def upsample_nearest(source: DataFrame, value: str, factor: int) -> DataFrame:
    """The same grid with the value of the source pixel underneath; keeps class labels whole."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return (
        source.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps))
        .select("scene_id", (F.col("row") * factor + F.col("_r")).alias("row"), (F.col("col") * factor + F.col("_c")).alias("col"), value)
    )


#: Side of the target tiles of a reprojection.
WARP_TILE = 64


def _warped(pixels: DataFrame) -> DataFrame:
    """pixels with the fractional source (row, col) under the centre of target pixel (row, col) of its frame, as _y and _x."""
    at = pixels.withColumns(dict(zip(("_tx", "_ty"), affine_xy("row", "col", F.col("target")), strict=True)))
    at = with_utm_lonlat(at, "_tx", "_ty", F.col("lon0"), "_lon", "_lat")
    place = [F.when(F.col("geographic"), F.col(g)).otherwise(F.col(p)) for g, p in (("_lon", "_tx"), ("_lat", "_ty"))]
    return at.withColumns(dict(zip(("_y", "_x"), affine_pixel(*place, F.col("source")), strict=True))).drop("_tx", "_ty", "_lon", "_lat")


def reproject(source: DataFrame, value: str, frames: DataFrame, smooth: bool = True, tile: int = WARP_TILE) -> DataFrame:
    """(scene_id, row, col, value) on the target grid of each scene, for every target pixel.

    source: (scene_id, row, col, value) label planes. frames, one row a scene: scene_id, target and source
    (structs a..f, see affine_xy), nrows, ncols of the target, source_rows, source_cols, lon0 (central
    meridian of the target's UTM zone), geographic (the source is in degrees; else in the target's zone).

    Each target pixel is mapped to its place in the source. smooth takes 4 x 4 pixels around it by
    cubic B-spline, normalised over those that exist; otherwise the pixel underneath counts. Places
    outside the source, and places without any pixel that counts, are NULL.

    Target pixels are never shuffled: a tile of them knows the source box its places lie in (as wide as
    the mapping makes it), gets that box as one array, and is unfolded afterwards.
    """
    steps = lambda size: F.explode(F.sequence(F.lit(0), F.expr(f"({size} - 1) div {tile}").cast("int")))
    # A tile is one short row and thousands of pixels, so tiles are dealt by number; patches meet them in the same deal.
    tiles = spread(frames.where("nrows > 0 and ncols > 0").withColumn("_tr", steps("nrows")).withColumn("_tc", steps("ncols")), "scene_id", "_tr", "_tc")
    inside = lambda axis, size: F.explode(F.sequence(F.col(axis) * tile, (F.least((F.col(axis) + 1) * tile, F.col(size)) - 1).cast("int")))
    unfold = lambda df: df.withColumn("row", inside("_tr", "nrows")).withColumn("col", inside("_tc", "ncols"))
    v, u = F.col("_y"), F.col("_x")
    reach = MAX_KERNEL - 1 if smooth else 0
    first = lambda p: F.floor(p if smooth else p + 0.5).cast("int")
    span = _warped(unfold(tiles)).groupBy("scene_id", "_tr", "_tc").agg(
        F.min(first(v)).alias("_r0"), F.max(first(v)).alias("_r1"), F.min(first(u)).alias("_c0"), F.max(first(u)).alias("_c1"),
        F.first("source_rows").alias("_h"), F.first("source_cols").alias("_w"),
    )
    low = lambda c: F.greatest(F.col(c) - reach, F.lit(0))
    high = lambda c, size: F.least(F.col(c) + reach + int(smooth), F.col(size) - 1).cast("int")
    boxes = span.select("scene_id", "_tr", "_tc", low("_r0").alias("_r0"), high("_r1", "_h").alias("_r1"), low("_c0").alias("_c0"), high("_c1", "_w").alias("_c1")).where("_r0 <= _r1 and _c0 <= _c1")
    cells = boxes.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    planes = source.select("scene_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("_v"))
    filled = cells.join(planes, ["scene_id", "row", "col"], "left")
    patch = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "_v"))), lambda x: x["_v"]).alias("_patch")
    patches = filled.groupBy("scene_id", "_tr", "_tc").agg(patch, *[F.first(c).alias(c) for c in ("_r0", "_r1", "_c0", "_c1")])
    whole = _warped(unfold(spread(tiles.join(patches, ["scene_id", "_tr", "_tc"], "left"), "scene_id", "_tr", "_tc"))).select("scene_id", "row", "col", "_y", "_x", "source_rows", "source_cols", "_patch", "_r0", "_r1", "_c0", "_c1")

    def at(r: Column, c: Column) -> Column:
        within = r.between(F.col("_r0"), F.col("_r1")) & c.between(F.col("_c0"), F.col("_c1"))
        return F.when(within, F.get("_patch", (r - F.col("_r0")) * (F.col("_c1") - F.col("_c0") + 1) + c - F.col("_c0")))

    ry, rx = F.floor(F.col("_y") + 0.5).cast("int"), F.floor(F.col("_x") + 0.5).cast("int")
    covered = ry.between(F.lit(0), F.col("source_rows") - 1) & rx.between(F.lit(0), F.col("source_cols") - 1)
    if not smooth:
        return whole.select("scene_id", "row", "col", F.when(covered, at(ry, rx)).alias(value))
    whole = whole.withColumn("_i", F.floor("_y").cast("int")).withColumn("_j", F.floor("_x").cast("int"))
    # Weights and places of the four rows and columns once a pixel, then the sixteen values, then their sums.
    near = {}
    for axis, p, i, lo, hi in (("y", "_y", "_i", "_r0", "_r1"), ("x", "_x", "_j", "_c0", "_c1")):
        for k, w in enumerate(_spline_taps(F.col(p) - F.col(i))):
            place = F.col(i) + k - 1
            near |= {f"_w{axis}{k}": w, f"_p{axis}{k}": F.when(place.between(F.col(lo), F.col(hi)), place - F.col(lo))}
    whole = whole.withColumn("_in", covered).withColumn("_wide", F.col("_c1") - F.col("_c0") + 1).withColumns(near)
    pairs = [(a, b) for a in range(4) for b in range(4)]
    known = whole.withColumns({f"_v{a}{b}": F.get("_patch", F.col(f"_py{a}") * F.col("_wide") + F.col(f"_px{b}")) for a, b in pairs})
    total, weight = F.lit(0.0), F.lit(0.0)
    for a, b in pairs:
        v, w = F.col(f"_v{a}{b}"), F.col(f"_wy{a}") * F.col(f"_wx{b}")
        total, weight = total + F.coalesce(w * v, F.lit(0.0)), weight + F.when(v.isNotNull(), w).otherwise(0.0)
    return known.select("scene_id", "row", "col", F.when(F.col("_in"), F.try_divide(total, weight)).alias(value))


def _spline_taps(t: Column) -> list[Column]:
    """Cubic B-spline weights of the four pixels around a place t beyond the second one."""
    s = 1 - t
    return [s * s * s / 6, (4 - 6 * t * t + 3 * t * t * t) / 6, (4 - 6 * s * s + 3 * s * s * s) / 6, t * t * t / 6]


def crop_to(pixels: DataFrame, image: DataFrame) -> DataFrame:
    """Pixels inside the extent of the image of the same scene."""
    ext = image.groupBy("scene_id").agg(
        F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1")
    )
    return pixels.join(ext, "scene_id").where("row between _r0 and _r1 and col between _c0 and _c1").drop("_r0", "_r1", "_c0", "_c1")
