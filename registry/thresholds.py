"""Histogram thresholds, classes, sliding windows, point windows and tiles."""

from pyspark.sql import functions as F

from registry import query
from registry.stencils import blur_sql, open_close_sql
from registry.tables import GRID_COLS, SCENE_ROWS
from strandline.functions import spectral as sp
from strandline.operators import stencil as st
from strandline.operators import threshold as th
from strandline.operators import windows as wi
from strandline.plans import water as wa


def running_sql(source: str, keys: str) -> str:
    return f"""(select *, n::double cnt, sum(n::double) over (partition by {keys} order by bin) n1,
      sum(n::double * bin) over (partition by {keys} order by bin) s1, sum(n::double * n) over (partition by {keys} order by bin) q1,
      sum(n::double) over (partition by {keys}) nt, sum(n::double * bin) over (partition by {keys}) st,
      sum(n::double * n) over (partition by {keys}) qt from {source})"""


def otsu_sql(source: str, keys: str) -> str:
    """(keys, threshold): rank the splits, lowest bin first among equals."""
    return f"""select {keys}, coalesce(min(case when g = best then bin end), 0)::int threshold from
      (select *, max(g) over (partition by {keys}) best from
        (select *, case when n1 < nt then power(nt * s1 - n1 * st, 2) / (n1 * (nt - n1)) end g from {running_sql(source, keys)})) group by {keys}"""


CODED = 'coded as (select scene_id, "row", col, case when v is not null and not isnan(v) then least(floor((v + 1) * 128), 255)::int end code from grid)'
HIST = "hist as (select scene_id, code bin, count(*) n from coded group by 1, 2)"


def coded(t):
    return t.grid().select("scene_id", "row", "col", sp.encode_floor("v").alias("code"))


@query("d10_otsu_global", f"""with {CODED}, {HIST}, o as ({otsu_sql("hist", "scene_id")})
    select scene_id, threshold, round(threshold / 128.0::double - 1, 9) as level from o""")
def _(t):
    return th.otsu(th.histogram(coded(t), "code")).select(
        "scene_id", "threshold", F.round(sp.decode_floor("threshold"), 9).alias("level"))


@query("d10_otsu_reduced_noise", f"""with {CODED}, plane as (select scene_id, "row", col, code::double code from coded),
    {blur_sql("plane", "code", 5, 0.0, SCENE_ROWS, GRID_COLS)},
    hist as (select scene_id, floor(code + 0.5)::int bin, count(*) n from blurred group by 1, 2),
    o as ({otsu_sql("hist", "scene_id")}) select scene_id, threshold, round(threshold / 128.0::double - 1, 9) as level from o""")
def _(t):
    plane = coded(t).withColumn("code", F.col("code").cast("double"))
    smooth = st.gaussian_blur(plane, "code", 5, 0.0, SCENE_ROWS, GRID_COLS)
    return th.otsu(th.histogram(smooth, F.floor(F.col("code") + 0.5))).select(
        "scene_id", "threshold", F.round(sp.decode_floor("threshold"), 9).alias("level"))


@query("d10_otsu_many_scenes", """with hist as (select scene_id, least(floor((v + 1) * 128), 255)::int bin, count(*) n from chips group by 1, 2),
    o as (""" + otsu_sql("hist", "scene_id") + ") select scene_id, threshold from o")
def _(t):
    return th.otsu(th.histogram(t.chips(), sp.encode_floor("v")))


@query("d12_yen_threshold", f"""with {CODED}, {HIST}, g as (select *, case when n1 < nt then power(n1 * (nt - n1), 2) / (q1 * (qt - q1)) end g
      from {running_sql("hist", "scene_id")})
    select scene_id, coalesce(min(case when g = best then bin end), min(bin))::int threshold,
      round((coalesce(min(case when g = best then bin end), min(bin)) - 127) / 128.0::double, 9) as level
    from (select *, max(g) over (partition by scene_id) best from g) group by 1""")
def _(t):
    return th.yen(th.histogram(coded(t), "code")).select(
        "scene_id", "threshold", F.round(sp.decode_yen("threshold"), 9).alias("level"))


# All cut pairs of the occupied bins.
CUTS = f"""run as (select * from {running_sql("hist", "scene_id")}),
    cuts as (select scene_id, cut1, cut2 from (select a.scene_id, a.bin cut1, b.bin cut2, row_number() over (partition by a.scene_id
      order by a.s1 * a.s1 / a.n1 + (b.s1 - a.s1) * (b.s1 - a.s1) / (b.n1 - a.n1) + (a.st - b.s1) * (a.st - b.s1) / (a.nt - b.n1) desc, a.bin, b.bin) k
      from run a join run b on a.scene_id = b.scene_id and a.bin < b.bin where b.n1 < b.nt) where k = 1),
    classed as (select h.*, (case when bin > cut1 then 1 else 0 end + case when bin > cut2 then 1 else 0 end)::int class from hist h join cuts using (scene_id))"""


@query("d13_exact_three_means", f"""with {CODED}, {HIST}, {CUTS} select scene_id, "row", col,
    (case when code > cut1 then 1 else 0 end + case when code > cut2 then 1 else 0 end)::int class from coded join cuts using (scene_id)""")
def _(t):
    px = coded(t)
    cuts = th.exact_means(th.histogram(px, "code"), 3)
    return px.join(cuts, "scene_id").select("scene_id", "row", "col", th.class_of("code", "cuts").alias("class"))


@query("d13_exact_two_means", f"""with {CODED}, {HIST}, run as (select * from {running_sql("hist", "scene_id")}) select scene_id, bin::int cut from
    (select scene_id, bin, row_number() over (partition by scene_id order by s1 * s1 / n1 + (st - s1) * (st - s1) / (nt - n1) desc, bin) k
     from run where n1 < nt) where k = 1""")
def _(t):
    return th.exact_means(th.histogram(coded(t), "code"), 2).select("scene_id", F.get("cuts", F.lit(0)).alias("cut"))


SHARES = """shares as (select scene_id, class, n, n / total::double share, first_value(class) over
      (partition by scene_id order by n, class) doubt from (select scene_id, class, sum(n)::bigint n from classed group by 1, 2)
      join (select scene_id, sum(n)::bigint total from classed group by 1) using (scene_id))"""


@query("d14_class_shares", f"""with {CODED}, {HIST}, {CUTS}, {SHARES} select scene_id, class, n, round(share, 9) share, doubt from shares""")
def _(t):
    hist = th.histogram(coded(t), "code")
    shares = th.class_shares(hist, th.exact_means(hist, 3), 3)
    return shares.select("scene_id", "class", "n", F.round("share", 9).alias("share"), "doubt")


def windows_sql(step: int, size: int) -> str:
    """Pixels by covering window: brute force over every origin of the scene."""
    return f"""pw as (select c.scene_id, "row", col, code, wy, wx from coded c,
      (select (i * {step})::int wy from range({SCENE_ROWS}) r(i) where i * {step} < {SCENE_ROWS}) a,
      (select (i * {step})::int wx from range({GRID_COLS}) r(i) where i * {step} < {GRID_COLS}) b
      where "row" >= wy and "row" < wy + {size} and col >= wx and col < wx + {size})"""


@query("e1_sliding_windows", f"""with {CODED}, {windows_sql(50, 100)} select scene_id, wy, wx, count(*) n, sum(code)::bigint total,
    min("row") r0, max("row") r1, min(col) c0, max(col) c1 from pw group by 1, 2, 3""")
def _(t):
    return wi.sliding_windows(coded(t), 50, 100, 100).groupBy("scene_id", "wy", "wx").agg(
        F.count("*").alias("n"), F.sum("code").alias("total"), F.min("row").alias("r0"), F.max("row").alias("r1"),
        F.min("col").alias("c0"), F.max("col").alias("c1"))


STEP, SIZE = 10, 20
WINDOWED = f"""{CODED}, {HIST}, {CUTS}, {SHARES}, {windows_sql(STEP, SIZE)},
    whist as (select scene_id, wy, wx, code bin, count(*) n from pw group by all),
    corner as (select scene_id, first_value(class) over (partition by scene_id order by n desc, class) water,
      row_number() over (partition by scene_id order by n desc, class) k from
      (select scene_id, class, sum(w.n) n from whist w join classed c using (scene_id, bin) where wy = 0 and wx = 0 group by 1, 2)),
    facts as (select scene_id, wy, wx, sum(case when class = water then w.n else 0 end) / sum(w.n)::double water_ratio,
      bool_or(class = doubt) and bool_or(class = water) mixed from whist w join classed c using (scene_id, bin)
      join (select distinct scene_id, doubt from shares) using (scene_id) join (select scene_id, water from corner where k = 1) using (scene_id) group by 1, 2, 3),
    wotsu as ({otsu_sql("whist", "scene_id, wy, wx")}),
    limits as (select scene_id, wy, wx, water_ratio, mixed, case when mixed then threshold when water_ratio > 0.9 then 0 end::int lim
      from facts join wotsu using (scene_id, wy, wx))"""


@query("d11_otsu_per_window", f"with {WINDOWED} select scene_id, wy, wx, threshold from wotsu")
def _(t):
    cells = th.histogram(wi.with_cell(coded(t), 10), "code", ("scene_id", "cy", "cx"))
    hist = wi.cells_to_windows(cells, 10, STEP, SIZE, SIZE).groupBy("scene_id", "wy", "wx", "bin").agg(F.sum("n").alias("n"))
    return th.otsu(hist, ("scene_id", "wy", "wx"))


@query("d15_window_class_stats", f"with {WINDOWED} select scene_id, wy, wx, round(water_ratio, 9) water_ratio, mixed from facts")
def _(t):
    f = wa.window_facts(wa.window_classes(coded(t), STEP, SIZE, SIZE))
    return f.select("scene_id", "wy", "wx", F.round("water_ratio", 9).alias("water_ratio"), "mixed")


@query("d16_corner_class", f"with {WINDOWED} select scene_id, water from corner where k = 1")
def _(t):
    return wa.window_classes(coded(t), STEP, SIZE, SIZE).groupBy("scene_id").agg(F.max("water").alias("water"))


@query("d17_or_of_windows", f"""with {WINDOWED} select scene_id, "row", col, max(case when code >= lim then 1 else 0 end)::int water
    from pw join limits using (scene_id, wy, wx) group by 1, 2, 3""")
def _(t):
    return wa.classify(t.grid(), "v", STEP, SIZE, SIZE, kernel=None)


@query("e6_window_classification", f"""with {WINDOWED}, orred as (select scene_id, "row", col, max(case when code >= lim then 1 else 0 end)::int water
    from pw join limits using (scene_id, wy, wx) group by 1, 2, 3), {open_close_sql("orred", "water", 2)}
    select scene_id, "row", col, water from m4""")
def _(t):
    return wa.classify(t.grid(), "v", STEP, SIZE, SIZE, kernel=5, block=64)


@query("flagship_water_share", f"""with toa as (select scene_id, "row", col, case when b2 + b4 = 0 then null else (b2 - b4) / (b2 + b4)::double end v from bands4),
    coded as (select scene_id, "row", col, least(floor((v + 1) * 128), 255)::int code from toa), {HIST},
    o as ({otsu_sql("hist", "scene_id")}),
    wet as (select scene_id, "row", col, (code >= threshold)::int water from coded join o using (scene_id)),
    {open_close_sql("wet", "water", 1)} select scene_id, count(*) pixels, sum(water)::bigint wet_pixels,
    round(avg(water), 9) water_share from m4 group by 1""")
def _(t):
    index = t.bands4().select("scene_id", "row", "col", sp.water_index("b2", "b4").alias("v"))
    cleaned = st.open_close(wa.threshold_mask(index, "v"), "water", 3, 3)
    return cleaned.groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.sum("water").alias("wet_pixels"), F.round(F.avg("water"), 9).alias("water_share"))


from registry.tables import ORIGIN_X, ORIGIN_Y, PIXEL, SCENE_STEP  # noqa: E402
from strandline.operators import points as pt  # noqa: E402
from strandline.operators import tiles as ti  # noqa: E402
from strandline.plans import point_labels as pl  # noqa: E402

HALF = 10


def georef(t, cols: int = GRID_COLS):
    return t.grid().groupBy("scene_id").agg(
        (F.max("row") + 1).cast("int").alias("nrows"), F.lit(cols).alias("ncols")
    ).select(
        "scene_id", (F.lit(ORIGIN_X) + F.col("scene_id") * SCENE_STEP).alias("origin_x"), F.lit(ORIGIN_Y).alias("origin_y"),
        F.lit(PIXEL).alias("pixel_size"), "nrows", "ncols",
    )


BOXES = f"""geo as (select scene_id, {ORIGIN_X}::double + scene_id * {SCENE_STEP}::double ox, {ORIGIN_Y}::double oy, max("row") + 1 nr from grid group by 1),
    boxes as (select point_id, scene_id, greatest(0, ceil((oy - y) / {PIXEL}::double - 0.5::double - {HALF}))::int r0,
      least(nr - 1, floor((oy - y) / {PIXEL}::double - 0.5::double + {HALF}))::int r1, greatest(0, ceil((x - ox) / {PIXEL}::double - 0.5::double - {HALF}))::int c0,
      least({GRID_COLS - 1}, floor((x - ox) / {PIXEL}::double - 0.5::double + {HALF}))::int c1 from buffer_points join geo using (scene_id)),
    whole as (select * from boxes where r1 - r0 + 1 >= {2 * HALF} and c1 - c0 + 1 >= {2 * HALF})"""
VOTES = f"""coded as (select scene_id, "row", col, trunc(v * 127 + 128)::int code from grid), {BOXES},
    pb as (select c.scene_id, "row", col, code, point_id from coded c join whole w on c.scene_id = w.scene_id
      and "row" between r0 and r1 and col between c0 and c1),
    phist as (select scene_id, point_id, code bin, count(*) n from pb group by all),
    potsu as ({otsu_sql("phist", "scene_id, point_id")})"""


@query("i4_square_buffer", """select point_id, scene_id, x - 30.0::double x0, y - 30.0::double y0, x + 30.0::double x1, y + 30.0::double y1 from buffer_points""")
def _(t):
    return pt.square_buffer(t.buffer_points(), 30.0).select("point_id", "scene_id", "x0", "y0", "x1", "y1")


@query("c13_pixels_in_buffers", f"""with {BOXES}, g as (select scene_id, "row", col from grid) select point_id, b.scene_id, count(*) n, any_value(r1 - r0 + 1 >= {2 * HALF} and c1 - c0 + 1 >= {2 * HALF}) whole
    from boxes b join g on g.scene_id = b.scene_id and "row" between r0 and r1 and col between c0 and c1 group by 1, 2""")
def _(t):
    boxes = pt.point_boxes(t.buffer_points(), georef(t), HALF)
    joined = pt.pixels_in_boxes(t.grid().select("scene_id", "row", "col"), boxes, block=32)
    return joined.groupBy("point_id", "scene_id").agg(F.count("*").alias("n"), F.bool_or("whole").alias("whole"))


@query("d11_otsu_per_buffer", f"with {VOTES} select point_id, scene_id, threshold, round((threshold - 128) / 127.0::double, 9) as level from potsu")
def _(t):
    px = t.grid().select("scene_id", "row", "col", sp.encode_trunc("v").alias("code"))
    boxes = pt.point_boxes(t.buffer_points(), georef(t), HALF).where("whole")
    limits = pl.box_thresholds(px, boxes.select(*pt.BOX).distinct(), block=32)
    return boxes.join(limits, pt.BOX).select(
        "point_id", "scene_id", "threshold", F.round(sp.decode_trunc("threshold"), 9).alias("level"))


@query("d25_window_cover", f"""with {VOTES} select scene_id, "row", col, count(*) cover from pb group by 1, 2, 3""")
def _(t):
    boxes = pt.distinct_boxes(pt.point_boxes(t.buffer_points(), georef(t), HALF))
    px = t.grid().select("scene_id", "row", "col", F.lit(0).alias("code"))
    return pt.box_counts(px, boxes, F.lit(0), block=64).where("cover > 0").select("scene_id", "row", "col", "cover")


LABELS = f"""{VOTES}, vote as (select c.scene_id, c."row", c.col, any_value(c.code) code, count(point_id) cover,
      coalesce(max(case when c.code >= threshold then 1 when threshold is not null then 0 end), 0)::int label_any,
      coalesce(sum(case when c.code >= threshold then 1 else 0 end), 0) hits
      from coded c left join (select * from pb join potsu using (scene_id, point_id)) p using (scene_id, "row", col) group by 1, 2, 3),
    mean as (select scene_id, avg(threshold) + 10 mt from potsu group by 1),
    lab as (select scene_id, "row", col, cover, label_any, (hits > cover * 0.55::double)::int label_majority,
      coalesce((code >= mt)::int, 0) label_mean from vote left join mean using (scene_id))"""


@query("d18_majority_vote", f'with {LABELS} select scene_id, "row", col, label_majority from lab')
def _(t):
    px = t.grid().select("scene_id", "row", "col", sp.encode_trunc("v").alias("code"))
    return pl.label_codes(px, t.buffer_points(), georef(t), HALF, block=64).select("scene_id", "row", "col", "label_majority")


@query("d19_mean_threshold_concat", f"""with {LABELS} select scene_id, "row", col, label_mean,
    case when cover > 0 then label_any else label_mean end label_final from lab""")
def _(t):
    px = t.grid().select("scene_id", "row", "col", sp.encode_trunc("v").alias("code"))
    return pl.label_codes(px, t.buffer_points(), georef(t), HALF, block=64).select(
        "scene_id", "row", "col", "label_mean", "label_final")


@query("e7_point_labels", f"""with index as (select scene_id, "row", col, coalesce((b2 - b4) / nullif((b2 + b4)::double, 0), 0) v from bands4),
    {blur_sql("index", "v", 9, 6.0, SCENE_ROWS, 16)}, {LABELS.replace("from grid)", "from blurred)", 1).replace(f"least({GRID_COLS - 1},", "least(15,").replace(f">= {2 * HALF}", ">= 6").replace(f"- {HALF})", "- 3)").replace(f"+ {HALF})", "+ 3)")}
    select scene_id, "row", col, cover, label_any, label_majority, label_mean, case when cover > 0 then label_any else label_mean end label_final from lab""")
def _(t):
    return pl.label_from_points(t.bands4(), t.buffer_points(), georef(t, 16), "b2", "b4", half=3, rows=SCENE_ROWS, cols=16, block=64)


# Each pixel as four columns, so that windows of the full half side fit into a scene.
WIDE = f"""wide as (select scene_id, "row", (col * 4 + i)::int col, v * (1 - i / 10.0::double) v from grid, range(4) r(i)),
    wgeo as (select scene_id, max("row") + 1 nr from grid group by 1),
    wpoints as (select point_id, scene_id, ({ORIGIN_Y}::double - y) / {PIXEL}::double - 0.5::double fy, (x - {ORIGIN_X}::double - scene_id * {SCENE_STEP}::double) / {PIXEL}::double * 4 - 0.5::double fx from buffer_points),
    boxes as (select point_id, scene_id, greatest(0, ceil(fy - 100))::int r0, least(nr - 1, floor(fy + 100))::int r1,
      greatest(0, ceil(fx - 100))::int c0, least({4 * GRID_COLS - 1}, floor(fx + 100))::int c1 from wpoints join wgeo using (scene_id)),
    whole as (select * from boxes where r1 - r0 + 1 >= 200 and c1 - c0 + 1 >= 200)"""


@query("e7_half_100", f"""with {WIDE}, coded as (select scene_id, "row", col, trunc(v * 127 + 128)::int code from wide),
    pb as (select c.scene_id, "row", col, code, point_id from coded c join whole w on c.scene_id = w.scene_id and "row" between r0 and r1 and col between c0 and c1),
    phist as (select scene_id, point_id, code bin, count(*) n from pb group by all), potsu as ({otsu_sql("phist", "scene_id, point_id")}),
    {LABELS.removeprefix(VOTES).lstrip(", ")}
    select scene_id, "row", col, cover, label_any, label_majority, label_mean, case when cover > 0 then label_any else label_mean end label_final from lab""")
def _(t):
    sub = F.explode(F.sequence(F.lit(0), F.lit(3)))
    wide = t.grid().withColumn("i", sub).select("scene_id", "row", (F.col("col") * 4 + F.col("i")).alias("col"), (F.col("v") * (1 - F.col("i") / 10.0)).alias("v"))
    west = F.lit(ORIGIN_X) + F.col("scene_id") * SCENE_STEP
    points = t.buffer_points().withColumn("x", west + (F.col("x") - west) * 4)
    geo = georef(t, 4 * GRID_COLS)
    return pl.label_codes(wide.select("scene_id", "row", "col", sp.encode_trunc("v").alias("code")), points, geo, pl.HALF)


TILES = f"""tl as (select c.*, wy, wx, ((wx // 16) * ceil({SCENE_ROWS} / 16.0::double) + wy // 16 + 1)::int tile, (ceil({SCENE_ROWS} / 16.0::double) * ceil({{cols}} / 16.0::double))::int tiles
      from {{source}} c, (select (i * 16)::int wy from range({SCENE_ROWS}) r(i) where i * 16 < {SCENE_ROWS}) a,
      (select (i * 16)::int wx from range({{cols}}) r(i) where i * 16 < {{cols}}) b
      where "row" >= wy and "row" < wy + 32 and col >= wx and col < wx + 32)"""


@query("e2_half_overlap_tiles", f"""with {TILES.format(source="grid", cols=GRID_COLS)} select scene_id, tile, tiles, 'scene' || scene_id || '_' || lpad(tile::varchar, greatest(2, length(tile::varchar))::int, '0')
    || '-of-' || tiles || '.tif' as name, count(*) n, min("row") r0, max("row") r1, min(col) c0, max(col) c1, round(avg(v), 9) mean from tl group by 1, 2, 3""")
def _(t):
    tiles = ti.make_tiles(t.grid(), F.lit(SCENE_ROWS), F.lit(GRID_COLS), 32, 32)
    from strandline.functions.names import tile_name

    path = F.concat(F.lit("data/scene"), F.col("scene_id").cast("string"), F.lit(".tif"))
    return tiles.groupBy("scene_id", "tile", "tiles").agg(
        F.count("*").alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"),
        F.max("col").alias("c1"), F.round(F.avg("v"), 9).alias("mean"),
    ).withColumn("name", tile_name(path, F.col("tile"), F.col("tiles")))


VOID = """vb as (select scene_id, "row", col, case when b1 < 3200 then 0 else b1 end b1, b2 from bands4)"""


@query("b12_skip_void_tiles", f"""with {VOID}, {TILES.format(source="vb", cols=16)}, kept as (select scene_id, tile from tl group by 1, 2 having not bool_or(b1 = 0 or b2 = 0))
    select scene_id, tile, "row", col, b1, b2 from tl join kept using (scene_id, tile)""")
def _(t):
    px = t.bands4().select("scene_id", "row", "col", F.when(F.col("b1") < 3200, 0).otherwise(F.col("b1")).alias("b1"), "b2")
    tiles = ti.make_tiles(px, F.lit(SCENE_ROWS), F.lit(16), 32, 32, skip_void=["b1", "b2"])
    return tiles.select("scene_id", "tile", "row", "col", "b1", "b2")


@query("e3_augmented_tiles", """with f as (select *, flip, q, sfx, case when flip then 7 - "row" else "row" end r from chips,
      (values ('', false, 0), ('_rot90', false, 1), ('_rot180', false, 2), ('_rot270', false, 3), ('_flip', true, 0), ('_rot90_flip', true, 1),
       ('_rot180_flip', true, 2), ('_rot270_flip', true, 3)) k(sfx, flip, q))
    select scene_id, sfx copy, (case q when 0 then r when 1 then 7 - col when 2 then 7 - r else col end)::int "row",
      (case q when 0 then col when 1 then r when 2 then 7 - col else 7 - r end)::int col, v from f""")
def _(t):
    return ti.augment(t.chips(), 8, 8)
