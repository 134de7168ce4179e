"""Label images: selection, matching, overlay, resampling."""

from pyspark.sql import functions as F

from registry import query
from registry.geometry import PIP_SQL
from registry.tables import GRID_COLS, SCENE_ROWS  # noqa: F401
from strandline.functions import names as nm
from strandline.operators import labels as lb

VALID = f"""{PIP_SQL}, inside as (select poly_id, image_id, time_start, pixel_id, any_value("value") "value" from label_pixels, edges
      where time_start >= date '1996-01-01' and time_start < date '2001-01-01' and (y0 > lat) <> (y1 > lat) and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0)
      group by 1, 2, 3, 4 having count(*) % 2 = 1),
    valid as (select poly_id, image_id, time_start, count(*) pixels, sum(("value" < 1)::int)::bigint nodata_count from inside i group by 1, 2, 3
      having sum(("value" < 1)::int) < (select avg(c) from (select count(*) / 3.0::double c from inside m where m.poly_id = i.poly_id group by image_id)))"""


def valid(t):
    """Images with fewer void pixels in a region than a third of its pixels in an average image."""
    every = lb.valid_images(t.label_pixels(), "1996-01-01", "2001-01-01", t.ring(), 1 << 60)
    mean = every.groupBy("poly_id").agg(F.avg(F.col("pixels") / 3.0).alias("m"))
    return every.join(mean, "poly_id").where(F.col("nodata_count") < F.col("m")).drop("m")


@query("d8_valid_label_images", f"with {VALID} select poly_id, image_id, pixels, nodata_count from valid")
def _(t):
    return valid(t).select("poly_id", "image_id", "pixels", "nodata_count")


@query("d8_nodata_limit", f"""with {PIP_SQL}, inside as (select poly_id, image_id, pixel_id, any_value("value") "value" from label_pixels, edges
      where time_start >= date '1995-06-01' and time_start < date '2000-06-01' and (y0 > lat) <> (y1 > lat) and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0)
      group by 1, 2, 3 having count(*) % 2 = 1)
    select poly_id, image_id, count(*) pixels, sum(("value" < 1)::int)::bigint nodata_count from inside group by 1, 2 having sum(("value" < 1)::int) < 12""")
def _(t):
    return lb.valid_images(t.label_pixels(), "1995-06-01", "2000-06-01", t.ring(), 12).select("poly_id", "image_id", "pixels", "nodata_count")


@query("d9_image_months", f"""with {VALID} select distinct image_id, strftime(time_start, '%Y-%m') as "month", strftime(time_start, '%Y-%m-%d') as "day", (select count(distinct image_id) from valid) images from valid""")
def _(t):
    v = valid(t).select("image_id", "time_start").distinct()
    return lb.image_months(v).withColumn("images", v.agg(F.count("*").alias("n")).scalar())


LABEL_LIST = f"""{VALID}, lab as (select 'data/labels/gsw_' || image_id || '.tif' label_path, (strptime(image_id || '_01', '%Y_%m_%d')::date + 14) label_date from (select distinct image_id from valid))"""


def label_list(t):
    path = F.concat(F.lit("data/labels/gsw_"), F.col("image_id"), F.lit(".tif"))
    return valid(t).select("image_id").distinct().select(path.alias("label")).withColumn("label_date", lb.label_date(nm.date_in_name("label")))


@query("c5_nearest_label", f"""with {LABEL_LIST}, days as (select distinct l_shipdate::date d from lineitem),
    near as (select d, label_path, label_date, row_number() over (partition by d order by abs(label_date - d), label_date) k from days, lab)
    select l_orderkey, l_linenumber, l_partkey, d::varchar input_date, label_path as label, label_date::varchar label_date
    from lineitem join near on l_shipdate::date = d where k = 1""")
def _(t):
    inputs = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("input_date"))
    m = lb.nearest_label(inputs, label_list(t))
    return m.withColumn("input_date", F.col("input_date").cast("string")).withColumn("label_date", F.col("label_date").cast("string"))


@query("c5_first_input_of_day", f"""with {LABEL_LIST}, i as (select acquired::date - 8400 d, path from scenes),
    near as (select d, label_path, row_number() over (partition by d order by abs(label_date - d), label_date) k from (select distinct d from i), lab)
    select d::varchar input_date, min(path) path, any_value(label_path) as label, strftime(d, '%Y-%m-%d') || '_labeled.tif' as output from i join near using (d) where k = 1 group by d""")
def _(t):
    inputs = t.scenes().select("path", F.date_sub(F.col("acquired").cast("date"), 8400).alias("input_date"))
    m = lb.first_input_of_day(lb.nearest_label(inputs, label_list(t)))
    return m.select(F.col("input_date").cast("string").alias("input_date"), "path", "label", "output")


@query("c6_label_overlay", """select b.scene_id, b."row", b.col, b1, b4, case when b1 < 3500 then 0 else g.label end::int label from bands4 b
    join (select scene_id, "row", col, (v > 0)::int + (v > 0.1::double)::int label from grid) g using (scene_id, "row", col)""")
def _(t):
    label = t.grid().select("scene_id", "row", "col", ((F.col("v") > 0).cast("int") + (F.col("v") > 0.1).cast("int")).alias("label"))
    px = t.bands4().select("scene_id", "row", "col", F.when(F.col("b1") < 3500, 0).otherwise(F.col("b1")).alias("m"), "b1", "b4")
    return lb.overlay(px, label, "m").drop("m")


_W = """case when abs(d) < 1 then (4 - 6 * d * d + 3 * abs(d) * d * d) / 6 when abs(d) < 2 then power(2 - abs(d), 3) / 6 else 0 end"""


@query("i6_upsample_spline", f"""with rw as (select t::int "t", p::int p, {_W} w from (select t, p, (t + 0.5::double) / 3 - 0.5::double - p d from range({SCENE_ROWS * 3}) a(t), range({SCENE_ROWS}) b(p)
      where p between t // 3 - 3 and t // 3 + 3) where {_W} > 0),
    cw as (select t::int "t", p::int p, {_W} w from (select t, p, (t + 0.5::double) / 3 - 0.5::double - p d from range(48) a(t), range(16) b(p)) where {_W} > 0),
    lab as (select scene_id, "row", col, b1 % 3 label from bands4),
    s1 as (select scene_id, "row", cw.t col, sum(cw.w * label) sv, sum(cw.w) sw from lab join cw on lab.col = cw.p group by 1, 2, 3)
    select scene_id, rw.t "row", s1.col col, round(sum(rw.w * sv) / sum(rw.w * sw), 7) label from s1 join rw on s1."row" = rw.p group by 1, 2, 3""")
def _(t):
    label = t.bands4().select("scene_id", "row", "col", (F.col("b1") % 3).alias("label"))
    return lb.upsample(label, "label", 3, block=64).select("scene_id", "row", "col", F.round("label", 7).alias("label"))


@query("i6_upsample_nearest", """select scene_id, ("row" * 2 + i)::int "row", (col * 2 + j)::int col, b1 % 3 label from bands4, range(2) a(i), range(2) b(j)""")
def _(t):
    label = t.bands4().select("scene_id", "row", "col", (F.col("b1") % 3).alias("label"))
    return lb.upsample_nearest(label, "label", 2)


@query("i7_crop_to_image", """with img as (select scene_id, min("row") r0, max("row") r1, min(col) c0, max(col) c1 from bands4 where b1 > 6000 group by 1)
    select scene_id, "row", col, v from grid join img using (scene_id) where "row" between r0 and r1 and col between c0 and c1""")
def _(t):
    return lb.crop_to(t.grid(), t.bands4().where("b1 > 6000"))


@query("label_production_flow", """with coarse as (select scene_id, "row" // 2 r2, col // 2 c2, max(b1 % 3) label from bands4 group by 1, 2, 3),
    img as (select b.scene_id, b."row", b.col, case when b1 < 3200 then 0 else b1 end b1, b2, b3, b4,
      case when b1 < 3200 then 0 else label end b5 from bands4 b join coarse c on c.scene_id = b.scene_id and r2 = "row" // 2 and c2 = col // 2),
    tl as (select i.*, wy, wx, ((wx // 8) * 32 + wy // 8 + 1)::int tile from img i, (select w * 8 wy from range(32) r(w)) a, (select w * 8 wx from range(2) r(w)) b
      where "row" between wy and wy + 15 and col between wx and wx + 15),
    kept as (select scene_id, tile from tl group by 1, 2 having not bool_or(b1 = 0 or b2 = 0 or b3 = 0 or b4 = 0)),
    f as (select *, "row" - wy tr, col - wx tc, least(16, 250 - wy) h, least(16, 16 - wx) w from tl join kept using (scene_id, tile)),
    g as (select *, case when flip then h - 1 - tr else tr end r from f, (values ('', false, 0), ('_rot90', false, 1), ('_rot180', false, 2), ('_rot270', false, 3), ('_flip', true, 0), ('_rot90_flip', true, 1),
       ('_rot180_flip', true, 2), ('_rot270_flip', true, 3)) k(sfx, flip, q))
    select scene_id, tile, sfx copy, count(*) n, sum(b5)::bigint label_sum, sum(b5 * (case q when 0 then r when 1 then w - 1 - tc when 2 then h - 1 - r else tc end)
      + b4 * (case q when 0 then tc when 1 then r when 2 then w - 1 - tc else h - 1 - r end))::bigint moment from g group by 1, 2, 3""")
def _(t):
    from strandline.plans import training as tr

    bands = t.bands4().withColumn("b1", F.when(F.col("b1") < 3200, 0).otherwise(F.col("b1")))
    coarse = t.bands4().groupBy("scene_id", F.expr("cast(row div 2 as int)").alias("row"), F.expr("cast(col div 2 as int)").alias("col")).agg(
        F.max(F.col("b1") % 3).alias("label"))
    images = tr.labelled_images(bands, coarse, 2, ["b1", "b2", "b3"], "b4", smooth=False)
    out = tr.labelled_tiles(images, F.lit(SCENE_ROWS), F.lit(16), side=16)
    return out.groupBy("scene_id", "tile", "copy").agg(
        F.count("*").alias("n"), F.sum("b5").alias("label_sum"), F.sum(F.col("b5") * F.col("tile_row") + F.col("b4") * F.col("tile_col")).cast("bigint").alias("moment"))
