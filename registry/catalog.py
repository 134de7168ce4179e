"""Scans, names, scene selection, mosaics, sources and sinks."""

from pyspark.sql import functions as F

from registry import query
from registry.tables import CLIMATE_SCALE  # noqa: F401
from strandline.functions import names as nm
from strandline.operators import scenes as sc
from strandline.session import new_folder
from strandline.sources import catalog as ca
from strandline.sources import metadata as md
from strandline.sources import tables as tb


@query("a1_imagery_scan", """select event_id, path from scenes where path not like 'data/output/%' and path like '%.tif'
    and path like '%\\_SR\\_%' escape '\\' and path not like '%8bit%'""")
def _(t):
    return ca.imagery(t.scenes()).select("event_id", "path")


@query("a1_listed_files", """select distinct n_name as name from nation where n_name like '%A%'""")
def _(t):
    # Files the query writes first, one folder for each nation, then lists.
    folder = new_folder(t.spark, "listing")
    t.raw("nation").select("n_name", "n_nationkey").write.partitionBy("n_name").parquet(folder)
    listed = ca.list_files(t.spark, folder, "*.parquet")
    found = listed.select(F.regexp_replace(F.regexp_extract("path", "n_name=([^/]+)", 1), "%20", " ").alias("name"))
    return found.where(F.col("name").contains("A")).distinct()


@query("a2_scan_with_exclusions", """select event_id, path from scenes where path like '%.tif' and path not like '%udm%' and path not like '%8bit%'""")
def _(t):
    return ca.with_exclusions(t.scenes(), ".tif", ["udm", "8bit"]).select("event_id", "path")


@query("a2_page_urls", """select url from pages where url like '%.html' and url not like '%blog%'""")
def _(t):
    pages = t.raw("pages").select(F.col("url").alias("path"), "url")
    return pages.where(F.col("url").endswith(".html") & ~F.col("url").contains("blog")).select("url")


@query("a15_unprocessed_scenes", """select event_id, scene_id from scenes where scene_id not in (select scene_id from scenes where event_type = 'view')""")
def _(t):
    done = t.scenes().where(F.col("event_type") == "view").select("scene_id")
    return ca.unprocessed(t.scenes(), done, "scene_id").select("event_id", "scene_id")


@query("a16_reviewed_scenes", """select event_id, scene_id from scenes where scene_id not in (select scene_id from scenes where event_type = 'error')""")
def _(t):
    review = t.scenes().select("scene_id", (F.col("event_type") != "error").alias("keep"))
    return ca.reviewed(t.scenes(), review).select("event_id", "scene_id")


@query("g2_file_set_difference", """select path from scenes where path like '%.tif' except all select path from scenes where path like '%8bit%'""")
def _(t):
    paths = t.scenes().select("path")
    return ca.minus(paths.where(F.col("path").endswith(".tif")), paths.where(F.col("path").contains("8bit")))


@query("b16_scene_search", """select event_id, scene_id from scenes where cloud_cover <= 0.1 and acquired > timestamp '2024-01-05 00:00:00'
    and acquired <= timestamp '2024-01-20 23:59:59'""")
def _(t):
    return sc.search(t.scenes(), "2024-01-05", "2024-01-20").select("event_id", "scene_id")


SEASON_SQL = "select o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || o_custkey scene_id, dayofyear(o_orderdate) doy from orders"


@query("b17_outside_winter", f"""select o_orderkey, scene_id from ({SEASON_SQL}) where doy > 136 and doy < 290""")
def _(t):
    ids = t.raw("orders").select(
        "o_orderkey", F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.col("o_custkey").cast("string")).alias("scene_id"))
    return sc.outside_winter(ids)


@query("b18_checked_requests", """select k, s start_text, e end_text, case when sd is not null and ed is not null then sd::varchar end as "start",
    case when sd is not null and ed is not null then ed::varchar end as "end",
    coalesce(year(sd) >= 2009 and year(ed) >= 2009 and sd < ed, false) as valid from
    (select *, try_strptime(s, '%Y-%m-%d')::date sd, try_strptime(e, '%Y-%m-%d')::date ed from
      (select o_orderkey k, case when o_orderpriority like '1%' then 'n/a' else strftime(o_orderdate + interval 10 year, '%Y-%m-%d') end s,
        strftime(o_orderdate + interval 10 year + (o_custkey % 9 - 3) * interval 1 day, '%Y-%m-%d') e from orders))""")
def _(t):
    later = F.add_months(F.col("o_orderdate").cast("date"), 120)
    requests = t.raw("orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderpriority").startswith("1"), "n/a").otherwise(F.date_format(later, "yyyy-MM-dd")).alias("start_text"),
        F.date_format(F.date_add(later, (F.col("o_custkey") % 9 - 3).cast("int")), "yyyy-MM-dd").alias("end_text"))
    return sc.checked_requests(requests).withColumn("start", F.col("start").cast("string")).withColumn("end", F.col("end").cast("string"))


@query("d4_scenes_by_day", """select year(acquired)::int "year", monthname(acquired) "month", day(acquired)::int "day", count(*) n, min(path) first_path from scenes group by 1, 2, 3""")
def _(t):
    return sc.by_day(t.scenes()).groupBy("year", "month", "day").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


MOSAIC_SQL = """img as (select scene_id, ("row" - scene_id * 0)::int wy, (col + (scene_id % 2) * 8)::int wx, 'scene_' || lpad(scene_id::varchar, 6, '0') path,
    case when b1 < 4500 then 0 else b1 end b1, case when b4 < 4500 then 0 else b4 end b4, (scene_id // 2)::int "day" from bands4)"""


def images(t):
    return t.bands4().select(
        F.col("row").alias("wy"), (F.col("col") + (F.col("scene_id") % 2) * 8).cast("int").alias("wx"),
        F.concat(F.lit("scene_"), F.lpad(F.col("scene_id").cast("string"), 6, "0")).alias("path"),
        F.when(F.col("b1") < 4500, 0).otherwise(F.col("b1")).alias("b1"), F.when(F.col("b4") < 4500, 0).otherwise(F.col("b4")).alias("b4"),
        F.expr("cast(scene_id div 2 as int)").alias("day"))


@query("d5_day_mosaic", f"""with {MOSAIC_SQL} select "day", wy, wx, coalesce(arg_min(b1, case when b1 <> 0 then path end), 0) b1,
    coalesce(arg_min(b4, case when b4 <> 0 then path end), 0) b4 from img group by 1, 2, 3""")
def _(t):
    return sc.mosaic(images(t), ["b1", "b4"], ["day"])


@query("i9_mosaic_extent", f"""with {MOSAIC_SQL} select "day", min(wx) x_min, max(wx) x_max, min(wy) y_min, max(wy) y_max, max(wx) - min(wx) + 1 width, max(wy) - min(wy) + 1 height from img group by 1""")
def _(t):
    return sc.extent(images(t), ["day"])


@query("h1_date_in_name", """select page_id, url, case when regexp_matches(n, '\\d{4}-\\d{2}-\\d{2}') then regexp_extract(n, '(\\d{4}-\\d{2}-\\d{2})', 1)
    when regexp_matches(n, '\\d{4}_\\d{2}') then regexp_extract(n, '(\\d{4}_\\d{2})', 1) end d from
    (select page_id, url, case when page_id % 3 = 0 then url || strftime(date '2015-01-01' + page_id::int, '%Y-%m-%d') when page_id % 3 = 1
      then url || strftime(date '2015-01-01' + page_id::int, '%Y_%m') else url end n from pages)""")
def _(t):
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.col("page_id").cast("int"))
    k = F.col("page_id") % 3
    name = F.when(k == 0, F.concat("url", F.date_format(day, "yyyy-MM-dd"))).when(k == 1, F.concat("url", F.date_format(day, "yyyy_MM"))).otherwise(F.col("url"))
    return t.raw("pages").select("page_id", "url", nm.date_in_name(name).alias("d"))


@query("h2_id_time", """select event_id, scene_id, strftime(date_trunc('second', acquired), '%Y-%m-%d %H:%M:%S') acquired from scenes""")
def _(t):
    return t.scenes().select("event_id", "scene_id", F.date_format(nm.id_time("scene_id"), "yyyy-MM-dd HH:mm:ss").alias("acquired"))


@query("h3_date_parts", """select event_id, year(ts)::int y, monthname(ts) m, day(ts)::int d, strftime(ts, '%m') mm, strftime(ts, '%d') dd, dayofyear(ts)::int doy from events""")
def _(t):
    ts = F.col("ts")
    return t.raw("events").select(
        "event_id", F.year(ts).alias("y"), F.date_format(ts, "MMMM").alias("m"), F.day(ts).alias("d"),
        F.lpad(F.month(ts).cast("string"), 2, "0").alias("mm"), F.lpad(F.day(ts).cast("string"), 2, "0").alias("dd"), F.dayofyear(ts).alias("doy"))


@query("h4_path_parts", """select event_id, split_part(path, '/', 3) as base, 'data/' || split_part(path, '/', 2) dir, regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') as stem,
    split_part(split_part(path, '/', 3), '.', 1) as head, '.' || split_part(split_part(path, '/', 3), '.', 2) as ext,
    'data/' || split_part(path, '/', 2) || '/' || split_part(split_part(path, '/', 3), '.', 1) || '_NDWI.tif' as staged from scenes""")
def _(t):
    return t.scenes().select(
        "event_id", nm.base_name("path").alias("base"), nm.dir_name("path").alias("dir"), nm.stem("path").alias("stem"),
        nm.first_part("path").alias("head"), nm.extension("path").alias("ext"), nm.staged("path", "NDWI").alias("staged"))


@query("h5_date_arithmetic", """select o_orderkey, (o_orderdate::date + 14)::varchar plus14, (make_date(year(o_orderdate), 1, 1) + (dayofyear(o_orderdate) - 1)::int)::varchar from_index from orders""")
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t.raw("orders").select(
        "o_orderkey", F.date_add(d, 14).cast("string").alias("plus14"),
        F.date_add(F.make_date(F.year(d), F.lit(1), F.lit(1)), F.dayofyear(d) - 1).cast("string").alias("from_index"))


@query("h6_tile_names", """select o_orderkey, 'scene_' || lpad(o_custkey::varchar, greatest(2, length(o_custkey::varchar))::int, '0') || '-of-' || o_orderkey || '.tif' as name from orders""")
def _(t):
    return t.raw("orders").select("o_orderkey", nm.tile_name(F.lit("data/scene.tif"), F.col("o_custkey"), F.col("o_orderkey")).alias("name"))


@query("h8_pretty_json")
def _(t):
    rings = t.ring().withColumn("ring", F.lit(0))
    return md.boundary_json(rings, "poly_id", pretty=True)


@query("a5_band_coefficients_xml", """select 'scene_' || scene_id as scene_id, band, round(coeff, 12) coeff from coeffs""")
def _(t):
    # One metadata file a scene, written as text and read back by the XML source.
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    band = tag(md.BAND_TAG, F.concat(tag("ps:bandNumber", F.col("band").cast("string")), tag("ps:reflectanceCoefficient", F.col("coeff").cast("string"))))
    blank = tag(md.BAND_TAG, F.concat(tag("ps:bandNumber", F.lit("5")), tag("ps:reflectanceCoefficient", F.lit("0.5"))))
    one = t.coeffs().groupBy("scene_id").agg(F.concat_ws("", F.collect_list(band)).alias("bands"))
    xml = tag(md.ROW_TAG, F.concat(
        tag("gml:metaDataProperty", tag("ps:EarthObservationMetaData", tag("eop:identifier", F.concat(F.lit("scene_"), F.col("scene_id").cast("string"))))),
        tag("gml:resultOf", tag("ps:EarthObservationResult", F.concat(F.col("bands"), blank)))))
    folder = new_folder(t.spark, "xml")
    one.select("scene_id", xml.alias("value")).write.partitionBy("scene_id").text(folder)
    return md.band_coefficients(t.spark, f"{folder}/scene_id=*").select("scene_id", "band", F.round("coeff", 12).alias("coeff"))


@query("a6_search_features_json", """select event_id::varchar scene_id, round(value / 1000, 6) cloud_cover from events""")
def _(t):
    feature = F.struct(F.struct(F.col("event_id").cast("string").alias("id"), F.struct(F.round(F.col("value") / 1000, 6).alias("cloud_cover")).alias("properties")).alias("f"))
    pages = t.raw("events").select(F.to_json(F.struct(F.array(feature["f"]).alias("features"))).alias("value"))
    folder = new_folder(t.spark, "search")
    pages.write.text(folder)
    found = t.spark.read.schema(md.SEARCH_SCHEMA).json(folder).select(F.inline("features"))
    return found.select(F.col("id").alias("scene_id"), F.col("properties.cloud_cover").alias("cloud_cover"))


@query("a7_boundary_json_roundtrip", """select poly_id, seq, round(x, 9) x, round(y, 9) y from ring""")
def _(t):
    folder = new_folder(t.spark, "boundary")
    md.write_boundaries(t.ring().withColumn("ring", F.lit(0)), folder)
    back = md.read_boundaries(t.spark, f"{folder}/poly_id=*")
    return back.select(F.regexp_extract("file", r"poly_id=(\d+)", 1).cast("int").alias("poly_id"), "seq", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("a8_vector_scan", """select transect_id, x0, y0, x1, y1 from transects where baseline_id = 7""")
def _(t):
    return t.transects().where(F.col("baseline_id") == 7).drop("baseline_id")


@query("a12_raster_roundtrip", """select scene_id, "row", col, v from grid where "row" >= 100 and "row" < 140 and col >= 10 and col < 50""")
def _(t):
    from strandline.operators.pixels import pixel_window

    folder = new_folder(t.spark, "raster")
    tb.write_pixels(t.grid(), folder)
    return pixel_window(tb.read_pixels(t.spark, folder), 100, 10, 40, 40).select("scene_id", "row", "col", "v")


@query("a13_date_partitions", """select event_id, year(acquired)::int "year", monthname(acquired) "month" from scenes""")
def _(t):
    folder = new_folder(t.spark, "dated")
    tb.write_by_date(t.scenes().select("event_id", "acquired"), folder, "acquired")
    return t.spark.read.parquet(folder).select("event_id", "year", "month")
