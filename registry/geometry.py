"""Coastline and transect geometry, projections, point in polygon."""

from pyspark.sql import functions as F

from registry import query
from registry.tables import GRID_COLS, ORIGIN_X, ORIGIN_Y, PIXEL, SCENE_ROWS, SCENE_STEP  # noqa: F401
from strandline.functions import projection as pr
from strandline.operators import spatial as sl
from strandline.plans import shoreline as sh

CELL = 50.0

SEGS = """ts as (select seq, x x0, y y0, lead(x) over (order by seq) x1, lead(y) over (order by seq) y1 from coast_true qualify x1 is not null),
    ps as (select seq, x x0, y y0, lead(x) over (order by seq) x1, lead(y) over (order by seq) y1 from coast_pred qualify x1 is not null)"""


def hits_sql(name: str, lines: str, transects: str = "transects") -> str:
    """Every transect against every segment."""
    return f"""{name} as (select distinct transect_id, round(x0 + tt * (x1 - x0), 9) + 0.0::double x, round(y0 + tt * (y1 - y0), 9) + 0.0::double y from
      (select t.transect_id, t.x0, t.y0, t.x1, t.y1,
        ((s.x0 - t.x0) * (s.y1 - s.y0) - (s.y0 - t.y0) * (s.x1 - s.x0)) / nullif((t.x1 - t.x0) * (s.y1 - s.y0) - (t.y1 - t.y0) * (s.x1 - s.x0), 0) tt,
        ((s.x0 - t.x0) * (t.y1 - t.y0) - (s.y0 - t.y0) * (t.x1 - t.x0)) / nullif((t.x1 - t.x0) * (s.y1 - s.y0) - (t.y1 - t.y0) * (s.x1 - s.x0), 0) uu
       from {transects} t, {lines} s) where tt between 0 and 1 and uu between 0 and 1)"""


def coast(t, predicted):
    return sl.segments(t.coast_vertices(predicted), ["feature_id"])


@query("a8_line_segments", f"""with {SEGS} select seq seg, round(x0, 6) x0, round(y0, 6) y0, round(x1, 6) x1, round(y1, 6) y1 from ts""")
def _(t):
    return coast(t, False).select("seg", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("c7_line_crossings", f"""with {SEGS}, {hits_sql("h", "ts")} select transect_id, x, y from h""")
def _(t):
    hits = sl.segment_crossings(t.transects(), coast(t, False), CELL)
    return hits.select(F.col("l_transect_id").alias("transect_id"), F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).distinct()


# Upright segments along the same lines: one a supplier, and pieces that reach into or beyond them.
UPRIGHT = """lhs as (select s_suppkey id, s_suppkey % 50 * 10.0::double x0, 0.0::double y0, s_suppkey % 50 * 10.0::double x1, 100.0::double y1 from supplier),
    rhs as (select p_partkey id, p_partkey % 60 * 10.0::double x0, p_partkey % 13 * 10.0::double y0, p_partkey % 60 * 10.0::double x1, p_partkey % 13 * 10.0::double - 45 + p_partkey % 7 * 20 y1 from part)"""


@query("c7_shared_pieces", f"""with {UPRIGHT} select l.id transect_id, r.id line_id, round(greatest(least(r.y0, r.y1), 0), 6) y0, round(least(greatest(r.y0, r.y1), 100), 6) y1
    from lhs l join rhs r on l.x0 = r.x0 where greatest(least(r.y0, r.y1), 0) < least(greatest(r.y0, r.y1), 100)""")
def _(t):
    """Pieces that transects and lines share; a piece is given upwards."""
    at = lambda c, n: (F.col(c) % n * 10.0).cast("double")
    left = t.raw("supplier").select(F.col("s_suppkey").alias("id"), at("s_suppkey", 50).alias("x0"), F.lit(0.0).alias("y0"), at("s_suppkey", 50).alias("x1"), F.lit(100.0).alias("y1"))
    low = at("p_partkey", 13)
    right = t.raw("part").select(F.col("p_partkey").alias("id"), at("p_partkey", 60).alias("x0"), low.alias("y0"), at("p_partkey", 60).alias("x1"), (low - 45 + F.col("p_partkey") % 7 * 20).alias("y1"))
    pieces = sl.segment_overlaps(left, right, CELL)
    return pieces.select(F.col("l_id").alias("transect_id"), F.col("r_id").alias("line_id"), F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query("g3_distinct_crossing_points", f"""with {SEGS}, {hits_sql("h", "ts")} select distinct x, y from h""")
def _(t):
    return sl.crossing_points(coast(t, False), t.transects(), CELL)


@query("c8_points_near_transects", """with d as (select transect_id, seq, x, y, least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 0), 1) k, x0, y0, x1, y1
      from coast_true, transects) select transect_id, seq, round(sqrt(power(x - (x0 + k * (x1 - x0)), 2) + power(y - (y0 + k * (y1 - y0)), 2)), 6) distance
      from d where sqrt(power(x - (x0 + k * (x1 - x0)), 2) + power(y - (y0 + k * (y1 - y0)), 2)) < 1.5::double""")
def _(t):
    near = sl.points_near(t.coast_vertices(False), t.transects(), CELL, within=1.5)
    return near.select("transect_id", "seq", F.round("distance", 6).alias("distance"))


PAIRS = f"""{SEGS}, {hits_sql("h1", "ts")}, {hits_sql("h2", "ps")},
    pairs as (select transect_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) distance from
      (select transect_id, min(x) x, min(y) y from h1 group by 1 having count(*) = 1) a join
      (select transect_id, min(x) x, min(y) y from h2 group by 1 having count(*) = 1) b using (transect_id))"""


@query("c14_paired_distances", f"""with {PAIRS} select transect_id, round(distance, 6) distance from pairs""")
def _(t):
    d = sl.paired_distances(t.transects(), coast(t, False), coast(t, True), CELL)
    return d.select("transect_id", F.round("distance", 6).alias("distance"))


@query("d22_coastline_rmse", f"""with {PAIRS} select round(sqrt(avg(distance * distance)), 6) rmse, count(*) pairs from pairs""")
def _(t):
    d = sl.paired_distances(t.transects(), coast(t, False), coast(t, True), CELL)
    return sl.rmse(d).select(F.round("rmse", 6).alias("rmse"), "pairs")


REGIONS = ((70, "west"), (45, "north"), (30, "central"), (12, "town"), (None, "east"))
REGION_SQL = "case when transect_id >= 70 then 'west' when transect_id >= 45 then 'north' when transect_id >= 30 then 'central' when transect_id >= 12 then 'town' else 'east' end"


@query("d22_rmse_by_region", f"""with {PAIRS}, r as (select {REGION_SQL} region, distance from pairs where transect_id not in (5, 6, 7))
    select region, round(sqrt(avg(distance * distance)), 6) rmse, count(*) pairs from r group by rollup (region)""")
def _(t):
    e = sh.coastline_error(t.transects(), coast(t, False), coast(t, True), CELL, REGIONS, river=[5, 6, 7])
    return e.select("region", F.round("rmse", 6).alias("rmse"), "pairs")


@query("b13_baseline_transects", "select transect_id, x0, y0, x1, y1 from transects where baseline_id = 17")
def _(t):
    return t.transects().where(F.col("baseline_id") == 17).drop("baseline_id")


@query("b14_without_river", "select transect_id, baseline_id from transects where transect_id not in (3, 4, 5, 6, 7)")
def _(t):
    return sh.without_river(t.transects(), river=[3, 4, 5, 6, 7]).select("transect_id", "baseline_id")


@query("b15_regions", f"select transect_id, {REGION_SQL} region from transects")
def _(t):
    return t.transects().select("transect_id", sh.region_of("transect_id", REGIONS).alias("region"))


@query("b15_regions_default", """select l_orderkey k, l_linenumber n, case when l_partkey * 10 >= 17443 then 'western coastline' when l_partkey * 10 >= 17394 then 'northern cliff'
    when l_partkey * 10 >= 17370 then 'central shoreline' when l_partkey * 10 >= 17337 then 'town shoreline' else 'east shoreline and cliff' end region from lineitem""")
def _(t):
    return t.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), sh.region_of(F.col("l_partkey") * 10).alias("region"))


PIP_SQL = """edges as (select poly_id, x x0, y y0, lead(x) over w x1, lead(y) over w y1 from ring window w as (partition by poly_id order by seq) qualify x1 is not null)"""


@query("c9_scenes_in_polygons", f"""with {PIP_SQL} select event_id, poly_id from scenes, edges where (y0 > lat) <> (y1 > lat)
    and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0) group by 1, 2 having count(*) % 2 = 1""")
def _(t):
    points = t.scenes().select("event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return sl.in_polygons(points, "event_id", t.ring())


@query("b16_search_with_geometry", f"""with {PIP_SQL}, inside as (select event_id from scenes, (select * from edges where poly_id = 0) where (y0 > lat) <> (y1 > lat)
    and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0) group by 1 having count(*) % 2 = 1)
    select event_id, scene_id from scenes where event_id in (select event_id from inside) and cloud_cover <= 0.1
    and acquired > timestamp '2024-01-05 00:00:00' and acquired <= timestamp '2024-01-20 23:59:59'""")
def _(t):
    from strandline.operators.scenes import search

    found = search(t.scenes(), "2024-01-05", "2024-01-20")
    points = found.select("event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    inside = sl.in_polygons(points, "event_id", t.ring().where("poly_id = 0"))
    return found.join(inside, "event_id", "left_semi").select("event_id", "scene_id")


@query("i8_clip_raster", f"""with rg as (select poly_id, seq, {ORIGIN_X}::double + (x + 162.75::double) * 2000 + 100 x, {ORIGIN_Y}::double + (y - 66.08::double) * 20000 - 400 y from ring),
    edges as (select poly_id, x x0, y y0, lead(x) over w x1, lead(y) over w y1 from rg window w as (partition by poly_id order by seq) qualify x1 is not null),
    px as (select scene_id, "row", col, v, {ORIGIN_X}::double + (col + 0.5::double) * {PIXEL}::double x, {ORIGIN_Y}::double - ("row" + 0.5::double) * {PIXEL}::double y from grid)
    select distinct scene_id, "row", col, v from (select scene_id, "row", col, poly_id, any_value(v) v from px, edges where (y0 > y) <> (y1 > y)
      and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) group by 1, 2, 3, 4 having count(*) % 2 = 1)""")
def _(t):
    from strandline.operators.labels import clip_pixels

    ring = t.ring().select(
        "poly_id", "seq", (F.lit(ORIGIN_X) + (F.col("x") + 162.75) * 2000 + 100).alias("x"), (F.lit(ORIGIN_Y) + (F.col("y") - 66.08) * 20000 - 400).alias("y"))
    x, y = pr.pixel_xy("row", "col", ORIGIN_X, ORIGIN_Y, PIXEL)
    return clip_pixels(t.grid().withColumn("x", x).withColumn("y", y), ring, strip=20.0).select("scene_id", "row", "col", "v")


@query("c10_clip_lines", f"""with {SEGS}, rg as (select poly_id, seq, (x + 162.75::double) * 3000 + 200 x, (y - 66.08::double) * 1500 + 60 y from ring),
    ed as (select poly_id, seq, x x0, y y0, lead(x) over w x1, lead(y) over w y1 from rg window w as (partition by poly_id order by seq) qualify x1 is not null),
    c as (select s.seq seg, poly_id, s.x0, s.y0, s.x1, s.y1, ((e.x0 - s.x0) * (e.y1 - e.y0) - (e.y0 - s.y0) * (e.x1 - e.x0)) / nullif((s.x1 - s.x0) * (e.y1 - e.y0) - (s.y1 - s.y0) * (e.x1 - e.x0), 0) t,
      ((e.x0 - s.x0) * (s.y1 - s.y0) - (e.y0 - s.y0) * (s.x1 - s.x0)) / nullif((s.x1 - s.x0) * (e.y1 - e.y0) - (s.y1 - s.y0) * (e.x1 - e.x0), 0) u from ts s, ed e),
    k as (select seg, poly_id, x0, y0, x1, y1, t from c where t between 0 and 1 and u between 0 and 1 union
      select ts.seq, poly_id, x0, y0, x1, y1, t from ts, (select distinct poly_id from rg), (values (0.0::double), (1.0::double)) v(t)),
    p as (select *, lead(t) over (partition by seg, poly_id order by t) t1 from k qualify t1 > t),
    m as (select *, x0 + (t + t1) / 2 * (x1 - x0) mx, y0 + (t + t1) / 2 * (y1 - y0) my from p)
    select m.seg, m.poly_id, round(t, 6) + 0.0::double t0, round(t1, 6) t1, round(any_value(m.x0 + t * (m.x1 - m.x0)), 5) x0, round(any_value(m.y0 + t * (m.y1 - m.y0)), 5) y0
    from m join ed e on e.poly_id = m.poly_id where (e.y0 > my) <> (e.y1 > my) and mx < e.x0 + (my - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) group by 1, 2, 3, 4 having count(*) % 2 = 1""")
def _(t):
    ring = t.ring().select("poly_id", "seq", ((F.col("x") + 162.75) * 3000 + 200).alias("x"), ((F.col("y") - 66.08) * 1500 + 60).alias("y"))
    pieces = sl.clip_segments(coast(t, False), "seg", ring, cell=CELL, strip=5.0)
    return pieces.select("seg", "poly_id", (F.round("t0", 6) + 0.0).alias("t0"), F.round("t1", 6).alias("t1"), F.round("x0", 5).alias("x0"), F.round("y0", 5).alias("y0"))


_AL = "".join(f" + {a!r}::double * cos({2 * j}.0::double * xi) * sinh({2 * j}.0::double * eta)" for j, a in enumerate(pr.UTM_ALPHA, 1))
_AN = "".join(f" + {a!r}::double * sin({2 * j}.0::double * xi) * cosh({2 * j}.0::double * eta)" for j, a in enumerate(pr.UTM_ALPHA, 1))


@query("i1_utm_zone_3", f"""with r as (select event_id, radians(lat) phi, radians(lon + 165) lam from scenes),
    t as (select *, sinh(atanh(sin(phi)) - {pr.UTM_ECC!r}::double * atanh({pr.UTM_ECC!r}::double * sin(phi))) tt from r),
    k as (select event_id, atan2(tt, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + tt * tt)) eta from t)
    select event_id, round(500000 + {pr.UTM_K0 * pr.UTM_A!r}::double * (eta{_AL}), 4) easting, round({pr.UTM_K0 * pr.UTM_A!r}::double * (xi{_AN}), 4) northing from k""")
def _(t):
    e, n = pr.utm_xy("lon", "lat")
    return t.scenes().select("event_id", F.round(e, 4).alias("easting"), F.round(n, 4).alias("northing"))


@query("i2_polar_stereographic", f"""with f as (select event_id, lon, lat, {pr.STEREO_SCALE!r}::double * tan(pi() / 4 - radians(lat) / 2) rho, radians(lon + 152) lam from scenes),
    p as (select event_id, rho * sin(lam) x, -rho * cos(lam) y, lon, lat from f)
    select event_id, round(x, 4) x, round(y, 4) y, round(lon, 8) lon, round(lat, 8) lat from p""")
def _(t):
    x, y = pr.stereo_xy("lon", "lat")
    p = t.scenes().select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = pr.stereo_lonlat("x", "y")
    return p.select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("i3_pixel_to_world", f"""select scene_id, "row", col, {ORIGIN_X}::double + scene_id * {SCENE_STEP}::double + (col + 0.5::double) * {PIXEL}::double x,
    {ORIGIN_Y}::double - ("row" + 0.5::double) * {PIXEL}::double y from grid""")
def _(t):
    x, y = pr.pixel_xy("row", "col", F.lit(ORIGIN_X) + F.col("scene_id") * SCENE_STEP, F.lit(ORIGIN_Y), PIXEL)
    return t.grid().select("scene_id", "row", "col", x.alias("x"), y.alias("y"))


@query("i5_representative_points", """select transect_id, round((x0 + x1) / 2, 9) x, round((y0 + y1) / 2, 9) y from transects""")
def _(t):
    m = sl.midpoints(t.transects().withColumn("seg", F.lit(0)), ["transect_id"])
    return m.select("transect_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
