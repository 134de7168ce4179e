"""Label planes on a grid of their own, in degrees, brought to the grid and zone of the images."""

from pyspark.sql import functions as F

from registry import query
from strandline.functions import projection as pj
from strandline.operators import labels as lb

# Fixed values of the fixture: turned image grids of three sizes, and label pixels of about 48 x 30 m in degrees, shifted so that some places are outside.
TARGET = {"a": "3.0", "b": "0.15", "c": "600000.0 + 1000 * scene_id", "d": "0.1", "e": "-3.0", "f": "7330000.0"}
SOURCE = {"a": "0.00106", "b": "0.00002", "c": "-162.79 + 0.02208 * scene_id", "d": "0.00001", "e": "-0.000269", "f": "66.0746 - 0.00032 * scene_id"}
NROWS, NCOLS = "250 - 40 * (scene_id % 3)", "64 - 10 * (scene_id % 2)"
SOURCE_ROWS, SOURCE_COLS = 25, 4

_XI, _ETA = f"(y / {pj.UTM_K0 * pj.UTM_A!r}::double)", f"((x - {pj.UTM_E0}) / {pj.UTM_K0 * pj.UTM_A!r}::double)"
_NORTH = " ".join([_XI, *[f"- {b!r}::double * sin({2 * j} * {_XI}) * cosh({2 * j} * {_ETA})" for j, b in enumerate(pj.UTM_BETA, 1)]])
_EAST = " ".join([_ETA, *[f"- {b!r}::double * cos({2 * j} * {_XI}) * sinh({2 * j} * {_ETA})" for j, b in enumerate(pj.UTM_BETA, 1)]])
_PHI = " ".join(["chi", *[f"+ {d!r}::double * sin({2 * j} * chi)" for j, d in enumerate(pj.UTM_DELTA, 1)]])
_W = """case when abs({0}) < 1 then (4 - 6 * {0} * {0} + 3 * abs({0}) * {0} * {0}) / 6 when abs({0}) < 2 then power(2 - abs({0}), 3) / 6 else 0 end"""
T, S = ({k: f"({v})::double" for k, v in affine.items()} for affine in (TARGET, SOURCE))

WARP_SQL = f"""source as (select scene_id, "row" // 10 as "row", col // 4 as col, max(b1 % 3) as label from bands4 group by 1, 2, 3),
    target as (select scene_id, r::int as "row", c::int as col, {T["a"]} * (c + 0.5) + {T["b"]} * (r + 0.5) + {T["c"]} as x, {T["d"]} * (c + 0.5) + {T["e"]} * (r + 0.5) + {T["f"]} as y
      from (select distinct scene_id from bands4), range(250) a(r), range(64) b(c) where r < {NROWS} and c < {NCOLS}),
    sphere as (select *, {_NORTH} as north, {_EAST} as east from target),
    geo as (select *, asin(sin(north) / cosh(east)) as chi, {pj.UTM_LON0} + degrees(atan2(sinh(east), cos(north))) as lon from sphere),
    away as (select scene_id, "row", col, lon - {S["c"]} as dx, degrees({_PHI}) - {S["f"]} as dy from geo),
    placed as (select scene_id, "row", col, ({S["a"]} * dy - {S["d"]} * dx) / ({S["a"]} * {S["e"]} - {S["b"]} * {S["d"]}) - 0.5 as v,
      ({S["e"]} * dx - {S["b"]} * dy) / ({S["a"]} * {S["e"]} - {S["b"]} * {S["d"]}) - 0.5 as u from away),
    covered as (select * from placed where floor(v + 0.5) between 0 and {SOURCE_ROWS - 1} and floor(u + 0.5) between 0 and {SOURCE_COLS - 1}),
    smooth as (select c.scene_id, c."row", c.col, sum({_W.format('(v - s."row")')} * {_W.format("(u - s.col)")} * s.label) / sum({_W.format('(v - s."row")')} * {_W.format("(u - s.col)")}) as label
      from covered c join source s on s.scene_id = c.scene_id and s."row" between floor(v) - 1 and floor(v) + 2 and s.col between floor(u) - 1 and floor(u) + 2 group by 1, 2, 3),
    nearest as (select c.scene_id, c."row", c.col, s.label from covered c join source s on s.scene_id = c.scene_id and s."row" = floor(v + 0.5) and s.col = floor(u + 0.5))"""


def source(t):
    return t.bands4().groupBy("scene_id", F.expr("cast(row div 10 as int)").alias("row"), F.expr("cast(col div 4 as int)").alias("col")).agg(F.max(F.col("b1") % 3).alias("label"))


def frames(t):
    affine = lambda values: F.struct(*[F.expr(f"cast({v} as double)").alias(k) for k, v in values.items()])
    scenes = t.raw("embeddings").select(F.expr("cast(vec_id div 250 as int)").alias("scene_id")).distinct()
    return scenes.select(
        "scene_id", affine(TARGET).alias("target"), affine(SOURCE).alias("source"), F.expr(NROWS).cast("int").alias("nrows"), F.expr(NCOLS).cast("int").alias("ncols"),
        F.lit(SOURCE_ROWS).alias("source_rows"), F.lit(SOURCE_COLS).alias("source_cols"), F.lit(pj.UTM_LON0).alias("lon0"), F.lit(True).alias("geographic"),
    )


@query("i6_reproject_spline", f"""with {WARP_SQL} select p.scene_id, p."row", p.col, round(s.label, 6) as label from placed p left join smooth s using (scene_id, "row", col)""")
def _(t):
    return lb.reproject(source(t), "label", frames(t)).withColumn("label", F.round("label", 6))


@query("i6_reproject_nearest", f"""with {WARP_SQL} select p.scene_id, p."row", p.col, n.label::double as label from placed p left join nearest n using (scene_id, "row", col)""")
def _(t):
    return lb.reproject(source(t), "label", frames(t), smooth=False)


@query("label_reprojection_flow", f"""with {WARP_SQL},
    img as (select b.scene_id, b."row", b.col, b1, b2, b3, b4, case when b1 < 3200 then 0 else coalesce(n.label, 0) end as b5
      from (select scene_id, "row", col, case when b1 < 3200 then 0 else b1 end b1, b2, b3, b4 from bands4) b left join nearest n using (scene_id, "row", col)),
    tl as (select i.*, wy, wx, ((wx // 8) * 32 + wy // 8 + 1)::int tile from img i, (select w * 8 wy from range(32) r(w)) a, (select w * 8 wx from range(2) r(w)) b
      where "row" between wy and wy + 15 and col between wx and wx + 15),
    kept as (select scene_id, tile from tl group by 1, 2 having not bool_or(b1 = 0 or b2 = 0 or b3 = 0 or b4 = 0))
    select scene_id, tile, 8 * count(*) as n, sum(8 * b5)::bigint as label_sum, sum(8 * b5 * b4)::bigint as weighted from tl join kept using (scene_id, tile) group by 1, 2""")
def _(t):
    """Coarse labels in degrees to labelled, tiled and turned training pixels of the images."""
    from registry.tables import SCENE_ROWS
    from strandline.plans import training as tr

    bands = t.bands4().withColumn("b1", F.when(F.col("b1") < 3200, 0).otherwise(F.col("b1")))
    images = tr.reprojected_images(bands, source(t), frames(t), ["b1", "b2", "b3"], "b4", smooth=False)
    out = tr.labelled_tiles(images, F.lit(SCENE_ROWS), F.lit(16), side=16)
    return out.groupBy("scene_id", "tile").agg(F.count("*").alias("n"), F.sum("b5").alias("label_sum"), F.sum(F.col("b5") * F.col("b4")).cast("bigint").alias("weighted"))
