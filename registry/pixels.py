"""Band scans, projections and filters over pixel rows."""

from pyspark.sql import functions as F

from registry import query
from strandline.functions import spectral as sp
from strandline.functions import weather as we
from strandline.operators import pixels as px


@query("a3_band_scan", """select scene_id, "row", col, b2 green, b4 nir from bands4""")
def _(t):
    return px.named_bands(t.bands4(), {"green": "b2", "nir": "b4"})


@query("a3_last_band", """select scene_id, "row", col, b4 nir from bands4""")
def _(t):
    stack = t.bands4().select("scene_id", "row", "col", F.array("b1", "b2", "b3", "b4").alias("bands"))
    return stack.select("scene_id", "row", "col", px.last_band("bands").alias("nir"))


@query("c1_coefficient_lookup", """select scene_id, "row", col, band, b b_value, coeff from (
    select scene_id, "row", col, 1 band, b1 b from bands4 union all select scene_id, "row", col, 2, b2 from bands4 union all
    select scene_id, "row", col, 3, b3 from bands4 union all select scene_id, "row", col, 4, b4 from bands4) join coeffs using (scene_id, band)""")
def _(t):
    long = t.bands4().select("scene_id", "row", "col", F.posexplode(F.array("b1", "b2", "b3", "b4")).alias("i", "b_value"))
    return px.coefficient_lookup(long.withColumn("band", F.col("i") + 1).drop("i"), t.coeffs()).select("scene_id", "row", "col", "band", "b_value", "coeff")


@query("a4_window_scan", """select scene_id, "row", col, v from grid
    where "row" >= 100 and "row" < 150 and col >= 16 and col < 48""")
def _(t):
    return px.pixel_window(t.grid(), 100, 16, 50, 32)


@query("b1_toa_reflectance", """select p.scene_id, p."row", p.col, round(b1 * c1, 9) r1, round(b2 * c2, 9) r2,
    round(b3 * c3, 9) r3, round(b4 * c4, 9) r4 from bands4 p join
    (select scene_id, max(case when band = 1 then coeff end) c1, max(case when band = 2 then coeff end) c2,
     max(case when band = 3 then coeff end) c3, max(case when band = 4 then coeff end) c4 from coeffs group by 1) c
    using (scene_id)""")
def _(t):
    toa = px.toa_reflectance(t.bands4(), t.coeffs(), {1: "b1", 2: "b2", 3: "b3", 4: "b4"})
    return toa.select("scene_id", "row", "col", *[F.round(f"b{k}", 9).alias(f"r{k}") for k in range(1, 5)])


@query("b2_water_index", """select scene_id, "row", col, (b2 - b4) / nullif((b2 + b4)::double, 0) ndwi,
    coalesce((b2 - b4) / nullif((b2 + b4)::double, 0), 0) ndwi0 from bands4""")
def _(t):
    return t.bands4().select(
        "scene_id", "row", "col",
        sp.water_index("b2", "b4").alias("ndwi"),
        sp.water_index("b2", "b4", empty=0.0).alias("ndwi0"),
    )


@query("b3_encode_floor", """select scene_id, "row", col, least(floor((v + 1) * 128), 255)::int e from grid""")
def _(t):
    return t.grid().select("scene_id", "row", "col", sp.encode_floor("v").alias("e"))


@query("b4_with_voids", """select scene_id, "row", col, case when col % 7 > 1 then trunc(v * 127 + 128)::int end e from grid""")
def _(t):
    """Void pixels as NULL and as NaN."""
    v = F.when(F.col("col") % 7 == 0, F.lit(float("nan"))).when(F.col("col") % 7 > 1, F.col("v"))
    return t.grid().select("scene_id", "row", "col", sp.encode_trunc(v).alias("e"))


@query("b4_encode_trunc", """select scene_id, "row", col, trunc(v * 127 + 128)::int e from grid""")
def _(t):
    return t.grid().select("scene_id", "row", "col", sp.encode_trunc("v").alias("e"))


@query("b5_decode", """select scene_id, e, count(*) n, round(e / 128.0::double - 1, 9) floor_form,
    round((e - 127) / 128.0::double, 9) yen_form, round((e - 128) / 127.0::double, 9) trunc_form
    from (select scene_id, least(floor((v + 1) * 128), 255)::int e from grid) group by 1, 2""")
def _(t):
    e = t.grid().groupBy("scene_id", sp.encode_floor("v").alias("e")).agg(F.count("*").alias("n"))
    return e.select(
        "scene_id", "e", "n", F.round(sp.decode_floor("e"), 9).alias("floor_form"),
        F.round(sp.decode_yen("e"), 9).alias("yen_form"), F.round(sp.decode_trunc("e"), 9).alias("trunc_form"),
    )


@query("b6_binary_class", """select scene_id, "row", col,
    case when b2 + b4 = 0 then 0 when (b2 - b4) / (b2 + b4)::double >= 0.05::double then 1 else 0 end water from bands4""")
def _(t):
    return t.bands4().select(
        "scene_id", "row", "col", sp.at_least(sp.water_index("b2", "b4"), 0.05).alias("water")
    )


@query("b7_blank_bands", """select scene_id, "row", col, b1, b2, b3, b4, 0::int b5, 0::int b6 from bands4""")
def _(t):
    return px.add_blank_bands(t.bands4(), ["b1", "b2", "b3", "b4"], 2)


@query("b8_labelled_stack", """select b.scene_id, b."row", b.col, b1, b2, b3, b4,
    (case when b1 = 0 then 0 when v >= 0 then 1 else 0 end)::int b5 from bands4 b join grid g using (scene_id, "row", col)""")
def _(t):
    label = t.grid().select("scene_id", "row", "col", sp.at_least("v", 0.0).alias("label"))
    return px.labelled_stack(t.bands4(), label, ["b1", "b2", "b3"], "b4")


@query("b9_narrow_types", """select scene_id, "row", col, ((b1 * 7 % 256) + 256)::int % 256 u8, b2 * 9 % 65536 u16,
    (trunc((v + v) * 1000)::bigint % 256 + 256)::int % 256 wrapped from bands4 join grid using (scene_id, "row", col)""")
def _(t):
    both = t.bands4().join(t.grid(), ["scene_id", "row", "col"])
    return both.select(
        "scene_id", "row", "col", sp.narrow(F.col("b1") * 7, "uint8").alias("u8"),
        sp.narrow(F.col("b2") * 9, "uint16").alias("u16"), sp.narrow((F.col("v") + F.col("v")) * 1000, "uint8").alias("wrapped"),
    )


@query("b10_midpoint_scale", """select scene_id, "row", col, round(least(greatest(case when v <= 0.05::double
    then (v + 0.3::double) / 0.35::double * 0.5 else 0.5 + (v - 0.05::double) / 0.25::double * 0.5 end, 0.0), 1.0), 9) s from grid""")
def _(t):
    return t.grid().select("scene_id", "row", "col", F.round(sp.midpoint_scale("v", -0.3, 0.05, 0.3), 9).alias("s"))


@query("b11_masked_label", """select scene_id, "row", col, case when b1 < 4000 then 0 else b2 % 3 end::int label from bands4""")
def _(t):
    void = F.when(F.col("b1") < 4000, 0).otherwise(F.col("b1"))
    return t.bands4().select(
        "scene_id", "row", "col", sp.masked_label(F.col("b2") % 3, void).cast("int").alias("label")
    )


@query("d20_raster_stats", """select scene_id, count(*) n, count(x) valid, round(min(x), 9) lo, round(max(x), 9) hi,
    round(avg(x), 9) mean from (select scene_id, case when abs(v) > 0.3::double then null else v end x from grid) group by 1""")
def _(t):
    gaps = t.grid().withColumn("v", F.when(F.abs("v") > 0.3, F.lit(None)).otherwise(F.col("v")))
    s = px.raster_stats(gaps, "v")
    return s.select("scene_id", "n", "valid", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "mean")])


@query("d21_histogram", """select scene_id, greatest(0, least(99, floor((v - lo) / (hi - lo) * 100)))::int bin, count(*) n
    from (select scene_id, v, min(v) over (partition by scene_id) lo, max(v) over (partition by scene_id) hi from grid) group by 1, 2""")
def _(t):
    return px.equal_bins(t.grid(), "v", 100)


@query("b19_wind_speed", """select d::varchar d, transect, round(sqrt(u10 * u10 + v10 * v10), 9) speed from transect_daily""")
def _(t):
    return t.transect_daily().select(F.col("d").cast("string").alias("d"), "transect", F.round(we.wind_speed("u10", "v10"), 9).alias("speed"))


@query("b20_wind_direction", """select d::varchar d, transect, round(case when s = 0 then null else asin(-u10 / s) end, 6) + 0.0::double direction,
    round(atan2(-u10 + 0.0::double, -v10 + 0.0::double), 6) bearing from (select *, sqrt(u10 * u10 + v10 * v10) s from transect_daily)""")
def _(t):
    return t.transect_daily().select(
        F.col("d").cast("string").alias("d"), "transect", F.round(we.wind_direction("u10", "v10"), 6).alias("direction"),
        F.round(we.wind_bearing("u10", "v10"), 6).alias("bearing"),
    )


@query("b21_temperature_units", """select d::varchar d, round((hi + lo) / 2, 9) tavg, round(((hi + lo) / 2 + 459.67::double) * 5 / 9, 9) kelvin,
    round(((hi + lo) / 2 + 459.67::double) * 5 / 9 - 273.1::double, 9) celsius from
    (select o_orderdate::date d, max(o_totalprice) / 10000 hi, min(o_totalprice) / 10000 lo from orders group by 1)""")
def _(t):
    day = t.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(
        (F.max("o_totalprice") / 10000).alias("hi"), (F.min("o_totalprice") / 10000).alias("lo"))
    k = we.daily_mean_kelvin("hi", "lo")
    return day.select(
        F.col("d").cast("string").alias("d"), F.round((F.col("hi") + F.col("lo")) / 2, 9).alias("tavg"), F.round(k, 9).alias("kelvin"),
        F.round(we.kelvin_to_celsius(k), 9).alias("celsius"),
    )


@query("h7_scalar_math", """select scene_id, "row", col, floor(v * 10)::bigint f, round(sqrt(abs(v)), 9) s, round(power(v, 2), 9) p,
    round(asin(v), 9) a, case when v > 0 then 1 else 0 end w from grid""")
def _(t):
    v = F.col("v")
    return t.grid().select(
        "scene_id", "row", "col", F.floor(v * 10).alias("f"), F.round(F.sqrt(F.abs(v)), 9).alias("s"),
        F.round(F.power(v, 2), 9).alias("p"), F.round(F.asin(v), 9).alias("a"), F.when(v > 0, 1).otherwise(0).alias("w"),
    )
