"""Voids and flat scenes: no value stays no value, one scene never ends the job."""

from pyspark.sql import functions as F

from strandline.functions import spectral as sp
from strandline.operators.pixels import coefficient_lookup, equal_bins, toa_reflectance
from strandline.operators.register import apply_shift, shift_scores
from strandline.operators.spatial import segments


def test_encoders_keep_voids(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (1.0,)], "v double")
    assert [r[0] for r in df.select(sp.encode_floor("v")).collect()] == [None, None, 0, 255]
    assert [r[0] for r in df.select(sp.midpoint_scale("v", -1.0, 0.0, 1.0)).collect()] == [None, None, 0.0, 1.0]


def test_flat_scene(spark):
    df = spark.range(2).crossJoin(spark.range(36).withColumnRenamed("id", "p")).select(
        F.col("id").alias("scene_id"), F.expr("cast(p div 6 as int)").alias("row"), (F.col("p") % 6).cast("int").alias("col"), F.when(F.col("id") == 0, 1.0).otherwise((F.col("p") * 7 % 11).cast("double")).alias("v"))
    scores = shift_scores(df, df, "v", reach=1).collect()
    assert all(r["score"] is None for r in scores if r["scene_id"] == 0)
    assert abs(next(r["score"] for r in scores if (r["scene_id"], r["dr"], r["dc"]) == (1, 0, 0)) - 1) < 1e-9
    assert [(r["bin"], r["n"]) for r in equal_bins(df, "v", 10).where("scene_id = 0").collect()] == [(0, 36)]


def test_missing_coefficient_drops_no_pixel(spark):
    pixels = spark.createDataFrame([("a", 0, 0, 10.0), ("b", 0, 0, 20.0)], "scene_id string, row int, col int, v double")
    coeffs = spark.createDataFrame([("a", 1, 0.5)], "scene_id string, band int, coeff double")
    assert {r["scene_id"]: r["v"] for r in toa_reflectance(pixels, coeffs, {1: "v"}).collect()} == {"a": 5.0, "b": None}
    long = pixels.withColumn("band", F.lit(1))
    assert {r["scene_id"]: r["coeff"] for r in coefficient_lookup(long, coeffs).collect()} == {"a": 0.5, "b": None}


def test_scene_without_shift_stays(spark):
    pixels = spark.createDataFrame([("a", 3, 3, 1.0), ("b", 4, 4, 2.0)], "scene_id string, row int, col int, v double")
    shift = spark.createDataFrame([("a", 1, -1)], "scene_id string, dr int, dc int")
    assert {(r["scene_id"], r["row"], r["col"]) for r in apply_shift(pixels, shift).collect()} == {("a", 2, 4), ("b", 4, 4)}


def test_segments_with_gaps_at_any_place(spark):
    places = [i for i in range(40) if i not in {5, 10, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 35}]
    line = spark.createDataFrame([("l", i, float(i), float(i * i)) for i in places], "id string, seq long, x double, y double")
    want = [(a, float(a), float(a * a), float(b), float(b * b)) for a, b in zip(places, places[1:])]
    for chunk in (1, 5, 7, 4096):
        found = segments(line, ["id"], chunk)
        assert sorted((r["seg"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in found.collect()) == want
