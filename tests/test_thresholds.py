import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plane, to_array
from strandline.functions import spectral as sp
from strandline.operators import points as pt
from strandline.operators import threshold as th
from strandline.operators import windows as wi
from strandline.plans import point_labels as pl
from strandline.plans import water

RNG = np.random.default_rng(3)


def brute_otsu(x):
    best, at = 0.0, 0
    for t in range(256):
        a, b = x[x <= t], x[x > t]
        if len(a) and len(b):
            s = len(a) * len(b) * (a.mean() - b.mean()) ** 2
            if s > best * (1 + 1e-12):
                best, at = s, t
    return at


def codes(spark, x, scene=0):
    return spark.createDataFrame([(scene, int(v)) for v in x], "scene_id int, code int")


def test_otsu_of_each_scene(spark):
    xs = [np.concatenate([RNG.normal(60, 12, 400), RNG.normal(150, 20, 300)]).clip(0, 255).astype(int), np.full(20, 9), RNG.integers(0, 256, 200)]
    df = codes(spark, xs[0], 0).union(codes(spark, xs[1], 1)).union(codes(spark, xs[2], 2))
    got = {r.scene_id: r.threshold for r in th.otsu(th.histogram(df, "code")).collect()}
    assert got == {0: brute_otsu(xs[0]), 1: 0, 2: brute_otsu(xs[2])}


@pytest.mark.parametrize("k", [2, 3, 4])
def test_exact_means_beat_every_cut(spark, k):
    x = RNG.integers(0, 40, 120)
    bins = np.unique(x)

    def gain(cuts):
        edges = [-1, *cuts, 255]
        parts = [x[(x > a) & (x <= b)] for a, b in zip(edges, edges[1:])]
        return sum(p.sum() ** 2 / len(p) for p in parts if len(p))

    best = max(gain(c) for c in itertools.combinations(bins[:-1], k - 1))
    cuts = th.exact_means(th.histogram(codes(spark, x), "code"), k).first().cuts
    assert len(cuts) == k - 1 and gain(cuts) == pytest.approx(best)


def test_fewer_values_than_classes(spark):
    df = codes(spark, [5, 5, 9])
    assert th.exact_means(th.histogram(df, "code"), 3).first().cuts == [5, 9]
    shares = th.class_shares(th.histogram(df, "code"), th.exact_means(th.histogram(df, "code"), 3)).orderBy("class").collect()
    assert [r.n for r in shares] == [2, 1, 0] and shares[0].doubt == 2


def test_nan_and_null_are_not_water(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,), (0.1,)], "x double").select(sp.at_least("x", 0.2).alias("w"))
    assert [r.w for r in df.collect()] == [0, 0, 1, 0]


def test_every_pixel_has_one_to_four_windows(spark):
    df = wi.sliding_windows(plane(spark, RNG.random((23, 31))), 5, 10, 10).groupBy("row", "col").count()
    assert {r["count"] for r in df.collect()} <= {1, 2, 3, 4} and df.count() == 23 * 31


def test_window_classification_matches_loops(spark):
    a = RNG.normal(0, 0.15, (40, 33))
    a[:, 18:] += 0.35
    a = a.clip(-0.99, 0.99)
    enc = np.minimum(np.floor((a + 1) * 128), 255).astype(int)
    df = plane(spark, a)
    cuts = th.exact_means(th.histogram(df.withColumn("code", sp.encode_floor("v")), "code"), 3).first().cuts
    cls = (enc > cuts[0]).astype(int) + (enc > cuts[1])
    counts = [(cls == i).sum() for i in range(3)]
    doubt = int(np.argmin(counts))
    corner = cls[:12, :12]
    wet = int(np.argmax([(corner == i).sum() for i in range(3)]))
    want = np.zeros(a.shape, int)
    for y in range(0, 40, 6):
        for x in range(0, 33, 6):
            w, e = cls[y:y + 12, x:x + 12], enc[y:y + 12, x:x + 12]
            if (w == doubt).any() and (w == wet).any():
                want[y:y + 12, x:x + 12] |= e >= brute_otsu(e.ravel())
            elif (w == wet).mean() > 0.9:
                want[y:y + 12, x:x + 12] |= 1
    got = to_array(water.classify(df, "v", 6, 12, 12, kernel=None), "water", a.shape, int)
    assert (got == want).all()


def test_point_labels_match_loops(spark):
    a = RNG.normal(0, 0.2, (30, 30)).clip(-0.99, 0.99)
    code = (a * 127 + 128).astype(int)
    # a third of the points share one place
    pts = [(10, 10)] * 4 + [(15, 12), (8, 20), (2, 2), (20, 20), (12, 14), (16, 16), (11, 18), (17, 9)]
    points = spark.createDataFrame([(i, 0, (c + 0.5) * 3.0, 100 - (r + 0.5) * 3.0) for i, (r, c) in enumerate(pts)], "point_id int, scene_id int, x double, y double")
    geo = spark.createDataFrame([(0, 0.0, 100.0, 3.0, 30, 30)], "scene_id int, origin_x double, origin_y double, pixel_size double, nrows int, ncols int")
    label, hits, cover, limits = np.zeros((30, 30), int), np.zeros((30, 30), int), np.zeros((30, 30), int), []
    for r, c in pts:
        r0, r1, c0, c1 = max(0, r - 5), min(29, r + 5), max(0, c - 5), min(29, c + 5)
        if r1 - r0 + 1 < 10 or c1 - c0 + 1 < 10:
            continue
        w = code[r0:r1 + 1, c0:c1 + 1]
        t = brute_otsu(w.ravel())
        limits.append(t)
        label[r0:r1 + 1, c0:c1 + 1] |= w >= t
        hits[r0:r1 + 1, c0:c1 + 1] += w >= t
        cover[r0:r1 + 1, c0:c1 + 1] += 1
    by_mean = (code >= np.mean(limits) + 10).astype(int)
    df = pl.label_codes(plane(spark, code, "code"), points, geo, half=5, block=16)
    assert (to_array(df, "cover", a.shape, int) == cover).all()
    assert (to_array(df, "label_any", a.shape, int) == label).all()
    assert (to_array(df, "label_majority", a.shape, int) == (hits > cover * 0.55)).all()
    assert (to_array(df, "label_mean", a.shape, int) == by_mean).all()
    assert (to_array(df, "label_final", a.shape, int) == np.where(cover > 0, label, by_mean)).all()


def test_histograms_and_counts_of_boxes_match_loops(spark):
    code = RNG.integers(-3, 40, (37, 29))
    rows = [(0, int(r), min(36, int(r + h)), int(c), min(28, int(c + w)), i % 5 + 1, float(RNG.integers(0, 30)))
            for i, (r, c, h, w) in enumerate(zip(*(RNG.integers(0, 28, 60) for _ in range(4)), strict=True))]
    boxes = spark.createDataFrame(rows, "scene_id int, r0 int, r1 int, c0 int, c1 int, weight int, level double")
    px = plane(spark, code, "code").withColumn("code", F.when(F.col("code") != 7, F.col("code")))
    want = {}
    cover, hits = np.zeros(code.shape, int), np.zeros(code.shape, int)
    for _, r0, r1, c0, c1, w, t in rows:
        part = code[r0:r1 + 1, c0:c1 + 1]
        for b, n in zip(*np.unique(part[part != 7], return_counts=True), strict=True):
            want[r0, r1, c0, c1, int(b)] = int(n)
        cover[r0:r1 + 1, c0:c1 + 1] += w
        hits[r0:r1 + 1, c0:c1 + 1] += w * ((part >= t) & (part != 7))
    got = {tuple(r)[1:6]: r.n for r in pt.box_histograms(px, boxes.select(*pt.BOX).distinct(), block=8).collect()}
    assert got == want
    df = pt.box_counts(px, boxes, "level", block=8)
    assert (to_array(df, "cover", code.shape, int) == cover).all()
    assert (to_array(df, "hits", code.shape, int) == hits).all()


def test_pixels_do_not_grow_with_the_windows_on_them(spark):
    """What reaches a block: its pixels once, and corners bounded by levels and places, for 400 windows as for one."""
    px = plane(spark, RNG.integers(0, 40, (32, 32)), "code")
    box = "scene_id int, r0 int, r1 int, c0 int, c1 int, weight int, level int"
    one = [(0, 0, 31, 0, 31, 1, 5)]
    many = one + [(0, i % 7, 31, i % 5, 31, 1, i % 3) for i in range(400)]
    for rows in (one, many):
        df = pt.box_counts(px, spark.createDataFrame(rows, box), "level", block=16)
        assert df.count() == 32 * 32
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FlatMapCoGroups" in plan
    assert pt.box_counts(px.limit(0), spark.createDataFrame(many, box), "level").count() == 0
    assert pt.box_counts(px, spark.createDataFrame([], box), "level").agg(F.sum("cover")).first()[0] == 0
    assert pt.box_histograms(px.limit(0), spark.createDataFrame(many, box)).count() == 0


def test_equal_boxes_are_one(spark):
    rows = [(0, 1, 5, 1, 5, True)] * 500 + [(0, 2, 6, 1, 5, True)]
    boxes = spark.createDataFrame(rows, "scene_id int, r0 int, r1 int, c0 int, c1 int, whole boolean")
    got = {(r.r0, r.weight) for r in pt.distinct_boxes(boxes).collect()}
    assert got == {(1, 500), (2, 1)}


def test_small_side_is_broadcast_by_size_only(spark, tables):
    df = water.threshold_mask(tables.grid(), "v")
    small = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small and "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = water.threshold_mask(tables.grid(), "v")
        assert "SortMergeJoin" in beyond._jdf.queryExecution().executedPlan().toString()
        assert beyond.exceptAll(df).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_class_of_orders_by_centre(spark):
    df = spark.createDataFrame([(3, [4, 8]), (6, [4, 8]), (9, [4, 8])], "code int, cuts array<int>")
    assert [r[0] for r in df.select(th.class_of(F.col("code"), "cuts")).collect()] == [0, 1, 2]
