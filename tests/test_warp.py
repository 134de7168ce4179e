"""Reprojection of label planes against loops over pixels."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import projection as pj
from strandline.operators import labels as lb

GRID = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
FRAME = f"scene_id int, target {GRID}, source {GRID}, nrows int, ncols int, source_rows int, source_cols int, lon0 double, geographic boolean"


def spline(d):
    a = abs(d)
    return (4 - 6 * a * a + 3 * a**3) / 6 if a < 1 else (2 - a) ** 3 / 6 if a < 2 else 0.0


def test_inverse_projection_round_trip(spark):
    places = spark.createDataFrame([(lon / 4, float(lat)) for lon in range(-672, -648) for lat in (-60, 0, 45, 66, 80)], "lon double, lat double")
    x, y = pj.utm_xy("lon", "lat")
    lon, lat = pj.utm_lonlat("x", "y")
    back = places.withColumn("x", x).withColumn("y", y).select("*", lon.alias("lon2"), lat.alias("lat2"))
    assert back.agg(F.max(F.abs(F.col("lon") - F.col("lon2"))) + F.max(F.abs(F.col("lat") - F.col("lat2")))).first()[0] < 1e-9


@pytest.mark.parametrize("smooth", [True, False])
def test_reproject_scenes_of_any_size(spark, smooth):
    """Three sizes, turned and scaled grids, voids, places outside, a scene without labels and one without pixels; tiles cut the scenes."""
    frames = [
        (0, (1.0, 0.1, 100.0, 0.05, -1.0, 50.0), (3.3, 0.2, 97.0, 0.1, -2.7, 52.0), 23, 17, 8, 6, 0.0, False),
        (1, (0.5, 0.0, 0.0, 0.0, -0.5, 0.0), (0.2, 0.0, -1.0, 0.0, -0.2, 1.0), 9, 30, 40, 70, 0.0, False),
        (2, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 4, 4, 3, 3, 0.0, False),
        (3, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 0, 4, 3, 3, 0.0, False),
    ]
    planes = {(s, r, c): float((r * 7 + c * 3 + s) % 5) for s, *_, h, w, _, _ in frames for r in range(h) for c in range(w) if s != 2 and (r + c) % 11}
    source = spark.createDataFrame([(*k, v) for k, v in planes.items()], "scene_id int, row int, col int, label double")
    got = {(r[0], r[1], r[2]): r[3] for r in lb.reproject(source, "label", spark.createDataFrame(frames, FRAME), smooth, tile=8).collect()}
    want = {}
    for s, t, m, rows, cols, h, w, *_ in frames:
        det = m[0] * m[4] - m[1] * m[3]
        for r in range(rows):
            for c in range(cols):
                dx = t[0] * (c + 0.5) + t[1] * (r + 0.5) + t[2] - m[2]
                dy = t[3] * (c + 0.5) + t[4] * (r + 0.5) + t[5] - m[5]
                v, u = (m[0] * dy - m[3] * dx) / det - 0.5, (m[4] * dx - m[1] * dy) / det - 0.5
                i, j = math.floor(v + 0.5), math.floor(u + 0.5)
                want[s, r, c] = None
                if not (0 <= i < h and 0 <= j < w):
                    continue
                if not smooth:
                    want[s, r, c] = planes.get((s, i, j))
                    continue
                taps = [(spline(v - a) * spline(u - b), planes[s, a, b]) for a in range(math.floor(v) - 1, math.floor(v) + 3) for b in range(math.floor(u) - 1, math.floor(u) + 3) if (s, a, b) in planes]
                if sum(k for k, _ in taps):
                    want[s, r, c] = sum(k * x for k, x in taps) / sum(k for k, _ in taps)
    assert got.keys() == want.keys()
    assert sum(v is None for v in want.values()) > 20 < sum(v is not None for v in want.values())
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9), k


def test_tiles_of_few_frames_are_dealt_over_the_tasks(spark):
    frames = [(s, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 64, 64, 3, 3, 0.0, False) for s in range(4)]
    source = spark.createDataFrame([(s, 0, 0, 1.0) for s in range(4)], "scene_id int, row int, col int, label double")
    out = lb.reproject(source, "label", spark.createDataFrame(frames, FRAME).coalesce(1), tile=8)
    parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 4 * 64 * 64 and max(r["count"] for r in parts) < 4 * 64 * 64 / 2
