import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import projection as pr
from strandline.operators import spatial as sl
from strandline.plans import shoreline as sh

RNG = np.random.default_rng(5)


def lines(spark, a):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id int, x0 double, y0 double, x1 double, y1 double")


def test_crossings_equal_all_pairs(spark):
    # a third of the segments sit in one cell
    a = np.concatenate([RNG.random((40, 4)) * 100, RNG.random((20, 4)) * 2 + 50])
    b = np.concatenate([RNG.random((40, 4)) * 100, RNG.random((20, 4)) * 2 + 50])
    want = set()
    for i, (x0, y0, x1, y1) in enumerate(a):
        for j, (p0, q0, p1, q1) in enumerate(b):
            d = (x1 - x0) * (q1 - q0) - (y1 - y0) * (p1 - p0)
            t = ((p0 - x0) * (q1 - q0) - (q0 - y0) * (p1 - p0)) / d
            u = ((p0 - x0) * (y1 - y0) - (q0 - y0) * (x1 - x0)) / d
            if 0 <= t <= 1 and 0 <= u <= 1:
                want.add((i, j))
    got = sl.segment_crossings(lines(spark, a), lines(spark, b), 10.0).select("l_id", "r_id").collect()
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want


def test_long_line_is_cut_into_chunks(spark):
    n = 3 * sl.CHUNK + 5
    v = spark.range(n).select(F.lit(1).alias("f"), F.col("id").alias("seq"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    s = sl.segments(v, ["f"])
    assert s.count() == n - 1 and s.where("x1 - x0 <> 1").count() == 0


def test_shared_vertex_counts_once(spark):
    transect = spark.createDataFrame([(1, 5.0, -5.0, 5.0, 5.0)], "transect_id int, x0 double, y0 double, x1 double, y1 double")
    coast = lines(spark, [[0, 0, 5, 0], [5, 0, 10, 0]])
    assert sl.crossing_points(coast, transect, 4.0).count() == 1
    assert sh.coastline_error(transect, coast, coast, 4.0).where("region is null").first().rmse == 0.0


def test_no_pair_gives_no_error_value(spark):
    transect = spark.createDataFrame([(1, 5.0, -5.0, 5.0, 5.0)], "transect_id int, x0 double, y0 double, x1 double, y1 double")
    twice = lines(spark, [[0, 0, 10, 0], [0, 1, 10, 1]])
    row = sh.coastline_error(transect, twice, twice, 4.0).where("region is null").first()
    assert row is None or (row.rmse is None and row.pairs == 0)


def test_points_in_ring_with_hole(spark):
    square = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)]
    rows = [("p", 0, i, float(x), float(y)) for i, (x, y) in enumerate(square(0, 10))] + [("p", 1, i, float(x), float(y)) for i, (x, y) in enumerate(square(3, 6))]
    rings = spark.createDataFrame(rows, "poly_id string, ring int, seq int, x double, y double")
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(RNG.random((200, 2)) * 12 - 1)], "id int, x double, y double")
    got = {r.id for r in sl.in_polygons(pts, "id", rings, strip=0.7).collect()}
    want = {r.id for r in pts.collect() if 0 < r.x < 10 and 0 < r.y < 10 and not (3 < r.x < 6 and 3 < r.y < 6)}
    assert got == want


def test_clip_keeps_the_inside_length(spark):
    rows = [("p", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])]
    rings = spark.createDataFrame(rows, "poly_id string, seq int, x double, y double")
    segs = lines(spark, [[-5, 5, 15, 5], [2, 2, 4, 4], [20, 20, 30, 30]])
    got = sl.with_length(sl.clip_segments(segs, "id", rings, 4.0, 1.0)).groupBy("id").agg(F.sum("length").alias("l"))
    assert {r.id: round(r.l, 9) for r in got.collect()} == {0: 10.0, 1: round(8**0.5, 9)}


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(-162.7172, 66.0756), (-152.0, 64.0), (-170.2, 71.9)], "lon double, lat double")
    x, y = pr.stereo_xy("lon", "lat")
    back = df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", *pr.stereo_lonlat("x", "y")).collect()
    assert all(abs(r[0] - r[2]) < 1e-6 and abs(r[1] - r[3]) < 1e-6 for r in back)
    assert pr.stereo_point(-162.7172, 66.0756) == pytest.approx(tuple(df.select(x, y).first()))


def test_utm_known_points(spark):
    # On the central meridian the easting is 500 km; the northing is the scaled meridian arc.
    df = spark.createDataFrame([(-165.0, 0.0), (-165.0, 66.0), (-164.0, 66.0), (-166.0, 66.0)], "lon double, lat double")
    e, n = pr.utm_xy("lon", "lat")
    r = df.select(e.alias("e"), n.alias("n")).collect()
    assert r[0].e == pytest.approx(500000) and r[0].n == pytest.approx(0, abs=1e-6)
    phi = np.linspace(0, np.radians(66.0), 200001)
    e2 = pr.UTM_ECC**2
    arc = np.trapezoid(pr.WGS84_A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert r[1].n == pytest.approx(arc * pr.UTM_K0, abs=1e-3)
    assert r[2].e - 500000 == pytest.approx(500000 - r[3].e)


def test_midpoint_of_bent_line(spark):
    segs = spark.createDataFrame([("a", 0, 0.0, 0.0, 2.0, 0.0), ("a", 1, 2.0, 0.0, 2.0, 6.0)], "k string, seg int, x0 double, y0 double, x1 double, y1 double")
    m = sl.midpoints(segs, ["k"]).first()
    assert (m.x, m.y) == (2.0, 2.0)


def test_regions_have_no_gap(spark):
    df = spark.createDataFrame([(17336,), (17337,), (17370,), (17394,), (17443,)], "t int").select(sh.region_of("t").alias("r"))
    assert [r.r for r in df.collect()] == [n for _, n in sh.REGIONS][::-1]


def test_walk_grows_with_the_length(spark):
    """A diagonal of 1,000 km and cells of 1 km: rows in proportion to the length, and no crossing is lost."""
    long = lines(spark, [[0, 0, 700000, 710000], [700000, 3, 5, 600000], [5000, 0, 5000, 9e5]])
    cells = sl._segment_cells(long, 1000.0)
    assert cells.count() < 3 * 3 * 1000 and cells.distinct().count() == cells.count()
    short = lines(spark, [[x * 1000.0, 500000.0, x * 1000.0 + 1000, 500000.0] for x in range(700)])
    assert {(r.l_id) for r in sl.segment_crossings(long, short, 1000.0).collect()} == {0, 1, 2}
    assert sl.segment_crossings(long, long.where("id = 1"), 1000.0).count() == 2


def test_shared_pieces_of_collinear_segments(spark):
    a = lines(spark, [[0, 0, 30, 15], [0, 0, 0, 10], [5, 5, 5, 5]])
    b = lines(spark, [[10, 5, 50, 25], [40, 20, 30, 15], [20, 10, 2, 1], [0, 4, 0, -7], [1, 4, 1, 8], [0, 0, 3, 3]])
    got = {(r.l_id, r.r_id, round(r.t0, 9), round(r.t1, 9)) for r in sl.segment_overlaps(a, b, 4.0).collect()}
    assert got == {(0, 0, round(1 / 3, 9), 1.0), (0, 2, round(2 / 30, 9), round(20 / 30, 9)), (1, 3, 0.0, 0.4)}
    assert sl.segment_overlaps(a, b, 4.0).count() == 3
    assert sl.shared_lines(b.union(b), a, 4.0).count() == 3


def test_polygon_cover_equals_ray_casting_on_the_lattice(spark):
    """Stars with vertices, edges and points on cell corners; holes; overlapping polygons."""
    rng = np.random.default_rng(3)
    rows, edges = [], {}
    for p in range(6):
        for ring in range(2):
            n = int(rng.integers(3, 9))
            turn = np.sort(rng.random(n)) * 2 * np.pi
            far = rng.integers(1, 9, n) / (1 + ring)
            xy = [(round(float(5 * p + f * np.cos(a)) * 2) / 2, round(float(f * np.sin(a)) * 2) / 2) for a, f in zip(turn, far)]
            xy.append(xy[0])
            rows += [(p, ring, i, x, y) for i, (x, y) in enumerate(xy)]
            edges.setdefault(p, []).extend(zip(xy[:-1], xy[1:]))
    rings = spark.createDataFrame(rows, "poly_id int, ring int, seq int, x double, y double")
    places = [(i, float(x) / 4, float(y) / 4) for i, (x, y) in enumerate((x, y) for x in range(-40, 150) for y in range(-40, 41, 3))]
    pts = spark.createDataFrame(places, "id int, x double, y double")
    want = set()
    for i, x, y in places:
        for p, es in edges.items():
            hits = sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in es)
            if hits % 2:
                want.add((i, p))
    for cell in (0.5, 0.3, 7.0):
        got = [tuple(r) for r in sl.in_polygons(pts, "id", rings, strip=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want, cell


def test_polygons_side_by_side_stay_linear(spark):
    """A point meets the cells of the polygons around it, not all polygons of its strip."""
    n = 200
    rows = [(p, i, p * 10.0 + x, y) for p in range(n) for i, (x, y) in enumerate([(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)])]
    rings = spark.createDataFrame(rows, "poly_id int, seq int, x double, y double")
    border, inner = sl.polygon_cover(rings, 1.0)
    assert border.groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] <= 4
    assert border.count() + inner.count() < 150 * n
    assert inner.select("poly_id", F.explode(F.expr("sequence(shiftleft(_cx, _level), shiftleft(_cx + 1, _level) - 1)")).alias("x"), "_cy").groupBy("x", "_cy").count().where("count > 1").isEmpty()
    pts = spark.createDataFrame([(i, i + 0.5, 4.5) for i in range(10 * n)], "id int, x double, y double")
    assert sl.in_polygons(pts, "id", rings, strip=1.0).count() == 8 * n


def test_crowded_line_meets_in_one_place_only(spark):
    """Many long segments on few lines, upright, level and slanted: every shared piece once, and no candidates beside them."""
    rng = np.random.default_rng(8)
    ways = [(0.0, 1.0), (1.0, 0.0), (2.0, -1.0), (-3.0, 4.0)]
    make = lambda n: [(*(float(v) for v in (dx * a + x, dy * a, dx * b + x, dy * b)),) for (dx, dy), x, a, b in (
        (ways[rng.integers(4)], float(rng.integers(3) * 64), int(rng.integers(-200, 200)), int(rng.integers(-200, 200))) for _ in range(n))]
    left, right = make(120), make(150)
    a, b = lines(spark, [list(v) for v in left]), lines(spark, [list(v) for v in right])
    want = set()
    for i, (x0, y0, x1, y1) in enumerate(left):
        ax, ay = x1 - x0, y1 - y0
        for j, (u0, v0, u1, v1) in enumerate(right):
            if ax * (v1 - v0) != ay * (u1 - u0) or ax * (v0 - y0) != ay * (u0 - x0) or (ax, ay) == (0, 0):
                continue
            t = sorted(((u - x0) * ax + (v - y0) * ay) / (ax * ax + ay * ay) for u, v in ((u0, v0), (u1, v1)))
            if max(t[0], 0.0) < min(t[1], 1.0):
                want.add((i, j, round(max(t[0], 0.0), 9), round(min(t[1], 1.0), 9)))
    found = [(r.l_id, r.r_id, round(r.t0, 9), round(r.t1, 9)) for r in sl.segment_overlaps(a, b, 64.0).collect()]
    assert len(want) > 500 and set(found) == want and len(found) == len(want)
    met = sl._later_starts(a, b, 64.0, "l_").count() + sl._later_starts(a, b, 64.0, "r_").count()
    assert met < 2 * len(want)


def test_lines_along_the_cells_lie_in_one_bin(spark):
    """Upright, level and diagonal segments, also on the borders of cells, are copied for crowded lines only, not for bins."""
    for way in ([64.0, 3.0, 64.0, 40.0], [3.0, 64.0, 40.0, 64.0], [3.0, 3.0, 40.0, 40.0], [10.0, 40.0, 40.0, 10.0]):
        segs = lines(spark, [way])
        side = sl._overlap_sides(segs, "r_", 64.0, False)
        assert side.count() == sl.COPIES * sl._segment_cells(segs, 64.0).count()


def test_shared_pieces_of_a_crowded_line_take_little_room(spark, tmp_path):
    """More segments than a chunk holds on one line: each pair once, and the pieces of a line segment lie together."""
    a = lines(spark, [[0.0, 0.0, 0.0, 40.0]] * (4 * sl.PACK + 900))
    b = lines(spark, [[0.0, float(i % 20) - 7, 0.0, float(i % 20) + 9] for i in range(60)] + [[0.0, 50.0, 0.0, 60.0]])
    found = sl.segment_overlaps(a, b, 64.0).select("l_id", "r_id", "y0", "y1")
    found.write.parquet(f"{tmp_path}/pieces")
    got = spark.read.parquet(f"{tmp_path}/pieces")
    n = 60 * (4 * sl.PACK + 900)
    assert got.count() == n and got.select("l_id", "r_id").distinct().count() == n
    assert got.where("y0 <> greatest(r_id % 20 - 7, 0) or y1 <> r_id % 20 + 9").count() == 0
    turns = got.coalesce(1).select("r_id", F.monotonically_increasing_id().alias("n")).withColumn("before", F.lag("r_id").over(Window.orderBy("n")))
    assert turns.where("r_id <> before").count() < n / 50
