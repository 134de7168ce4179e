import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plane, to_array
from strandline.operators import chains, components, contour

RNG = np.random.default_rng(11)


def flood(mask, eight):
    out = np.full(mask.shape, -1)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for r, c in np.argwhere(mask == 1):
        if out[r, c] < 0:
            out[r, c], todo = r * 1000 + c, [(r, c)]
            while todo:
                y, x = todo.pop()
                for dy, dx in steps:
                    p, q = y + dy, x + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] == 1 and out[p, q] < 0:
                        out[p, q] = r * 1000 + c
                        todo.append((p, q))
    return out


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("block", [6, 64])
def test_pixel_components(spark, eight, block):
    mask = (RNG.random((25, 20)) > 0.45).astype(int)
    got = components.label_pixels(plane(spark, mask, "m"), "m", eight, block)
    flat = got.withColumn("k", F.col("component.row") * 1000 + F.col("component.col"))
    assert (to_array(flat, "k", mask.shape, int) == flood(mask, eight)).all()


def test_star_and_chain_components(spark):
    # one hub holds most edges, a long chain needs several rounds, and one node stands alone
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(299, 500), (2000, 2000)]
    df = spark.createDataFrame(edges, "u long, v long")
    nodes = spark.createDataFrame([(n,) for e in edges for n in e] + [(7777,)], "node long")
    got = {r.node: r.component for r in components.components(df, nodes).collect()}
    assert {got[i] for i in [*range(300), 500]} == {0}
    assert {got[1000 + i] for i in range(61)} == {1000}
    assert got[7777] == 7777 and got[2000] == 2000


def test_no_region_at_all(spark):
    assert components.label_pixels(plane(spark, np.zeros((4, 4), int), "m"), "m", block=2).count() == 0


def test_chains_and_loops(spark):
    links = [(f"a{i:02d}", i, i + 1, 2) for i in range(13)] + [(f"b{i}", 100 + i, 100 + (i + 1) % 5, 1) for i in range(5)] + [("c0", 300, 301, 1)]
    df = spark.createDataFrame(links, "id string, start int, end int, length int")
    got = {r.id: (r.chain, r.seq, r.closed) for r in chains.order_chains(df).collect()}
    assert all(got[f"a{i:02d}"] == ("a00", 2 * i, False) for i in range(13))
    assert all(got[f"b{i}"] == ("b0", i, True) for i in range(5)) and got["c0"] == ("c0", 0, False)


@pytest.mark.parametrize("block", [4, 7, 64])
def test_polylines_are_walks(spark, block):
    mask = (RNG.random((22, 19)) > 0.5).astype(int)
    segs = contour.level_segments(plane(spark, mask, "m"), "m", block=8)
    pieces = {((s.y0, s.x0), (s.y1, s.x1)) for s in segs.collect()}
    walked = set()
    lines = {}
    for r in contour.polylines(segs, block).orderBy("part", "seq").collect():
        lines.setdefault(r.part, []).append(r)
    for rows in lines.values():
        assert [r.seq for r in rows] == list(range(len(rows)))
        pts = [(r.y, r.x) for r in rows]
        steps = list(zip(pts, pts[1:]))
        assert not walked & set(steps)
        walked |= set(steps)
        assert (pts[0] == pts[-1]) == rows[0].closed
        if not rows[0].closed:
            frame = lambda p: p[0] in (0, 42) or p[1] in (0, 36)
            assert frame(pts[0]) and frame(pts[-1])
    assert walked == pieces


def test_outer_boundary_leaves_holes_out(spark):
    m = np.zeros((9, 9), int)
    m[1:8, 1:8] = 1
    m[3:6, 3:6] = 0
    m[4, 4] = 1
    got = to_array(contour.outer_boundary(plane(spark, m, "m"), "m", 9, 9, block=4), "edge", m.shape, int)
    want = np.zeros((9, 9), int)
    want[1:8, 1:8] = 1
    want[2:7, 2:7] = 0
    assert (got == want).all()
