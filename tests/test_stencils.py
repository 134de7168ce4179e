import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plane, to_array
from strandline.operators import blocks, stencil, tiles
from strandline.operators import labels as lb
from strandline.operators import register as rg
from strandline.operators import snake as sn

RNG = np.random.default_rng(7)


def box(a, half, fn):
    h, w = a.shape
    return np.array([[fn(a[max(0, r - half):r + half + 1, max(0, c - half):c + half + 1]) for c in range(w)] for r in range(h)])


@pytest.mark.parametrize("block", [8, 64])
def test_blur_matches_direct_sum(spark, block):
    a = RNG.random((21, 18))
    k = np.array(stencil.gaussian_kernel(9, 2.0))
    p = np.pad(a, 4, mode="reflect")
    want = np.array([[(p[r:r + 9, c:c + 9] * np.outer(k, k)).sum() for c in range(18)] for r in range(21)])
    got = to_array(stencil.gaussian_blur(plane(spark, a), "v", 9, 2.0, 21, 18, block=block), "v", a.shape)
    assert np.allclose(got, want)


def test_kernel_rules():
    assert stencil.gaussian_kernel(5) == (0.0625, 0.25, 0.375, 0.25, 0.0625)
    assert abs(sum(stencil.gaussian_kernel(17)) - 1) < 1e-12
    with pytest.raises(ValueError):
        stencil.gaussian_kernel(4)


@pytest.mark.parametrize("block", [5, 16])
def test_open_close_over_blocks(spark, block):
    a = (RNG.random((23, 19)) > 0.4).astype(int)
    opened = box(box(a, 2, np.min), 2, np.max)
    want = box(box(opened, 2, np.max), 2, np.min)
    got = to_array(stencil.open_close(plane(spark, a, "m"), "m", 5, 5, block=block), "m", a.shape, int)
    assert (got == want).all()
    again = to_array(stencil.open_close(plane(spark, got, "m"), "m", 5, 5, block=block), "m", a.shape, int)
    assert (again == got).all()


def test_stencil_chain_pays_for_one_exchange(spark):
    a = (RNG.random((8, 8)) > 0.5).astype(int)
    plan = stencil.open_close(plane(spark, a, "m"), "m", 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window") == 6


def test_fill_gaps(spark):
    a = np.full((3, 7), np.nan)
    a[1, 0], a[1, 6] = 2.0, 8.0
    df = plane(spark, a).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = to_array(stencil.fill_gaps(df, "v", reach=4), "v", a.shape)
    assert got[1, 2] == pytest.approx((2 / 2 + 8 / 4) / (1 / 2 + 1 / 4))
    assert got[1, 1] == 2.0 and np.isnan(got[0, 3])


def brute_quadrants(a, reach):
    out = a.copy()
    sites = np.argwhere(~np.isnan(a))
    for r, c in np.argwhere(np.isnan(a)):
        best = {}
        for y, x in sites:
            d2 = (y - r) ** 2 + (x - c) ** 2
            quad, rank = (x > c, y > r), (d2, abs(x - c))
            if d2 <= reach ** 2 and (quad not in best or rank < best[quad][0]):
                best[quad] = rank, a[y, x]
        if best:
            w = {q: 1 / np.sqrt(rank[0]) for q, (rank, _) in best.items()}
            out[r, c] = sum(w[q] * v for q, (_, v) in best.items()) / sum(w.values())
    return out


@pytest.mark.parametrize("reach", [2, 6, 300])
def test_fill_quadrants_of_an_l_shaped_gap(spark, reach):
    a = RNG.random((19, 23))
    a[3:16, 4:9] = np.nan
    a[11:16, 4:20] = np.nan
    a[RNG.random(a.shape) > 0.8] = np.nan
    df = plane(spark, a).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = to_array(stencil.fill_quadrants(df, "v", reach, lines=4), "v", a.shape)
    assert np.allclose(got, brute_quadrants(a, reach), equal_nan=True)


def test_fill_quadrants_without_neighbours(spark):
    empty = plane(spark, np.full((3, 4), np.nan)).withColumn("v", F.lit(None).cast("double"))
    assert stencil.fill_quadrants(empty, "v").where("v is not null").count() == 0
    assert stencil.fill_quadrants(empty.limit(0), "v").count() == 0


def test_blocks_hold_every_pixel_once_in_the_core(spark):
    a = RNG.random((17, 23))
    halo = blocks.with_halo(plane(spark, a), ["v"], 3, block=8)
    assert halo.where("core").count() == a.size
    assert halo.where("core").select("row", "col").distinct().count() == a.size


def test_eight_copies_of_a_tile(spark):
    a = np.arange(12).reshape(3, 4)
    wide = tiles.augment(plane(spark, a, "m"), 3, 4)
    seen = set()
    for name, flip, turns in tiles.COPIES:
        want = np.rot90(np.flipud(a) if flip else a, turns)
        got = to_array(wide.where(F.col("copy") == name), "m", want.shape, int)
        assert (got == want).all()
        seen.add(got.tobytes() + bytes(want.shape))
    assert len(seen) == 8


def test_tile_numbers_and_cover(spark):
    a = RNG.random((10, 7))
    t = tiles.make_tiles(plane(spark, a), F.lit(10), F.lit(7), 4, 4)
    per_pixel = t.groupBy("row", "col").count().agg(F.min("count"), F.max("count")).first()
    assert (per_pixel[0], per_pixel[1]) == (1, 4)
    assert t.select("tile").distinct().count() == 5 * 4 == t.first()["tiles"]


def test_segmentation_matches_arrays(spark):
    a = RNG.random((24, 22)) * 40
    a[:, :11] += 100
    u = ((np.arange(24)[:, None] // 5 + np.arange(22)[None, :] // 5) % 2).astype(int)

    def lines(p):
        h, w = 24, 22
        at = lambda dr, dc: p[1 + dr:1 + dr + h, 1 + dc:1 + dc + w]
        return [(at(-d[0], -d[1]), at(*d)) for d in ((0, 1), (1, 0), (1, 1), (1, -1))]

    def sup_inf(x):
        return np.max([np.minimum(np.minimum(x, p), q) for p, q in lines(np.pad(x, 1))], axis=0)

    def inf_sup(x):
        return np.min([np.maximum(np.maximum(x, p), q) for p, q in lines(np.pad(x, 1))], axis=0)

    want = u.copy()
    for k in range(3):
        c0, c1 = a[want == 0].mean(), a[want == 1].mean()
        g = np.abs(np.array(np.gradient(want.astype(float)))).sum(0)
        force = g * ((a - c1) ** 2 - (a - c0) ** 2)
        want = np.where(force < 0, 1, np.where(force > 0, 0, want))
        want = sup_inf(inf_sup(want)) if k % 2 == 0 else inf_sup(sup_inf(want))
    got = to_array(sn.segment(plane(spark, a), "v", steps=3, block=8), "u", a.shape, int)
    assert (got == want).all()


def test_shift_is_found_and_undone(spark):
    a = RNG.random((16, 16))
    base = plane(spark, a)
    moved = base.withColumn("row", F.col("row") - 1).withColumn("col", F.col("col") + 2)
    best = rg.best_shift(rg.shift_scores(base, moved, "v", reach=3, block=8))
    assert best.first().asDict() == {"scene_id": 0, "dr": -1, "dc": 2, "score": pytest.approx(1.0)}
    assert np.allclose(to_array(rg.apply_shift(moved, best), "v", a.shape), a)


def test_upsample_keeps_a_flat_plane(spark):
    got = to_array(lb.upsample(plane(spark, np.full((5, 6), 3.5)), "v", 4, block=3), "v", (20, 24))
    assert np.allclose(got, 3.5)
